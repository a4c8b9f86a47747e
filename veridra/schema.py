"""The evidence table: one row for each value that a source states about a candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.text import quoted

LOCATION = "struct<city: string, region: string, country: string>"
LINKS = "struct<linkedin: string, github: string, portfolio: string, other: array<string>>"
EXPERIENCE = "struct<company: string, title: string, start: string, end: string, summary: string>"
EDUCATION = "struct<institution: string, degree: string, field: string, end_year: string>"

#: a value of any field: exactly one part is set
VALUE = (
    f"struct<text: string, number: double, location: {LOCATION}, links: {LINKS}, "
    f"experience: {EXPERIENCE}, education: {EDUCATION}>"
)
PARTS = {"location": LOCATION, "links": LINKS, "experience": EXPERIENCE, "education": EDUCATION}

SCALARS = ("full_name", "location", "links", "headline", "years_experience")
ARRAYS = ("emails", "phones", "skills", "experience", "education")
FIELDS = SCALARS + ARRAYS

#: rank of a profile kind: the order in which evidence counts
PROFILE_ORDER = {"resume": 0, "github": 1, "csv": 2, "ats": 3, "discovered_github": 4}

#: reliability of each kind of source
CONFIDENCE = {"csv": 0.9, "ats": 0.95, "github": 0.85, "github_repos": 0.95, "resume": 0.8}

EVIDENCE = (
    "candidate_id string, profile_ord int, item_ord int, field string, "
    f"raw {VALUE}, canonical {VALUE}, source string, method string, base_conf double, norms array<string>"
)


def part_of(field: str) -> str:
    if field == "years_experience":
        return "number"
    return field if field in PARTS else "text"


def value_of(field: str, content: Column) -> Column:
    """``content`` as a ``VALUE`` of a field."""
    part = part_of(field)
    kinds = {"text": "string", "number": "double"} | PARTS
    return F.struct(*(((content if p == part else F.lit(None)).cast(kind)).alias(p) for p, kind in kinds.items()))


def display(value: Column) -> Column:
    """The text by which values are grouped, ranked and reported."""

    def shown(part: str, names: tuple[str, ...]) -> Column:
        parts = [F.concat(F.lit(f"{n}="), quoted(value[part][n])) for n in names]
        return F.when(value[part].isNotNull(), F.concat_ws(" ", *parts))

    others = F.concat(F.lit("["), F.array_join(F.transform(value["links"]["other"], quoted), ", "), F.lit("]"))
    links = F.concat(
        F.concat_ws(" ", *(F.concat(F.lit(f"{n}="), quoted(value["links"][n])) for n in ("linkedin", "github", "portfolio"))),
        F.lit(" other="),
        F.coalesce(others, F.lit("[]")),
    )
    return F.coalesce(
        value["text"],
        value["number"].cast("string"),
        shown("location", ("city", "region", "country")),
        F.when(value["links"].isNotNull(), links),
        shown("experience", ("company", "title", "start", "end", "summary")),
        shown("education", ("institution", "degree", "field", "end_year")),
    )


def rows_of(profiles: DataFrame, items: Column, *, source: Column, method: Column, confidence: Column, profile_ord: Column) -> DataFrame:
    """Evidence from an array of ``item(...)`` structs on each row of ``profiles``."""
    rows = profiles.select(
        F.col("candidate_id").cast("string").alias("candidate_id"),
        profile_ord.cast("int").alias("profile_ord"),
        F.posexplode(F.filter(items, lambda i: i.isNotNull())).alias("item_ord", "item"),
        source.alias("source"),
        method.alias("method"),
        confidence.cast("double").alias("base_conf"),
    )
    return rows.select(
        "candidate_id",
        "profile_ord",
        "item_ord",
        F.col("item.field").alias("field"),
        F.col("item.raw").alias("raw"),
        F.lit(None).cast(VALUE).alias("canonical"),
        "source",
        F.coalesce("item.method", "method").alias("method"),
        F.coalesce("item.base_conf", "base_conf").alias("base_conf"),
        F.array().cast("array<string>").alias("norms"),
    )


def item(field: str, content: Column, given: Column | None = None, method: str | None = None, confidence: float | None = None) -> Column:
    """One stated value, null where ``given`` is not true (by default: ``content`` is null)."""
    made = F.struct(
        F.lit(field).alias("field"),
        value_of(field, content).alias("raw"),
        F.lit(method).cast("string").alias("method"),
        F.lit(confidence).cast("double").alias("base_conf"),
    )
    return F.when(content.isNotNull() if given is None else given, made)


def items(field: str, contents: Column, method: str | None = None, confidence: float | None = None) -> Column:
    """Stated values from an array."""
    return F.coalesce(F.transform(contents, lambda c: item(field, c, method=method, confidence=confidence)), F.array())
