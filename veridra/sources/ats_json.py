"""Applicant-tracking JSON, one object per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_given, strip
from ..schema import CONFIDENCE, EDUCATION, EXPERIENCE, LOCATION, PROFILE_ORDER, item, items, rows_of
from .recruiter_csv import split_skills


def read(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``ats_path`` and the parsed object of each file; unreadable files go."""
    paths = [p.strip() for p in paths.split(",")] if isinstance(paths, str) else list(paths)
    files = spark.read.option("wholetext", True).text(paths).select(F.col("_metadata.file_path").alias("ats_path"), "value")
    return parse(files)


def parse(files: DataFrame) -> DataFrame:
    """The same from columns ``ats_path`` and ``value``."""
    return files.select("ats_path", F.try_parse_json("value").alias("ats")).filter("ats IS NOT NULL")


def _get(path: str, kind: str = "string", of: str = "ats") -> Column:
    return F.try_variant_get(F.col(of), f"$.{path}", kind)


def stated_id() -> Column:
    """The object's own id: ``candidate_id``, or ``id`` where that is absent or empty."""
    first = _get("candidate_id")
    return F.when(is_given(first), first).otherwise(_get("id"))


def for_candidates(objects: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """Objects with their ``candidate_id``.

    An object without an id belongs to the one candidate of ``candidates``, if there
    is exactly one; otherwise to none.
    """
    named = objects.withColumn("candidate_id", F.when(is_given(stated_id()), stated_id()))
    if candidates is None:
        return named.filter("candidate_id IS NOT NULL")
    only = candidates.agg(F.count_distinct("candidate_id").alias("n"), F.min("candidate_id").alias("only_id"))
    given = named.crossJoin(F.broadcast(only))  # one row
    given = given.withColumn("candidate_id", F.coalesce("candidate_id", F.when(F.col("n") == 1, F.col("only_id"))))
    return given.drop("n", "only_id").join(candidates.select("candidate_id").distinct(), "candidate_id", "left_semi")


def evidence(objects: DataFrame) -> DataFrame:
    def text(field: str, value: Column) -> Column:
        return item(field, strip(value), is_given(value))

    absent = F.expr("variant_get(ats, '$.full_name') IS NULL")
    name = F.when(absent, _get("name")).otherwise(_get("full_name"))
    is_object = F.coalesce(F.startswith(F.schema_of_variant(F.expr("try_variant_get(ats, '$.location', 'variant')")), F.lit("OBJECT")), F.lit(False))
    where = F.when(
        is_object, F.struct(*(_get(f"location.{c}").alias(c) for c in ("city", "region", "country")))
    ).otherwise(F.struct(strip(_get("location")).alias("city"), F.lit(None).cast("string").alias("region"), F.lit(None).cast("string").alias("country")))
    has_place = is_object | is_given(_get("location"))
    years = _get("experience_years").try_cast("double")
    numeric = F.startswith(F.schema_of_variant(F.expr("variant_get(ats, '$.experience_years')")), F.lit("STRING"))
    given_years = years.isNotNull() & (F.coalesce(numeric, F.lit(False)) | (years != 0))  # the number 0 counts as absent
    skills = F.coalesce(
        F.transform(_get("skills", "array<string>"), strip),
        F.when(is_given(_get("skills")), split_skills(_get("skills"))),
    )

    def structs(path: str, names: tuple[str, ...], kind: str, needed: tuple[str, ...]) -> Column:
        found = _get(path, f"array<struct<{', '.join(f'{n}: string' for n in names)}>>")
        kept = F.filter(found, lambda s: F.lit(False) | _any([is_given(s[n]) for n in needed]))
        blank = F.transform(
            kept, lambda s: F.struct(*((F.coalesce(s[n], F.lit("")) if n in needed else s[n]).alias(n) for n in names)).cast(kind)
        )
        return blank

    work = structs("experience", ("company", "title", "start", "end", "summary"), EXPERIENCE, ("company", "title"))
    study = structs("education", ("institution", "degree", "field", "end_year"), EDUCATION, ("institution",))
    singles = F.array(
        text("full_name", name),
        text("emails", _get("email")),
        text("phones", _get("phone")),
        item("location", where.cast(LOCATION), has_place),
        text("headline", _get("headline")),
        item("years_experience", years, given_years),
    )
    found = F.concat(singles, items("skills", skills), items("experience", work), items("education", study))
    return rows_of(
        objects,
        found,
        source=F.concat(F.lit("ATS:"), "ats_path"),
        method=F.lit("ATS_JSON_Parser"),
        confidence=F.lit(CONFIDENCE["ats"]),
        profile_ord=F.lit(PROFILE_ORDER["ats"]),
    )


def _any(conditions: list[Column]) -> Column:
    result = conditions[0]
    for c in conditions[1:]:
        result = result | c
    return result
