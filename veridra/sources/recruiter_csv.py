"""Recruiter CSV exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_given, strip
from ..schema import CONFIDENCE, EXPERIENCE, LINKS, LOCATION, PROFILE_ORDER, item, items, rows_of

COLUMNS = (
    "candidate_id full_name email phone location headline github resume_file company job_title skills experience_years"
).split()


def read(spark: SparkSession, paths: str | list[str], line_breaks: bool = True) -> DataFrame:
    """All rows as strings, with their file and a number that rises in file order.

    Columns are matched by header; absent ones are null. Quoted line breaks are
    part of a value, so a file is one task; where values hold none, ``line_breaks`` =
    False lets a large file be split.
    """
    paths = paths.split(",") if isinstance(paths, str) else list(paths)
    rows = None
    for path in paths:
        one = spark.read.option("header", True).option("multiLine", line_breaks).option("escape", '"').option("inferSchema", False).csv(path.strip())
        one = one.select(*((F.col(f"`{c}`") if c in one.columns else F.lit(None)).cast("string").alias(c) for c in COLUMNS))
        one = one.withColumn("csv_path", F.lit(path.strip())).withColumn("file_ord", F.lit(0 if rows is None else rows[1]))
        rows = (one, 1) if rows is None else (rows[0].unionByName(one), rows[1] + 1)
    return rows[0].withColumn("csv_ord", F.struct("file_ord", F.monotonically_increasing_id().alias("line"))).drop("file_ord")


def first_rows(rows: DataFrame) -> DataFrame:
    """The first row of each candidate; null ids go. Aggregated before it is shuffled."""
    first = rows.filter("candidate_id IS NOT NULL").groupBy("candidate_id").agg(F.min_by(F.struct("*"), "csv_ord").alias("row"))
    return first.select("row.*")


def split_location(text: Column) -> Column:
    """``a, b, c`` is city, region, country; ``a, c`` city and country; else a city."""
    parts = F.transform(F.split(text, ","), strip)
    n = F.size(parts)
    return F.struct(
        parts[0].alias("city"),
        F.when(n >= 3, F.get(parts, F.lit(1))).alias("region"),
        F.when(n >= 3, F.get(parts, F.lit(2))).when(n == 2, F.get(parts, F.lit(1))).alias("country"),
    ).cast(LOCATION)


def split_skills(text: Column) -> Column:
    return F.transform(F.split(text, r"\|"), strip)


def evidence(rows: DataFrame) -> DataFrame:
    def given(name: str) -> Column:
        return is_given(F.col(name))

    def text(field: str, name: str) -> Column:
        return item(field, strip(F.col(name)), given(name))

    links = F.struct(
        F.lit(None).alias("linkedin"), strip(F.col("github")).alias("github"), F.lit(None).alias("portfolio"), F.array().alias("other")
    ).cast(LINKS)
    work = F.struct(
        strip(F.coalesce("company", F.lit(""))).alias("company"),
        strip(F.coalesce("job_title", F.lit(""))).alias("title"),
        *(F.lit(None).alias(c) for c in ("start", "end", "summary")),
    ).cast(EXPERIENCE)
    singles = F.array(
        text("full_name", "full_name"),
        text("emails", "email"),
        text("phones", "phone"),
        item("location", split_location(F.col("location")), given("location")),
        item("links", links, given("github")),
        text("headline", "headline"),
        item("years_experience", strip(F.col("experience_years")).try_cast("double")),
        item("experience", work, given("company") | given("job_title")),
    )
    skills = items("skills", F.when(given("skills"), split_skills(F.col("skills"))))
    return rows_of(
        first_rows(rows),
        F.concat(singles, skills),
        source=F.concat(F.lit("CSV:"), "csv_path"),
        method=F.lit("CSV_DictReader"),
        confidence=F.lit(CONFIDENCE["csv"]),
        profile_ord=F.lit(PROFILE_ORDER["csv"]),
    )


def scan_upload(rows: DataFrame) -> DataFrame:
    """candidate_id and name of each row, as an upload page lists them."""
    return rows.select("candidate_id", F.when(is_given(F.col("full_name")), F.col("full_name")).otherwise("Unknown Name").alias("name"))
