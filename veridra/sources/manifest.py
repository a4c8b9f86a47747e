"""Which sources a run reads, in order, and its settings."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("CSV", "GitHub", "PDF Resume", "ATS")
UPLOADS = (".pdf", ".docx", ".csv")


def discover(
    spark: SparkSession, csv_path: str | None = None, github_url: str | None = None, resume_path: str | None = None, ats_path: str | None = None
) -> DataFrame:
    """ord, kind, location of every source; lists are separated by commas."""
    given = list(zip(KINDS, (csv_path, github_url, resume_path, ats_path)))
    rows = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(given) if v], "kind_ord int, kind string, value string")
    parts = rows.select("kind_ord", "kind", F.posexplode(F.split("value", ",")).alias("part", "location"))
    parts = parts.withColumn("location", F.trim("location")).filter("location <> ''")
    return parts.select(F.struct("kind_ord", "part").alias("ord"), "kind", "location")


def load_settings(path: str) -> dict:
    """Output settings from a JSON file; ``ValueError`` where it cannot be read."""
    try:
        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
    except (OSError, ValueError) as problem:
        raise ValueError(f"settings cannot be read: {problem}") from problem
    return {"fields": [], "include_confidence": True, "include_provenance": True, "on_missing": "null"} | settings


def is_upload(name: str) -> bool:
    return name.lower().endswith(UPLOADS)
