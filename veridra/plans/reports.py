"""Reports on a run, and its stages written out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import SCALARS, display

UPLOADS = ("csv", "ats", "github", "resumes")
STAGES = ("extracted", "normalized", "merged", "scored", "profiles", "projected", "validated")


def extraction(evidence: DataFrame) -> DataFrame:
    """candidate_id, profile_ord, source and a map of each field's raw values."""
    shown = (
        F.when(F.col("field") == "location", F.concat_ws(", ", *(F.coalesce(f"raw.location.{c}", F.lit("None")) for c in ("city", "region", "country"))))
        .when(F.col("field") == "links", F.concat(F.lit("github: "), F.coalesce("raw.links.github", F.lit("None"))))
        .when(F.col("field") == "experience", F.concat_ws(" - ", "raw.experience.company", "raw.experience.title"))
        .when(F.col("field") == "education", F.col("raw.education.institution"))
        .otherwise(display(F.col("raw")))
    )
    rows = evidence.withColumn("shown", shown)
    by_field = rows.groupBy("candidate_id", "profile_ord", "source", "field").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("item_ord", "shown"))), lambda r: r["shown"]).alias("values")
    )
    entries = F.sort_array(F.collect_list(F.struct("field", "values")))
    return by_field.groupBy("candidate_id", "profile_ord", "source").agg(F.map_from_entries(entries).alias("report"))


def sources_found(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count("*").alias("discovered_sources_count"))


def summary(profiles: DataFrame) -> DataFrame:
    """candidate_id and the number of values of each field."""
    sizes = [F.when(F.col(f).isNotNull(), 1).otherwise(0).alias(f) for f in SCALARS]
    return profiles.select("candidate_id", *sizes, *(F.size(f).alias(f) for f in ("emails", "phones", "skills", "experience", "education")))


def run_report(profiles: DataFrame, validated: DataFrame) -> DataFrame:
    """One row for each candidate: what its profile holds and how it was judged."""
    judged = validated.select("candidate_id", "is_valid", F.size("errors").alias("errors_count"), F.size("warnings").alias("warnings_count"))
    sums = profiles.select("candidate_id", "overall_confidence", "missing_fields", "rules_failed")
    return summary(profiles).join(sums, "candidate_id").join(judged, "candidate_id")


def write_stages(stages: dict[str, DataFrame], folder: str, kind: str = "parquet") -> None:
    """Each named stage as a table below ``folder``, replacing an earlier run's."""
    for name, frame in stages.items():
        frame.write.mode("overwrite").format(kind).save(f"{folder}/{name}")
