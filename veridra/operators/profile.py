"""One row for each candidate: scalars as tracked fields, arrays of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ARRAYS, SCALARS, part_of
from .confidence import overall_of, overall_parts


def tracked(field: str) -> Column:
    """raw_value, canonical_value, value, confidence, provenance of a merged row."""
    part = part_of(field)
    return F.struct(
        F.col(f"raw_value.{part}").alias("raw_value"),
        F.col(f"canonical_value.{part}").alias("canonical_value"),
        F.col(f"value.{part}").alias("value"),
        F.col("confidence"),
        F.col("provenance"),
    )


def assemble(scored: DataFrame) -> DataFrame:
    """Scalars null and arrays empty where a candidate has no such evidence, clusters in order; overall confidence.

    One grouping on candidate_id, by which the votes are already dealt out.
    """
    columns = [F.first(F.when(F.col("field") == f, tracked(f)), ignorenulls=True).alias(f) for f in SCALARS]
    for f in ARRAYS:
        rows = F.sort_array(F.collect_list(F.when(F.col("field") == f, F.struct("cluster", tracked(f).alias("kept")))))
        columns.append(F.transform(rows, lambda r: r["kept"]).alias(f))
    profiles = scored.groupBy("candidate_id").agg(*columns, *overall_parts())
    overall = overall_of(F.col("overall_scores"), F.col("overall_sources"))
    return profiles.select("candidate_id", *SCALARS, *ARRAYS, overall.alias("overall_confidence"))
