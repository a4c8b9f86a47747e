"""Weighted vote: one winning value for each cluster of evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import display

PROVENANCE = (
    "struct<field: string, source: string, method: string, confidence: double, normalization_applied: array<string>, "
    "confidence_evolution: array<string>, agreement_count: int, supporting_sources: array<string>, "
    "rejected_sources: array<struct<value: string, source: string, method: string, confidence: double>>, "
    "timestamp: string, merge_decision: string>"
)


def with_value(evidence: DataFrame) -> DataFrame:
    """``evidence`` with ``value``: the canonical value, or else the raw one."""
    return evidence.withColumn("value", F.coalesce("canonical", "raw"))


def vote(clustered: DataFrame, timestamp: str | None = None) -> DataFrame:
    """One row for each (candidate_id, field, cluster): winner and provenance.

    Values score the sum of their confidences, added in order of evidence; the
    highest score wins, then the value that sorts last. Both groupings need a
    candidate's rows together, so they share one shuffle on candidate_id.
    """
    rows = clustered.withColumn("value_key", display(F.col("value"))).repartition("candidate_id")
    backing = F.sort_array(
        F.collect_list(F.struct("seq", "raw", "canonical", "value", "source", "method", "base_conf", "norms"))
    )
    by_value = rows.groupBy("candidate_id", "field", "cluster", "value_key").agg(backing.alias("backing"))
    score = F.aggregate("backing", F.lit(0.0), lambda total, b: total + b["base_conf"])
    by_value = by_value.withColumn("score", score)
    ranked = F.sort_array(F.collect_list(F.struct("score", "value_key", "backing")), asc=False)
    voted = by_value.groupBy("candidate_id", "field", "cluster").agg(ranked.alias("ranked"))

    best = F.element_at("ranked", 1)
    # by confidence, then by order of evidence
    winners = F.array_sort(
        best["backing"],
        lambda a, b: F.when(a["base_conf"] > b["base_conf"], -1)
        .when(a["base_conf"] < b["base_conf"], 1)
        .when(a["seq"] < b["seq"], -1)
        .when(a["seq"] > b["seq"], 1)
        .otherwise(0),
    )
    voted = voted.select("candidate_id", "field", "cluster", "ranked", best["score"].alias("score"), best["value_key"].alias("value_key"), winners.alias("winners"))
    losers = F.flatten(
        F.transform(
            F.slice("ranked", F.lit(2), F.size("ranked")),
            lambda r: F.transform(
                r["backing"],
                lambda b: F.struct(
                    r["value_key"].alias("value"), b["source"].alias("source"), b["method"].alias("method"), b["base_conf"].alias("confidence")
                ),
            ),
        )
    )
    primary = F.element_at("winners", 1)
    sources = F.transform("winners", lambda w: w["source"])
    # fixed value: the wording of the decision
    decision = F.concat(
        F.format_string("Selected value '%s' with aggregate confidence score %.2f supported by %d source(s) (", F.col("value_key"), F.col("score"), F.size("winners")),
        F.array_join(sources, ", "),
        F.format_string("). Rejected %d conflicting evidence source(s).", F.size(losers)),
    )
    provenance = F.struct(
        F.col("field").alias("field"),
        primary["source"].alias("source"),
        primary["method"].alias("method"),
        primary["base_conf"].alias("confidence"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("winners", lambda w: w["norms"])))).alias("normalization_applied"),
        F.array().cast("array<string>").alias("confidence_evolution"),
        F.size("winners").alias("agreement_count"),
        sources.alias("supporting_sources"),
        losers.alias("rejected_sources"),
        F.lit(timestamp).cast("string").alias("timestamp"),
        decision.alias("merge_decision"),
    ).cast(PROVENANCE)
    return voted.select(
        "candidate_id",
        "field",
        "cluster",
        "value_key",
        "score",
        primary["raw"].alias("raw_value"),
        primary["canonical"].alias("canonical_value"),
        primary["value"].alias("value"),
        primary["base_conf"].alias("confidence"),
        provenance.alias("provenance"),
    )

