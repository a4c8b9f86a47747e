"""Confidence of merged fields and of whole candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.contact import is_email

#: fixed values of the score
AGREEMENT_STEP, AGREEMENT_MOST = 0.05, 0.20
CONFLICT_STEP, CONFLICT_MOST = -0.05, -0.15
EMAIL_BONUS, EMAIL_PENALTY = 0.05, -0.20
PHONE_BONUS, PHONE_PENALTY = 0.10, -0.30
FUZZY_WEIGHT, SOURCE_BONUS = 0.10, 0.05


def agreement_bonus(count: Column) -> Column:
    return F.when(count > 1, F.least(F.lit(AGREEMENT_MOST), AGREEMENT_STEP * (count - 1))).otherwise(0.0)


def conflict_penalty(rejected: Column) -> Column:
    return F.when(rejected > 0, F.greatest(F.lit(CONFLICT_MOST), CONFLICT_STEP * rejected)).otherwise(0.0)


def bounded(score: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 2)


def _fuzzy_percents(norms: Column) -> Column:
    found = F.filter(norms, lambda n: n.rlike(r"Fuzzy_Match.*_\d+(?:\.\d+)?(?:pct)?$"))
    return F.transform(found, lambda n: F.regexp_extract(n, r"_(\d+(?:\.\d+)?)(?:pct)?$", 1).cast("double"))


def score(merged: DataFrame) -> DataFrame:
    """``merged`` with final confidence, also in its provenance, and how it came about."""
    origin = F.col("provenance")
    base, agreeing, rejected = origin["confidence"], origin["agreement_count"], F.size(origin["rejected_sources"])
    norms = origin["normalization_applied"]
    bonus, penalty = agreement_bonus(agreeing), conflict_penalty(rejected)
    valid_email, e164 = is_email(F.col("value_key")), F.array_contains(norms, "E164_Format")
    emails, phones = F.col("field") == "emails", F.col("field") == "phones"
    validity = (
        F.when(emails, F.when(valid_email, EMAIL_BONUS).otherwise(EMAIL_PENALTY))
        .when(phones, F.when(e164, PHONE_BONUS).otherwise(PHONE_PENALTY))
        .otherwise(0.0)
    )
    partly = F.filter(_fuzzy_percents(norms), lambda p: p < 100)

    def fuzzy(percent: Column) -> Column:
        return -((100 - percent) / 100.0) * FUZZY_WEIGHT

    adjust = F.when(F.size(partly) > 0, fuzzy(F.element_at(partly, -1))).otherwise(0.0)  # the last one counts
    final = bounded(base + bonus + penalty + validity + adjust)
    # fixed values: the wording of the steps
    steps = F.concat(
        F.array_compact(
            F.array(
                F.format_string("Base extraction confidence: %.2f (%s)", base, origin["source"]),
                F.when(agreeing > 1, F.format_string("Agreement Bonus: +%.2f (%d matching sources)", bonus, agreeing)),
                F.when(rejected > 0, F.format_string("Conflict Penalty: %.2f (%d conflicting sources)", penalty, rejected)),
                F.when(emails & valid_email, F.lit("Validation Bonus: +0.05 (Valid email structure)"))
                .when(emails, F.lit("Validation Penalty: -0.20 (Invalid email structure)"))
                .when(phones & e164, F.lit("Validation Bonus: +0.10 (Valid E164 phone format)"))
                .when(phones, F.lit("Validation Penalty: -0.30 (Invalid or un-parseable phone format)")),
            )
        ),
        F.transform(
            partly,
            lambda p: F.format_string("Fuzzy Normalization Adjustment: %.2f (%s%% match similarity)", fuzzy(p), p.cast("string")),
        ),
    )
    return merged.withColumn("confidence", final).withColumn(
        "provenance", origin.withField("confidence", F.col("confidence")).withField("confidence_evolution", steps)
    )


def overall_parts() -> list[Column]:
    """Aggregates of a candidate's merged rows from which ``overall_of`` scores it."""
    sources = F.array_union(F.array(F.col("provenance.source")), F.transform("provenance.rejected_sources", lambda r: r["source"]))
    return [
        F.sort_array(F.collect_list(F.struct("field", "cluster", "confidence"))).alias("overall_scores"),
        F.flatten(F.collect_list(sources)).alias("overall_sources"),
    ]


def overall_of(scores: Column, sources: Column) -> Column:
    """Mean of the fields, added in a fixed order, and more with several sources."""
    mean = F.aggregate(scores, F.lit(0.0), lambda total, s: total + s["confidence"]) / F.size(scores)
    return bounded(mean + F.when(F.size(F.array_distinct(sources)) > 1, SOURCE_BONUS).otherwise(0.0))


def overall(scored: DataFrame) -> DataFrame:
    """candidate_id, overall_confidence."""
    parts = scored.groupBy("candidate_id").agg(*overall_parts())
    return parts.select("candidate_id", overall_of(F.col("overall_scores"), F.col("overall_sources")).alias("overall_confidence"))
