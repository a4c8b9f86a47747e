"""Clusters of equivalent evidence within a candidate's field.

Scalar fields are one cluster. E-mail addresses and phones cluster by equal folded
text; skills, experience and education by fuzzy score against the first member, in
order of evidence. Clusters are numbered by their first member.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fuzzy
from ..functions.text import fold_key
from ..schema import SCALARS

FUZZY_SCORE = 85.0
FUZZY_FIELDS = ("skills", "experience", "education")


def order(evidence: DataFrame) -> DataFrame:
    """``evidence`` with ``seq``, a candidate's total order of evidence."""
    place = Window.partitionBy("candidate_id").orderBy("profile_ord", "source", "item_ord", "field")
    return evidence.withColumn("seq", F.row_number().over(place).cast("long"))


def cluster(evidence: DataFrame) -> DataFrame:
    """``evidence`` (with ``seq`` and ``value``) with the number ``cluster``.

    Only distinct keys meet in the fuzzy comparison: equal values join the same
    cluster whatever stands between them.
    """
    value = F.col("value")
    none = F.lit("none")  # an absent part compares as this word
    parts = (
        F.when(F.col("field") == "skills", F.array(fold_key(value["text"])))
        .when(F.col("field") == "experience", F.array(*(F.coalesce(fold_key(value["experience"][n]), none) for n in ("company", "title"))))
        .when(F.col("field") == "education", F.array(F.coalesce(fold_key(value["education"]["institution"]), none)))
        .when(F.col("field").isin(*SCALARS), F.array().cast("array<string>"))
        .otherwise(F.array(fold_key(value["text"])))
    )
    keyed = evidence.withColumn("match_key", parts)
    by_key = Window.partitionBy("candidate_id", "field", "match_key")
    keyed = keyed.withColumn("key_seq", F.min("seq").over(by_key))

    fuzzy_rows = keyed.filter(F.col("field").isin(*FUZZY_FIELDS)).groupBy("candidate_id", "field", "match_key").agg(F.min("seq").alias("key_seq"))
    ordered = fuzzy_rows.groupBy("candidate_id", "field").agg(F.sort_array(F.collect_list(F.struct("key_seq", "match_key"))).alias("keys"))
    headed = ordered.withColumn("heads", fuzzy.leaders(F.col("keys.match_key"), FUZZY_SCORE))
    headed = headed.select(
        "candidate_id",
        F.explode(F.arrays_zip(F.col("keys.key_seq").alias("key_seq"), F.transform("heads", lambda h: F.get("keys.key_seq", h)).alias("head_seq"))).alias("of"),
    ).select("candidate_id", "of.key_seq", "of.head_seq")
    joined = keyed.join(headed, ["candidate_id", "key_seq"], "left")
    return joined.withColumn("cluster", F.coalesce("head_seq", "key_seq")).drop("match_key", "key_seq", "head_seq")
