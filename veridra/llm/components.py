"""Connected components of links too many for one machine."""

from __future__ import annotations

from contextlib import ExitStack

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, scratch


def local_components(size: int, left: np.ndarray, right: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable from each of ``size`` indices; ``labels`` holds earlier links."""
    labels = np.arange(size) if labels is None else labels
    while left.size:
        low = np.minimum(labels[left], labels[right])
        np.minimum.at(labels, labels[left], low)
        np.minimum.at(labels, labels[right], low)
        while not np.array_equal(jumped := labels[labels], labels):
            labels = jumped
        apart = labels[left] != labels[right]
        left, right = left[apart], right[apart]
    return labels


def _star(edges: DataFrame, stack: ExitStack) -> DataFrame:
    """Link ``v`` of each edge u, v to the smallest neighbour of ``u`` (or u itself).

    The smallest neighbours are aggregated before they are shuffled and written, so
    that the join reads both sides afresh and can split the edges of a hot node.
    """
    least = stack.enter_context(scratch(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))))
    return edges.join(least, "u")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root for every node of ``edges`` (u, v long); root is the smallest node reachable.

    Alternates large-star and small-star rounds until the edges stop changing:
    logarithmically many rounds, each of two aggregations and two joins.
    """
    seen = None
    current = checkpointed(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    for _ in range(max_rounds):
        with ExitStack() as stack:
            both = current.select("u", "v").unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
            large = _star(both, stack).filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
            large = stack.enter_context(scratch(large.filter("u <> v").distinct()))
            small = _star(large, stack)
            parts = small.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(
                small.select("u", F.col("low").alias("v"))
            )
            current = checkpointed(parts.filter("u <> v").distinct())
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("the components did not settle")
    roots = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
