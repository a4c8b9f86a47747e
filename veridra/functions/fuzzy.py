"""Weighted fuzzy ratio of two strings, 0 to 100.

The score takes the best of several normalised similarities by longest common
subsequence: of the strings, of their sorted and shared tokens, and, where lengths
differ by half or more, of the shorter string with the windows of the longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values of the score: length ratios and the weights that they select
PARTIAL_FROM, FAR_FROM = 1.5, 8.0
TOKEN_WEIGHT, NEAR_WEIGHT, FAR_WEIGHT = 0.95, 0.9, 0.6


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    if not a or not b:
        return 0
    spots: dict[str, int] = {}
    for i, c in enumerate(a):
        spots[c] = spots.get(c, 0) | 1 << i
    row = whole = (1 << len(a)) - 1
    for c in b:
        met = row & spots.get(c, 0)
        row = (row + met) | (row - met)
        row &= whole
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 200.0 * common_subsequence(a, b) / total if total else 100.0


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string with a window of the longer, clipped ones included."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0
    size, best = len(short), 0.0
    for end in range(1, len(long) + size):
        window = long[max(0, end - size) : min(end, len(long))]
        if window and (window[-1] in short or window[0] in short):
            best = max(best, ratio(short, window))
    if len(a) == len(b) and a != b:  # either may be the one that slides
        for end in range(1, 2 * size):
            window = short[max(0, end - size) : min(end, size)]
            best = max(best, ratio(long, window)) if window else best
    return best


def _sorted_tokens(text: str) -> str:
    return " ".join(sorted(text.split()))


def _token_set(a: str, b: str, compare) -> float:
    left, right = set(a.split()), set(b.split())
    shared = " ".join(sorted(left & right))
    only_left, only_right = " ".join(sorted(left - right)), " ".join(sorted(right - left))
    if shared and not (only_left and only_right):
        return 100.0
    if compare is partial_ratio:
        return 100.0 if shared else partial_ratio(only_left, only_right)
    with_left, with_right = f"{shared} {only_left}".strip(), f"{shared} {only_right}".strip()
    best = ratio(with_left, with_right)
    if shared:
        best = max(best, ratio(shared, with_left), ratio(shared, with_right))
    return best


def weighted_ratio(a: str | None, b: str | None) -> float:
    if not a or not b:
        return 0.0
    lengths = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if lengths < PARTIAL_FROM:
        tokens = max(ratio(_sorted_tokens(a), _sorted_tokens(b)), _token_set(a, b, ratio))
        return max(best, TOKEN_WEIGHT * tokens)
    weight = NEAR_WEIGHT if lengths <= FAR_FROM else FAR_WEIGHT
    best = max(best, weight * partial_ratio(a, b))
    tokens = max(partial_ratio(_sorted_tokens(a), _sorted_tokens(b)), _token_set(a, b, partial_ratio))
    return max(best, TOKEN_WEIGHT * weight * tokens)


#: texts whose best choice a worker remembers
CACHE_TEXTS = 100_000


def best_of(text: Column, choices: list[str]) -> Column:
    """``struct<choice, score>``: the first best choice for a text; each worker scores a spelling once."""

    @F.pandas_udf("struct<choice string, score double>")
    def best_choice(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[str | None, float]] = {}
        for texts in batches:
            if len(known) > CACHE_TEXTS:
                known.clear()
            for value in set(texts.dropna().unique()).difference(known):
                scores = [weighted_ratio(value, c) for c in choices]
                top = max(scores, default=0.0)
                known[value] = (choices[scores.index(top)], top) if top else (None, 0.0)
            yield pd.DataFrame([known.get(t, (None, None)) for t in texts], columns=["choice", "score"])

    return best_choice(text)


def leaders(keys: Column, threshold: float) -> Column:
    """``array<int>``: for each of an ordered array's key lists, the index of its cluster's first.

    A key list joins the first cluster whose first member it matches: in every part
    the keys are equal or reach ``threshold``.
    """

    @F.pandas_udf("array<int>")
    def leader_of(groups: pd.Series) -> pd.Series:
        score_of: dict[tuple[str, str], bool] = {}

        def alike(a: str, b: str) -> bool:
            if a == b:
                return True
            if (a, b) not in score_of:
                if len(score_of) > 100_000:
                    score_of.clear()
                score_of[a, b] = weighted_ratio(a, b) >= threshold
            return score_of[a, b]

        def cluster(group) -> list[int]:
            heads: list[int] = []
            found = []
            for i, parts in enumerate(group):
                head = next((h for h in heads if all(map(alike, parts, group[h]))), None)
                if head is None:
                    heads.append(i)
                    head = i
                found.append(head)
            return found

        return pd.Series([cluster(g) if g is not None else None for g in groups])

    return leader_of(keys)
