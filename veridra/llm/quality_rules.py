"""Quality rules: counted text statistics and robust multivariate outliers.

Base statistics are counted per text. Texts that pass the base rule get a vector of
transformed statistics: logarithm of the mean word length, and the arcsine roots of
the shares of symbols, repeated words, repeated lines, capitals and punctuation.
Repeated words count within ``REPEAT_WORDS`` consecutive words of the text without
its repeated lines: chance repeats do not add up over a long text, and a repeated
line counts once. Beside the vector stands its sampling variance: a share of n things
that come ``clump`` at a time has variance clump / 4n after the arcsine root, whatever
its size.

Every language and source, and every language, gets a minimum-covariance-determinant
estimate of its vectors (``Estimate``). Of n rows the h = (n + d + 1) / 2 are sought
whose covariance has the least determinant, the mean sampling variance added to its
diagonal, which alone keeps it from being singular: half of all texts may repeat
nothing. The search is that of deterministic MCD: from robust starts, concentration steps
until the determinant settles, and the least of them. (Random starts can find a lesser
determinant where bad rows are a tight cluster, by taking it in.) A factor makes the
covariance of the half consistent for normal rows, and a last step re-estimates from
all rows within the ``REWEIGHT`` quantile of chi-square.

Groups of up to ``SAMPLE_ROWS`` rows are searched whole. Larger ones are searched
first in a sample of that size, and the result is the start of concentration steps
over all their rows: bins of distances and sums of moments, counted where the rows
are, so that a group of any size needs no task that holds it.

A group's estimate is joined with that of its language: it weighs as many rows as the
group has beyond the d + 1 that determine a covariance, the language's ``PRIOR_ROWS``.
Small groups lean on their language and large ones on themselves. A text is rejected when its squared Mahalanobis distance exceeds
``CUTOFF``, a quantile of chi-square, under the covariance between texts (the
estimate less its mean sampling variance) and the text's own sampling variance.

Defined results: a null or empty text has no words and fails the base rule; null
languages and sources are groups of their own; a language with fewer than
``MIN_ROWS`` texts beyond the base rule has no estimate, and its texts are kept with a
null distance and the ``verdict`` ``unjudged``; equal rows are judged alike; an empty
table gives no rows. ``verdict`` is ``base`` or ``outlier`` for rejected texts, else
``inlier``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import WORD_SEPARATORS, checkpointed, release_memory

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
DIMENSIONS = 6
#: squared distance beyond which a text is an outlier: the 0.999 quantile of chi-square with 6 degrees of freedom
CUTOFF = 22.4577
REWEIGHT, PRIOR_ROWS, MIN_ROWS = 0.975, 30, 2 * DIMENSIONS
SAMPLE_ROWS, MAX_STEPS = 2000, 50
#: change of the logarithm of the determinant below which steps over all rows end
SETTLED = 1e-3
MAX_BROADCAST_GROUPS = 10_000
#: words within which repeats are sought for the vector, and words that come together in the shortest repeat
REPEAT_WORDS, REPEAT_CLUMP = 500, 6
#: bins for each doubling of a distance
DISTANCE_BINS = 32

_UPPER = bytes(range(65, 91))
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def chi_square(x: float, freedom: int) -> float:
    """The distribution function, for an even number of degrees of freedom."""
    return 1.0 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(freedom // 2))


def chi_square_quantile(share: float, freedom: int = DIMENSIONS) -> float:
    low, high = 0.0, 200.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, freedom) < share else (low, middle)
    return high


def consistency(share: float) -> float:
    """What the covariance of the nearest ``share`` of normal rows is short of."""
    return share / chi_square(chi_square_quantile(share), DIMENSIONS + 2) if share < 1 else 1.0


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words covered by windows whose words occur as a window twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    places: dict[bytes, int] = {}
    ids = np.fromiter((places.setdefault(w, len(places)) for w in words), np.int64, len(words))
    key = ids[:n]
    for k in range(1, window):
        key = key * len(places) + ids[k : k + n]
        if k < window - 1 and len(places) > 1 << 20:  # the next product could overflow
            key = np.unique(key, return_inverse=True)[1]
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    covered = np.zeros(len(words), bool)
    for k in range(window):
        covered[k : k + n] |= twice
    return int(covered.sum())


def block_repeats(words: list[bytes]) -> int:
    """Repeated words within blocks of ``REPEAT_WORDS``."""
    return sum(repeated_words(words[i : i + REPEAT_WORDS]) for i in range(0, len(words), REPEAT_WORDS))


def text_statistics(text: str | None) -> tuple:
    """Base statistics, the vector, and its sampling variances (zeros without words)."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if not n:
        return 0, 0, sum(map(text.count, SYMBOLS)), 0, 0, *[0.0] * (2 * DIMENSIONS)
    chars = len(text) - sum(map(text.count, WORD_SEPARATORS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(WORD_SEPARATORS)]
    distinct = list(dict.fromkeys(lines))
    repeated_lines = len(lines) - len(distinct)
    repeats = repeated_words(words)
    own, own_repeats = words, repeats
    if repeats and (repeated_lines or n > REPEAT_WORDS):
        own = "\n".join(distinct).encode().split() if repeated_lines else words
        own_repeats = block_repeats(own)
    upper = len(raw) - len(raw.translate(None, _UPPER))
    punctuation = len(raw) - len(raw.translate(None, _PUNCTUATION))
    rates = np.array([symbols / chars, own_repeats / len(own), repeated_lines / len(lines), upper / chars, punctuation / chars])
    spread = np.arcsin(np.sqrt(np.minimum(rates, 1.0)))
    sizes = np.fromiter(map(len, words), np.float64, n)
    per_char = 0.25 / chars
    noise = (sizes.var() / sizes.mean() ** 2 / n, per_char, 0.25 * REPEAT_CLUMP / len(own), 0.25 / len(lines), per_char, per_char)
    return n, chars, symbols, repeated_lines, repeats, float(np.log(chars / n)), *spread.tolist(), *map(float, noise)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
VECTOR = tuple(f"x{i}" for i in range(DIMENSIONS))
NOISE = tuple(f"v{i}" for i in range(DIMENSIONS))


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """Columns ``keep``, ``COUNTS``, ``VECTOR``, ``NOISE`` and base_failed of every row."""
    fields = [docs.schema[c] for c in keep]
    schema = T.StructType(
        [T.StructField(f"k{i}", f.dataType) for i, f in enumerate(fields)]
        + [T.StructField(c, T.LongType()) for c in COUNTS]
        + [T.StructField(c, T.DoubleType()) for c in VECTOR + NOISE]
    )
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*(text_statistics(t.as_py()) for t in batch.column(len(keep)))))
            if columns:
                types = [pa.int64()] * len(COUNTS) + [pa.float64()] * (2 * DIMENSIONS)
                made = [pa.array(c, t) for c, t in zip(columns, types)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], names)
        release_memory()

    rows = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(text).alias("text")).mapInArrow(run, schema)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), *COUNTS, *VECTOR, *NOISE, failed.alias("base_failed"))


@dataclass
class Estimate:
    """Centre and covariance of a group, and the logarithm of the determinant that was sought."""

    centre: np.ndarray
    spread: np.ndarray
    logdet: float


def half_of(n: int) -> int:
    return min(n, (n + DIMENSIONS + 1) // 2)


def squared_distances(rows: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """``spread``: one matrix, or one for each row."""
    apart = rows - centre
    return np.einsum("ij,ij->i", apart, np.linalg.solve(spread, apart[..., None])[..., 0])


def moments(rows: np.ndarray, noise: np.ndarray, factor: float) -> Estimate:
    centre = rows.mean(0)
    apart = rows - centre
    spread = factor * (apart.T @ apart) / len(rows)
    return Estimate(centre, spread, float(np.linalg.slogdet(spread + np.diag(noise))[1]))


def concentrate(rows: np.ndarray, noise: np.ndarray, at: Estimate, steps: int) -> Estimate:
    """Estimates from the half that is nearest to the one before, until the determinant falls no more."""
    h = half_of(len(rows))
    factor = consistency(h / len(rows))
    for _ in range(steps):
        near = squared_distances(rows, at.centre, at.spread + np.diag(noise))
        # equal rows are taken or left by their place: the halves differ, the moments do not
        after = moments(rows[np.argsort(near, kind="stable")[:h]], noise, factor)
        settled = at.logdet - after.logdet < 1e-9
        at = after
        if settled:
            break
    return at


def starts_of(rows: np.ndarray, noise: np.ndarray) -> list[Estimate]:
    """Medians with scales, and with the correlations of spatial signs: starts that withstand nearly half of bad rows."""
    low, centre, high = np.quantile(rows, [0.25, 0.5, 0.75], axis=0)
    scale = np.sqrt(((high - low) / 1.349) ** 2 + noise)
    apart = (rows - centre) / scale
    length = np.linalg.norm(apart, axis=1, keepdims=True)
    signs = np.divide(apart, length, out=np.zeros_like(apart), where=length > 0)
    found = []
    for shape in (np.eye(DIMENSIONS), signs.T @ signs):
        size = np.sqrt(np.diag(shape))
        size[size <= 0] = 1.0
        shape = shape / np.outer(size, size)
        np.fill_diagonal(shape, 1.0)
        found.append(Estimate(centre, shape * np.outer(scale, scale), math.inf))
    return found


def search(rows: np.ndarray, noise: np.ndarray) -> Estimate:
    """The least determinant that the starts lead to."""
    rows = rows[np.lexsort(rows.T)]  # whatever order the rows come in
    return min((concentrate(rows, noise, s, MAX_STEPS) for s in starts_of(rows, noise)), key=lambda e: e.logdet)


def reweighted(rows: np.ndarray, noise: np.ndarray, at: Estimate) -> Estimate:
    near = squared_distances(rows, at.centre, at.spread + np.diag(noise))
    return moments(rows[near <= max(chi_square_quantile(REWEIGHT), near.min())], noise, consistency(REWEIGHT))


ESTIMATE = "centre array<double>, spread array<double>, precision array<double>, logdet double"


def _estimate_columns(noise: list, found: list[Estimate]) -> list[pa.Array]:
    precisions = [np.linalg.inv(e.spread + np.diag(v)).ravel() for e, v in zip(found, noise)]
    lists = pa.list_(pa.float64())
    return [
        pa.array([e.centre for e in found], lists),
        pa.array([e.spread.ravel() for e in found], lists),
        pa.array(precisions, lists),
        pa.array([e.logdet for e in found], pa.float64()),
    ]


def _squared_distance() -> Column:
    """Of columns ``VECTOR`` from ``centre`` under ``precision`` (row-major)."""
    apart = [F.col(x) - F.col("centre")[i] for i, x in enumerate(VECTOR)]
    total = F.lit(0.0)
    for i in range(DIMENSIONS):
        for j in range(i, DIMENSIONS):
            total += F.lit(1.0 if i == j else 2.0) * F.col("precision")[i * DIMENSIONS + j] * apart[i] * apart[j]
    return F.greatest(total, F.lit(0.0))


def _moments(rows: DataFrame, noise: DataFrame, share: Column) -> DataFrame:
    """grp and ``ESTIMATE`` from the sums of rows of weight ``w``; ``share`` of a group are taken."""
    pairs = [(i, j) for i in range(DIMENSIONS) for j in range(i, DIMENSIONS)]
    firsts = F.array(*(F.sum(F.col("w") * F.col(x)) for x in VECTOR))
    seconds = F.array(*(F.sum(F.col("w") * F.col(VECTOR[i]) * F.col(VECTOR[j])) for i, j in pairs))
    sums = rows.groupBy("grp").agg(F.sum("w").alias("weight"), firsts.alias("firsts"), seconds.alias("seconds"))
    sums = sums.join(noise, "grp").select("grp", "weight", "firsts", "seconds", "noise", share.alias("share"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, noises = [], batch.column(4).to_pylist()
            for weight, first, second, noise, part in zip(*(c.to_pylist() for c in batch.columns[1:])):
                centre, moment = np.array(first) / weight, np.zeros((DIMENSIONS, DIMENSIONS))
                for (i, j), value in zip(pairs, second):
                    moment[i, j] = moment[j, i] = value / weight
                spread = consistency(part) * (moment - np.outer(centre, centre))
                found.append(Estimate(centre, spread, float(np.linalg.slogdet(spread + np.diag(noise))[1])))
            if found:
                yield pa.RecordBatch.from_arrays([batch.column(0), *_estimate_columns(noises, found)], ["grp", "centre", "spread", "precision", "logdet"])

    return sums.mapInArrow(run, f"grp string, {ESTIMATE}")


def _step(rows: DataFrame, groups: DataFrame, at: DataFrame, small: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One concentration step over all ``rows``; the bin in which the half ends counts by the part that it needs."""
    placed = rows.join(small(at.select("grp", "centre", "precision")), "grp")
    placed = placed.select("grp", *VECTOR, F.floor(F.log2(_squared_distance() + F.lit(1e-6)) * DISTANCE_BINS).cast("int").alias("bin"))
    run = Window.partitionBy("grp").orderBy("bin")
    counts = placed.groupBy("grp", "bin").agg(F.count("*").alias("held")).join(small(groups.select("grp", "n")), "grp")
    half = F.floor((F.col("n") + DIMENSIONS + 1) / 2)
    ends = counts.withColumn("upto", F.sum("held").over(run)).filter((F.col("upto") >= half) & (F.col("upto") - F.col("held") < half))
    ends = ends.select("grp", F.col("bin").alias("end"), ((half - F.col("upto") + F.col("held")) / F.col("held")).alias("part"))
    taken = placed.join(small(ends), "grp").filter("bin <= end").withColumn("w", F.when(F.col("bin") < F.col("end"), 1.0).otherwise(F.col("part")))
    return _moments(taken, groups.select("grp", "noise", "n"), F.floor((F.col("n") + DIMENSIONS + 1) / 2) / F.col("n"))


def robust_estimate(rows: DataFrame, groups: DataFrame, small: Callable[[DataFrame], DataFrame], sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """grp and ``ESTIMATE`` of the groups in ``rows`` (grp, id, ``VECTOR``).

    ``groups`` holds their sizes n and mean sampling variances ``noise``; ``small``
    hints at the join with tables of groups.
    """
    chance = F.pmod(F.xxhash64("id", *VECTOR), F.col("n"))
    drawn = rows.join(small(groups), "grp").filter(chance < sample_rows)
    # of rows that are equal throughout all or none are drawn: the bound holds all the same
    order = Window.partitionBy("grp").orderBy(F.xxhash64("id", *VECTOR))
    drawn = drawn.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= sample_rows)

    def local(key: tuple, table: pa.Table) -> pa.Table:
        held = np.stack([table[x].to_numpy() for x in VECTOR], 1)
        noise = np.array(table["noise"][0].as_py())
        found = search(held, noise)
        if table["n"][0].as_py() <= sample_rows:  # the whole group
            found = reweighted(held, noise, found)
        return pa.table([pa.array([key[0].as_py()]), *_estimate_columns([noise], [found])], ["grp", "centre", "spread", "precision", "logdet"])

    first = checkpointed(drawn.select("grp", "n", "noise", *VECTOR).groupBy("grp").applyInArrow(local, f"grp string, {ESTIMATE}"))
    large = groups.filter(F.col("n") > sample_rows)
    if large.isEmpty():
        return first
    rows = rows.join(small(large.select("grp")), "grp", "left_semi")
    at = checkpointed(first.join(small(large.select("grp")), "grp", "left_semi"))
    for _ in range(MAX_STEPS):
        before, at = at, checkpointed(_step(rows, large, at, small))
        change = at.join(before.select("grp", F.col("logdet").alias("old")), "grp").agg(F.max(F.abs(F.col("logdet") - F.col("old"))))
        if change.first()[0] <= SETTLED:
            break
    near = rows.join(small(at.select("grp", "centre", "precision")), "grp").filter(_squared_distance() <= chi_square_quantile(REWEIGHT))
    done = _moments(near.withColumn("w", F.lit(1.0)), groups.select("grp", "noise"), F.lit(REWEIGHT))
    return first.join(small(large.select("grp")), "grp", "left_anti").unionByName(checkpointed(done))


def _between(spread: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """The covariance between texts: without the mean sampling variance, and no variance below zero."""
    values, axes = np.linalg.eigh(spread - np.diag(noise))
    return (axes * np.maximum(values, 0.0)) @ axes.T


def pooled(own: tuple, wider: tuple, prior: float = PRIOR_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Centre and covariance between texts of ``own`` (n, centre, spread, noise) with ``prior`` rows of ``wider`` (centre, spread, noise)."""
    n, own_centre, own_spread, own_noise = own
    n = max(0, n - DIMENSIONS - 1)
    centre = (n * own_centre + prior * wider[0]) / (n + prior)

    def about(other: np.ndarray, spread: np.ndarray) -> np.ndarray:
        return spread + np.outer(other - centre, other - centre)

    spread = (n * about(own_centre, own_spread) + prior * about(wider[0], wider[1])) / (n + prior)
    return centre, _between(spread, (n * own_noise + prior * wider[2]) / (n + prior))


def _joined_estimates(groups: DataFrame, estimates: DataFrame, small: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """g_lang, g_source, centre and covariance ``between`` texts of every language and source that has an estimate."""
    whole = checkpointed(groups.join(estimates.select("grp", "centre", "spread"), "grp"))
    wider = whole.filter("level = 1").select(F.col("g_lang").alias("w_lang"), *(F.col(c).alias(f"w_{c}") for c in ("centre", "spread", "noise")))
    both = whole.filter("level = 0").join(small(wider), F.col("g_lang").eqNullSafe(F.col("w_lang")))
    both = both.select("g_lang", "g_source", "n", "centre", "spread", "noise", "w_centre", "w_spread", "w_noise")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for n, *parts in zip(*(c.to_pylist() for c in batch.columns[2:])):
                centre, spread, noise, w_centre, w_spread, w_noise = map(np.array, parts)
                square = (DIMENSIONS, DIMENSIONS)
                found.append(pooled((n, centre, spread.reshape(square), noise), (w_centre, w_spread.reshape(square), w_noise)))
            lists = pa.list_(pa.float64())
            made = [pa.array([c for c, _ in found], lists), pa.array([b.ravel() for _, b in found], lists)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *made], ["g_lang", "g_source", "centre", "between"])

    kinds = dict(both.dtypes)
    return both.mapInArrow(run, f"g_lang {kinds['g_lang']}, g_source {kinds['g_source']}, centre array<double>, between array<double>")


def _distance(vector: Column, noise: Column, centre: Column, between: Column) -> Column:
    """Squared distance of a text under its own sampling variance; null without an estimate."""

    @F.arrow_udf("double")
    def mahalanobis(rows: pa.Array, noises: pa.Array, centres: pa.Array, betweens: pa.Array) -> pa.Array:
        known = np.flatnonzero(~np.asarray(centres.is_null().to_numpy(zero_copy_only=False)))
        out = np.zeros(len(rows))
        at = pa.array(known)

        def matrix(column: pa.Array, width: int) -> np.ndarray:
            return column.take(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)

        if known.size:
            spread = matrix(betweens, DIMENSIONS**2).reshape(-1, DIMENSIONS, DIMENSIONS).copy()
            spread[:, range(DIMENSIONS), range(DIMENSIONS)] += matrix(noises, DIMENSIONS) + 1e-12
            out[known] = squared_distances(matrix(rows, DIMENSIONS), matrix(centres, DIMENSIONS), spread)
        return pa.array(out, mask=np.isin(np.arange(len(rows)), known, invert=True))

    return mahalanobis(vector, noise, centre, between)


def judge(measured: DataFrame, by: tuple[str, str] = ("lang", "source"), cutoff: float = CUTOFF, doc_id: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``measured`` with squared ``distance`` (null: base rule, or unjudged), ``verdict`` and ``kept``."""
    measured = checkpointed(measured)
    lang, source = F.col(by[0]).alias("g_lang"), F.col(by[1]).alias("g_source")
    eligible = measured.filter(~F.col("base_failed")).select(F.col(doc_id).cast("string").alias("id"), lang, source, *VECTOR, *NOISE)
    whole = F.struct(F.lit(0).alias("level"), "g_lang", "g_source")
    wider = F.struct(F.lit(1).alias("level"), "g_lang", F.lit(None).cast(dict(eligible.dtypes)["g_source"]).alias("g_source"))
    rows = eligible.withColumn("of", F.explode(F.array(whole, wider))).withColumn("grp", F.to_json("of"))
    sums = rows.groupBy("grp").agg(F.first("of").alias("of"), F.count("*").alias("n"), F.array(*(F.avg(v) for v in NOISE)).alias("noise"))
    sized = checkpointed(sums.select("grp", "of.level", "of.g_lang", "of.g_source", "n", "noise"))
    small = F.broadcast if sized.count() <= MAX_BROADCAST_GROUPS else (lambda table: table)
    enough = sized.filter(f"level = 1 AND n >= {MIN_ROWS}").select(F.col("g_lang").alias("e_lang"))
    groups = checkpointed(sized.join(small(enough), F.col("g_lang").eqNullSafe(F.col("e_lang")), "left_semi"))
    estimates = robust_estimate(rows.select("grp", "id", *VECTOR), groups.select("grp", "n", "noise"), small, sample_rows)
    found = checkpointed(_joined_estimates(groups, estimates, small))
    same = F.col(by[0]).eqNullSafe(F.col("g_lang")) & F.col(by[1]).eqNullSafe(F.col("g_source")) & ~F.col("base_failed")
    scored = measured.join(small(found), same, "left")
    distance = _distance(F.array(*VECTOR), F.array(*NOISE), F.col("centre"), F.col("between"))
    scored = scored.withColumn("distance", distance).drop("g_lang", "g_source", "centre", "between")
    verdict = F.when(F.col("base_failed"), "base").when(F.col("distance").isNull(), "unjudged").when(F.col("distance") > cutoff, "outlier").otherwise("inlier")
    return scored.withColumn("verdict", verdict).withColumn("kept", F.col("verdict").isin("unjudged", "inlier"))
