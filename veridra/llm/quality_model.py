"""Quality classifier: logistic regression over hashed word n-grams.

Words and n-grams are hashed into 2**BITS weights that follow-the-regularised-
leader updates learn; a document's vector holds the square roots of its n-gram
counts, scaled to length one, and its score is the logistic function of a sparse
dot product. Before hashing, a text is cut into runs of letters, digits and other
symbols; letters are lower-cased with capitals kept as a mark, digits become one
sign, and a run equal to the one before it becomes a mark of repetition.

Learning uses a bounded sample: the ``max_rows`` labelled documents whose ids hash
lowest, so the sample does not depend on the order of rows. Their vectors meet in
one task, whose size the bound limits. Scoring reads every text whole.

Defined results: a null or empty text has the score of the bias alone; null labels
and null ids are not learned from; repeated labels of a document count once (the
highest); without any label the score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release_memory

BITS, MAX_ROWS, EPOCHS = 18, 10_000, 4
ALPHA, BETA, L1, L2 = 2.0, 1.0, 1e-4, 1e-4
THRESHOLD = 0.3

_RUNS = regex.compile(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+").findall
_SAME = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0xD6E8FEB86659FD93)
CACHE_RUNS = 150_000


class Hasher:
    """Indices and values of a text's hashed n-grams."""

    def __init__(self, bits: int = BITS):
        self.shift, self.known = np.uint64(64 - bits), {}

    def _hash(self, run: str) -> int:
        first = run[0]
        if first.isalpha():
            run = ("^" if len(run) > 1 and run.isupper() else "") + run.lower()
        elif first.isnumeric():
            run = "0"
        return xxhash.xxh64_intdigest(run.encode(), 7)

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        runs = _RUNS(text) if text else []
        if not runs:
            return np.empty(0, np.int32), np.empty(0)
        if len(self.known) > CACHE_RUNS:
            self.known = {}
        known = self.known
        for run in set(runs).difference(known):
            known[run] = self._hash(run)
        h = np.fromiter(map(known.__getitem__, runs), np.uint64, len(runs))
        h[1:][h[1:] == h[:-1]] = _SAME
        keys = np.concatenate([h, h[:-1] * _STEP + h[1:]])
        keys = (keys ^ keys >> np.uint64(29)) * _MIX
        index, counts = np.unique((keys >> self.shift).astype(np.int32), return_counts=True)
        return index, np.sqrt(counts / len(keys))


@dataclass
class FTRL:
    """Follow-the-regularised-leader for logistic loss, one row at a time."""

    size: int
    z: np.ndarray = field(init=False)
    n: np.ndarray = field(init=False)

    def __post_init__(self):
        self.z, self.n = np.zeros(self.size), np.zeros(self.size)

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, index: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(index)
        p = 1.0 / (1.0 + np.exp(-np.clip(w @ value, -35, 35)))
        gradient = (p - label) * value
        n = self.n[index]
        self.z[index] += gradient - (np.sqrt(n + gradient**2) - np.sqrt(n)) / ALPHA * w
        self.n[index] = n + gradient**2


def _with_bias(index: np.ndarray, value: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return np.append(index, np.int32(1 << bits)), np.append(value, value.dtype.type(1))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights, the bias last, from (indices, values, label) rows in their order."""
    model = FTRL((1 << bits) + 1)
    order = np.random.default_rng(11)
    rows = [(*_with_bias(i, v, bits), y) for i, v, y in rows]
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            model.learn(*rows[k])
    return model.weights()


def labelled_sample(labels: DataFrame, doc_id: str = "doc_id", label: str = "quality", max_rows: int = MAX_ROWS) -> DataFrame:
    """At most ``max_rows`` labelled ids, those that hash lowest."""
    known = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull())
    once = known.groupBy(F.col(doc_id).alias("label_id")).agg(F.max(label).cast("int").alias("label"))
    return once.orderBy(F.xxhash64("label_id"), "label_id").limit(max_rows)


def train(docs: DataFrame, sample: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = BITS) -> np.ndarray:
    """Weights learned from the documents that ``sample`` (``labelled_sample``) names."""
    named = docs.select(F.col(doc_id).alias("label_id"), F.col(text).alias("text"))
    rows = named.join(F.broadcast(sample), "label_id")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Hasher(bits)
        for batch in batches:
            found = [hashed(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("label_id"),
                    batch.column("label"),
                    pa.array([i.tobytes() for i, _ in found], pa.binary()),
                    pa.array([v.astype(np.float32).tobytes() for _, v in found], pa.binary()),
                ],
                ["label_id", "label", "indices", "vals"],
            )
        del hashed
        release_memory()

    key_type = dict(rows.dtypes)["label_id"]
    vector_rows = rows.select("label_id", "label", "text").mapInArrow(
        vectors, f"label_id {key_type}, label int, indices binary, vals binary"
    )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for batch in batches:
            for key, y, i, v in zip(*(c.to_pylist() for c in batch.columns)):
                held[str(key)] = (np.frombuffer(i, np.int32), np.frombuffer(v, np.float32), y)
        weights = fit([held.pop(k) for k in sorted(held)], bits)
        release_memory()
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype(np.float32).tobytes()], pa.binary())], ["weights"])

    learned = vector_rows.dropDuplicates(["label_id"]).repartition(1).mapInArrow(learn, "weights binary").collect()
    # a table without rows has no task that learns
    return np.frombuffer(learned[0]["weights"], np.float32).astype(float) if learned else np.zeros((1 << bits) + 1)


def score(text: Column, weights: np.ndarray, spark, bits: int = BITS) -> Column:
    """Probability of label 1 for a whole text."""
    shared = spark.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def quality_score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashed = Hasher(bits)
        w = shared.value
        for texts in batches:
            dots = np.array([w[i] @ v for i, v in (hashed(x.as_py()) for x in texts)] or [], float) + w[-1]
            yield pa.array(1.0 / (1.0 + np.exp(-np.clip(dots, -35, 35))), pa.float64())
        del hashed
        release_memory()

    return quality_score(text)
