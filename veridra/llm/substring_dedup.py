"""Substring deduplication by Rabin-Karp window hashes.

A window is ``WINDOW`` consecutive words of one document. A word is removed when a
window that covers it also starts in a document with a smaller id; windows are
judged on the input. Repeated windows that overlap or touch merge into maximal
removal intervals.

1. Documents are dealt into blocks of consecutive ids of about ``BLOCK_BYTES`` of text
   (by sums of bytes, sorted in Spark), so that every document of a block has a smaller
   id than those of later blocks. An id whose rows hold more, and the null id, have
   blocks of their own, all of the same rank.
2. Each block rolls a 64-bit polynomial hash over its words and keeps its distinct
   window hashes, sorted. They leave as differences, packed by range of hash, a few
   bytes each: a passage that a third of all documents share leaves a block once, and
   ranges that hold none of a block's hashes cost it nothing.
3. Each range of hashes notes which of them a block of lower rank holds, and answers
   every block with one bit per hash.
4. Each block joins the answers to what it knows of its own documents and emits
   texts and intervals.

The text is shuffled once; both uses of a block read that shuffle. Blocks grow with the
table up to ``MAX_BLOCK_BYTES`` so that a packed row holds many hashes: ``PACKED`` or
more up to about 0.7 TB, some five at 10 TB, and single ones at 100 TB. Hashes have 64
bits after mixing: n distinct windows meet falsely with probability n²/2⁶⁵.

Defined results: null and empty texts have no words; shorter documents than a
window lose nothing; documents with equal ids do not repeat each other; a null id
counts as larger than all others; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release_memory, shuffle_width

WINDOW = 50
BLOCK_BYTES, MAX_BLOCK_BYTES = 6 << 20, 24 << 20
#: windows that one range of hashes should hold at most, bytes of text for each, and hashes wanted in a packed row
RANGE_WINDOWS, WINDOW_BYTES, PACKED = 2_000_000, 6, 64
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: words whose hashes a worker remembers
CACHE_WORDS = 150_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RollingHasher:
    """64-bit hashes of every window of a document's words."""

    def __init__(self, window: int = WINDOW):
        self.window, self.known = window, {}
        self.powers = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def _upto(self, n: int) -> None:
        if len(self.powers) < n:
            size = max(n, 2 * len(self.powers))
            back = np.uint64(pow(int(_BASE), -1, 1 << 64))
            self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]), dtype=np.uint64)
            self.inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, back)]), dtype=np.uint64)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        n = len(words) - self.window + 1
        if n < 1:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        for word in set(words).difference(known):
            known[word] = xxhash.xxh64_intdigest(word, 1)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        self._upto(len(words))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(h * self.powers[: len(words)], dtype=np.uint64)])
        return _mixed((sums[self.window :] - sums[:n]) * self.inverse[:n])


def removal_intervals(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal [from, to) word intervals that windows at the sorted ``starts`` cover."""
    if not starts.size:
        return []
    breaks = np.flatnonzero(np.diff(starts) > window)
    firsts = starts[np.concatenate([[0], breaks + 1])]
    lasts = starts[np.concatenate([breaks, [starts.size - 1]])] + window
    return list(zip(firsts.tolist(), lasts.tolist()))


class Block:
    """The distinct window hashes of a block of documents."""

    def __init__(self, ids: list, texts: list[str | None], window: int, hasher: RollingHasher):
        self.ids = np.array([np.iinfo(np.int64).max if i is None else i for i in ids], np.int64)
        self.hashes = [hasher((t or "").encode().split()) for t in texts]
        joined = np.concatenate([*self.hashes, np.empty(0, np.uint64)])
        owners = np.repeat(self.ids, [len(h) for h in self.hashes])
        self.distinct, inverse = np.unique(joined, return_inverse=True)
        self.first = np.full(len(self.distinct), np.iinfo(np.int64).max, np.int64)
        np.minimum.at(self.first, inverse, owners)
        self.inverse = np.split(inverse, np.cumsum([len(h) for h in self.hashes])[:-1]) if self.hashes else []

    def repeated(self, k: int, earlier: np.ndarray) -> np.ndarray:
        """Starts of document ``k``'s windows that start in a smaller id."""
        at = self.inverse[k]
        return np.flatnonzero(earlier[at] | (self.first[at] < self.ids[k]))


def range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """The number of the range, of ``ranges`` equal parts of the 64-bit numbers, that holds each hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def packed_ranges(hashes: np.ndarray, ranges: int) -> Iterator[tuple[int, bytes]]:
    """Each range that holds some of the sorted ``hashes``, with those."""
    spans = range_of(hashes, ranges)
    starts = np.flatnonzero(np.diff(spans, prepend=-1))
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(hashes)]):
        yield int(spans[a]), pack_sorted(hashes[a:b])


def pack_sorted(hashes: np.ndarray) -> bytes:
    """Differences of sorted numbers, byte planes apart: the high planes are empty."""
    steps = np.diff(hashes, prepend=np.uint64(0))
    planes = steps.view(np.uint8).reshape(-1, 8)
    used = 8
    while used > 1 and not planes[1:, used - 1].any():
        used -= 1
    # the first number is whole, the rest take as many planes as the largest needs
    return bytes([used]) + hashes[:1].tobytes() + np.ascontiguousarray(planes[1:, :used].T).tobytes()


def unpack_sorted(packed: bytes) -> np.ndarray:
    used, first = packed[0], np.frombuffer(packed, np.uint64, 1, 1)
    rest = np.frombuffer(packed, np.uint8, -1, 9).reshape(used, -1).T
    steps = np.zeros((len(rest), 8), np.uint8)
    steps[:, :used] = rest
    return np.cumsum(np.concatenate([first, steps.reshape(-1).view(np.uint64)]), dtype=np.uint64)


_HASHERS: dict[int, RollingHasher] = {}


def _hasher(window: int) -> RollingHasher:
    return _HASHERS.setdefault(window, RollingHasher(window))


@dataclass
class Deal:
    """Blocks by id: the first id of each rank, and how many blocks the rank has."""

    firsts: np.ndarray
    parts: np.ndarray

    def __post_init__(self):
        self.bases = np.cumsum(self.parts) - self.parts

    def block_of(self, ids: np.ndarray, salts: np.ndarray) -> np.ndarray:
        rank = np.maximum(np.searchsorted(self.firsts, ids, "right") - 1, 0)
        return self.bases[rank] + salts % self.parts[rank]

    def rank_of(self, block: int) -> int:
        return int(np.searchsorted(self.bases, block, "right") - 1)


#: what a null id counts as
LAST_ID = np.iinfo(np.int64).max


def deal_blocks(docs: DataFrame, doc_id: str, text: str, block_bytes: int, total: int = 0) -> Deal:
    """Blocks of about ``block_bytes`` of the ``total`` bytes; 16 bytes on the driver and the workers for each."""
    spark = docs.sparkSession
    size = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    ids = docs.groupBy(F.coalesce(F.col(doc_id), F.lit(LAST_ID)).alias("id")).agg(F.sum(size + 1).alias("size"))
    # a partition sorts the ids of some hundreds of blocks
    width = max(shuffle_width(spark), total // (256 * block_bytes))
    rows = ids.repartitionByRange(width, "id").sortWithinPartitions("id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # bytes of the block that is being filled
        for batch in batches:
            found = []
            for key, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if size > block_bytes or key == LAST_ID:
                    found.append((key, -(-size // block_bytes)))
                    held = None
                elif held is None or held + size > block_bytes:
                    found.append((key, 1))
                    held = size
                else:
                    held += size
            firsts, parts = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(firsts, pa.int64()), pa.array(parts, pa.int64())], ["first", "parts"])

    # one row for each block_bytes of text, two numbers each
    found = sorted((r["first"], r["parts"]) for r in rows.mapInArrow(cut, "first long, parts long").collect())
    return Deal(np.array([f for f, _ in found] or [0], np.int64), np.array([p for _, p in found] or [1], np.int64))


RESULT_COLUMNS = ("n_words", "n_removed", "kept_text", "removed")


def remove_repeats(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    block_bytes: int | None = None,
    range_windows: int = RANGE_WINDOWS,
) -> DataFrame:
    """The rows of ``docs`` with n_words, n_removed, kept_text and removed.

    ``kept_text`` holds the kept words joined by single spaces, ``removed`` the
    maximal removed intervals as [from, to) word numbers. Input columns of these
    names are replaced.
    """
    spark = docs.sparkSession
    carried = [c for c in docs.columns if c not in RESULT_COLUMNS]
    at_id, at_text = carried.index(doc_id), carried.index(text)
    plain = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carried)))
    plain = plain.withColumn(f"c{at_id}", F.col(f"c{at_id}").cast("long"))
    fields = list(plain.schema.fields)
    key, value = F.col(f"c{at_id}"), F.col(f"c{at_text}")
    total = plain.agg(F.sum(F.octet_length(value).cast("long")).alias("n")).first()["n"] or 0
    windows = total // WINDOW_BYTES
    if block_bytes is None:
        block_bytes = min(MAX_BLOCK_BYTES, max(BLOCK_BYTES, PACKED * windows // range_windows * WINDOW_BYTES))
    deal = deal_blocks(plain, f"c{at_id}", f"c{at_text}", block_bytes, total)
    ranges = max(1, -(-windows // range_windows))
    shared = spark.sparkContext.broadcast(deal)
    n_blocks = int(deal.parts.sum())

    @F.arrow_udf("long")
    def block_of(ids: pa.Array, salts: pa.Array) -> pa.Array:
        known = ids.fill_null(LAST_ID).to_numpy(zero_copy_only=False)
        return pa.array(shared.value.block_of(known, salts.to_numpy(zero_copy_only=False)))

    # rows of one id are dealt by text and, as texts repeat, by the partition that they come from
    salt = F.pmod(F.xxhash64(value, F.spark_partition_id()), F.lit(1 << 31))
    width = max(shuffle_width(spark), -(-n_blocks // 4))
    dealt = plain.withColumn("block", block_of(key, salt)).repartition(width, "block")

    def block_of_table(table: pa.Table) -> Block:
        return Block(table[f"c{at_id}"].to_pylist(), table[f"c{at_text}"].to_pylist(), window, _hasher(window))

    def send(key: tuple, table: pa.Table) -> pa.Table:
        parts = list(packed_ranges(block_of_table(table).distinct, ranges))
        release_memory()
        return pa.table(
            {
                "span": pa.array([i for i, _ in parts], pa.int64()),
                "block": pa.array([key[0].as_py()] * len(parts), pa.int64()),
                "packed": pa.array([x for _, x in parts], pa.binary()),
            }
        )

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["block"].to_pylist(), table["packed"].to_pylist()))
        parts = [unpack_sorted(x) for _, x in rows]
        sizes = [len(x) for x in parts]
        joined = np.concatenate(parts)
        ranks = np.repeat(np.array([shared.value.rank_of(block) for block, _ in rows], np.int32), sizes)
        order = np.argsort(joined, kind="stable")  # equal hashes stay in order of block, and so of rank
        ranked, ranks = joined[order], ranks[order]
        starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        least = np.repeat(ranks[starts], np.diff(np.append(starts, ranked.size)))
        seen = np.zeros(len(joined), bool)
        seen[order] = ranks > least
        bits = [np.packbits(x) for x in np.split(seen, np.cumsum(sizes)[:-1])]
        told = [(block, x.tobytes()) for (block, _), x in zip(rows, bits) if x.any()]
        del parts, joined, order, ranked, ranks, least, seen, bits
        release_memory()
        return pa.table(
            {
                "block": pa.array([b for b, _ in told], pa.int64()),
                "span": pa.array([key[0].as_py()] * len(told), pa.int64()),
                "bits": pa.array([x for _, x in told], pa.binary()),
            }
        )

    removed_type = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))

    def remove(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        block = block_of_table(table)
        earlier = np.zeros(len(block.distinct), bool)
        if len(answers):
            spans = range_of(block.distinct, ranges)
            numbers = answers["span"].to_numpy()
            ends = zip(np.searchsorted(spans, numbers, "left").tolist(), np.searchsorted(spans, numbers, "right").tolist())
            for (a, b), bits in zip(ends, answers["bits"].to_pylist()):
                earlier[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
        n_words, n_removed, kept_texts, removed = [], [], [], []
        for k, text in enumerate(table[f"c{at_text}"].to_pylist()):
            words = (text or "").encode().split()
            spans = removal_intervals(block.repeated(k, earlier), window)
            kept = [w for a, b in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(words)]) for w in words[a:b]]
            n_words.append(len(words))
            n_removed.append(len(words) - len(kept))
            kept_texts.append(b" ".join(kept).decode())
            removed.append([{"from": a, "to": b} for a, b in spans])
        del block, earlier
        release_memory()
        made = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept_texts, pa.string()), pa.array(removed, removed_type)]
        return pa.table([*(table[f.name] for f in fields), *made], [*(f.name for f in fields), *RESULT_COLUMNS])

    sent = dealt.groupBy("block").applyInArrow(send, "span long, block long, packed binary")
    sent = sent.repartition(max(shuffle_width(spark), ranges), "span")
    answers = sent.groupBy("span").applyInArrow(answer, "block long, span long, bits binary").repartition(width, "block")
    schema = T.StructType(
        fields
        + [
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("kept_text", T.StringType()),
            T.StructField("removed", T.ArrayType(T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType())]))),
        ]
    )
    done = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(remove, schema)
    return done.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(carried)), *RESULT_COLUMNS)
