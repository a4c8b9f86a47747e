"""SimHash near-duplicate detection with bit-sliced comparison.

Each text gets a 64-bit fingerprint of its 3-word shingles. Fingerprints link when
``RADIUS`` or fewer bits differ. Equal fingerprints are compared once.

Candidates: four 16-bit parts hold at most three differing bits, so one part is
equal; the other 48 bits in four parts of 12 again have an equal part. Each distinct
fingerprint therefore has 16 keys of 28 bits, and two that link share a key.

Fingerprints of a key are compared as bit planes. Plane b holds bit b of 64
fingerprints in one machine word; exclusive-or with the other side's bit marks the
lanes that differ, and carry-save counters (ones, twos, and a mark for four or
more) add the marks of many lanes at once. A block of lanes is abandoned as soon as
all its lanes have passed the radius.

A key with more than ``BLOCK`` fingerprints is dealt into blocks of that size and
each pair of blocks is compared in a task of its own. Every comparison emits a
spanning forest of the links it found, at most one row per fingerprint, and the
components are joined by distributed star contraction.

Defined results: null and empty texts have fingerprint zero and link like others;
null ids take part, and a component of null ids only has a null id; repeated rows
are equal documents; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, release_memory, width_for
from .components import connected_components, local_components

RADIUS, SHINGLE, SEED = 3, 3, 42
BLOCK = 4096
#: groups up to this size are compared lane by lane with other groups' lanes
SMALL = 48
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    ends = ends.tolist()
    spans = zip(starts, ends[min(shingle, len(words)) - 1 :])
    return np.fromiter(
        map(xxhash.xxh64_intdigest, [joined[a:b] for a, b in spans], repeat(SEED)), np.uint64
    )


def majority_bits(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes, as a signed 64-bit number."""
    if not hashes.size:
        return 0
    counts = np.zeros(64, np.int64)
    for start in range(0, hashes.size, 1 << 14):
        part = hashes[start : start + (1 << 14)].astype("<u8", copy=False)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > hashes.size, bitorder="little").view("<i8")[0])


def fingerprint_of(text: str | None) -> int:
    return majority_bits(shingle_hashes(text))


def fingerprint(text: Column) -> Column:
    """``long``: the 64-bit fingerprint of a whole text."""

    @F.arrow_udf("long")
    def simhash64(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([fingerprint_of(x.as_py()) for x in texts], pa.int64())
        release_memory()

    return simhash64(text)


def bit_planes(prints: np.ndarray) -> np.ndarray:
    """64 rows; lane i of a row holds that bit of print i. Lanes are padded with zeros."""
    padded = np.zeros(-(-prints.size // 64) * 64, "<u8")
    padded[: prints.size] = prints
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def lanes_within(marks: Iterator[np.ndarray], shape: tuple, radius: int = RADIUS) -> np.ndarray:
    """Lanes with at most ``radius`` marks, as words of bits.

    Carry-save: three planes of marks enter per step as a sum and a carry, which ripple
    through the counter's planes; what leaves the last one is beyond the radius.
    """
    size = radius.bit_length()
    planes = [np.zeros(shape, np.uint64) for _ in range(size)]
    over = np.zeros(shape, np.uint64)

    def add(x: np.ndarray, weight: int) -> None:
        nonlocal over
        for i in range(weight, size):
            x, planes[i] = planes[i] & x, planes[i] ^ x
        over |= x

    def beyond() -> np.ndarray:
        more, same = over, _ALL
        if radius + 1 == 1 << size:  # whatever the planes hold is within
            return more
        for i in reversed(range(size)):
            if radius >> i & 1:
                same = same & planes[i]
            else:
                more = more | (same & planes[i])
                same = same & ~planes[i]
        return more

    marks = iter(marks)
    for step, x in enumerate(marks):
        y, z = next(marks, None), next(marks, None)
        if y is None:
            add(x, 0)
        elif z is None:
            add(x ^ y, 0)
            add(x & y, 1)
        else:
            half = x ^ y
            add(half ^ z, 0)
            add((x & y) | (half & z), 1)
        if step % 3 == 2 and (beyond() == _ALL).all():
            break
    return ~beyond()


def _set_lanes(words: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little")
    return np.nonzero(bits[:, :lanes])


def compare_blocks(queries: np.ndarray, members: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, member) index pairs within the radius, for parts of the queries."""
    planes = bit_planes(members)
    bits = np.arange(64, dtype=np.uint64)
    for start in range(0, queries.size, 128):
        part = queries[start : start + 128]
        set_bits = np.where((part[None, :] >> bits[:, None]) & np.uint64(1), _ALL, np.uint64(0))
        near = lanes_within((planes[b][None, :] ^ set_bits[b][:, None] for b in range(64)), (part.size, planes.shape[1]), radius)
        some = np.flatnonzero(near.any(1))
        at, lane = _set_lanes(near[some], members.size) if some.size else (np.empty(0, int), np.empty(0, int))
        yield start + some[at], lane


def link_group(prints: np.ndarray, others: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links in ``prints``, or between it and ``others``."""
    whole = prints if others is None else np.concatenate([prints, others])
    shift = 0 if others is None else prints.size
    labels = np.arange(whole.size)
    for at, lane in compare_blocks(prints, prints if others is None else others):
        labels = local_components(whole.size, at, lane + shift, labels)
    moved = np.flatnonzero(labels != np.arange(whole.size))
    return whole[moved], whole[labels[moved]]


def link_small_groups(groups: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for many sorted small groups at once: lane i holds prints i and i + lag."""
    labels, lag = np.arange(prints.size), 1
    at = np.arange(prints.size)
    while True:
        at = at[at + lag < prints.size]
        at = at[groups[at] == groups[at + lag]]
        if not at.size:
            break
        for start in range(0, at.size, 1 << 16):
            part = at[start : start + (1 << 16)]
            planes = bit_planes(prints[part] ^ prints[part + lag])
            near = lanes_within((planes[b] for b in range(64)), (planes.shape[1],))
            lane = _set_lanes(near[None, :], part.size)[1]
            labels = local_components(prints.size, part[lane], part[lane] + lag, labels)
        lag += 1
    moved = np.flatnonzero(labels != np.arange(prints.size))
    return prints[moved], prints[labels[moved]]


def _keys(fingerprint: Column) -> Column:
    """The 16 keys: number of the equal parts above, their 28 bits below."""
    keys = []
    for a in range(4):
        outer = F.shiftrightunsigned(fingerprint, 16 * a).bitwiseAND(F.lit(0xFFFF))
        low = fingerprint.bitwiseAND(F.lit((1 << 16 * a) - 1))
        high = F.shiftleft(F.shiftrightunsigned(fingerprint, 16 * a + 16), 16 * a) if a < 3 else F.lit(0).cast("long")
        rest = low.bitwiseOR(high)  # the 48 bits beside part a
        for b in range(4):
            inner = F.shiftrightunsigned(rest, 12 * b).bitwiseAND(F.lit(0xFFF))
            keys.append(F.lit((4 * a + b) << 28).bitwiseOR(F.shiftleft(outer, 12)).bitwiseOR(inner))
    return F.array(*keys)


def links(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """u, v: links between the distinct ``fp`` of ``prints`` that join what the radius joins."""
    spark = prints.sparkSession
    keyed = checkpointed(prints.select(F.explode(_keys(F.col("fp"))).alias("key"), "fp"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    sizes = checkpointed(sizes.select("key", "n", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    shared = keyed.join(sizes, "key")  # fingerprints alone under a key go
    part = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = shared.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = dealt.select(
        F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("task"),
        "key",
        F.least("part", "other").alias("a"),
        F.greatest("part", "other").alias("b"),
        "part",
        "fp",
    )
    # a key's fingerprints travel once for each of its blocks, in rows of some 48 bytes
    copies = sizes.agg(F.sum(F.col("n") * F.col("blocks")).alias("n")).first()["n"] or 0
    width = width_for(spark, 48 * copies)
    rows = rows.repartition(width, "task").sortWithinPartitions("key", "a", "b", "part", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(pairs: list) -> pa.RecordBatch:
            u, v = (np.concatenate(x) if x else np.empty(0, np.uint64) for x in zip(*pairs)) if pairs else ([], [])
            return pa.RecordBatch.from_arrays(
                [pa.array(np.asarray(x, np.uint64).view(np.int64), pa.int64()) for x in (u, v)], ["u", "v"]
            )

        def link(table: pa.Table) -> pa.RecordBatch:
            columns = {c: table[c].to_numpy() for c in ("key", "a", "b", "part", "fp")}
            prints = columns["fp"].view(np.uint64)
            fresh = np.ones(prints.size, bool)
            fresh[1:] = False
            for c in ("key", "a", "b"):
                fresh[1:] |= columns[c][1:] != columns[c][:-1]
            starts = np.flatnonzero(fresh)
            sizes = np.diff(np.append(starts, prints.size))
            group = np.repeat(np.arange(starts.size), sizes)
            whole = columns["a"] == columns["b"]
            small = (np.repeat(sizes, sizes) <= SMALL) & whole
            pairs = [link_small_groups(group[small], prints[small])] if small.any() else []
            for start, size in zip(starts.tolist(), sizes.tolist()):
                if small[start]:
                    continue
                of = prints[start : start + size]
                if whole[start]:
                    pairs.append(link_group(of))
                else:
                    first = columns["part"][start : start + size] == columns["a"][start]
                    pairs.append(link_group(of[first], of[~first]))
            return emit(pairs)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            keys = np.stack([table[c].to_numpy().astype(np.int64) for c in ("key", "a", "b")])
            last = np.flatnonzero((keys != keys[:, -1:]).any(0))
            if not last.size:
                continue  # the batch so far holds one group: wait for its end
            cut = int(last[-1]) + 1
            yield link(table.slice(0, cut))
            held = table.slice(cut).to_batches()
        if held:
            yield link(pa.Table.from_batches(held))
        release_memory()

    return rows.mapInArrow(run, "u long, v long")


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp, component_id of every row of ``docs``."""
    marked = checkpointed(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text)).alias("fp")))
    distinct = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = checkpointed(connected_components(links(distinct.select("fp"))))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return marked.join(checkpointed(named), "fp").select("doc_id", "fp", "component_id")


def hex_of(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


#: ids to drop that are broadcast at most, 8 bytes each; more are joined by shuffle
MAX_BROADCAST_IDS = 1_000_000


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` per component: that of the smallest id (any one, if rows repeat)."""
    return drop_components(docs, components(docs, doc_id, text), fingerprint, doc_id, text)


def drop_components(docs: DataFrame, found: DataFrame, mark: Callable[[Column], Column], doc_id: str, text: str) -> DataFrame:
    """One row of ``docs`` per component in ``found``, whose ``fp`` is ``mark`` of the text.

    The ids that go are fewer than those that stay, and up to a bound the texts
    need not be shuffled to lose them. Where ids repeat, rows are told apart by
    their fingerprints and joined with all that stay.
    """
    found = checkpointed(found)
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = checkpointed(found.filter(~stays).select(F.col("doc_id").alias("gone_id")))
    if found.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        hint = F.broadcast if gone.count() <= MAX_BROADCAST_IDS else (lambda table: table)
        return docs.join(hint(gone), F.col(doc_id).eqNullSafe(F.col("gone_id")), "left_anti")
    marks = ("veridra_id", "veridra_fp", "veridra_component")
    kept = found.filter(stays).select(*(F.col(c).alias(m) for c, m in zip(("doc_id", "fp", "component_id"), marks))).distinct()
    marked = docs.withColumn("veridra_mark", mark(F.col(text)))
    same = F.col(doc_id).eqNullSafe(F.col("veridra_id")) & (F.col("veridra_mark") == F.col("veridra_fp"))
    return marked.join(kept, same).dropDuplicates(["veridra_component"]).select(*(F.col(f"`{c}`") for c in docs.columns))
