"""SimHash near-duplicates at a similarity of five-word shingles.

The general form of ``simhash``: two texts link when the sets of their ``SHINGLE``-word
shingles have a Jaccard similarity of ``SIMILARITY`` or more, and groups are the
components of these links. Fingerprints and their bit-sliced comparison are those of
``simhash`` with a radius wide enough for the similarity; no equal parts of the bits can
be keys at that radius, so candidates come from min-hashes, and links are confirmed on
the sets.

1. Each distinct set has a fingerprint and ``BANDS`` keys of ``ROWS`` min-hashes. Two sets
   of similarity s share a key with probability 1 - (1 - s^ROWS)^BANDS, so a pair right
   at 0.8 is passed over in 7 of a million cases, a pair at 0.9 in 1 of 10^11. Its
   fingerprints differ in more than ``RADIUS`` bits in 3 of a million cases.
2. Every set is compared with the least set of each of its keys: one comparison for each
   two sets that meet, however many share the key. These links make stars.
3. Sets that keys connect form loose groups. Where the stars leave a loose group in one
   piece nothing is left to find: copies of one text cost no more than that. Otherwise
   its sets are dealt into parts of ``BLOCK``, large pieces into parts of their own, and
   every two parts but those of the same piece are compared bit-sliced in a task of
   their own. Pairs within the radius that nothing joins yet are confirmed by their
   sets, and a spanning forest of the links leaves the task.

Only sets that share a key are written out and shuffled. Defined results: null and empty
texts have the empty set and are alike; a text of fewer than ``SHINGLE`` words is one
shingle; null ids take part; an empty table gives no rows. Sets are told apart by 64-bit
digests.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, release_memory, scratch, width_for
from .components import connected_components, local_components
from .simhash import MAX_BROADCAST_IDS, compare_blocks, drop_components, majority_bits, shingle_hashes

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 24
BANDS, ROWS, SEED = 30, 5, 17
#: sets of a part, and sets that one task compares with the least of their key
BLOCK, STAR_BLOCK = 512, 4096

_CHOOSER = np.random.default_rng(SEED)
_MASKS, _FACTORS = (_CHOOSER.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles."""
    return np.unique(shingle_hashes(text, SHINGLE))


def digest_of(shingles: np.ndarray) -> int:
    """A signed 64-bit number for a set; 0 for the empty set."""
    if not shingles.size:
        return 0
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.astype("<u8", copy=False).tobytes(), SEED)).view(np.int64))


def band_keys(shingles: np.ndarray) -> list[int]:
    """``BANDS`` signed keys; none for the empty set."""
    if not shingles.size:
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, shingles.size, 1024):
        part = shingles[None, start : start + 1024] ^ _MASKS[:, None]
        np.minimum(least, (part * _FACTORS[:, None]).min(1), out=least)
    bands = least.astype("<u8", copy=False).reshape(BANDS, ROWS)
    keys = [xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(bands)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def marks(text: Column) -> Column:
    """fp, the digest of a text's shingle set, its size, fingerprint and band keys."""

    @F.arrow_udf("struct<fp long, size int, bits long, keys array<long>>")
    def marks_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = []
            for text in texts:
                shingles = shingle_set(text.as_py())
                found.append((digest_of(shingles), shingles.size, majority_bits(shingles), band_keys(shingles)))
            columns = list(zip(*found)) or [()] * 4
            types = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["fp", "size", "bits", "keys"])
        release_memory()

    return marks_of(text)


def digest(text: Column) -> Column:
    @F.arrow_udf("long")
    def digests(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([digest_of(shingle_set(t.as_py())) for t in texts], pa.int64())
        release_memory()

    return digests(text)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the similarity."""
    small, large = sorted((a.size, b.size))
    if small < SIMILARITY * large - 1e-9:
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common >= SIMILARITY * (a.size + b.size - common) - 1e-9


def link_sets(sets: list[np.ndarray], prints: np.ndarray, pieces: np.ndarray | None = None, split: int | None = None) -> np.ndarray:
    """Smallest index reachable by links between the sets; with ``split``, by those across that index.

    Sets of equal ``pieces`` are joined already. Of the pairs that join the same two
    pieces, few are confirmed at first, and more while none of them links.
    """
    labels = np.arange(len(sets))
    if pieces is not None:
        _, first, inverse = np.unique(pieces, return_index=True, return_inverse=True)
        labels = first[inverse]
    cut, shift = (len(sets), 0) if split is None else (split, split)
    for at, lane in compare_blocks(prints[:cut], prints[shift:], RADIUS):
        lane, tries = lane + shift, 1
        while True:
            open_ = np.flatnonzero((labels[at] != labels[lane]) & ((split is not None) | (at < lane)))
            if not open_.size:
                break
            at, lane = at[open_], lane[open_]
            ends = np.minimum(labels[at], labels[lane]) * len(sets) + np.maximum(labels[at], labels[lane])
            order = np.argsort(ends, kind="stable")
            run = np.flatnonzero(np.diff(ends[order], prepend=-1))
            place = np.arange(order.size) - np.repeat(run, np.diff(np.append(run, order.size)))
            tested = order[place < tries]
            linked = np.array([alike(sets[i], sets[j]) for i, j in zip(at[tested], lane[tested])], bool)
            labels = local_components(len(sets), at[tested][linked], lane[tested][linked], labels)
            rest = np.ones(at.size, bool)
            rest[tested] = False
            at, lane, tries = at[rest], lane[rest], 4 * tries
    return labels


def _sets(docs: DataFrame, places: DataFrame, doc_id: str, text: str) -> DataFrame:
    """fp and ``shingles`` (as bytes) of the sets in ``places`` (at_id, fp)."""
    # up to a bound the texts need not be shuffled to find those that hold a set
    hint = F.broadcast if places.count() <= MAX_BROADCAST_IDS else (lambda table: table)
    texts = docs.select(F.col(doc_id).alias("own_id"), F.col(text).alias("text"))
    texts = texts.join(hint(places), F.col("own_id").eqNullSafe(F.col("at_id"))).select("fp", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for fp, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                shingles = shingle_set(value.as_py())
                if digest_of(shingles) == fp:  # else another text of a repeated id
                    kept.append((fp, shingles.astype("<u8", copy=False).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in kept], pa.int64()), pa.array([s for _, s in kept], pa.binary())], ["fp", "shingles"])
        release_memory()

    return texts.mapInArrow(run, "fp long, shingles binary")


def _read(shingles: pa.Scalar) -> np.ndarray:
    return np.frombuffer(shingles.as_buffer(), "<u8")


def _stars(pairs: DataFrame, sets: DataFrame, width: int, block: int) -> DataFrame:
    """u, v: the ``pairs`` (fp, low) that are alike."""
    # leaders of more than a block of sets are few: at most one for every block of pairs
    hot = checkpointed(pairs.groupBy(F.col("low").alias("hot")).agg(F.ceil(F.count("*") / block).cast("int").alias("chunks")).filter("chunks > 1"))
    hint = F.broadcast if hot.count() <= MAX_BROADCAST_IDS else (lambda table: table)

    def counted(rows: DataFrame) -> DataFrame:
        return rows.join(hint(hot), F.col("low") == F.col("hot"), "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))

    members = counted(pairs).select("low", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int").alias("chunk"), "fp")
    leaders = counted(pairs.select("low").distinct())
    leaders = leaders.select("low", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("low").alias("fp"))
    rows = members.unionByName(leaders).join(sets, "fp")
    leads = F.col("fp") == F.col("low")
    rows = rows.select("low", "chunk", (~leads).alias("follows"), "fp", "shingles")
    rows = rows.repartition(width, "low", "chunk").sortWithinPartitions("low", "chunk", "follows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, held = None, np.empty(0, np.uint64)
        for batch in batches:
            found = []
            for low, follows, fp, shingles in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)):
                if not follows:
                    leader, held = low, _read(shingles).copy()
                elif leader == low and alike(held, _read(shingles)):
                    found.append((fp, low))
            u, v = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
        release_memory()

    return rows.mapInArrow(run, "u long, v long")


def _across(loose: DataFrame, sets: DataFrame, width: int, block: int) -> DataFrame:
    """u, v: links between the pieces of ``loose`` groups (fp, bits, root, piece) that are not whole."""
    pieces = loose.groupBy("root", "piece").agg(F.count("*").alias("n"))
    # pieces that fill a part have parts of their own; the others of a group share some
    shares = pieces.groupBy("root").agg(F.count("*").alias("pieces"), F.ceil(F.sum(F.when(F.col("n") < block, F.col("n")).otherwise(0)) / block).alias("shared"))
    broken = checkpointed(pieces.join(shares.filter("pieces > 1"), "root").withColumn("own", F.col("n") >= block))
    count = F.when(F.col("own"), F.ceil(F.col("n") / block)).otherwise(F.col("shared"))
    dealt = loose.join(broken.withColumn("count", count), ["root", "piece"])
    number = F.pmod(F.when(F.col("own"), F.xxhash64("fp")).otherwise(F.xxhash64("piece")), F.col("count"))
    part = F.struct(F.when(F.col("own"), F.col("piece")).alias("whole"), number.alias("number"))
    dealt = checkpointed(dealt.select("fp", "bits", "root", "piece", part.alias("part")))
    parts = dealt.select("root", F.col("part").alias("other")).distinct()
    met = dealt.join(parts, "root")
    apart = F.col("part.whole").isNull() | F.col("other.whole").isNull() | (F.col("part.whole") != F.col("other.whole"))
    first = F.col("part") < F.col("other")
    rows = met.filter(apart).select("root", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), (~first).alias("second"), "fp", "bits", "piece")
    rows = rows.withColumn("second", F.col("second") & (F.col("a") != F.col("b"))).join(sets, "fp")
    rows = rows.select(F.to_json(F.struct("root", "a", "b")).alias("task"), (F.col("a") != F.col("b")).alias("two"), "second", "fp", "bits", "piece", "shingles")
    rows = rows.repartition(width, "task").sortWithinPartitions("task", "second", "fp")

    def compare(two: bool, held: list[tuple]) -> pa.RecordBatch:
        prints = np.array([h[1] for h in held], np.int64)
        split = sum(not h[0] for h in held) if two else None
        labels = pieces = np.arange(prints.size)
        if prints.size > 1 and split not in (0, prints.size):
            pieces = np.unique([h[3] for h in held], return_inverse=True)[1].ravel()
            labels = link_sets([h[4] for h in held], np.array([h[2] for h in held], np.int64).view(np.uint64), pieces, split)
        # the pieces hang together already: one row for each that joined another
        moved = np.flatnonzero(pieces != pieces[labels])
        moved = moved[np.unique(pieces[moved], return_index=True)[1]]
        return pa.RecordBatch.from_arrays([pa.array(prints[moved]), pa.array(prints[labels[moved]])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            *plain, shingles = batch.columns
            for task, two, second, fp, bits, piece, value in zip(*(c.to_pylist() for c in plain), shingles):
                if at != (task, two):
                    if len(held) > 1:
                        yield compare(at[1], held)
                    at, held = (task, two), []
                held.append((second, fp, bits, piece, _read(value).copy()))
        if len(held) > 1:
            yield compare(at[1], held)
        release_memory()

    return rows.mapInArrow(run, "u long, v long")


def _named(nodes: DataFrame, roots: DataFrame, name: str) -> DataFrame:
    """``nodes`` with column ``name``: the root of fp, or fp itself."""
    joined = nodes.join(roots, F.col("fp") == F.col("node"), "left").withColumn(name, F.coalesce("root_of", "fp"))
    return joined.drop("node", "root_of")


def links(docs: DataFrame, distinct: DataFrame, doc_id: str, text: str, block: int, repeated: bool) -> DataFrame:
    """node, root: components of the digests in ``distinct`` (fp, least, size, bits, keys) that link.

    ``repeated``: whether rows of ``docs`` may have both id and set in common.
    """
    keyed = checkpointed(distinct.select("fp", "bits", F.explode("keys").alias("key")))
    least = keyed.groupBy("key").agg(F.min_by(F.struct("fp", "bits"), "fp").alias("low"), F.count("*").alias("n")).filter("n > 1")
    meets = keyed.join(least.select("key", "low"), "key").filter(F.col("fp") != F.col("low.fp"))
    meets = meets.select("fp", F.col("low.fp").alias("low"), F.bit_count(F.col("bits").bitwiseXOR(F.col("low.bits"))).alias("apart")).distinct()
    meets = checkpointed(meets)
    groups = checkpointed(connected_components(meets.select(F.col("fp").alias("u"), F.col("low").alias("v"))))
    held = distinct.join(groups, F.col("fp") == F.col("node")).select("fp", "least", "size", "bits", "root")
    held = checkpointed(held)
    volume = held.agg(F.sum("size").alias("n")).first()["n"] or 0
    width = width_for(docs.sparkSession, 8 * volume)
    with ExitStack() as stack:
        sets = _sets(docs, held.select(F.col("least").alias("at_id"), "fp"), doc_id, text)
        sets = stack.enter_context(scratch(sets.dropDuplicates(["fp"]) if repeated else sets))
        near = meets.filter(F.col("apart") <= RADIUS).select("fp", "low")
        stars = checkpointed(_stars(near, sets, width, STAR_BLOCK))
        pieces = connected_components(stars).select("node", F.col("root").alias("root_of"))
        loose = checkpointed(_named(held.select("fp", "bits", "root"), pieces, "piece"))
        across = checkpointed(_across(loose, sets, width, block))
    return connected_components(stars.unionByName(across))


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, fp, component_id of every row of ``docs``."""
    found = docs.select(F.col(doc_id).alias("doc_id"), marks(F.col(text)).alias("found"))
    marked = checkpointed(found.select("doc_id", "found.*"))
    firsts = (F.first(c).alias(c) for c in ("size", "bits", "keys"))
    distinct = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), *firsts))
    repeated = not marked.groupBy("doc_id", "fp").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    roots = checkpointed(links(docs, distinct, doc_id, text, block, repeated)).select("node", F.col("root").alias("root_of"))
    rooted = _named(distinct.select("fp", "least"), roots, "root")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return marked.select("doc_id", "fp").join(checkpointed(named), "fp").select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` per component: that of the smallest id (any one, if rows repeat)."""
    return drop_components(docs, components(docs, doc_id, text), digest, doc_id, text)
