"""Embedding near-duplicates: spherical k-means cells, blocked cosine products.

Equal vectors are grouped first, by hash and by value. Spherical k-means, fitted on a
bounded sample of the distinct vectors, gives cells of about ``CELL_VECTORS``; beyond
``FAN`` cells it has two levels, the second fitted on a bounded sample of every cell of
the first. Centres closer than ``MERGED`` make one cell: a dense group stays whole.

Every vector is a member of one home cell and is compared with the members of that and
of the ``probes`` - 1 next nearest cells. A partner in another cell lies beyond the
hyperplane that parts the two centres, and the angle between x and that plane is
asin(x.(c - c') / |c - c'|): nearest cells for which it exceeds the threshold's angle are
left out. Work and shuffle grow with the number of vectors times ``probes`` and the size
of cells. Links between vectors whose cells are not among each other's nearest are
missed; ``probes`` = None visits every cell that the bound allows, and misses none.

A cell's members are dealt into blocks and its visitors into chunks of bounded bytes; one
task multiplies one chunk with one block in single precision and decides products near
the threshold in double precision. Two vectors that visit each other's cells are linked
in the cell of the higher number. Tasks emit counts and a spanning forest of the links
they found, at most two rows per vector.

Defined results: null vectors, zero vectors, vectors with null or non-finite
components and vectors with a null id link with nothing and are their own component;
vectors are scaled by their largest component before they are multiplied, so that no
finite vector overflows or vanishes; vectors of different lengths do not link; repeated
rows are vectors of their own; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, scratch
from .components import connected_components, local_components

THRESHOLD, PROBES = 0.9, 4
CELL_VECTORS, FAN, ITERATIONS = 1024, 256, 8
#: cosine of centres that belong to one cell
MERGED = 0.85
#: cells of the first level whose second level is searched
FIRST_PROBES = 4
#: numbers in a block of members, and in a chunk of visitors
BLOCK_NUMBERS, CHUNK_NUMBERS = 1 << 18, 1 << 20
#: vectors to fit a level of a cell on at most, and their bytes at most; bytes of centres that are broadcast at most
SAMPLE_ROWS, SAMPLE_BYTES, CENTRE_BYTES = 8192, 32 << 20, 64 << 20


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    if not vectors.size:
        return vectors
    vectors /= np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def spherical_kmeans(vectors: np.ndarray, cells: int, iterations: int = ITERATIONS) -> np.ndarray:
    """Unit centres of at most ``cells`` cells of unit ``vectors``."""
    centres = vectors[np.linspace(0, len(vectors) - 1, min(cells, len(vectors))).astype(int)]
    for _ in range(iterations):
        home = np.argmax(vectors @ centres.T, 1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, vectors)
        norms = np.linalg.norm(sums, axis=1)
        sums[norms > 1e-9] /= norms[norms > 1e-9, None]
        sums[norms <= 1e-9] = centres[norms <= 1e-9]
        centres = sums
    return centres


@dataclass
class Cells:
    """Centres of the cells for vectors of one length."""

    first: int  # cells are numbered across the lengths
    centres: np.ndarray
    top: np.ndarray | None = None  # centres of the first level, if there are two
    under: list[np.ndarray] = field(default_factory=list)  # places of the centres below each of them

    def __post_init__(self):
        size = len(self.centres)
        labels = np.arange(size)
        for start in range(0, size, 1024):
            close = self.centres[start : start + 1024] @ self.centres.T >= MERGED
            labels = local_components(size, *(x + y for x, y in zip(np.nonzero(close), (start, 0))), labels)
        self.cell = np.unique(labels, return_inverse=True)[1].ravel().astype(np.int32) + self.first

    def nearest(self, unit: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the nearest centres of each vector, the nearest first."""
        if self.top is None:
            at = np.broadcast_to(np.arange(len(self.centres)), (len(unit), len(self.centres)))
            near = unit @ self.centres.T
        else:
            tops = np.argsort(-(unit @ self.top.T), axis=1, kind="stable")[:, :FIRST_PROBES]
            width = max(map(len, self.under))
            at, near = np.zeros((len(unit), tops.shape[1] * width), np.int64), np.full((len(unit), tops.shape[1] * width), -2.0)
            for t in np.unique(tops):
                rows, slot = np.nonzero(tops == t)
                below = self.under[t]
                columns = slot[:, None] * width + np.arange(len(below))
                at[rows[:, None], columns] = below
                near[rows[:, None], columns] = unit[rows] @ self.centres[below].T
        order = np.argsort(-near, axis=1, kind="stable")[:, :count]
        return np.take_along_axis(at, order, 1), np.take_along_axis(near, order, 1)

    def visits(self, unit: np.ndarray, margin: float, probes: int | None) -> tuple[np.ndarray, list[np.ndarray]]:
        """Home cell of each vector, and the distinct cells that it visits, home first."""
        if probes is None:
            near = unit @ self.centres.T
            at = np.broadcast_to(np.arange(len(self.centres)), near.shape)
            home = np.argmax(near, 1)
        else:
            at, near = self.nearest(unit, probes)
            home = at[:, 0]
        own = np.einsum("ij,ij->i", unit, self.centres[home])[:, None]
        cosines = (self.centres @ self.centres.T)[home] if probes is None else np.einsum("ij,ikj->ik", self.centres[home], self.centres[at])
        within = (own - near <= margin * np.sqrt(np.maximum(2 - 2 * cosines, 0)) + 1e-9) & (near > -2)
        cells, homes = self.cell[at], self.cell[home]
        return homes, [np.array([h, *sorted(set(c[w].tolist()) - {h})], np.int32) for h, c, w in zip(homes.tolist(), cells, within)]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def linked_rows(left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Matrix of the unit rows of ``left`` and ``right`` whose product reaches ``threshold``."""
    near = left.astype(np.float32) @ right.astype(np.float32).T
    linked = near >= threshold
    i, j = np.nonzero(np.abs(near - threshold) < 1e-4)
    linked[i, j] = np.einsum("ij,ij->i", left[i], right[j]) >= threshold
    return linked


def hash_of(vector: Column) -> Column:
    return F.xxhash64(vector)


def _sound(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, vector (null if it links with nothing) and its hash."""
    v = F.col(embedding)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(
        F.col(vec_id).alias("vec_id"),
        F.when(F.coalesce(sound, F.lit(False)) & F.col(vec_id).isNotNull(), v).alias("vector"),
    )
    return rows.withColumn("h", F.when(F.col("vector").isNotNull(), hash_of(F.col("vector"))))


def _numbered(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct vectors (node, least, copies, vector) of ``rows``, and vec_id, node of every row.

    A vector's node is its hash; vectors that share a hash are told apart by their values.
    """
    held = rows.filter("h IS NOT NULL").groupBy("h", "vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    held = checkpointed(held)
    shared = checkpointed(held.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"))
    if shared.isEmpty():
        return held.select(F.col("h").alias("node"), "least", "copies", "vector"), rows.select("vec_id", F.col("h").alias("node"))
    turn = F.row_number().over(Window.partitionBy("h").orderBy("vector"))
    node = F.when(F.col("turn") > 1, F.xxhash64("h", "turn")).otherwise(F.col("h"))
    odd = checkpointed(held.join(shared, "h", "left_semi").withColumn("turn", turn).withColumn("node", node).drop("turn"))
    distinct = held.join(shared, "h", "left_anti").withColumn("node", F.col("h")).unionByName(odd)
    ours = odd.select(F.col("h").alias("odd_h"), F.col("vector").alias("odd_vector"), F.col("node").alias("odd_node"))
    named = rows.join(ours, (F.col("h") == F.col("odd_h")) & (F.col("vector") == F.col("odd_vector")), "left")
    return distinct.select("node", "least", "copies", "vector"), named.select("vec_id", F.coalesce("odd_node", "h").alias("node"))


def _fit(distinct: DataFrame, d: int, n: int, first: int, cell_vectors: int) -> Cells:
    """Cells for the ``n`` vectors of length ``d`` in ``distinct``."""
    limit = max(64, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * d)))
    wanted = min(-(-n // cell_vectors), FAN * FAN, CENTRE_BYTES // (8 * d))
    ours = distinct.filter(F.size("vector") == d).select("node", "vector")
    # written first: a direct collect would bring every partition's candidates to the driver
    with scratch(ours.orderBy("node").limit(limit)) as rows:
        sample = unit_rows(np.array([v for _, v in sorted((r["node"], r["vector"]) for r in rows.collect())]))
    if wanted <= FAN:
        return Cells(first, spherical_kmeans(sample, wanted))
    top = spherical_kmeans(sample, math.isqrt(wanted - 1) + 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                home = np.argmax(unit_rows(_matrix(batch.column(1))) @ top.T, 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home)], ["node", "vector", "top"])

    kind = dict(distinct.dtypes)["vector"]
    placed = ours.mapInArrow(place, f"node long, vector {kind}, top int")
    counts = {r["top"]: r["n"] for r in placed.groupBy("top").agg(F.count("*").alias("n")).collect()}  # at most FAN rows
    chances = F.create_map(*(F.lit(x) for t, c in counts.items() for x in (t, min(1.0, limit / c))))
    drawn = placed.filter(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < F.element_at(chances, F.col("top")) * (1 << 30))

    def fit(key: tuple, table: pa.Table) -> pa.Table:
        t = key[0].as_py()
        held = table.sort_by("node")
        centres = spherical_kmeans(unit_rows(_matrix(held["vector"])), min(FAN, max(1, round(wanted * counts[t] / n))))
        return pa.table({"top": pa.array([t] * len(centres), pa.int32()), "centre": pa.array(list(centres), pa.list_(pa.float64()))})

    with scratch(drawn.groupBy("top").applyInArrow(fit, "top int, centre array<double>")) as rows:
        found = sorted((r["top"], r["centre"]) for r in rows.collect())  # CENTRE_BYTES at most
    tops = np.array([t for t, _ in found])
    return Cells(first, np.array([c for _, c in found]), top, [np.flatnonzero(tops == t) for t in range(len(top))])


def components(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    threshold: float = THRESHOLD,
    probes: int | None = PROBES,
    cell_vectors: int = CELL_VECTORS,
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors``.

    ``probes`` is the number of cells that a vector visits; None loses no link.
    """
    spark = vectors.sparkSession
    margin = math.sqrt(1 - threshold**2)
    distinct, named = _numbered(checkpointed(_sound(vectors, vec_id, embedding)))

    sizes = distinct.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).collect()
    cells: dict[int, Cells] = {}
    first = 0
    for d, n in sorted((r["d"], r["n"]) for r in sizes):
        cells[d] = _fit(distinct, d, n, first, cell_vectors)
        first = int(cells[d].cell.max()) + 1
    shared = spark.sparkContext.broadcast(cells)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), 1024):
                batch = whole.slice(start, 1024)
                lengths = batch.column(2).value_lengths().to_numpy()
                for d in np.unique(lengths).tolist():
                    part = batch.take(pa.array(np.flatnonzero(lengths == d)))
                    home, visits = shared.value[d].visits(unit_rows(_matrix(part.column(2))), margin, probes)
                    made = [pa.array(home), pa.array(visits, pa.list_(pa.int32()))]
                    yield pa.RecordBatch.from_arrays([*part.columns, *made], ["node", "copies", "vector", "home", "visits"])

    kind = dict(distinct.dtypes)["vector"]
    placed = distinct.select("node", "copies", "vector").mapInArrow(
        assign, f"node long, copies long, vector {kind}, home int, visits array<int>"
    )
    placed = checkpointed(placed)
    share = F.size("vector") / F.lit(BLOCK_NUMBERS)
    members = placed.groupBy(F.col("home").alias("cell")).agg(F.ceil(F.sum(share)).cast("int").alias("blocks"))
    share = F.size("vector") / F.lit(CHUNK_NUMBERS)
    visitors = placed.select(F.explode("visits").alias("cell"), share.alias("share")).groupBy("cell")
    visitors = visitors.agg(F.ceil(F.sum("share")).cast("int").alias("chunks"))
    # at most CENTRE_BYTES of centres for each length of vectors
    grid = F.broadcast(checkpointed(members.join(visitors, "cell")))

    def each(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    part = F.pmod(F.hash("node"), F.col("blocks"))
    chunk = F.pmod(F.hash("node", F.lit(1)), F.col("chunks"))
    held = placed.withColumn("cell", F.col("home")).join(grid, "cell")
    held = held.select("cell", part.alias("block"), each("chunks").alias("chunk"), F.lit(0).alias("role"), "home", "node", "copies", "vector", "visits")
    sent = placed.withColumn("cell", F.explode("visits")).join(grid, "cell")
    none = F.lit(None).cast("array<int>").alias("visits")
    sent = sent.select("cell", each("blocks").alias("block"), chunk.alias("chunk"), F.lit(1).alias("role"), "home", "node", "copies", "vector", none)

    def compare(table: pa.Table) -> pa.Table:
        role = table["role"].to_numpy()
        node, copies, home = (table[c].to_numpy() for c in ("node", "copies", "home"))
        unit = unit_rows(_matrix(table["vector"])) if len(table) else np.empty((0, 0))
        ours, theirs = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        cell = table["cell"][0].as_py()
        # our members by the cells of higher number that they visit: links with those are found there
        visited = table["visits"].take(pa.array(ours)).combine_chunks()
        visitor = np.repeat(np.arange(ours.size), visited.value_lengths().to_numpy())
        elsewhere = visited.flatten().to_numpy()
        order = np.argsort(elsewhere, kind="stable")
        elsewhere, visitor = elsewhere[order], visitor[order]
        counts, labels = np.zeros(len(role), np.int64), np.arange(len(role))
        for start in range(0, theirs.size, 1024):
            some = theirs[start : start + 1024]
            if not ours.size:
                break
            linked = linked_rows(unit[some], unit[ours], threshold)
            linked &= node[some][:, None] != node[ours][None, :]
            for other in np.unique(home[some][linked.any(1)]):
                if other > cell:
                    a, b = np.searchsorted(elsewhere, [other, other + 1])
                    linked[np.ix_(home[some] == other, visitor[a:b])] = False
            counts[some] += linked @ copies[ours]
            across = home[some] != cell
            counts[ours] += copies[some][across] @ linked[across]
            rows = np.flatnonzero(linked.any(1))
            if rows.size:  # visitors with the same partners hang on one of them
                packed = np.packbits(linked[rows], axis=1)
                _, lead, same = np.unique(packed, axis=0, return_index=True, return_inverse=True)
                labels = local_components(len(role), some[rows], some[rows[lead]][same.ravel()], labels)
                i, j = np.nonzero(linked[rows[lead]])
                labels = local_components(len(role), some[rows[lead]][i], ours[j], labels)
        found = np.flatnonzero(counts)
        moved = np.flatnonzero(labels != np.arange(len(role)))
        moved = moved[node[moved] != node[labels[moved]]]
        return pa.table(
            {
                "node": pa.array(np.concatenate([node[found], node[moved]])),
                "links": pa.array(np.concatenate([counts[found], np.zeros(moved.size, np.int64)])),
                "to": pa.array(np.concatenate([np.zeros(found.size, np.int64), node[labels[moved]]]), mask=np.arange(found.size + moved.size) < found.size),
            }
        )

    tasks = held.unionByName(sent).groupBy("cell", "block", "chunk")
    told = checkpointed(tasks.applyInArrow(compare, "node long, links long, to long"))
    counts = told.filter("to IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    edges = told.filter("to IS NOT NULL").select(F.col("node").alias("u"), F.col("to").alias("v"))
    roots = connected_components(edges).withColumnRenamed("node", "of")
    rooted = distinct.select("node", "least", "copies").join(roots, F.col("node") == F.col("of"), "left")
    rooted = checkpointed(rooted.select("node", "least", "copies", F.coalesce("root", "node").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    # a vector's copies link with each other
    whole = rooted.join(least, "root").join(counts, "node", "left")
    whole = whole.select(
        F.col("node").alias("of"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    done = named.join(checkpointed(whole), F.col("node") == F.col("of"), "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return done.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.cast("long").alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
