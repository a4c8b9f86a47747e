"""SimHash, embeddings and connected components."""

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veridra.llm import components, embedding_dedup, queries, simhash

from .helpers import AWKWARD, docs, empty


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def slow_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@settings(max_examples=100, deadline=None)
@given(st.text("abAB é\n", max_size=40))
def test_fingerprint(text):
    assert simhash.fingerprint_of(text) == signed(slow_print(text))


def test_fingerprints_of_awkward_texts():
    for _, text, *_ in AWKWARD:
        assert simhash.fingerprint_of(text) == signed(slow_print(text))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=150), st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=40))
def test_bit_sliced_comparison(members, queries_):
    near = [q ^ (1 << i) ^ (1 << (i * 7 % 64)) for i, q in enumerate(members[:5])]
    q, m = np.array(queries_ + near, np.uint64), np.array(members, np.uint64)
    found = {(int(i), int(j)) for a, b in simhash.compare_blocks(q, m) for i, j in zip(a, b)}
    assert found == {(i, j) for i, x in enumerate(q.tolist()) for j, y in enumerate(m.tolist()) if (x ^ y).bit_count() <= 3}


def test_keys_cover_the_radius(spark):
    chooser = np.random.default_rng(1)
    rows = []
    for i in range(200):
        x = int(chooser.integers(0, 2**63)) * 2 + 1
        y = x
        for b in chooser.choice(64, 3, replace=False):
            y ^= 1 << int(b)
        rows.append((i, signed(x), signed(y)))
    frame = spark.createDataFrame(rows, "i int, x long, y long")
    shared = frame.select(F.size(F.array_intersect(simhash._keys(F.col("x")), simhash._keys(F.col("y")))).alias("n"))
    assert shared.agg(F.min("n")).first()[0] >= 1


def check_links(spark, prints, **sizes):
    distinct = sorted({signed(p) for p in prints})
    frame = spark.createDataFrame([(p,) for p in distinct], "fp long")
    links = [tuple(r) for r in simhash.links(frame, **sizes).collect()]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 64 for a, b in links)
    brute = [(a, b) for i, a in enumerate(distinct) for b in distinct[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3]
    assert roots(distinct, links) == roots(distinct, brute)


def test_links_against_brute_force(spark):
    chooser = np.random.default_rng(2)
    prints = [int(x) for x in chooser.integers(0, 2**63, 100)]
    for base in prints[:30]:
        for _ in range(6):
            changed = base
            for b in chooser.choice(64, int(chooser.integers(1, 6)), replace=False):
                changed ^= 1 << int(b)
            prints.append(changed)
    prints += [0, 2**64 - 1, 1, 3, 7, 15, 31]
    check_links(spark, prints)


def test_dense_groups_in_small_blocks(spark):
    """Many prints under the same keys, compared block by block."""
    chooser = np.random.default_rng(3)
    base = int(chooser.integers(0, 2**63))
    prints = [base]
    for _ in range(300):
        changed = base
        for b in chooser.choice(64, int(chooser.integers(1, 5)), replace=False):
            changed ^= 1 << int(b)
        prints.append(changed)
    check_links(spark, prints, block=16)
    check_links(spark, prints)


def test_components_of_awkward_rows(spark):
    rows = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.components(docs(spark)).collect()}
    assert sum(1 for _ in simhash.components(docs(spark)).collect()) == len(AWKWARD)
    assert rows[2, 0] == rows[1, 0] == rows[3, 0] == 1
    assert {rows[k] for k in rows if k[0] in (4, 5)} == {4}
    assert simhash.components(empty(spark)).count() == 0
    kept = simhash.drop_near_duplicates(docs(spark))
    assert kept.columns == docs(spark).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "4", "6", "7", "8", "9", "None"]


def test_simhash_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {k: slow_print(t) for k, t in texts.items()}
    keys = sorted(prints)
    values = np.array([prints[k] for k in keys], np.uint64)
    pairs = [(keys[i], keys[int(j)]) for i in range(len(keys)) for j in np.flatnonzero(np.bitwise_count(values[:i] ^ values[i]) <= 3)]
    wanted = roots(keys, pairs)
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op8_simhash(spark, sf).collect()}
    assert found == {k: (f"{prints[k]:016x}", wanted[k]) for k in keys}


def test_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(-5, 200), (200, 201), (7, 7)]
    frame = spark.createDataFrame(links, "u long, v long")
    found = {r["node"]: r["root"] for r in components.connected_components(frame).collect()}
    wanted = roots({n for e in links for n in e}, links)
    assert found == {n: r for n, r in wanted.items()}
    assert components.connected_components(frame.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_local_components(links):
    left, right = (np.array([e[k] for e in links], int) for k in (0, 1))
    half = len(links) // 2
    labels = components.local_components(31, left[:half], right[:half])
    labels = components.local_components(31, left[half:], right[half:], labels)
    assert dict(enumerate(labels.tolist())) == roots(range(31), links)


# embeddings


def brute_embeddings(rows):
    sound = {}
    for i, (key, v) in enumerate(rows):
        if key is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            sound[i] = np.array(v, float) / np.linalg.norm(np.array(v, float))
    links = [(i, j) for i in sound for j in sound if i < j and len(sound[i]) == len(sound[j]) and sound[i] @ sound[j] >= 0.9]
    degree = {i: sum(i in e for e in links) for i in range(len(rows))}
    root = roots(range(len(rows)), links)
    least = {}
    for i, r in root.items():
        if rows[i][0] is not None:
            least[r] = min(least.get(r, rows[i][0]), rows[i][0])
    return sorted((str(rows[i][0]), degree[i], str(least.get(root[i]) if i in sound else rows[i][0])) for i in range(len(rows)))


def check_embeddings(spark, rows, kind="float", **settings):
    frame = spark.createDataFrame([(k, v, 0) for k, v in rows], f"vec_id long, embedding array<{kind}>, label int")
    clashes = ("node", "h", "vector", "home", "visits", "cell", "copies", "kept", "n_links", "component_id")
    frame = frame.withColumns({c: F.lit("clash") for c in clashes})
    found = embedding_dedup.components(frame, **settings).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in found) == brute_embeddings(rows)
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in found)


def cloud(seed, n=250, d=8):
    chooser = np.random.default_rng(seed)
    base = chooser.normal(size=(n // 5, d))
    rows = base[chooser.integers(0, len(base), n)] + chooser.normal(size=(n, d)) * chooser.choice([0.0, 0.1, 0.3], n)[:, None]
    return [(int(i) + 3, [float(x) for x in np.float32(v)]) for i, v in enumerate(rows)]


@pytest.mark.parametrize("fan", [embedding_dedup.FAN, 4])
def test_embeddings_against_brute_force(spark, monkeypatch, fan):
    """All cells that the bound allows: every link, with one level of cells or two."""
    check_embeddings(spark, cloud(1))
    for name, value in (("FAN", fan), ("BLOCK_NUMBERS", 80), ("CHUNK_NUMBERS", 240)):
        monkeypatch.setattr(embedding_dedup, name, value)
    check_embeddings(spark, cloud(2), probes=None, cell_vectors=20)
    check_embeddings(spark, cloud(3, d=3), probes=None, cell_vectors=20)


@pytest.mark.parametrize("fan", [embedding_dedup.FAN, 8])
def test_recall_of_the_nearest_cells(spark, monkeypatch, fan):
    """Groups among vectors without any: nearly all links, none that is not one."""
    monkeypatch.setattr(embedding_dedup, "FAN", fan)
    chooser = np.random.default_rng(11)
    bases, near = chooser.normal(size=(1500, 32)), []
    for k, size in enumerate([2] * 100 + [6] * 30 + [60] * 4):
        near.append(bases[k] + chooser.normal(size=(size, 32)) * chooser.uniform(0.05, 0.35))
    rows = np.concatenate([bases, *near])
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    linked = np.triu(unit @ unit.T >= 0.9, 1)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    found = {r["vec_id"]: r for r in embedding_dedup.components(frame, cell_vectors=64).collect()}
    degree = linked.sum(0) + linked.sum(1)
    assert all(found[i]["n_links"] <= degree[i] for i in found)
    recall = sum(r["n_links"] for r in found.values()) / degree.sum()
    assert recall >= 0.9, recall
    wanted = roots(range(len(rows)), list(zip(*np.nonzero(linked))))
    assert np.mean([found[i]["component_id"] == wanted[i] for i in found]) > 0.9


def test_vectors_that_share_a_hash_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "hash_of", lambda v: (F.get(v, F.lit(0)) > 0).cast("long"))
    check_embeddings(spark, cloud(4, n=120))


@pytest.mark.parametrize("size", [1e200, 1e-200, 5e-324])
def test_very_long_and_very_short_vectors(spark, size):
    rows = [(1, [size, size]), (2, [1.0, 1.0]), (3, [size, 0.0]), (4, [0.0, size]), (5, [size, -size])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.components(frame).collect()}
    assert found == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4), 5: (0, 5)}


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0])]
    rows += [(8, [None, 1.0]), (9, []), (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (11, [-1.0, 0.0]), (12, [1e-30, 1e-38]), (13, [3e38, 3e38])]
    check_embeddings(spark, rows)
    check_embeddings(spark, [(1, None)])
    assert embedding_dedup.components(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_visits_lose_no_partner():
    chooser = np.random.default_rng(9)
    vectors = embedding_dedup.unit_rows(chooser.normal(size=(600, 4)))
    cells = embedding_dedup.Cells(5, embedding_dedup.spherical_kmeans(vectors, 25))
    home, visits = cells.visits(vectors, np.sqrt(1 - 0.81), None)
    near = vectors @ vectors.T >= 0.9
    assert all(home[j] in visits[i] for i, j in zip(*np.nonzero(near)))
    assert np.mean([len(v) for v in visits]) < 0.5 * 25
    _, few = cells.visits(vectors, np.sqrt(1 - 0.81), 3)
    assert all(v[0] == h and len(v) <= 3 and set(v) <= set(w) for h, v, w in zip(home, few, visits))


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_embedding_query(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    found = queries.op10_embedding_dedup(spark, path).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in found) == brute_embeddings(rows)


def test_dropping_by_shuffle_equals_dropping_by_broadcast(spark, monkeypatch):
    rows = [(k, f"some words about topic {k % 7} and nothing else", "en", "a", 0) for k in range(40)]
    one = sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs(spark, rows)).collect())
    monkeypatch.setattr(simhash, "MAX_BROADCAST_IDS", 0)
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs(spark, rows)).collect()) == one
    # one id with two texts stays if either does
    twice = docs(spark, [(1, "a b c d", "en", "a", 0), (2, "a b c d", "en", "a", 0), (2, "quite other words here", "en", "a", 0)])
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(twice).collect()) == [1, 2]
