"""Near copies by five-word shingles, against all pairs of texts."""

import numpy as np

import corpus_pipeline
from veridra.llm import near_copies

from .helpers import AWKWARD, docs, empty
from .test_near_duplicates import roots


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = {k: plain_shingles(t) for k, t in rows}
    alike = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    return roots(sorted(sets), alike)


def edited(seed, texts=12, copies=6, words=100):
    """Texts, and copies with up to four words replaced."""
    chooser = np.random.default_rng(seed)
    rows = []
    for t in range(texts):
        base = [f"t{t}w{i}" for i in range(words)]
        rows.append(base)
        for c in range(copies):
            copy = list(base)
            for at in chooser.choice(words, int(chooser.integers(1, 5)), replace=False):
                copy[at] = f"c{c}x{at}"
            rows.append(copy)
    return [(i, " ".join(r), "en", "a", 0) for i, r in enumerate(rows)]


def test_pipeline_drops_texts_with_one_word_replaced(spark):
    rows = []
    for t in range(20):
        base = [f"t{t}w{i}" for i in range(100)]
        rows += [(2 * t, " ".join(base), "en", "a", 0), (2 * t + 1, " ".join([*base[:50], "other", *base[51:]]), "en", "a", 0)]
    kept = corpus_pipeline.drop_near_duplicates(spark, docs(spark, rows), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, 40, 2))


def test_components_against_all_pairs(spark):
    rows = edited(1)
    wanted = brute([r[:2] for r in rows])
    assert 12 < len(set(wanted.values())) < len(rows)  # some copies are alike, some are not
    for block in (near_copies.BLOCK, 3):
        found = near_copies.components(docs(spark, rows), block=block).collect()
        assert {r["doc_id"]: r["component_id"] for r in found} == wanted


def test_table_against_all_pairs(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    wanted = brute([(r["doc_id"], r["text"]) for r in table.collect()])
    found = near_copies.components(table).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == wanted


def test_awkward_rows(spark):
    kept = near_copies.drop_near_copies(docs(spark))
    assert kept.columns == docs(spark).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "4", "6", "7", "8", "9", "None"]
    assert near_copies.components(docs(spark)).count() == len(AWKWARD)
    assert near_copies.drop_near_copies(empty(spark)).count() == 0
    twice = docs(spark, [*edited(2, 2, 2), (0, "quite other words here", "en", "a", 0)])
    assert near_copies.components(twice).filter("component_id = 0").count() >= 1


def test_large_groups_of_copies_cost_no_pairs(spark, monkeypatch):
    """A chain of edits, a star of copies, and groups that stars leave in pieces."""
    monkeypatch.setattr(near_copies, "STAR_BLOCK", 7)
    chooser = np.random.default_rng(3)
    base = [f"b{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 40):  # each differs from the base in one word
        copy = list(base)
        copy[int(chooser.integers(120))] = f"x{i}"
        rows.append((i, " ".join(copy)))
    drift = [f"d{i}" for i in range(120)]
    for i in range(40, 70):  # each differs from the one before
        drift[int(chooser.integers(120))] = f"y{i}"
        rows.append((i, " ".join(drift)))
    wanted = brute(rows)
    for block in (near_copies.BLOCK, 4):
        found = near_copies.components(docs(spark, [(k, t, "en", "a", 0) for k, t in rows]), block=block).collect()
        assert {r["doc_id"]: r["component_id"] for r in found} == wanted


def test_linking_confirms_by_the_sets():
    """Fingerprints within the radius do not link by themselves, and pieces that hang together are not compared."""
    sets = [np.arange(i * 10, i * 10 + 100, dtype=np.uint64) for i in range(6)]  # neighbours share 90 of 110
    prints = np.zeros(6, np.uint64)
    assert near_copies.link_sets(sets, prints).tolist() == [0] * 6
    assert near_copies.link_sets(sets[::2], prints[::2]).tolist() == [0, 1, 2]
    assert near_copies.link_sets(sets[::2], prints[::2], np.array([5, 9, 5])).tolist() == [0, 1, 0]
    far = np.array([0, 2**64 - 1], np.uint64)
    assert near_copies.link_sets([sets[0], sets[0]], far).tolist() == [0, 1]
    assert near_copies.link_sets(sets[:4], prints[:4], split=2).tolist() == [0, 1, 1, 3]


def test_wide_radius_counts_every_lane():
    from veridra.llm import simhash

    chooser = np.random.default_rng(2)
    one = chooser.integers(0, 2**64 - 1, 70, dtype=np.uint64)
    flips = [np.uint64(sum(1 << int(b) for b in chooser.choice(64, n, replace=False))) for n in range(64)]
    members = np.concatenate([one, one[0] ^ np.array(flips, np.uint64)])
    for radius in (0, 1, 2, 3, 6, 7, 24, 31, 32, 63):
        found = {(int(i), int(j)) for a, b in simhash.compare_blocks(one, members, radius) for i, j in zip(a, b)}
        apart = np.array([[int(x ^ y).bit_count() for y in members] for x in one])
        assert found == set(zip(*map(lambda v: v.tolist(), np.nonzero(apart <= radius))))
