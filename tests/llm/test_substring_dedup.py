import hashlib
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veridra.llm import queries
from veridra.llm import substring_dedup as dedup

from .helpers import AWKWARD, docs, empty


def brute(rows, window):
    """doc_id -> (n_words, removed marks) by sets of word tuples."""
    words = [(k, (t or "").encode().split()) for k, t in rows]
    first = {}
    for key, w in words:
        for i in range(len(w) - window + 1):
            at = tuple(w[i : i + window])
            first[at] = min(first.get(at, key), key)
    out = []
    for key, w in words:
        marks = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < key:
                marks[i : i + window] = [True] * window
        out.append((key, len(w), sum(marks), b" ".join(x for x, m in zip(w, marks) if not m).decode()))
    return sorted(out)


def check(spark, rows, window=5, **sizes):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = dedup.remove_repeats(frame, window=window, **sizes)
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in found.collect())
    assert got == brute(rows, window)


def test_against_brute_force(spark):
    chooser = np.random.default_rng(4)
    passages = [" ".join(f"p{j}w{k}" for k in range(12)) for j in range(4)]
    rows = []
    for key in range(60):
        parts = [" ".join(f"u{key}x{k}" for k in range(int(chooser.integers(0, 9))))]
        parts += [passages[int(chooser.integers(4))] for _ in range(int(chooser.integers(0, 4)))]
        chooser.shuffle(parts)
        rows.append((int(chooser.integers(0, 50)), " ".join(parts)))
    check(spark, rows)
    check(spark, rows, block_bytes=300, range_windows=20)
    check(spark, [(k * 10**14, t) for k, t in rows], block_bytes=300, range_windows=20)


def test_copies_and_short_documents(spark):
    text = " ".join(f"w{i}" for i in range(20))
    check(spark, [(1, text), (2, text), (3, text + " tail"), (4, "w0 w1 w2 w3"), (5, ""), (6, None), (6, None)], block_bytes=64)


def test_own_repeats_stay(spark):
    check(spark, [(1, "a b c d e " * 10), (1, "a b c d e " * 10)])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=50, unique=True))
def test_packing_of_hashes(values):
    hashes = np.array(sorted(values), np.uint64)
    assert np.array_equal(dedup.unpack_sorted(dedup.pack_sorted(hashes)), hashes)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 60)))
def test_intervals(starts):
    spans = dedup.removal_intervals(np.array(sorted(starts), np.int64), 5)
    covered = {i for s in starts for i in range(s, s + 5)}
    assert {i for a, b in spans for i in range(a, b)} == covered
    assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))


def test_rolling_hashes_do_not_depend_on_place():
    hasher = dedup.RollingHasher(3)
    words = [b"a", b"b", b"c", b"x", b"a", b"b", b"c"]
    h = hasher(words)
    assert h[0] == h[4] and len(set(h.tolist())) == 4
    assert hasher(words[:2]).size == 0


def test_blocks_rise_with_ids(spark):
    ids = [5, -3, 10**15, 7, 8, 9, None, 2**63 - 1, -(2**62)]
    frame = spark.createDataFrame([(i, "some words here") for i in ids], "doc_id long, text string")
    deal = dedup.deal_blocks(frame, "doc_id", "text", 20)
    known = np.array(sorted(dedup.LAST_ID if i is None else i for i in ids))
    blocks = deal.block_of(known, np.zeros(known.size, np.int64))
    assert (np.diff(blocks) >= 0).all() and len(set(blocks.tolist())) > 4
    assert [deal.rank_of(int(b)) for b in blocks] == sorted(deal.rank_of(int(b)) for b in blocks)


def test_blocks_of_repeated_and_absent_ids_are_bounded(spark):
    """Rows of one id, equal texts among them, share a rank and not a block."""
    rows = [(k, "few words") for k in range(40)] + [(7, f"text number {k % 3}") for k in range(400)] + [(None, "no id")] * 300
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    deal = dedup.deal_blocks(frame, "doc_id", "text", 500)
    assert len(deal.firsts) < 8 and deal.parts.max() > 5
    assert deal.parts[np.searchsorted(deal.firsts, 7)] >= 10
    chooser = np.random.default_rng(1)
    dealt = deal.block_of(np.full(400, 7), chooser.integers(0, 1 << 31, 400))
    assert np.bincount(dealt - dealt.min()).max() < 120 and len({deal.rank_of(int(b)) for b in dealt}) == 1
    passage = " ".join(f"p{k}" for k in range(8))
    check(spark, [(k, f"{passage} own{k}") for k in (3, 5, 5, 5, 5, 9, 9)] + [(5, f"{passage} x{k}") for k in range(60)], block_bytes=200, range_windows=9)


def test_null_ids_come_last_whatever_their_number(spark):
    passage = " ".join(f"p{k}" for k in range(8))
    frame = spark.createDataFrame([(None, f"{passage} z{k} {passage}") for k in range(50)] + [(2, passage)], "doc_id long, text string")
    found = dedup.remove_repeats(frame, window=5, block_bytes=300, range_windows=10).collect()
    assert sorted(r["n_removed"] for r in found) == [0] + [16] * 50
    alone = dedup.remove_repeats(frame.filter("doc_id IS NULL"), window=5, block_bytes=300, range_windows=10).collect()
    assert {r["n_removed"] for r in alone} == {0}


def test_ranges_without_hashes_cost_nothing():
    """A hundred million ranges and few hashes."""
    hashes = np.sort(np.random.default_rng(3).integers(0, 2**64 - 1, 5000, dtype=np.uint64))
    began = time.perf_counter()
    parts = list(dedup.packed_ranges(hashes, 10**8))
    assert time.perf_counter() - began < 1
    assert [i for i, _ in parts] == sorted(set(dedup.range_of(hashes, 10**8).tolist()))
    assert np.array_equal(np.concatenate([dedup.unpack_sorted(x) for _, x in parts]), hashes)
    edges = np.array([0, 2**32 - 1, 2**63, 2**64 - 1], np.uint64)
    assert dedup.range_of(edges, 7).tolist() == [0, 0, 3, 6]


def test_awkward_rows(spark):
    found = dedup.remove_repeats(docs(spark), window=3)
    assert found.count() == len(AWKWARD)
    assert set(docs(spark).columns) <= set(found.columns)
    row = found.filter("doc_id = 5").first()
    assert row["n_words"] == 6 and row["n_removed"] == 6 and row["block"] == "clash"
    assert dedup.remove_repeats(empty(spark)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    wanted = [(k, n, m, hashlib.sha256(t.encode()).hexdigest()) for k, n, m, t in brute(rows, 50)]
    found = queries.op6_substring_dedup(spark, sf).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted(map(tuple, found.collect())) == wanted
    assert found.agg(F.sum("n_removed")).first()[0] > 0
