import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veridra.llm import packing, queries

from .helpers import AWKWARD, docs, empty

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return tokenizer


def check(pieces, wanted):
    """Every document's ids lie in exactly one piece each; sequences are gapless and little padded."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for doc, start, length, total, sequence, offset, used, ids in pieces:
        assert len(ids) == 4 * length and 0 < length <= 1024
        by_doc[doc].append((start, length, total, ids))
        by_sequence[sequence].append((offset, length, used))
    assert set(by_doc) == {d for d, ids in wanted.items() if ids}
    for doc, parts in by_doc.items():
        parts.sort()
        assert b"".join(p[3] for p in parts) == np.array(wanted[doc], "<i4").tobytes()
        assert [p[0] for p in parts] == np.cumsum([0, *(p[1] for p in parts)])[:-1].tolist()
        assert {p[2] for p in parts} == {len(wanted[doc])}
    padding = 0
    for parts in by_sequence.values():
        parts.sort()
        assert [p[0] for p in parts] == np.cumsum([0, *(p[1] for p in parts)])[:-1].tolist()
        used = sum(p[1] for p in parts)
        assert used <= 1024 and {p[2] for p in parts} == {used}
        padding += 0 if used & (used - 1) == 0 else 1024 - used
    return padding


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=60))
def test_packer(lengths):
    packer, placed = packing.HarmonicPacker(), []
    wanted = {k: [(k * 7919 + i) % 50_000 for i in range(n)] for k, n in enumerate(lengths)}
    for k, ids in wanted.items():
        placed += packer.add(k, np.array(ids, "<i4").tobytes())
    placed += packer.finish()
    padding = check(placed, wanted)
    assert padding <= 0.011 * sum(lengths) + 1


def test_cuts_follow_the_classes():
    for total in range(1, 3000):
        cuts = packing.plan_cuts(total, 1024, 32, 10)
        assert sum(n for n, _ in cuts) == total
        assert all(k * n <= 1024 for n, k in cuts) and all(k * n >= 1024 - 31 for n, k in cuts if k)


def test_tokenizer_equals_the_library(library):
    tokenizer = packing.VocabularyTokenizer(PATH)
    assert tokenizer.quick is not None
    for _, text, *_ in AWKWARD:
        assert np.frombuffer(QUICK.ids(text), "<i4").tolist() == library.encode(text or "", add_special_tokens=False).ids
    assert np.frombuffer(tokenizer.ids("<|endoftext|>"), "<i4").tolist() == library.encode("<|endoftext|>", add_special_tokens=False).ids


def test_other_vocabulary():
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = packing.VocabularyTokenizer(path)
    assert tokenizer.quick is None
    assert np.frombuffer(tokenizer.ids("Hello there"), "<i4").tolist() == Tokenizer.from_file(path).encode("Hello there", add_special_tokens=False).ids


def test_awkward_rows(spark, library):
    rows = docs(spark).drop("ids").withColumn("ids", packing.tokenize(F.col("text"), PATH))
    pieces = packing.pack(rows).collect()
    total = sum(len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in AWKWARD)
    assert sum(p["length"] for p in pieces) == total
    assert any(p["doc_id"] is None for p in pieces)
    both = ("doc_id", "start", "length", "sequence_id", "offset")
    at_once = packing.pack_texts(docs(spark), PATH).select(*both).collect()
    assert sorted(map(str, at_once)) == sorted(str(r) for r in packing.pack(rows).select(*both).collect())
    assert packing.pack_texts(empty(spark), PATH).count() == 0
    assert packing.pack_texts(docs(spark), PATH, end_id=None).filter("doc_id = 2").count() == 0
    assert packing.pack(empty(spark).drop("ids").withColumn("ids", packing.tokenize(F.col("text"), PATH))).count() == 0


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    wanted = {d: [*library.encode(t, add_special_tokens=False).ids, 0] for d, t in texts.items()}
    used, tokens = defaultdict(int), 0
    for r in queries.op2_harmonic_packing(spark, sf).collect():
        part = wanted[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        assert r["doc_tokens"] == len(wanted[r["doc_id"]])
        used[r["sequence_id"]] += r["length"]
        tokens += r["length"]
    assert tokens == sum(map(len, wanted.values()))
    assert sum(1024 - n for n in used.values() if n & (n - 1)) < 0.02 * tokens


QUICK = packing.VocabularyTokenizer(PATH)


@settings(max_examples=500, deadline=None)
@given(st.text(st.characters(max_codepoint=0x24F, exclude_categories=["Cs"]), max_size=80) | st.text("ab 'sdlmtrev\n\t  1²½Éß\x85\xa0", max_size=40))
def test_quick_ids_are_the_library_s(library, text):
    """Texts that the rank library encodes: letters, digits, marks and white space of the Latin blocks."""
    assert QUICK.quick is not None and packing.is_plain(text)
    assert np.frombuffer(QUICK.ids(text), "<i4").tolist() == library.encode(text, add_special_tokens=False).ids
