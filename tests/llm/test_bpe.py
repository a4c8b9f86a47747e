import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veridra.llm import bpe, queries
from veridra.llm.splitting import Splitter, plain_pattern

from .helpers import AWKWARD, docs, empty

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.TextEncoder(bpe.ByteBPE(bpe.read_ranks(PATH)), public_tokenizers.PATTERN)


def ids(encoder, text):
    return np.frombuffer(encoder.encode([text])[0], "<i4").tolist()


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=60))
def test_equals_the_library(library, encoder, text):
    assert ids(encoder, text) == library.encode_ordinary(text)
    assert encoder.bpe.decode(np.array(ids(encoder, text), int))[0].tobytes() == text.encode()


def test_long_pieces(library, encoder):
    chooser = random.Random(5)
    for text in ("a" * 9000, "".join(chooser.choice("abehtnß") for _ in range(12_000)), " " * 5000, "中文" * 4000, "1" * 3000):
        assert ids(encoder, text) == library.encode_ordinary(text)


def test_cache_is_bounded(library, encoder, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 3)
    for text in ("one two three four five", "six seven eight nine", "one nine two"):
        assert ids(encoder, text) == library.encode_ordinary(text)


def test_cache_keeps_what_comes_back(encoder, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 4)
    small = bpe.TextEncoder(encoder.bpe, public_tokenizers.PATTERN)
    asked = []
    monkeypatch.setattr(small.bpe, "encode_pieces", lambda pieces, real=small.bpe.encode_pieces: asked.extend(pieces) or real(pieces))
    for i in range(20):
        small.encode([f"often seen{i} once{i}"])
    assert asked.count(b"often") == 1 and len(small.known) + len(small.older) < 30


def test_unknown_ids_fail(encoder):
    with pytest.raises(ValueError):
        encoder.bpe.decode(np.array([50_256]))
    with pytest.raises(ValueError):
        encoder.bpe.decode(np.array([-1]))


def test_splitter_equals_the_pattern():
    import regex

    chooser, whole = random.Random(2), regex.compile(public_tokenizers.PATTERN)
    split = Splitter(public_tokenizers.PATTERN)
    for _ in range(3000):
        text = "".join(chr(chooser.randrange(0x250)) if chooser.random() < 0.5 else chooser.choice(" a1'sd\n") for _ in range(20))
        assert split(text) == whole.findall(text)
    assert plain_pattern(r"\p{Lu}+") is None and plain_pattern(r"[\S]") is None


def test_columns_of_awkward_rows(spark, library):
    rows = docs(spark).withColumn("coded", bpe.encode(F.col("text"), PATH, public_tokenizers.PATTERN))
    found = rows.withColumn("back", bpe.decode(F.col("coded"), PATH)).collect()
    assert len(found) == len(AWKWARD)
    for row in found:
        assert row["coded"] == library.encode_ordinary(row["text"] or "")
        assert bytes(row["back"]) == (row["text"] or "").encode()
    both = rows.select("text", bpe.round_trip(F.col("text"), PATH, public_tokenizers.PATTERN).alias("r")).collect()
    assert sorted((str(r["text"]), r["r"]["ids"], bytes(r["r"]["decoded"])) for r in both) == sorted(
        (str(r["text"]), r["coded"], bytes(r["back"])) for r in found
    )
    assert empty(spark).select(bpe.encode(F.col("text"), PATH, public_tokenizers.PATTERN)).count() == 0
    null = spark.createDataFrame([(None,)], "ids array<int>").select(bpe.decode(F.col("ids"), PATH)).first()
    assert bytes(null[0]) == b""


def test_query(spark, library):
    import hashlib

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = queries.op1_byte_bpe(spark, sf).collect()
    assert {r["doc_id"] for r in found} == set(texts)
    for r in found:
        wanted = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(wanted)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, wanted)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
