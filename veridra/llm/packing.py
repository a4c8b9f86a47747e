"""Harmonic packing of token sequences.

Every document becomes pieces of at most ``capacity`` tokens. A full piece is a
sequence of its own. A remainder of length r belongs to class k when it lies in
(capacity/(k+1), capacity/k]; k of them fill one bin, so a bin of class k takes a
fixed count of pieces and needs no search. A remainder that would leave more than
``slack`` tokens of its bin empty is cut: the largest length of the next class
goes there and the rest is classed again. Pieces too short for any class below
``classes`` share a last class that is filled token by token.

Workers pack their own partition only and hold just the open bins (under
``classes`` bins of ``capacity`` tokens). What is left open at the end of a
partition is joined and cut into full sequences; the last of them is cut at
powers of two, which need no padding. Nothing is shuffled, and a worker that is
lost is packed again from its own input partition.

Defined results: a null or empty text is a document of just the end id; repeated
rows and repeated or null ``doc_id`` are documents of their own; an empty table
gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import id_lists
from .common import release_memory
from .splitting import is_plain

CAPACITY, CLASSES, SLACK = 1024, 32, 10

PIECES = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, "
    "sequence_tokens long, token_ids binary"
)


def plan_cuts(total: int, capacity: int, classes: int, slack: int) -> list[tuple[int, int]]:
    """(length, class) of a document's pieces in order; class 0 is the token-wise one."""
    cuts = [(capacity, 1)] * (total // capacity)
    rest = total % capacity
    while rest:
        k = capacity // rest
        if k >= classes:
            cuts.append((rest, 0))
            break
        if capacity - k * rest <= slack:
            cuts.append((rest, k))
            break
        cut = capacity // (k + 1)
        cuts.append((cut, k + 1) if k + 1 < classes else (cut, 0))
        rest -= cut
    return cuts


class HarmonicPacker:
    """Packs the documents of one partition; yields lists of placed pieces.

    A placed piece is (doc_id, start, length, doc_tokens, sequence, offset,
    sequence_tokens, ids), where ids are little-endian int32 bytes.
    """

    def __init__(self, capacity: int = CAPACITY, classes: int = CLASSES, slack: int = SLACK):
        self.capacity, self.classes, self.slack = capacity, classes, slack
        self.open: dict[int, list] = {}
        self.loose, self.loose_tokens, self.sequences = [], 0, 0

    def _close(self, pieces: list) -> list:
        used, offset, placed = sum(len(p[3]) // 4 for p in pieces), 0, []
        for doc_id, start, doc_tokens, ids in pieces:
            placed.append((doc_id, start, len(ids) // 4, doc_tokens, self.sequences, offset, used, ids))
            offset += len(ids) // 4
        self.sequences += 1
        return placed

    def _take(self, tokens: int) -> list:
        """Cut ``tokens`` tokens off the front of the loose pieces."""
        taken, need = [], tokens
        while need:
            doc_id, start, doc_tokens, ids = self.loose[-1]
            if len(ids) // 4 <= need:
                taken.append(self.loose.pop())
                need -= len(ids) // 4
            else:
                taken.append((doc_id, start, doc_tokens, ids[: 4 * need]))
                self.loose[-1] = (doc_id, start + need, doc_tokens, ids[4 * need :])
                need = 0
        self.loose_tokens -= tokens
        return self._close(taken)

    def add(self, doc_id, ids: bytes) -> list:
        placed, start, total = [], 0, len(ids) // 4
        for length, k in plan_cuts(total, self.capacity, self.classes, self.slack):
            piece = (doc_id, start, total, ids[4 * start : 4 * (start + length)])
            start += length
            if k:
                pieces = self.open.setdefault(k, [])
                pieces.append(piece)
                if len(pieces) == k:
                    placed += self._close(self.open.pop(k))
            else:
                self.loose.append(piece)
                self.loose_tokens += length
                if self.loose_tokens >= self.capacity:
                    placed += self._take(self.capacity)
        return placed

    def finish(self) -> list:
        placed = []
        for k in sorted(self.open):
            self.loose += self.open.pop(k)
        self.loose_tokens = sum(len(p[3]) // 4 for p in self.loose)
        while self.loose_tokens:
            size = min(self.capacity, 1 << (self.loose_tokens.bit_length() - 1))
            placed += self._take(size)
        return placed


def _packed(rows: Iterator[tuple[int | None, bytes]], packer: HarmonicPacker) -> Iterator[pa.RecordBatch]:
    """``PIECES`` batches from (doc_id, ids as little-endian int32 bytes)."""
    from pyspark import TaskContext

    base = TaskContext.get().partitionId() << 40
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "token_ids"]

    def batch(placed: list) -> pa.RecordBatch:
        columns = list(zip(*placed))
        columns[4] = [base + s for s in columns[4]]
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:7]), pa.array(columns[7], pa.binary())], names)

    placed: list = []
    for key, ids in rows:
        placed += packer.add(key, ids)
        if len(placed) > 20_000:
            yield batch(placed)
            placed = []
    placed += packer.finish()
    if placed:
        yield batch(placed)
    del placed
    release_memory()


def pack(
    docs: DataFrame, ids: str = "ids", doc_id: str = "doc_id", capacity: int = CAPACITY, classes: int = CLASSES, slack: int = SLACK
) -> DataFrame:
    """One row per piece (``PIECES``) of ``docs``, whose column ``ids`` holds array<int>.

    ``sequence_id`` is the partition's number and a count within it; ``offset`` is
    the place in the sequence, ``sequence_tokens`` its tokens before padding and
    ``token_ids`` the piece's ids as little-endian 32-bit bytes. Documents without
    ids have no pieces.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes]]:
        for batch in batches:
            lists = batch.column(1)
            flat = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")
            ends = lists.offsets.to_numpy()
            for i, key in enumerate(batch.column(0)):
                if ends[i] < ends[i + 1]:
                    yield key.as_py(), flat[ends[i] : ends[i + 1]].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _packed(rows(batches), HarmonicPacker(capacity, classes, slack))

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, PIECES)


def pack_texts(
    docs: DataFrame,
    tokenizer_path: str,
    text: str = "text",
    doc_id: str = "doc_id",
    end_id: int | None = 0,
    capacity: int = CAPACITY,
    classes: int = CLASSES,
    slack: int = SLACK,
) -> DataFrame:
    """``pack`` of the texts' ids (``tokenize``), one worker doing both."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes]]:
        ids, tail = _tokenizer(tokenizer_path).ids, _end(end_id)
        for batch in batches:
            for key, value in zip(*batch.columns):
                if coded := ids(value.as_py()) + tail:
                    yield key.as_py(), coded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _packed(rows(batches), HarmonicPacker(capacity, classes, slack))

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES)


class VocabularyTokenizer:
    """Ids of texts by a ``tokenizers`` file.

    A byte-level BPE file whose merges stand in the order of their ids is run by
    the faster of the two installed libraries, which then gives the same ids. Any
    other file, and texts with characters whose class may differ between the two
    libraries' Unicode versions, go to ``tokenizers`` itself. Strings of special
    tokens are ordinary text.
    """

    def __init__(self, path: str):
        self.path, self._library = path, None
        with open(path, encoding="utf-8") as file:
            self.quick = _as_ranks(json.load(file))

    @property
    def library(self) -> Tokenizer:
        """Loaded when a text first needs it."""
        if self._library is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            self._library = Tokenizer.from_file(self.path)
            self._library.encode_special_tokens = True
        return self._library

    def ids(self, text: str | None) -> bytes:
        """Little-endian int32 ids of a whole text."""
        if not text:
            return b""
        if self.quick is not None and is_plain(text):
            return self.quick.encode_to_numpy(text, disallowed_special=()).astype("<i4", copy=False).tobytes()
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<i4").tobytes()


#: fixed value: the split pattern of the byte-level pre-tokenizer
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of_sign() -> dict[str, int]:
    """The byte for which each sign of a byte-level vocabulary stands."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _as_ranks(spec: dict) -> tiktoken.Encoding | None:
    """A rank encoding equal to the file's model, or None where it isn't of that kind."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and not any(
        model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    )
    split = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    if not (plain and split) or spec.get("normalizer"):
        return None
    vocab = model["vocab"]
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    special = {t["content"] for t in spec.get("added_tokens", [])}
    signs = _byte_of_sign()
    ranks = {bytes(signs[c] for c in token): i for token, i in vocab.items() if token not in special}
    singles = sorted(i for token, i in ranks.items() if len(token) == 1)
    if merged != sorted(set(merged)) or len(singles) != 256 or len(merged) + 256 != len(ranks) or merged[0] <= singles[-1]:
        return None
    return tiktoken.Encoding("file", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})


_TOKENIZERS: dict[str, VocabularyTokenizer] = {}


def _tokenizer(path: str) -> VocabularyTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = VocabularyTokenizer(path)
    return _TOKENIZERS[path]


def _end(end_id: int | None) -> bytes:
    return b"" if end_id is None else int(end_id).to_bytes(4, "little", signed=True)


def tokenize(text: Column, tokenizer_path: str, end_id: int | None = 0) -> Column:
    """``array<int>``: ids of the whole text, then ``end_id`` if there is one."""

    @F.arrow_udf("array<int>")
    def vocabulary_ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ids, tail = _tokenizer(tokenizer_path).ids, _end(end_id)
        for texts in batches:
            yield id_lists([ids(x.as_py()) + tail for x in texts])
        release_memory()

    return vocabulary_ids(text)
