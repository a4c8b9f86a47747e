"""Byte-level BPE encoding and decoding.

Encoding keeps, for every piece of text that the split pattern yields, a segment
tree over its byte positions. A leaf holds the rank of the pair that starts at
that byte and continues with the next live token; a node holds the smallest
(rank, position) below it, so the root is the leftmost pair of least rank. One
merge changes three leaves (the merged position, its left neighbour and the
vanished right half) and each is repaired along one root path. Pieces of a
similar length are advanced together, one merge each per round, as rows of the
same arrays.

Defined results: a null or empty text encodes to no ids; null ids decode to no
bytes; an id without a token raises ``ValueError``. Texts are taken whole, and a
piece of any length costs O(n log n).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .splitting import Splitter

#: encoded pieces that a Python worker remembers: those since the last turn, and as many of the turn before
CACHE_PIECES = 200_000
#: longer pieces are not remembered
CACHE_PIECE_CHARS = 64
#: characters of text that a worker splits before it encodes their new pieces
CHUNK_CHARS = 1 << 21
#: rows of a batch that a worker turns into Python objects at once
PART_ROWS = 500


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PairRanks:
    """Open-addressed table from pairs of ids to the rank of their merge."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        bits = max(4, (4 * len(pairs)).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys, self._ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        keys = np.fromiter(pairs, np.int64, len(pairs))
        values = np.fromiter(pairs.values(), np.int32, len(pairs))
        slots = self._slots(keys)
        while keys.size:
            free = np.flatnonzero(self._keys[slots] < 0)
            slot, first = np.unique(slots[free], return_index=True)
            placed = free[first]
            self._keys[slot], self._ranks[slot] = keys[placed], values[placed]
            rest = np.ones(keys.size, bool)
            rest[placed] = False
            keys, values, slots = keys[rest], values[rest], (slots[rest] + 1) & self._mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self._shift).view(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; -1 where there is no merge or an id is negative."""
        keys = left.astype(np.int64) << 32 | right
        keys[(left < 0) | (right < 0)] = -1
        slots = self._slots(keys)
        found = self._keys[slots]
        ranks = np.where(found == keys, self._ranks[slots], np.int32(-1))
        open_ = np.flatnonzero((found != keys) & (found >= 0) & (keys >= 0))
        while open_.size:
            slots[open_] = (slots[open_] + 1) & self._mask
            found = self._keys[slots[open_]]
            hit = found == keys[open_]
            ranks[open_[hit]] = self._ranks[slots[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return ranks


class ByteBPE:
    """Encoder and decoder for one table of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pair_ranks = PairRanks(ranks)
        tokens = {rank: token for token, rank in ranks.items()}
        known = [tokens.get(i) for i in range(max(tokens) + 1)]
        self._sizes = np.array([-1 if t is None else len(t) for t in known], np.int64)
        self._text = np.frombuffer(b"".join(t or b"" for t in known), np.uint8)
        self._starts = np.cumsum(np.maximum(self._sizes, 0)) - np.maximum(self._sizes, 0)

    def _encode_rows(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Encode pieces of 2 to ``width`` bytes (a power of two) as rows of one forest."""
        rows = len(pieces)
        kind = np.int32 if len(self._sizes) * width < 1 << 31 else np.int64
        none = np.iinfo(kind).max
        lengths = np.fromiter(map(len, pieces), np.int32, rows)
        spots = np.arange(width, dtype=np.int32)
        ids = np.full((rows, width + 1), -1, np.int32)
        ids[:, :width][spots < lengths[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        # the live neighbours; past the end stands a column that stays empty
        after = np.empty((rows, width + 1), np.int32)
        after[:, :width] = spots + 1
        after[:, width] = width
        after[np.arange(rows), lengths - 1] = width
        before = np.broadcast_to(np.arange(-1, width, dtype=np.int32), (rows, width + 1)).copy()

        def leaves(rank: np.ndarray, spot: np.ndarray) -> np.ndarray:
            return np.where(rank >= 0, rank.astype(kind) * kind(width) + spot.astype(kind), kind(none))

        tree = np.full((rows, 2 * width), none, kind)
        rank = self.pair_ranks(ids[:, : width - 1].ravel(), ids[:, 1:width].ravel()).reshape(rows, width - 1)
        tree[:, width : 2 * width - 1] = leaves(rank, spots[:-1])
        level = width
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])

        live = np.flatnonzero(tree[:, 1] < none)
        while live.size:
            best = tree[live, 1]
            here, new = best % kind(width), (best // kind(width)).astype(np.int32)
            gone = after[live, here]
            right = after[live, gone]
            left = before[live, here]
            ids[live, here] = new
            ids[live, gone] = -1
            after[live, here] = right
            before[live, right] = here
            with_left = np.flatnonzero(left >= 0)
            row_left, left = live[with_left], left[with_left]
            ranks = self.pair_ranks(
                np.concatenate([new, ids[row_left, left]]), np.concatenate([ids[live, right], new[with_left]])
            )
            tree[live, width + gone] = none
            tree[live, width + here] = leaves(ranks[: live.size], here)
            tree[row_left, width + left] = leaves(ranks[live.size :], left)
            row = np.concatenate([live, live, row_left])
            node = width + np.concatenate([here, gone, left])
            for _ in range(width.bit_length() - 1):
                node >>= 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
            live = live[tree[live, 1] < none]

        kept = ids[:, :width] >= 0
        flat = ids[:, :width][kept].astype("<i4", copy=False).tobytes()
        ends = (4 * np.cumsum(kept.sum(1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Little-endian int32 ids of each piece."""
        out: list[bytes] = [b""] * len(pieces)
        classes: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if (whole := self.ranks.get(piece)) is not None:
                out[i] = whole.to_bytes(4, "little")
            elif piece:
                classes.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
        for width, members in classes.items():
            members = iter(members)
            while part := list(islice(members, max(1, (1 << 17) // width))):
                for i, ids in zip(part, self._encode_rows([pieces[i] for i in part], width)):
                    out[i] = ids
        return out

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that ``ids`` stand for, joined, and where each id's bytes end."""
        if ids.size and not 0 <= ids.min() <= ids.max() < len(self._sizes):
            raise ValueError("an id has no token")
        sizes = self._sizes[ids]
        if ids.size and sizes.min() < 0:
            raise ValueError("an id has no token")
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if ids.size else 0
        at = np.repeat(self._starts[ids] - ends + sizes, sizes) + np.arange(total)
        return self._text[at], ends


class TextEncoder:
    """Splits texts by a pattern and encodes the pieces, remembering frequent ones.

    When ``known`` is full it becomes ``older`` and a new one begins; a piece that is
    met again moves over, so what is met at least once a turn is never forgotten.
    """

    def __init__(self, bpe: ByteBPE, pattern: str):
        self.bpe, self.split = bpe, Splitter(pattern)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian int32 ids of each text."""
        out, chunk, chars = [], [], 0
        for text in texts:
            chunk.append(text or "")
            chars += len(chunk[-1])
            if chars >= CHUNK_CHARS:
                out += self._chunk(chunk)
                chunk, chars = [], 0
        return out + self._chunk(chunk)

    def _chunk(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHE_PIECES:
            self.older, self.known = self.known, {}
        split = [self.split(text) for text in texts]
        missing = set().union(*split).difference(self.known)
        again = self.older.keys() & missing
        self.known.update((piece, self.older[piece]) for piece in again)
        new = list(missing - again)
        found = dict(zip(new, self.bpe.encode_pieces([piece.encode() for piece in new])))
        ids_of = self.known
        long = {p: x for p, x in found.items() if len(p) > CACHE_PIECE_CHARS}
        ids_of.update((p, x) for p, x in found.items() if p not in long)
        if not long:
            return [b"".join(map(ids_of.__getitem__, pieces)) for pieces in split]
        return [b"".join([ids_of[p] if p in ids_of else long[p] for p in pieces]) for pieces in split]


_BPE: dict[str, ByteBPE] = {}
_ENCODERS: dict[tuple[str, str], TextEncoder] = {}


def _bpe(path: str) -> ByteBPE:
    if path not in _BPE:
        _BPE[path] = ByteBPE(read_ranks(path))
    return _BPE[path]


def id_lists(encoded: list[bytes]) -> pa.Array:
    """``array<int>`` from little-endian int32 bytes."""
    offsets = np.zeros(len(encoded) + 1, np.int64)
    np.cumsum([len(x) // 4 for x in encoded], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.frombuffer(b"".join(encoded), "<i4")))


def _encoded(texts: pa.Array, ranks_path: str, pattern: str) -> Iterator[list[bytes]]:
    """The ids of each text, a part of the batch at a time: long texts are not all decoded at once."""
    key = (ranks_path, pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = TextEncoder(_bpe(ranks_path), pattern)
    for start in range(0, len(texts), PART_ROWS):
        yield _ENCODERS[key].encode(texts.slice(start, PART_ROWS).to_pylist())


def _decoded(bpe: ByteBPE, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """The bytes of consecutive lists of ``sizes`` ids."""
    text, token_ends = bpe.decode(ids)
    cuts = np.concatenate([[0], token_ends])[np.concatenate([[0], np.cumsum(sizes)])]
    raw, cuts = text.tobytes(), cuts.tolist()
    return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


def encode(text: Column, ranks_path: str, pattern: str) -> Column:
    """``array<int>``: ids of the whole text, each match of ``pattern`` encoded separately."""

    @F.arrow_udf("array<int>")
    def byte_bpe_encode(texts: pa.Array) -> pa.Array:
        return id_lists([ids for part in _encoded(texts, ranks_path, pattern) for ids in part])

    return byte_bpe_encode(text)


def decode(ids: Column, ranks_path: str) -> Column:
    """``binary``: the bytes that the ids stand for, which need not be valid UTF-8."""

    @F.arrow_udf("binary")
    def byte_bpe_decode(lists: pa.Array) -> pa.Array:
        decoded = []
        for start in range(0, len(lists), PART_ROWS):
            part = lists.slice(start, PART_ROWS)
            sizes = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)
            decoded += _decoded(_bpe(ranks_path), part.flatten().to_numpy(zero_copy_only=False), sizes)
        return pa.array(decoded, pa.binary())

    return byte_bpe_decode(ids)


def round_trip(text: Column, ranks_path: str, pattern: str) -> Column:
    """``struct<ids array<int>, decoded binary>``: ``encode``, and ``decode`` of its ids.

    A plan that uses the ids beside what they decode to would encode twice, because
    Spark runs each chain of Python functions by itself.
    """

    @F.arrow_udf("struct<ids array<int>, decoded binary>")
    def byte_bpe_round_trip(texts: pa.Array) -> pa.Array:
        ids, decoded = [], []
        for part in _encoded(texts, ranks_path, pattern):
            ids += part
            decoded += _decoded(_bpe(ranks_path), np.frombuffer(b"".join(part), "<i4"), np.array([len(x) // 4 for x in part]))
        return pa.StructArray.from_arrays([id_lists(ids), pa.array(decoded, pa.binary())], ["ids", "decoded"])

    return byte_bpe_round_trip(text)
