"""Language identification by words first, then shorter and shorter n-grams.

Training counts every word of every training text. A word that was seen adds, per
language, the logarithm of its relative frequency there. An unseen word backs off: it is
cut into n-grams of the longest order (``MAX_GRAM`` characters down to one) of which at
least half were seen, each step down costing ``BACKOFF``; n-gram frequencies are those of
the training words, edges marked, weighted by count. What one language has not seen
counts there as half a sighting, the same for all languages.

Every word and n-gram of the training texts is part of the model: a table of 64-bit keys
and their frequencies by language. Up to ``MAX_BROADCAST_ROWS`` rows (a key in a
language, 16 bytes each) it travels to the workers; a larger one stays a table, and
``identify`` joins its words with the distinct words of chunks of texts (and its n-grams with
unseen words, where they alone are too many). All ways give the same verdicts;
scores that are joined are rounded to single precision.
``max_words`` and ``max_grams`` of ``learn`` make a smaller model of the most frequent keys, if
that is wanted.

Words and n-grams are told apart by their keys: n of them meet falsely with probability
n^2 / 2^65. Defined results: a null text, a text without a letter and every text under an
empty model is ``und`` with score 0. Ties go to the language that sorts first. The score is
the winner's share of the posterior over languages; ``known`` is the share of the words of
which the model has seen the word or n-grams. Repeated rows have equal verdicts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from contextlib import ExitStack
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import PARTITION_BYTES, checkpointed, release_memory, scratch, shuffle_width
from .splitting import is_plain, plain_pattern

MAX_GRAM, BACKOFF = 4, 1.0
MAX_BROADCAST_ROWS = 4_000_000
UNKNOWN = "und"
VERDICT = "struct<lang_pred string, score double, known double>"

_WORDS = regex.compile(r"\p{L}+(?:\p{M}+\p{L}*)*").findall
_PLAIN_WORDS = re.compile(plain_pattern(r"\p{L}+")).findall
#: words that a worker counts before it hands the counts on, words that it remembers, and n-grams that it counts at once
FLUSH_WORDS, CACHE_WORDS, FLUSH_GRAMS = 150_000, 150_000, 2_000_000
#: words of a chunk of texts, bytes of text for a span of words, and spans at most
CHUNK_WORDS, SPAN_BYTES, MAX_SPANS = 200_000, 32 << 20, 4096
#: keys of texts that are broadcast at most, 8 bytes each
MAX_BROADCAST_KEYS = 1_000_000
#: words of a part of a text, and of a batch of new words, that are scored at once
PART_WORDS, NEW_WORDS = 150_000, 4096
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    lowered = text.lower()
    return _PLAIN_WORDS(lowered) if is_plain(lowered) else _WORDS(lowered)


def grams_of(word: str, order: int) -> list[str]:
    edged = f"<{word}>" if order > 1 else word
    return [edged[i : i + order] for i in range(len(edged) - order + 1)]


_word_key = partial(xxhash.xxh64_intdigest, seed=42)


def word_keys(words: list[str]) -> np.ndarray:
    """The keys of words: those that Spark's ``xxhash64`` gives them."""
    return np.fromiter((_word_key(w.encode()) for w in words), np.uint64, len(words))


def gram_keys(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-grams of ``words``, as ``grams_of`` cuts them, and how many each word has."""
    edged = [f"<{w}>" for w in words] if order > 1 else words
    sizes = np.fromiter(map(len, edged), np.int64, len(edged))
    codes = np.frombuffer("".join(edged).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    counts = np.maximum(sizes - order + 1, 0)
    spots = np.repeat(np.cumsum(sizes) - sizes, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    keys = np.full(spots.size, order, np.uint64)
    for k in range(order):
        keys = (keys + codes[spots + k]) * _FACTOR
        keys ^= keys >> np.uint64(29)
    return keys, counts


@dataclass
class Frequencies:
    """Logarithms of the relative frequencies of keys, by language; ``floor`` where there is none."""

    floor: float
    keys: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))  # sorted
    ends: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    langs: np.ndarray = field(default_factory=lambda: np.empty(0, np.int16))
    logs: np.ndarray = field(default_factory=lambda: np.empty(0, np.float64))

    @classmethod
    def of(cls, keys: np.ndarray, langs: np.ndarray, counts: np.ndarray, totals: np.ndarray) -> Frequencies:
        """From rows of a key, the number of a language, and a count; ``totals`` by language."""
        order = np.lexsort((langs, keys))
        keys, langs, counts = keys[order], langs[order], counts[order]
        lasts = np.flatnonzero(np.append(keys[1:] != keys[:-1], True)) if keys.size else np.empty(0, np.int64)
        return cls(floor_of(totals), keys[lasts], lasts + 1, langs.astype(np.int16), np.log(counts / totals[langs]))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it is unknown."""
        if not self.keys.size:
            return np.full(keys.size, -1)
        places = np.minimum(np.searchsorted(self.keys, keys), self.keys.size - 1)
        return np.where(self.keys[places] == keys, places, -1)

    def rows(self, places: np.ndarray, languages: int) -> np.ndarray:
        """Scores of known keys for all languages."""
        out = np.full((places.size, languages), self.floor)
        ends = self.ends[places]
        sizes = ends - np.where(places > 0, self.ends[places - 1], 0)
        at = np.repeat(ends - np.cumsum(sizes), sizes) + np.arange(sizes.sum())
        out[np.repeat(np.arange(places.size), sizes), self.langs[at]] = self.logs[at]
        return out


def floor_of(totals: np.ndarray) -> float:
    return math.log(0.5 / max(totals.max(initial=1), 1))


@dataclass
class LanguageModel:
    """Frequencies of words, and of n-grams by their order."""

    languages: list[str]
    words: Frequencies
    grams: dict[int, Frequencies]

    def score_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per-language scores of words, backing off where they are unseen, and whether anything of them was seen."""
        size = len(self.languages)
        out, seen = np.zeros((len(words), size)), np.zeros(len(words), bool)
        places = self.words.find(word_keys(words))
        known = np.flatnonzero(places >= 0)
        out[known] = self.words.rows(places[known], size)
        seen[known] = True
        rest = np.flatnonzero(places < 0)
        for order in range(MAX_GRAM, 0, -1):
            if not rest.size or order not in self.grams:
                continue
            keys, counts = gram_keys([words[i] for i in rest], order)
            places = self.grams[order].find(keys)
            hit = np.flatnonzero(places >= 0)
            owner = np.repeat(np.arange(rest.size), counts)[hit]
            found = np.bincount(owner, minlength=rest.size)
            enough = (found > 0) & (2 * found >= counts)
            sums = np.zeros((rest.size, size))
            for start in range(0, hit.size, NEW_WORDS):
                part = slice(start, start + NEW_WORDS)
                np.add.at(sums, owner[part], self.grams[order].rows(places[hit[part]], size))
            out[rest[enough]] = sums[enough] / found[enough, None] - BACKOFF * (MAX_GRAM - order)
            seen[rest[enough]] = True
            rest = rest[~enough]
        return out, seen


def verdict_of(languages: list[str], total: np.ndarray) -> tuple[str, float]:
    best = int(np.argmax(total))
    return languages[best], float(1.0 / np.exp(np.clip(total - total[best], -700, 0)).sum())


class Classifier:
    """Applies a model to texts, remembering the scores of words."""

    def __init__(self, model: LanguageModel):
        self.model, self.known = model, {}
        self.table = np.zeros((0, len(model.languages) + 1))

    def __call__(self, text: str | None) -> tuple[str, float, float]:
        words = words_of(text) if text else []
        if not words or not self.model.languages:
            return UNKNOWN, 0.0, 0.0
        total = np.zeros(self.table.shape[1])
        for start in range(0, len(words), PART_WORDS):  # a longer text is scored in parts
            total += self._total(words[start : start + PART_WORDS])
        return *verdict_of(self.model.languages, total[:-1]), float(total[-1]) / len(words)

    def _total(self, words: list[str]) -> np.ndarray:
        new = list(set(words).difference(self.known))
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known, new = {}, list(set(words))
        if new:
            first = len(self.known)
            if first + len(new) > len(self.table):
                self.table = np.resize(self.table, (max(2 * len(self.table), first + len(new), 1024), self.table.shape[1]))
            new.sort()
            for start in range(0, len(new), NEW_WORDS):
                part = new[start : start + NEW_WORDS]
                at = slice(first + start, first + start + len(part))
                self.table[at, :-1], self.table[at, -1] = self.model.score_words(part)
            self.known.update(zip(new, range(first, first + len(new))))
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        return self.table[at].sum(0)


def count_words(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """lang, word, n over all of ``docs``; pre-aggregated in the workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        held = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, words in counts.items():
                n = pa.array(words.values(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(words)), pa.array(words, pa.string()), n], ["lang", "word", "n"])

        for batch in batches:
            for text, lang in zip(*batch.columns):
                words = counts.setdefault(lang.as_py(), Counter())
                before = len(words)
                words.update(words_of(text.as_py()))
                held += len(words) - before
                if held > FLUSH_WORDS:
                    yield from rows()
                    counts.clear()
                    held = 0
        yield from rows()
        counts.clear()
        release_memory()

    rows = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text), F.col(lang))
    partial_counts = rows.mapInArrow(run, "lang string, word string, n long")
    return partial_counts.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def count_grams(counts: DataFrame) -> DataFrame:
    """gram_order, key, lang, n of the n-grams of all words in ``counts`` (lang, word, n)."""
    names = ["gram_order", "key", "lang", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list] = {}
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, order), parts in held.items():
                keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                n = np.zeros(keys.size, np.int64)
                np.add.at(n, place, np.concatenate([n for _, n in parts]))
                columns = [pa.repeat(pa.scalar(order, pa.int32()), keys.size), pa.array(keys.view(np.int64)), pa.repeat(lang, keys.size), pa.array(n)]
                yield pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            words, n = batch.column(1).to_pylist(), batch.column(2).to_numpy()
            for lang in sorted(set(langs.tolist())):
                at = np.flatnonzero(langs == lang)
                for order in range(1, MAX_GRAM + 1):
                    keys, per_word = gram_keys([words[i] for i in at], order)
                    held.setdefault((lang, order), []).append((keys, np.repeat(n[at], per_word)))
                    size += keys.size
            if size > FLUSH_GRAMS:
                yield from rows()
                held.clear()
                size = 0
        yield from rows()
        held.clear()
        release_memory()

    parts = counts.select("lang", "word", "n").mapInArrow(run, "gram_order int, key long, lang string, n long")
    return parts.groupBy("gram_order", "key", "lang").agg(F.sum("n").alias("n"))


def _most_frequent(counts: DataFrame, keys: list[str], limit: int | None, by: list[str]) -> DataFrame:
    """The rows of the ``limit`` most frequent ``keys`` within ``by``."""
    if limit is None:
        return counts
    totals = counts.groupBy(*by, *keys).agg(F.sum("n").alias("total"))
    order = Window.partitionBy(*by).orderBy(F.desc("total"), *keys) if by else Window.partitionBy(F.lit(0)).orderBy(F.desc("total"), *keys)
    kept = totals.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
    return counts.join(kept.select(*by, *keys), [*by, *keys], "left_semi")


@dataclass
class LanguageTables:
    """A model that stays a table: gram_order (0: words), key, lang_no, n."""

    languages: list[str]
    totals: np.ndarray  # by order and language
    rows: DataFrame
    gram_rows: int
    limit: int  # rows that are broadcast

    def local(self, words: bool = True) -> LanguageModel:
        """The model in memory; without ``words``, its n-grams."""
        found = {o: [] for o in range(MAX_GRAM + 1)}
        rows = self.rows if words else self.rows.filter("gram_order > 0")
        table = rows.select("gram_order", "key", "lang_no", "n").toArrow()
        orders, keys, langs, n = (table[c].to_numpy() for c in table.column_names)
        for order in found:
            at = orders == order
            found[order] = Frequencies.of(keys[at].view(np.uint64), langs[at].astype(np.int64), n[at], self.totals[order])
        return LanguageModel(self.languages, found.pop(0), found)


def learn(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    max_words: int | None = None,
    max_grams: int | None = None,
    max_broadcast_rows: int | None = None,
) -> LanguageModel | LanguageTables:
    """Learn from every row of ``docs`` with a text and a language."""
    limit = MAX_BROADCAST_ROWS if max_broadcast_rows is None else max_broadcast_rows
    with scratch(count_words(docs, text, lang)) as counts:
        sums = counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()  # a row for each language
        languages = sorted(r["lang"] for r in sums)
        if not languages:
            return LanguageModel([], Frequencies(0.0), {})
        numbers = F.create_map(*(F.lit(x) for pair in zip(languages, range(len(languages))) for x in pair))
        words = counts.select(F.lit(0).alias("gram_order"), F.xxhash64("word").alias("key"), "lang", "n")
        grams = count_grams(counts)
        words = _most_frequent(words, ["key"], max_words, [])
        grams = _most_frequent(grams, ["key"], max_grams, ["gram_order"])
        rows = words.unionByName(grams).select("gram_order", "key", F.element_at(numbers, F.col("lang")).cast("int").alias("lang_no"), "n")
        with scratch(rows) as held:
            totals = np.ones((MAX_GRAM + 1, len(languages)))
            size = 0
            by_order = held.filter("gram_order > 0").groupBy("gram_order", "lang_no").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect()
            for r in by_order:
                totals[r["gram_order"], r["lang_no"]] = r["n"]
                size += r["rows"]
            for r in sums:
                totals[0, languages.index(r["lang"])] = r["n"]
            gram_rows = size
            size += held.filter("gram_order = 0").count()
            if size <= limit:
                return LanguageTables(languages, totals, held, gram_rows, limit).local()
            return LanguageTables(languages, totals, checkpointed(held), gram_rows, limit)


def predict(text: Column, model: LanguageModel, spark) -> Column:
    """``VERDICT`` of a whole text; the model is broadcast."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(VERDICT)
    def language_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        classify = Classifier(shared.value)
        for texts in batches:
            yield _verdicts([classify(text.as_py()) for text in texts])
        del classify
        release_memory()

    return language_of(text)


def _verdicts(found: list[tuple[str, float, float]]) -> pa.Array:
    columns = list(zip(*found)) or [(), (), ()]
    types = (pa.string(), pa.float64(), pa.float64())
    return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["lang_pred", "score", "known"])


def pack_places(places: np.ndarray) -> bytes:
    """Rising numbers as steps of two bytes each, or of four where one is larger."""
    steps = np.diff(places, prepend=0)
    return (b"\0" + steps.astype("<u2").tobytes()) if steps.max(initial=0) < 1 << 16 else (b"\1" + steps.astype("<u4").tobytes())


def unpack_places(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(packed, "<u4" if packed[0] else "<u2", -1, 1), dtype=np.int64)


def _requests(docs: DataFrame, text: str, spans: int) -> DataFrame:
    """The words of ``docs`` once for each chunk of texts, and each text as places in its chunk's words.

    kind 0, a text: chunk, text_key, places and counts of its distinct words. kind 1, the
    words of a chunk that fall in a span: chunk, span, their places and themselves.
    """
    names = ["kind", "chunk", "span", "text_key", "places", "counts", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        known: dict[str, int] = {}
        texts: list[tuple] = []

        def rows() -> Iterator[pa.RecordBatch]:
            keys = word_keys(list(known))
            at = ((keys >> np.uint64(32)) * np.uint64(spans) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            words = np.array(list(known), object)[order]
            starts = np.flatnonzero(np.diff(at[order], prepend=-1))
            asked = [
                (1, chunk, int(at[order[i]]), None, pack_places(order[i:j]), None, "\n".join(words[i:j]))
                for i, j in zip(starts.tolist(), [*starts[1:].tolist(), order.size])
            ]
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*texts, *asked), types)], names)

        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = Counter(words_of(value.as_py()))
                places = np.fromiter((known.setdefault(w, len(known)) for w in found), np.int64, len(found))
                order = np.argsort(places)
                counts = np.fromiter(found.values(), "<u4", len(found))[order]
                texts.append((0, chunk, None, key, pack_places(places[order]), counts.astype("<u1" if counts.max(initial=0) < 256 else "<u4").tobytes(), None))
                if len(known) > CHUNK_WORDS:
                    yield from rows()
                    known.clear()
                    texts.clear()
                    chunk += 1
        if texts:
            yield from rows()
        known.clear()
        release_memory()

    rows = docs.filter(F.col(text).isNotNull()).select(F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "kind int, chunk long, span long, text_key long, places binary, counts binary, words string")


def _unseen_grams(words: DataFrame) -> DataFrame:
    """key of a word, gram_order, its n-grams' gram_key, and cuts, how many it has of that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, words = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for order in range(1, MAX_GRAM + 1):
                grams, cuts = gram_keys(words, order)
                columns = [np.repeat(keys, cuts), np.full(grams.size, order, np.int32), grams.view(np.int64), np.repeat(cuts, cuts)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "gram_order", "gram_key", "cuts"])

    return words.select("key", "word").mapInArrow(run, "key long, gram_order int, gram_key long, cuts long")


def _backed_off(unseen: DataFrame, grams: LanguageModel) -> DataFrame:
    """span, key, scores, seen of words (span, key, word) by n-grams that fit in memory."""
    shared = unseen.sparkSession.sparkContext.broadcast(grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), NEW_WORDS):
                batch = whole.slice(start, NEW_WORDS)
                scores, seen = shared.value.score_words(batch.column(2).to_pylist())
                lists = pa.array(scores.astype(np.float32).tolist(), pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], lists, pa.array(seen)], ["span", "key", "scores", "seen"])
        release_memory()

    return unseen.select("span", "key", "word").mapInArrow(run, "span long, key long, scores array<float>, seen boolean")


def _scored_words(words: DataFrame, model: LanguageTables, stack: ExitStack) -> DataFrame:
    """span, key, scores (one for each language), seen of the distinct ``words`` (span, key, word)."""
    size = len(model.languages)
    totals = F.array(*(F.array(*map(F.lit, t)) for t in model.totals.tolist()))
    logs = F.log(F.col("n") / F.element_at(F.element_at(totals, F.col("gram_order") + 1), F.col("lang_no") + 1))
    floors = F.element_at(F.array(*(F.lit(floor_of(t)) for t in model.totals)), F.col("gram_order") + 1)
    by_lang = [F.max(F.when(F.col("lang_no") == i, logs)).alias(f"l{i}") for i in range(size)]
    in_memory = model.gram_rows <= model.limit
    rows = (model.rows.filter("gram_order = 0") if in_memory else model.rows).groupBy("gram_order", "key").agg(*by_lang)
    rows = rows.select("gram_order", "key", F.array(*(F.coalesce(f"l{i}", floors).cast("float") for i in range(size))).alias("scores"))
    rows = stack.enter_context(scratch(rows))
    whole = rows.filter("gram_order = 0").select(F.col("key").alias("k"), "scores")
    met = stack.enter_context(scratch(words.join(whole, F.col("key") == F.col("k"), "left").select("span", "key", F.when(F.col("k").isNull(), F.col("word")).alias("word"), "scores")))
    unseen = met.filter("scores IS NULL")
    known = met.filter("scores IS NOT NULL").select("span", "key", "scores", F.lit(True).alias("seen"))
    if in_memory:
        return known.unionByName(_backed_off(unseen, model.local(words=False)))
    grams = rows.filter("gram_order > 0").select(F.col("gram_order").alias("o"), F.col("key").alias("gram_key"), F.col("scores").alias("gram_scores"))
    cut = _unseen_grams(unseen).join(grams, ["gram_key"]).filter("o = gram_order")
    sums = [F.sum(F.col("gram_scores")[i]).alias(f"s{i}") for i in range(size)]
    found = cut.groupBy("key", "gram_order").agg(F.count("*").alias("found"), F.first("cuts").alias("cuts"), *sums).filter("2 * found >= cuts")
    down = F.lit(BACKOFF) * (F.lit(MAX_GRAM) - F.col("gram_order"))
    means = F.array(*((F.col(f"s{i}") / F.col("found") - down).cast("float") for i in range(size))).alias("scores")
    backed = found.select("key", "gram_order", means).groupBy("key").agg(F.max_by("scores", "gram_order").alias("b_scores"))
    joined = unseen.select("span", "key").join(backed.withColumnRenamed("key", "k"), F.col("key") == F.col("k"), "left")
    nothing = F.array(*(F.lit(0.0).cast("float") for _ in range(size)))
    backed = joined.select("span", "key", F.coalesce("b_scores", nothing).alias("scores"), F.col("b_scores").isNotNull().alias("seen"))
    return known.unionByName(backed)


def _text_verdicts(docs: DataFrame, model: LanguageTables, text: str) -> DataFrame:
    """text_key, found: the ``VERDICT`` of every text that is not null, by the model's tables.

    A chunk asks for the scores of its distinct words span by span, as one row each, and is
    answered in the same order; a word that many chunks hold is scored once.
    """
    spark, size, languages = docs.sparkSession, len(model.languages), model.languages
    volume = docs.agg(F.sum(F.octet_length(text).cast("long")).alias("n")).first()["n"] or 0
    spans = min(MAX_SPANS, -(-volume // SPAN_BYTES) or 1)
    width = max(shuffle_width(spark), spans)
    chunks = max(shuffle_width(spark), volume // PARTITION_BYTES)
    with ExitStack() as stack:
        held = stack.enter_context(scratch(_requests(docs, text, spans)))
        asked = held.filter("kind = 1").select("chunk", "span", "places", "words")

        def distinct(key: tuple, table: pa.Table) -> pa.Table:
            words = sorted(set().union(*(w.as_py().split("\n") for w in table["words"])))
            keys = pa.array(word_keys(words).view(np.int64))
            return pa.table({"span": pa.array([key[0].as_py()] * len(words), pa.int64()), "key": keys, "word": pa.array(words, pa.string())})

        dealt = asked.repartition(width, "span")
        words = stack.enter_context(scratch(dealt.groupBy("span").applyInArrow(distinct, "span long, key long, word string")))
        scored = _scored_words(words, model, stack)

        def answer(key: tuple, requests: pa.Table, table: pa.Table) -> pa.Table:
            order = np.argsort(table["key"].to_numpy().view(np.uint64))
            keys = table["key"].to_numpy().view(np.uint64)[order]
            scores = table["scores"].combine_chunks().flatten().to_numpy().reshape(-1, size)[order]
            seen = table["seen"].to_numpy()[order].astype(np.float32)
            known = np.column_stack([scores, seen]).astype("<f4")
            told = [known[np.searchsorted(keys, word_keys(w.as_py().split("\n")))].tobytes() for w in requests["words"]]
            return pa.table({"chunk": requests["chunk"], "places": requests["places"], "told": pa.array(told, pa.binary())})

        pairs = dealt.groupBy("span").cogroup(scored.repartition(width, "span").groupBy("span"))
        answers = pairs.applyInArrow(answer, "chunk long, places binary, told binary")

        def judge(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
            asked = [unpack_places(p.as_py()) for p in answers["places"]]
            table = np.empty((sum(map(len, asked)), size + 1))
            for at, told in zip(asked, answers["told"]):
                table[at] = np.frombuffer(told.as_buffer(), "<f4").reshape(-1, size + 1)
            found = []
            for at, n in zip(texts["places"], texts["counts"]):
                at = unpack_places(at.as_py())
                n = np.frombuffer(n.as_buffer(), "<u1" if len(n.as_buffer()) == at.size else "<u4").astype(float)
                if not at.size:
                    found.append((UNKNOWN, 0.0, 0.0))
                    continue
                total = n @ table[at]
                found.append((*verdict_of(languages, total[:-1]), float(total[-1] / n.sum())))
            return pa.table({"text_key": texts["text_key"], "found": _verdicts(found)})

        texts = held.filter("kind = 0").select("chunk", "text_key", "places", "counts").repartition(chunks, "chunk")
        judged = texts.groupBy("chunk").cogroup(answers.repartition(chunks, "chunk").groupBy("chunk"))
        judged = judged.applyInArrow(judge, f"text_key long, found {VERDICT}")
        return checkpointed(judged.groupBy("text_key").agg(F.min("found").alias("found")))


def identify(docs: DataFrame, model: LanguageModel | LanguageTables, text: str = "text", into: str = "language") -> DataFrame:
    """``docs`` without ``text``, with column ``into``: the ``VERDICT`` of every row."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c != text]
    if isinstance(model, LanguageModel):
        return docs.select(*kept, predict(F.col(text), model, docs.sparkSession).alias(into))
    found = _text_verdicts(docs, model, text).withColumnRenamed("text_key", "veridra_known_key")
    without = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("known"))
    keyed = docs.select(*kept, F.xxhash64(text).alias("veridra_text_key"))
    joined = keyed.join(found.withColumnRenamed("found", "veridra_found"), F.col("veridra_text_key") == F.col("veridra_known_key"), "left")
    return joined.select(*kept, F.coalesce("veridra_found", without).alias(into))


def accepted(verdict: Column, keep: list[str] | None = None) -> Column:
    """Whether a ``VERDICT`` names a language (of ``keep`` if given) of which the model has seen something in the text."""
    good = (verdict["lang_pred"] != F.lit(UNKNOWN)) & (verdict["known"] > 0)
    return good if keep is None else good & verdict["lang_pred"].isin(keep)


def select_texts(docs: DataFrame, model: LanguageModel | LanguageTables, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` whose verdict is ``accepted``.

    A joined model does not shuffle the texts for it while those that go are few.
    """
    spark = docs.sparkSession
    if isinstance(model, LanguageModel):
        judged = docs.withColumn("veridra_verdict", predict(F.col(text), model, spark)).filter(accepted(F.col("veridra_verdict"), keep))
        return judged.select(*(F.col(f"`{c}`") for c in docs.columns))
    found = _text_verdicts(docs, model, text)
    gone = checkpointed(found.filter(~accepted(F.col("found"), keep)).select("text_key"))
    hint = F.broadcast if gone.count() <= MAX_BROADCAST_KEYS else (lambda table: table)
    return docs.filter(F.col(text).isNotNull()).join(hint(gone), F.xxhash64(text) == F.col("text_key"), "left_anti")
