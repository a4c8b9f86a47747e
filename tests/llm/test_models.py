"""Language ID and the quality classifier."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veridra.llm import langid, quality_model, queries

from .helpers import AWKWARD, docs, empty

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_words():
    assert langid.words_of("Ab'c 12 É-f") == ["ab", "c", "é", "f"]
    assert "".join(langid.words_of("x" * 1000)) == "x" * 1000
    assert langid.words_of("éa") == ["éa"]


def test_keys_of_grams():
    words = ["a", "ab", "héllo", "中文", "\U0001d51e" * 3, "", "x" * 300]
    for order in range(1, langid.MAX_GRAM + 1):
        keys, counts = langid.gram_keys(words, order)
        cut = [langid.grams_of(w, order) for w in words]
        assert counts.tolist() == [len(c) for c in cut]
        by_key = {}
        for key, gram in zip(keys.tolist(), [g for c in cut for g in c]):
            assert by_key.setdefault(key, gram) == gram
        assert len(set(by_key.values())) == len(by_key)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 2**31), max_size=50))
def test_packing_of_places(places):
    rising = np.array(sorted(places), np.int64)
    assert langid.unpack_places(langid.pack_places(rising)).tolist() == rising.tolist()


def test_keys_of_words_are_those_of_the_tables(spark):
    words = ["a", "héllo", "中文", "x" * 100]
    frame = spark.createDataFrame([(w,) for w in words], "word string").select("word", F.xxhash64("word").alias("k"))
    found = {r["word"]: r["k"] for r in frame.collect()}
    assert langid.word_keys(words).view(np.int64).tolist() == [found[w] for w in words]


def test_counts_cover_every_text(spark):
    rows = [(i, "uno dos", "es", "s", 0) for i in range(7)] + [(9, "one", "en", "s", 0), (10, None, "en", "s", 0), (11, "x", None, "s", 0)]
    counts = {(r["lang"], r["word"]): r["n"] for r in langid.count_words(docs(spark, rows), "text", "lang").collect()}
    assert counts == {("es", "uno"): 7, ("es", "dos"): 7, ("en", "one"): 1}


def frequencies(rows, totals, keys_of):
    """From (text, language number, count)."""
    keys = np.concatenate([keys_of([t]) for t, _, _ in rows]) if rows else np.empty(0, np.uint64)
    return langid.Frequencies.of(keys, np.array([x for _, x, _ in rows], int), np.array([n for _, _, n in rows], float), np.array(totals, float))


def test_backoff():
    words = frequencies([("the", 0, 5), ("the", 1, 1)], [10, 10], langid.word_keys)
    grams = {o: frequencies([], [10, 10], langid.word_keys) for o in (1, 2, 3)}
    grams[4] = frequencies([("de", 0, 1), ("de", 1, 5)], [10, 10], lambda w: langid.gram_keys(w, 4)[0])
    grams[1] = frequencies([("q", 0, 9)], [10, 10], lambda w: langid.gram_keys(w, 1)[0])
    found, seen = langid.LanguageModel(["de", "en"], words, grams).score_words(["the", "de", "q", "zzz"])
    assert np.allclose(found[0], np.log([0.5, 0.1])) and np.allclose(found[1], np.log([0.1, 0.5]))
    assert np.allclose(found[2], np.log([0.9, 0.05]) - 3 * langid.BACKOFF) and np.allclose(found[3], 0)
    assert seen.tolist() == [True, True, True, False]


def test_long_texts_and_small_memory(monkeypatch):
    words = frequencies([("the", 0, 1), ("the", 1, 9)], [10, 10], langid.word_keys)
    model = langid.LanguageModel(["de", "en"], words, {})
    text = "the " * 50 + " ".join("abcdefghij"[i % 10] * (i % 7 + 1) for i in range(60))
    whole = langid.Classifier(model)(text)
    for name in ("CACHE_WORDS", "PART_WORDS", "NEW_WORDS"):
        monkeypatch.setattr(langid, name, 5)
    assert langid.Classifier(model)(text) == pytest.approx(whole) and whole[0] == "en"


class PlainModel:
    """The same rules with dictionaries of words and n-grams."""

    def __init__(self, rows):
        self.words, self.grams = {}, {o: {} for o in range(1, langid.MAX_GRAM + 1)}
        self.languages = sorted({lang for lang, text in rows if langid.words_of(text)})
        for lang, text in rows:
            for word in langid.words_of(text):
                self._count(self.words, word, lang)
                for order, held in self.grams.items():
                    for gram in langid.grams_of(word, order):
                        self._count(held, gram, lang)
        self.totals = {0: self._sums(self.words)} | {o: self._sums(g) for o, g in self.grams.items()}

    def _count(self, held, key, lang):
        of = held.setdefault(key, {})
        of[lang] = of.get(lang, 0) + 1

    def _sums(self, held):
        return {x: sum(of.get(x, 0) for of in held.values()) or 1 for x in self.languages}

    def logs(self, order, of):
        totals = self.totals[order]
        return [math.log(of[x] / totals[x]) if x in of else math.log(0.5 / max(totals.values())) for x in self.languages]

    def word(self, word):
        if word in self.words:
            return self.logs(0, self.words[word])
        for order in range(langid.MAX_GRAM, 0, -1):
            cut = langid.grams_of(word, order)
            hits = [self.logs(order, self.grams[order][g]) for g in cut if g in self.grams[order]]
            if hits and 2 * len(hits) >= len(cut):
                return [sum(h) / len(hits) - langid.BACKOFF * (langid.MAX_GRAM - order) for h in zip(*hits)]
        return [0.0] * len(self.languages)

    def verdict(self, text):
        words = langid.words_of(text or "")
        if not words or not self.languages:
            return "und", 0.0
        totals = [sum(s) for s in zip(*map(self.word, words))]
        best = max(range(len(totals)), key=lambda i: (totals[i], -i))
        return self.languages[best], 1 / sum(math.exp(max(-700, t - totals[best])) for t in totals)


@pytest.mark.parametrize("rows", [10**9, "n-grams", 0])
def test_verdicts_against_plain_counting(spark, rows):
    """Broadcast, its words joined, and joined, over a whole table: every word and n-gram counts."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = table.collect()
    learned = [r for r in texts if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    plain = PlainModel([(r["lang"], r["text"]) for r in learned if r["lang"] and r["text"]])
    training = table.filter("crc32(cast(doc_id as string)) % 4 <> 2")
    limit = langid.learn(training, max_broadcast_rows=0).gram_rows if rows == "n-grams" else rows
    model = langid.learn(training, max_broadcast_rows=limit)
    assert isinstance(model, langid.LanguageModel if rows == 10**9 else langid.LanguageTables)
    found = {r["doc_id"]: r["language"] for r in langid.identify(table, model).collect()}
    assert len(found) == len(texts)
    for r in texts:
        lang, score = plain.verdict(r["text"])
        assert (found[r["doc_id"]]["lang_pred"], found[r["doc_id"]]["score"]) == (lang, pytest.approx(score, abs=1e-6 if rows == 10**9 else 1e-3)), r["doc_id"]


@pytest.mark.parametrize("rows", [10**9, 0])
def test_ties_repeated_rows_and_unknown_scripts(spark, rows):
    frame = docs(spark, [(1, "uno dos", "es", "a", 0), (2, "one two", "en", "a", 0), (2, "one two", "en", "a", 0), (3, "uno one one uno", None, "a", 0)])
    frame = frame.unionByName(docs(spark, [(4, "中文", None, "a", 0), (5, "中文", None, "a", 0), (6, None, None, "a", 0), (7, "12 !", None, "a", 0), (None, "uno", None, "a", 0)]))
    balanced = docs(spark, [(1, "uno dos", "es", "a", 0), (2, "one two", "en", "a", 0)])
    found = langid.identify(frame, langid.learn(balanced, max_broadcast_rows=rows)).collect()
    by_id = {r["doc_id"]: r["language"] for r in found}
    assert len(found) == 9 and found[0]["word"] == "clash"
    assert by_id[3]["lang_pred"] == "en" and by_id[3]["score"] == pytest.approx(0.5)  # a tie: the first in order
    assert by_id[4] == by_id[5] and by_id[4]["known"] == 0 and by_id[4]["lang_pred"] in ("en", "es")
    assert by_id[6]["lang_pred"] == by_id[7]["lang_pred"] == "und" and by_id[None]["lang_pred"] == "es"


def test_smaller_models_on_request(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    small = langid.learn(table, max_words=100, max_grams=50)
    assert small.words.keys.size == 100 and all(g.keys.size <= 50 for g in small.grams.values())
    whole = langid.learn(table)
    assert whole.words.keys.size > 1000 and set(small.words.keys.tolist()) <= set(whole.words.keys.tolist())


def test_awkward_texts(spark):
    model = langid.learn(docs(spark))
    found = docs(spark).select("doc_id", langid.predict(F.col("text"), model, spark).alias("r")).collect()
    by_id = {r["doc_id"]: r["r"] for r in found}
    assert len(found) == len(AWKWARD)
    for key in (1, 2, 3, 9):
        assert by_id[key]["lang_pred"] == "und" and by_id[key]["score"] == 0
    assert by_id[4]["lang_pred"] == "en" and 0 < by_id[4]["score"] <= 1
    nothing = langid.learn(empty(spark))
    assert docs(spark).select(langid.predict(F.col("text"), nothing, spark)["lang_pred"]).distinct().collect()[0][0] == "und"
    for rows in (10**9, 0):
        kept = langid.select_texts(docs(spark), langid.learn(docs(spark), max_broadcast_rows=rows))
        assert kept.columns == docs(spark).columns and kept.count() == len(AWKWARD) - 4
    assert langid.select_texts(docs(spark), nothing).count() == 0
    english = langid.select_texts(docs(spark), model, keep=["fr"])
    assert [r["doc_id"] for r in english.collect()] == [7]


def test_language_query(spark, documents):
    rows = queries.op9_language_id(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(documents)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    judged = [r["lang_pred"] == documents[r["doc_id"]]["lang"] for r in rows if r["held_out"] and documents[r["doc_id"]]["lang"]]
    assert np.mean(judged) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_hashing():
    hashed = quality_model.Hasher()
    index, value = hashed("One two two two TWO 12 #!")
    assert np.isclose((value**2).sum(), 1.0) and (np.diff(index) > 0).all()
    assert np.array_equal(hashed("one two")[0], hashed("one  two\n")[0])
    assert hashed(None)[0].size == hashed(" \n")[0].size == 0


def test_learning_separates():
    hashed = quality_model.Hasher()
    rows = [(*hashed(f"good words number {i} here"), 1) for i in range(40)] + [(*hashed(f"spam spam | buy {i}"), 0) for i in range(40)]
    weights = quality_model.fit(rows)
    dots = [weights[i] @ v + weights[-1] for i, v, _ in rows]
    assert min(dots[:40]) > max(dots[40:])


def test_sample_is_bounded_and_ignores_order(spark):
    rows = [(i, i % 2, 0) for i in range(200)] + [(3, 1, 0), (3, 1, 0), (None, 1, 0), (500, None, 0)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    one = quality_model.labelled_sample(labels, max_rows=50)
    other = quality_model.labelled_sample(labels.orderBy(F.desc("doc_id")), max_rows=50)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))
    assert one.count() == one.select("label_id").distinct().count() == 50
    assert quality_model.labelled_sample(labels).count() == 200


def test_awkward_training(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, quality int")
    weights = quality_model.train(docs(spark), quality_model.labelled_sample(labels))
    scores = docs(spark).select(quality_model.score(F.col("text"), weights, spark)).collect()
    assert len(scores) == len(AWKWARD) and all(0 <= r[0] <= 1 for r in scores)
    nothing = quality_model.train(docs(spark), quality_model.labelled_sample(labels.limit(0)))
    assert docs(spark).select(quality_model.score(F.col("text"), nothing, spark)).first()[0] == 0.5
    assert empty(spark).select(quality_model.score(F.col("text"), weights, spark)).count() == 0


def test_quality_query(spark, documents):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.op7_quality_classifier(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(documents)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    judged = [r["predicted"] == labels[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(judged) > 50 and np.mean(judged) > 0.95


def plain_vector(text, bits):
    """The hashed n-grams of a text, one at a time."""
    import re

    runs = [r for r in re.findall(r"[^\W\d_]+|\d+|(?:[^\s\w]|_)+", text or "")]
    hashes = []
    for k, run in enumerate(runs):
        if run[0].isalpha():
            run = ("^" if len(run) > 1 and run.isupper() else "") + run.lower()
        elif run[0].isnumeric():
            run = "0"
        hashes.append(xxhash.xxh64_intdigest(run.encode(), 7))
    same = [k > 0 and hashes[k] == hashes[k - 1] for k in range(len(hashes))]
    hashes = [int(quality_model._SAME) if s else h for h, s in zip(hashes, same)]
    keys = hashes + [(a * int(quality_model._STEP) + b) % 2**64 for a, b in zip(hashes, hashes[1:])]
    found = Counter((((k ^ k >> 29) * int(quality_model._MIX)) % 2**64) >> (64 - bits) for k in keys)
    return {i: math.sqrt(n / len(keys)) for i, n in found.items()}


def plain_fit(rows, bits, epochs):
    """Follow-the-regularised-leader with dictionaries, as the papers write it."""
    z, n = Counter(), Counter()
    rows = [({**v, 1 << bits: 1.0}, y) for v, y in rows]

    def weight(i):
        if abs(z[i]) <= quality_model.L1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return (sign * quality_model.L1 - z[i]) / ((quality_model.BETA + math.sqrt(n[i])) / quality_model.ALPHA + quality_model.L2)

    order = np.random.default_rng(11)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            vector, label = rows[k]
            w = {i: weight(i) for i in vector}
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(w[i] * v for i, v in vector.items())))))
            for i, v in vector.items():
                g = (p - label) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality_model.ALPHA * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z}


def test_scores_against_plain_learning(spark, documents):
    """The trained weights and the scores of texts, over the labelled texts of a table."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    sample = quality_model.labelled_sample(labels.filter("crc32(cast(doc_id as string)) % 5 <> 0"), max_rows=150)
    table = spark.read.parquet(f"{SF}/documents.parquet")
    bits = 12
    weights = quality_model.train(table, sample, bits=bits)
    named = {str(r["label_id"]): (r["label_id"], r["label"]) for r in sample.collect()}
    rows = [(plain_vector(documents[named[k][0]]["text"], bits), named[k][1]) for k in sorted(named)]
    plain = plain_fit(rows, bits, quality_model.EPOCHS)
    assert np.allclose(weights, [plain.get(i, 0.0) for i in range((1 << bits) + 1)], atol=1e-3)
    some = table.filter("doc_id % 7 = 0").select("doc_id", quality_model.score(F.col("text"), weights, spark, bits).alias("s")).collect()
    for r in some:
        dot = sum(plain.get(i, 0.0) * v for i, v in plain_vector(documents[r["doc_id"]]["text"], bits).items()) + plain[1 << bits]
        assert r["s"] == pytest.approx(1 / (1 + math.exp(-dot)), abs=2e-3)
