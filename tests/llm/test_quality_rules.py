import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from veridra.llm import quality_rules as rules
from veridra.llm import queries

from .helpers import AWKWARD, docs, empty


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered)


@settings(max_examples=300, deadline=None)
@given(st.text("ab \n\t#é", max_size=60))
def test_counts(text):
    assert rules.text_statistics(text)[:5] == plain_counts(text)


def test_counts_of_awkward_texts():
    for _, text, *_ in AWKWARD:
        assert rules.text_statistics(text)[:5] == plain_counts(text)
    many = [f"w{i}" for i in range(5000)] * 2
    assert rules.repeated_words([w.encode() for w in many]) == 10_000


def test_base_rule_and_verdicts(spark):
    good = [(i, f"line {i} one.\n" + " ".join(f"w{(i * 31 + k * k) % 997}" for k in range(80)), "en", "a", 0) for i in range(120)]
    junk = [(900 + i, " ".join(f"w{(i * 31 + k * k) % 997}&&&###" for k in range(80)), "en", "a", 0) for i in range(3)]
    rows = {r["doc_id"]: r for r in rules.judge(rules.measure(docs(spark, good + junk, extra=False))).collect()}
    assert all(rows[i]["kept"] for i in range(120))
    assert not any(rows[900 + i]["kept"] or rows[900 + i]["base_failed"] for i in range(3))
    assert rows[900]["distance"] > rules.CUTOFF


def test_small_groups_are_pooled(spark):
    prose = [(i, " ".join(f"w{(i * 17 + k * k) % 991}" for k in range(60)), "en", f"s{i}", 0) for i in range(60)]
    lone = [(500, " ".join(f"v{k}" for k in range(60)), "xx", "only", 0)]
    rows = {r["doc_id"]: r for r in rules.judge(rules.measure(docs(spark, prose + lone, extra=False))).collect()}
    assert rows[1]["distance"] is not None and rows[500]["distance"] is None and rows[500]["kept"]
    assert rows[500]["verdict"] == "unjudged" and {rows[i]["verdict"] for i in range(60)} <= {"inlier", "outlier"}


def test_repeats_of_the_vector_count_once_and_do_not_add_up():
    line = "one line of seven words in all"
    other = " ".join(f"w{i}" for i in range(60))
    vector = dict(zip(rules.VECTOR, rules.text_statistics(f"{line}\n{other}\n{line}")[5:]))
    assert vector["x2"] == 0 and vector["x3"] > 0  # a repeated line is no repeated words as well
    chance = "a b c " + " ".join(f"v{i}" for i in range(2 * rules.REPEAT_WORDS)) + " a b c"
    assert rules.text_statistics(chance)[4] == 6 and rules.text_statistics(chance)[7] == 0


def test_awkward_rows(spark, monkeypatch):
    judged = rules.judge(rules.measure(docs(spark)))
    assert judged.count() == len(AWKWARD)
    assert rules.judge(rules.measure(empty(spark))).count() == 0
    monkeypatch.setattr(rules, "MAX_BROADCAST_GROUPS", -1)
    assert rules.judge(rules.measure(docs(spark))).count() == len(AWKWARD)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = {r["doc_id"]: r for r in queries.op5_quality_rules(spark, sf).collect()}
    assert set(found) == set(texts)
    for key, text in texts.items():
        row = found[key]
        n, *rest = plain_counts(text)
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == (n, *rest)
        assert row["base_failed"] == (n < 50 or 100 * rest[-1] > 50 * n)
        assert not (row["base_failed"] and row["kept"])
    good = [found[k] for k, q in labels.items() if q == 1 and not found[k]["base_failed"]]
    assert np.mean([r["kept"] for r in good]) > 0.99
