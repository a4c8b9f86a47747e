"""The corpus pipeline, each stage held against its own input."""

import pytest

import corpus_pipeline
from veridra.llm import langid, packing, quality_model, queries, simhash

from .helpers import docs, empty
from .test_near_copies import brute as brute_copies
from .test_packing import check as check_pieces
from .test_substring_dedup import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's name, input and output, written and read again."""
    folder = tmp_path_factory.mktemp("stages")
    table = spark.read.parquet(f"{SF}/documents.parquet")
    done = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, table, SF).write.parquet(str(folder / name))
        after = spark.read.parquet(str(folder / name))
        done[name] = (table, after)
        table = after
    return done


def test_stages_are_the_ones_in_order():
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "quality_classifier", "near_duplicates", "substring_dedup", "packing"]


def test_columns_stay(stages):
    for before, after in list(stages.values())[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes


def test_language_stage(spark, stages):
    before, after = stages["language_id"]
    model = langid.learn(before.filter("crc32(cast(doc_id as string)) % 4 <> 2"))
    verdicts = {r["doc_id"]: langid.Classifier(model)(r["text"]) for r in before.collect()}
    kept = {k for k, (lang, _, known) in verdicts.items() if lang != "und" and known > 0}
    assert {r["doc_id"] for r in after.collect()} == kept


def test_quality_stage(spark, stages):
    before, after = stages["quality_classifier"]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in after.collect()}
    judged = [(r["doc_id"] in kept) == (labels[r["doc_id"]] == 1) for r in before.collect() if r["doc_id"] in labels]
    assert sum(judged) / len(judged) > 0.95


def test_near_duplicate_stage(stages):
    """Against all pairs: five-word shingles, similarity 0.8 or more."""
    before, after = stages["near_duplicates"]
    wanted = brute_copies([(r["doc_id"], r["text"]) for r in before.collect()])
    assert {r["doc_id"] for r in after.collect()} == {k for k, r in wanted.items() if k == r}
    assert 0 < after.count() < before.count()


def test_substring_stage(stages):
    before, after = stages["substring_dedup"]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    wanted = {k: (t if n else texts[k]) for k, _, n, t in brute(list(texts.items()), 50)}
    assert {r["doc_id"]: r["text"] for r in after.collect()} == wanted


def test_packing_stage(spark, stages):
    import public_tokenizers

    before, after = stages["packing"]
    tokenizer = packing.VocabularyTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    import numpy as np

    wanted = {r["doc_id"]: [*np.frombuffer(tokenizer.ids(r["text"]), "<i4").tolist(), 0] for r in before.collect()}
    names = ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "token_ids")
    check_pieces([tuple(bytes(r[c]) if c == "token_ids" else r[c] for c in names) for r in after.collect()], wanted)


def tokens_by_document(frame):
    """Each document's token bytes, its pieces joined in order."""
    pieces = {}
    for r in frame.select("doc_id", "start", "token_ids", "doc_tokens").collect():
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], bytes(r["token_ids"])))
    return {key: b"".join(t for _, t in sorted(held)) for key, held in pieces.items()}


def test_run_equals_the_stages(spark, stages):
    """The whole pipeline gives the tokens that the stages give one by one, each of which is held against brute force above."""
    whole = corpus_pipeline.run(spark, SF)
    last = stages["packing"][1]
    assert whole.columns == last.columns
    found = tokens_by_document(whole)
    assert found == tokens_by_document(last)
    kept = {r["doc_id"] for r in stages["substring_dedup"][1].collect()}
    assert {doc_id for doc_id, _ in found} == kept and all(len(t) == 4 * n for (_, n), t in found.items())


def test_stages_stand_awkward_rows(spark, tmp_path):
    table = docs(spark)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, table, SF).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert after.columns == table.columns
        table = after
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), SF).count() == 0


def test_queries_cover_the_ten_operators():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
    assert quality_model.THRESHOLD == 0.3 and simhash.RADIUS == 3


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, name):
    import duckdb

    connection = duckdb.connect()
    for table in ("documents", "embeddings"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    result = connection.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    found = queries.QUERIES[name](spark, SF).select(*names).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, result.fetchall()))
