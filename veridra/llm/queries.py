"""Queries that apply the corpus operators to the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embedding_dedup, html_text, langid, licenses, packing, quality_model, quality_rules, simhash, substring_dedup
from .common import fold, table

MULTI_RANKS = "byte_bpe_multi_50k.tiktoken"
PACK_VOCABULARY = "byte_bpe_50k.json"


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document, decode the ids, and digest both."""
    ranks = public_tokenizers.path(MULTI_RANKS)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = docs.select("doc_id", bpe.round_trip(F.col("text"), ranks, public_tokenizers.PATTERN).alias("coded"))
    return coded.select(
        "doc_id",
        F.size("coded.ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("coded.ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("coded.decoded", 256).alias("decoded_sha256"),
    )


def op2_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokenise and pack every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.pack_texts(docs, public_tokenizers.path(PACK_VOCABULARY))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens"
    )


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and visible text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", html_text.extract(F.col("html")).alias("found"))
    return pages.select("page_id", "found.title", "found.text", F.length("found.text").cast("long").alias("n_chars"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License of every document. The table has no paths: no document has a directory to inherit from, so ``licenses.inherit`` has no part here."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.coalesce("source", F.lit("-")), F.lit("/"), F.col("doc_id").cast("string"), F.lit("/text"))
    scanned = licenses.scan(docs.select("doc_id", path.alias("path"), "text"), keep=("doc_id",))
    own = F.col("own_license")
    return scanned.select("*", own.alias("license"), F.when(own.isNotNull(), F.col("path")).alias("license_from"), F.lit(False).alias("inherited"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measure every document and judge it against its language and source."""
    judged = quality_rules.judge(quality_rules.measure(table(spark, sf_dir, "documents")))
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", "distance", "verdict")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove from every document the windows that an earlier document has."""
    done = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train on four folds of the labelled documents and score every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    sample = quality_model.labelled_sample(labels.filter(fold(F.col("doc_id"), 5) != 0))
    weights = quality_model.train(docs, sample)
    scored = docs.select("doc_id", quality_model.score(F.col("text"), weights, spark).alias("score"))
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= quality_model.THRESHOLD).cast("int").alias("predicted"),
    )


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train on three of four folds and predict the language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.learn(docs.filter(fold(F.col("doc_id"), 4) != 2))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "language.lang_pred", "language.score")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of every embedding."""
    return embedding_dedup.components(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_harmonic_packing": op2_harmonic_packing,
    "op3_html_extraction": op3_html_extraction,
    "op4_license_scan": op4_license_scan,
    "op5_quality_rules": op5_quality_rules,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_simhash": op8_simhash,
    "op9_language_id": op9_language_id,
    "op10_embedding_dedup": op10_embedding_dedup,
}

#: what SQL can express: the other operators train, tokenise or hash in ways that it lacks
ORACLE_SQL: dict[str, str] = {
    "op6_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        p AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 49, 0) + 1)) AS i FROM w),
        h AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS win FROM p),
        f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS first_id FROM h),
        c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM f WHERE first_id < doc_id),
        u AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS j FROM w),
        k AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.j) AS kept, count(*) AS n_kept
              FROM u LEFT JOIN c ON c.doc_id = u.doc_id AND c.j = u.j WHERE c.j IS NULL GROUP BY u.doc_id)
        SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN k ON k.doc_id = w.doc_id
    """,
    "op10_embedding_dedup": """
        WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
        reach(id, r) AS (SELECT vec_id, vec_id FROM e UNION SELECT reach.id, l.b FROM reach JOIN l ON reach.r = l.a),
        c AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id),
        n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
        SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, id = component_id AS kept FROM c LEFT JOIN n ON n.a = c.id
    """,
}
