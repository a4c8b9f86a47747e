"""The corpus pipeline: five stages over ``documents``, each feeding the next.

Language ID drops texts without a language, the quality classifier drops what it
scores low, near-duplicate groups keep one document, repeated passages are cut out
of the texts, and what is left is packed into token sequences. All stages but the
last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridra.llm import langid, near_copies, packing, quality_model, substring_dedup
from veridra.llm.common import fold, shared_folder, ship, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the languages learned from ``docs``.

    Null texts and texts without a letter go, and so do texts of which the model has seen
    neither a word nor an n-gram; ties between languages keep the text. Null ids learn
    and stay; repeated rows are judged alike; an empty table gives no rows.
    """
    ship(spark)
    model = langid.learn(docs.filter(fold(F.col("doc_id"), 4) != 2))
    return langid.select_texts(docs, model)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold.

    Null and empty texts have the score of a text without words; without labels every
    score is 0.5 and all stay. Repeated rows are judged alike; null ids are scored and
    never learned from; an empty table gives no rows.
    """
    labels = table(spark, sf_dir, "labels").filter(fold(F.col("doc_id"), 5) != 0)
    weights = quality_model.train(docs, quality_model.labelled_sample(labels))
    scored = docs.withColumn("found_quality", quality_model.score(F.col("text"), weights, spark))
    return scored.filter(F.col("found_quality") >= quality_model.THRESHOLD).select(*(f"`{c}`" for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id.

    SimHash at a similarity: texts whose five-word shingles have a Jaccard similarity of
    0.8 or more are near-duplicates. Null and empty texts are alike; a null id goes if a
    document with an id is like it; of rows that repeat one stays.
    """
    ship(spark)
    return near_copies.drop_near_copies(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; other texts are untouched.

    Null texts stay null; a null id counts as the last; rows of one id do not cut each
    other; of a text that is cut, the words that stay are joined by single spaces and
    ``n_chars`` counts them.
    """
    ship(spark)
    done = substring_dedup.remove_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("n_chars"))
    changed = {"text": text, "n_chars": n_chars.cast(docs.schema["n_chars"].dataType)}
    return done.select(*(changed.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences: one row per piece.

    Null and empty texts are the end token alone; rows that repeat are packed each.
    """
    ship(spark)
    return packing.pack_texts(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("quality_classifier", classify_quality),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("packing", pack_sequences),
]

#: training and tokenising are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``.

    Stages read their input more than once, so all but the last are written to the
    shared folder and read again, as the stages of a longer pipeline would be.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
