"""Small document tables with the awkward cases that every operator has to stand."""

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
LONG = " ".join(f"word{i % 97} tail{i % 13}." for i in range(30_000))
AWKWARD = [
    (1, None, "en", "a", None),
    (2, "", "en", "a", 0),
    (3, " \t\n\x0b ", None, None, 5),
    (4, "plain words and more plain words", "en", "a", 32),
    (4, "plain words and more plain words", "en", "a", 32),
    (5, "plain words and more plain words", "en", "b", 32),
    (None, "a row without an id", "en", "b", 19),
    (6, LONG, "en", "a", len(LONG)),
    (7, "é 中文 \U0001f600 naïve line\x1cfs", "fr", "b", 20),
    (8, "x" * 20_000, "en", "a", 20_000),
    (9, "#$%&*|<> 12345 !!! ...", "en", "c", 20),
]


def docs(spark, rows=AWKWARD, extra=True):
    """A table of documents; with columns whose names the operators use themselves."""
    frame = spark.createDataFrame([tuple(r) + (None,) * (5 - len(r)) for r in rows], DOCS)
    if not extra:
        return frame
    from pyspark.sql import functions as F

    clashes = ("ids", "fp", "node", "block", "score", "found", "n_words", "kept", "label", "word", "key", "centre", "grp", "part")
    return frame.withColumns({c: F.lit("clash") for c in clashes})


def empty(spark):
    return docs(spark, [])
