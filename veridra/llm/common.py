"""Session and scratch helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, ship

#: bytes that separate words everywhere a contract says ``[^\x20\x09-\x0D]+``;
#: ``bytes.split()`` without arguments splits on exactly these.
WORD_SEPARATORS = " \t\n\x0b\x0c\r"


def release_memory() -> None:
    """Give freed memory back: Spark keeps a Python worker for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it decides itself
        pass


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def scratch(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` as a Parquet table in the shared folder, gone when the block ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/veridra-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: bytes of a partition that code of ours holds while it works on it
PARTITION_BYTES = 32 << 20


def width_for(spark: SparkSession, size: int) -> int:
    """Partitions for ``size`` bytes: as many as the session sets, or more where they would grow large."""
    return max(shuffle_width(spark), -(-size // PARTITION_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key, modulus: int):
    """``crc32(key as text) mod modulus``; null keys fall in fold 0 of a crc of ''."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)
