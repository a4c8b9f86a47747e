"""Evidence that arrives in batches: candidates it touches are consolidated anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import profile
from ..plans.consolidate import consolidate

#: parts of the evidence table
BUCKETS = 256


def consolidate_stream(arriving: DataFrame, evidence_path: str, profiles_path: str, checkpoint: str) -> StreamingQuery:
    """Append arriving evidence to a table and write the profiles of the batch's candidates.

    Evidence is partitioned by a hash of the candidate, so that a batch reads the part of
    the history that its candidates are in.

    Profiles of a batch go to their own partition ``batch``; the largest batch of a
    candidate is its current profile. A batch that is repeated after a failure
    replaces its own partitions.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        placed = batch.withColumn("bucket", F.pmod(F.xxhash64("candidate_id"), F.lit(BUCKETS)).cast("int"))
        placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{evidence_path}/batch={number}")
        arrived = spark.read.parquet(f"{evidence_path}/batch={number}")
        touched = arrived.select("candidate_id").distinct()
        buckets = [r["bucket"] for r in arrived.select("bucket").distinct().collect()]  # BUCKETS at most
        known = spark.read.parquet(evidence_path).filter((F.col("batch") <= number) & F.col("bucket").isin(buckets))
        _, _, scored = consolidate(known.drop("batch", "bucket").join(touched, "candidate_id", "left_semi"))
        profiles = profile.assemble(scored)
        profiles.write.mode("overwrite").parquet(f"{profiles_path}/batch={number}")

    return arriving.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
