"""Profiles of a stream: an addition. Each micro-batch folds into additive frequencies.

Frequencies add up, so the state is one Parquet table of (ordinal, value, cnt) per batch id, and
the profile of all so far is an aggregate of them. Batches are idempotent by their id: a batch
that is run again overwrites its own folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.operators.frequency import frequencies, value_statistics


def fold_batches(stream: DataFrame, state_dir: str, checkpoint: str, **trigger):
    def fold(batch: DataFrame, batch_id: int) -> None:
        frequencies(batch).write.mode("overwrite").parquet(f"{state_dir}/batch={batch_id}")

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def folded(spark: SparkSession, state_dir: str) -> DataFrame:
    return spark.read.parquet(state_dir).groupBy("ordinal", "text", "value").agg(F.sum("cnt").alias("cnt"))


def stream_profile(spark: SparkSession, state_dir: str) -> DataFrame:
    """value_statistics of all batches so far."""
    return value_statistics(folded(spark, state_dir))
