"""Incremental result table (S8 as a stream sink).

The reference appends suite results run after run and keeps the last row per
(test, model, category, category_minority).  Here every micro-batch is written
as its own ``batch_id`` partition (overwriting only that partition, so a
retried batch is idempotent) and readers apply the keyed upsert: the row of the
highest batch wins.  No state lives in the driver or in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT_KEYS = ("test", "model", "category", "category_minority")


def append_batch(df: DataFrame, batch_id: int, path: str) -> None:
    """foreachBatch body: write the micro-batch as partition ``batch_id``."""
    (df.withColumn("batch_id", F.lit(int(batch_id)))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))


def current_results(spark: SparkSession, path: str, keys: Sequence[str] = RESULT_KEYS,
                    order_col: str | None = None) -> DataFrame:
    """The result table as of now: last row per key (NULL keys equal); ``order_col`` orders rows of one batch
    (without it a batch must hold a key once)."""
    allr = spark.read.parquet(path)
    rest = [c for c in allr.columns if c not in keys]
    order = F.struct("batch_id", F.col(order_col)) if order_col else F.struct("batch_id")
    last = allr.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return last.select(*keys, "_r.*").drop("batch_id")


def start_results_stream(results: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Stream result rows (e.g. from a folder where runs drop their outputs)
    into the batch-partitioned table.  ``checkpoint`` must be shared storage."""
    w = results.writeStream.foreachBatch(lambda df, bid: append_batch(df, bid, path)) \
        .option("checkpointLocation", checkpoint)
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()
