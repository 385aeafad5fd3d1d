"""Structured Streaming forms (an extension: the batch operators have no stream)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def score_stream(queries: DataFrame, search: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Run `search` on each micro-batch of queries(item_id, query) and append its rows as Parquet under `out`/batch=n.

    A batch that is run again after a failure overwrites its own folder, so results stay whole and single.
    """

    def one(batch: DataFrame, n: int) -> None:
        search(batch).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return queries.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, key, cnt) per tumbling window; rows later than the watermark are left out. Works on batches and streams."""
    e = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return e.groupBy(F.window("_t", window).alias("w"), key).agg(F.count("*").alias("cnt")).select(F.col("w.start").alias("start"), key, "cnt")
