"""Positions in a total order without a one-task window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from spanloom.runtime import stage


def positions(df: DataFrame, by: list[str | Column], name: str = "pos") -> DataFrame:
    """Adds `name`: 0, 1, 2, .. in the order of `by`, which must be total over the rows.

    Rows are range-partitioned and sorted; a row's position is its place in its partition plus the rows of the
    partitions before, a table of one row a partition. An empty table stays empty.
    """
    raw = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_m", F.monotonically_increasing_id())
    raw = stage(raw, "order").withColumn("_p", F.shiftright("_m", 33))
    n = raw.groupBy("_p").agg(F.count("*").alias("_n"))
    off = n.withColumn("_o", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return raw.join(F.broadcast(off), "_p").withColumn(name, F.col("_o") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m", "_p", "_o")


def first_seen_ids(df: DataFrame, key: str, at: list[str], name: str = "id") -> DataFrame:
    """(key, name): distinct keys numbered from 0 by their first position (`at`), ties by key. Null keys have no id."""
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*at)).alias("_first"))
    return positions(first, ["_first", key], name).select(key, name)


def keep_first(df: DataFrame, key: list[str], seq: list[str]) -> DataFrame:
    """One row a key: the first by `seq`, by an aggregate that combines before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*seq)).alias("_r"))
    return best.select(*key, *(F.col(f"_r.{c}").alias(c) for c in rest))


def running_sum(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Adds `name`: the sum of `value` over all rows up to this one in the order of `by`, total over the rows.

    Sums run within sorted range partitions, a batch at a time, and start from the sums of the partitions before.
    """
    raw = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_p", F.spark_partition_id())
    whole = df.schema[value].dataType.typeName() in ("long", "integer", "short", "byte")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far = 0
        for b in batches:
            if b.num_rows:
                x = np.cumsum(pc.fill_null(b.column(value), 0).to_numpy(zero_copy_only=False).astype(np.int64 if whole else np.float64)) + so_far
                so_far = x[-1]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(x)], [*b.schema.names, "_i"])

    schema = ", ".join(f"`{c}` {k}" for c, k in raw.dtypes) + f", _i {'long' if whole else 'double'}"
    raw = stage(raw.mapInArrow(run, schema), "order")
    n = raw.groupBy("_p").agg(F.sum(value).alias("_n"))
    off = n.withColumn("_o", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return raw.join(F.broadcast(off), "_p").withColumn(name, F.col("_o") + F.col("_i")).drop("_p", "_o", "_i")
