"""EXTENSION: queries in the form of streams, run on the batch table."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.plans.registry import Registry
from spanloom.runtime import table
from spanloom.streaming.scoring import windowed_counts

R = Registry()


@R.add("ext_windowed_events", "select epoch(time_bucket(interval '1 hour', ts))::bigint as start_s, event_type, count(*) as cnt from events group by all")
def ext_windowed_events(spark, d):
    w = windowed_counts(table(spark, d, "events"), "ts", "event_type")
    return w.select(F.unix_timestamp("start").alias("start_s"), "event_type", "cnt")
