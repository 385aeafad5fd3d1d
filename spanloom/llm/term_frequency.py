"""Occurrences and records of every term: heavy-light aggregation.

A first pass finds the heavy terms: every task keeps a Misra-Gries summary of at most `heavy` counters, so each term
with more than 1 / heavy of all occurrences is in some summary, and the best `heavy` of the summed summaries are
broadcast (a fixed bound). In the second pass each task counts the heavy terms exactly in arrays, written out once
a task, and only the other terms are shuffled, combined by batch. Both tables are united. Which terms are heavy
changes no count.

Defined results: null lists and null or empty terms do not count; a term that occurs twice in a record counts twice
in `occurrences` and once in `records`; empty input gives no terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.runtime import stage

_SEP = "\x00"


def _count(field: np.ndarray, terms: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(field-and-term names, occurrences, records) of one batch."""
    off = terms.offsets.to_numpy()
    flat = terms.values.slice(off[0], off[-1] - off[0])
    rec = np.repeat(np.arange(len(terms)), np.diff(off))
    enc = flat.dictionary_encode()
    v = max(1, len(enc.dictionary))
    code = enc.indices.to_numpy() if len(flat) else np.zeros(0, np.int64)
    pair, times = np.unique(rec.astype(np.int64) * v + code, return_counts=True)  # (record, term)
    key = field[pair // v].astype(np.int64) * v + pair % v
    k, inv = np.unique(key, return_inverse=True)
    names = pc.binary_join_element_wise(pa.array((k // v).astype(str)), enc.dictionary.take(pa.array(k % v)).cast(pa.string()), _SEP) if len(k) else pa.array([], pa.string())
    return names, np.bincount(inv, times, minlength=len(k)).astype(np.int64), np.bincount(inv, minlength=len(k)).astype(np.int64)


def _table(names: pa.Array, tf: np.ndarray, df: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"name": names.cast(pa.string()), "tf": pa.array(tf, pa.int64()), "df": pa.array(df, pa.int64())})


def _merge(parts: list) -> tuple[pa.Array, np.ndarray]:
    t = pa.table({"n": pa.concat_arrays([p[0] for p in parts]), "c": np.concatenate([p[1] for p in parts])}).group_by("n").aggregate([("c", "sum")])
    return t["n"].combine_chunks(), t["c_sum"].to_numpy()


def heavy_terms(records: DataFrame, heavy: int = 4096) -> pa.Array:
    """The names of at most `heavy` terms, all those with more than 1 / heavy of the occurrences of a task among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, c = pa.array([], pa.string()), np.zeros(0, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            n, tf, _ = _count(b.column("field").to_numpy(), b.column("terms"))
            names, c = _merge([(names, c), (n, tf)])
            if len(c) > heavy:
                c = c - np.partition(c, len(c) - heavy - 1)[len(c) - heavy - 1]
                keep = c > 0
                names, c = names.filter(pa.array(keep)), c[keep]
        yield _table(names, c, c)

    got = records.mapInArrow(run, "name string, tf long, df long").groupBy("name").agg(F.sum("tf").alias("tf"))
    return got.orderBy(F.desc("tf"), "name").limit(heavy).toArrow()["name"].combine_chunks()


def term_frequencies(records: DataFrame, heavy: int = 4096) -> DataFrame:
    """records(field INT, terms ARRAY<STRING>) -> (field, term, occurrences, records, heavy)."""
    spark = records.sparkSession
    clean = records.where("terms is not null").select("field", F.filter("terms", lambda x: x.isNotNull() & (x != "")).alias("terms"))
    clean = stage(clean, "terms")
    table = heavy_terms(clean, heavy)
    shared = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy_names = shared.value
        tf, df = np.zeros(len(heavy_names), np.int64), np.zeros(len(heavy_names), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            names, t, d = _count(b.column("field").to_numpy(), b.column("terms"))
            at = pc.index_in(names, heavy_names)
            light = pc.is_null(at).to_numpy(zero_copy_only=False)
            slot = at.drop_null().to_numpy().astype(np.int64)
            tf[slot] += t[~light]
            df[slot] += d[~light]
            if light.any():
                out = _table(names.filter(pa.array(light)), t[light], d[light])
                yield out.append_column("heavy", pa.array(np.zeros(out.num_rows, bool)))
        if len(heavy_names):
            out = _table(heavy_names, tf, df)
            out = out.append_column("heavy", pa.array(np.ones(out.num_rows, bool)))
            yield out.filter(pa.array(tf > 0))

    parts = stage(clean.mapInArrow(run, "name string, tf long, df long, heavy boolean"), "parts")
    add = lambda t: t.groupBy("name", "heavy").agg(F.sum("tf").alias("occurrences"), F.sum("df").alias("records"))
    both = add(parts.where("heavy")).unionByName(add(parts.where("not heavy")))
    cut = F.split("name", _SEP, 2)
    return both.select(cut[0].cast("int").alias("field"), cut[1].alias("term"), "occurrences", "records", "heavy")


def mark(frequencies: DataFrame, bounds: DataFrame) -> DataFrame:
    """bounds(field, rare_below, common_above) -> adds mark: rare, common or null."""
    j = frequencies.join(F.broadcast(bounds), "field")
    return j.withColumn("mark", F.when(F.col("records") < F.col("rare_below"), "rare").when(F.col("records") > F.col("common_above"), "common")).drop("rare_below", "common_above")
