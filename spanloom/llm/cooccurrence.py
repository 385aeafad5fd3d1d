"""Pairs of items that occur together in a record: stripes with a log-likelihood ratio.

Each task turns its records into stripes: for an item, the array of the later items (by bytes) it occurs with and
their counts, combined over many records before anything is shuffled. Stripes are shuffled by item and by a hash
segment of the neighbours, so the stripe of an item that is in a third of all records is spread over `segments`
reducers, and merged by a streaming hash aggregate. Items below `least` records cannot be in a pair of `least`
records and are left out beforehand; that loses no pair.

Defined results: null and empty item lists do not count as records; repeated values in a record count once;
repeated records must be removed before; empty input gives no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.runtime import stage

_PAIRS = 4_000_000  # held by a task before they are combined


def _combine(keys: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    k, inv = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(inv, np.concatenate(counts)).astype(np.int64)


def _stripes(field: np.ndarray, items: pa.ListArray, keep: pa.Array | None, segments: int) -> Iterator[pa.RecordBatch]:
    off = items.offsets.to_numpy()
    flat = items.values.slice(off[0], off[-1] - off[0])
    rec = np.repeat(np.arange(len(items)), np.diff(off))
    if keep is not None:
        named = pc.binary_join_element_wise(pa.array(field[rec].astype(str)), flat.cast(pa.string()), "\x00")
        ok = pc.is_in(named, keep).to_numpy(zero_copy_only=False)
        flat, rec = flat.filter(pa.array(ok)), rec[ok]
    if not len(flat):
        return
    enc = flat.dictionary_encode()
    order = pc.sort_indices(enc.dictionary).to_numpy()  # by bytes
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    terms, v = enc.dictionary.take(pa.array(order)), len(order)
    codes = rank[enc.indices.to_numpy()]
    both = np.unique(rec * v + codes)  # sorted by record, then bytes; once a record
    rec, codes = both // v, both % v
    f = field[rec].astype(np.int64)
    keys, counts, held, shift = [], [], 0, 1
    while shift < len(rec):
        same = np.flatnonzero(rec[shift:] == rec[:-shift])
        if not len(same):
            break
        keys.append((f[same] * v + codes[same]) * v + codes[same + shift])
        counts.append(np.ones(len(same), np.int64))
        held += len(same)
        if held > _PAIRS:
            k, n = _combine(keys, counts)
            keys, counts, held = [k], [n], 0
        shift += 1
    if not keys:
        return
    k, n = _combine(keys, counts)
    b, a = k % v, k // v
    # The segment of a neighbour goes by its own bytes, so it is the same in every task.
    own = np.array([hash_bytes(x) for x in terms.to_pylist()], np.int64) % segments
    seg = own[b]
    sort = np.lexsort((b, seg, a))
    a, b, n, seg = a[sort], b[sort], n[sort], seg[sort]
    start = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (seg[1:] != seg[:-1]))))
    offs = pa.array(np.append(start, len(a)).astype(np.int32))
    yield pa.record_batch({
        "field": pa.array((a[start] // v).astype(np.int32)), "item_a": terms.take(pa.array(a[start] % v)), "seg": pa.array(seg[start].astype(np.int32)),
        "others": pa.ListArray.from_arrays(offs, terms.take(pa.array(b))), "counts": pa.ListArray.from_arrays(offs, pa.array(n)),
    })


def hash_bytes(x: str) -> int:
    h = 0
    for c in x.encode():
        h = (h * 131 + c) & 0x7FFFFFFF
    return h


def pair_counts(records: DataFrame, least: DataFrame | None = None, segments: int = 16, most_kept: int = 200_000) -> DataFrame:
    """records(field INT, items ARRAY<STRING>) -> (field, item_a, item_b, n_ab, n_a, n_b, n), item_a < item_b by bytes.

    least(field, n, least): keep pairs of at least `least` records. Its item table is sent to the tasks only when it
    has at most `most_kept` rows (there are at most values / least such items); beyond that nothing is left out early.
    """
    spark = records.sparkSession
    records = records.select("field", F.array_distinct(F.filter("items", lambda x: x.isNotNull())).alias("items")).where("size(items) > 0")
    single = records.select("field", F.explode("items").alias("item")).groupBy("field", "item").agg(F.count("*").alias("k"))
    total = records.groupBy("field").agg(F.count("*").alias("n"))
    keep = None
    if least is not None:
        single = stage(single.join(F.broadcast(least), "field").where("k >= least").select("field", "item", "k"), "items")
        if single.count() <= most_kept:
            t = single.select(F.concat(F.col("field").cast("string"), F.lit("\x00"), "item").alias("x")).toArrow()
            keep = spark.sparkContext.broadcast(t["x"].combine_chunks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = keep.value if keep is not None else None
        held: list[pa.RecordBatch] = []

        def out(held):
            t = pa.Table.from_batches(held).combine_chunks()
            if t.num_rows:
                items = t["items"].combine_chunks()
                items = items.cast(pa.list_(pa.string()))
                yield from _stripes(t["field"].to_numpy(), items, kept, segments)

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= 100_000:
                yield from out(held)
                held = []
        if held:
            yield from out(held)

    stripes = records.select("field", "items").mapInArrow(run, "field int, item_a string, seg int, others array<string>, counts array<long>")
    pairs = (
        stripes.repartition("field", "item_a", "seg").select("field", "item_a", "seg", F.explode(F.arrays_zip("others", "counts")).alias("o"))
        .groupBy("field", "item_a", "seg", F.col("o.others").alias("item_b")).agg(F.sum("o.counts").alias("n_ab"))
    )
    if least is not None:
        pairs = pairs.join(F.broadcast(least.select("field", "least")), "field").where("n_ab >= least")
    pairs = pairs.select("field", "item_a", "item_b", "n_ab")
    a = single.select("field", F.col("item").alias("item_a"), F.col("k").alias("n_a"))
    b = single.select("field", F.col("item").alias("item_b"), F.col("k").alias("n_b"))
    return pairs.join(a, ["field", "item_a"]).join(b, ["field", "item_b"]).join(F.broadcast(total), "field")


def significance(pairs: DataFrame) -> DataFrame:
    """Adds lift = n_ab * n / (n_a * n_b) and llr, the log-likelihood ratio of the two-by-two table."""
    x = lambda c: F.when(c > 0, c * F.log(c)).otherwise(0.0)
    d = lambda c: F.col(c).cast("double")
    ab, a, b, n = d("n_ab"), d("n_a"), d("n_b"), d("n")
    cells = x(ab) + x(a - ab) + x(b - ab) + x(n - a - b + ab)
    llr = 2 * (cells + x(n) - x(a) - x(n - a) - x(b) - x(n - b))
    return pairs.withColumn("lift", ab * n / (a * b)).withColumn("llr", F.greatest(F.lit(0.0), llr))


def items_together(records: DataFrame, segments: int = 16) -> DataFrame:
    """All pairs of each field with counts, lift and log-likelihood ratio."""
    return significance(pair_counts(stage(records, "records"), None, segments))
