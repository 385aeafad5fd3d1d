"""All pairs of set-valued records above a Jaccard similarity: forests of sorted minhash sketches.

A tree is one order of K minhash values; a node of depth d holds the sets whose sketches share the first d values,
a run of the lexicographically sorted sketches. Each tree is deepened until the node holds few enough sets by an
array of counts that never counts too low; a pair at the threshold t shares a node of depth d with probability
t ** d. Every set goes on to further trees until the chance that it has missed such a pair in all of them is below
1 - recall. A set stops only when its own bound is reached and the sets that are left can still meet it in the
trees it has taken part in, so the bound holds for every pair. There are enough trees even if every node has to be
as deep as a tree goes, so no set and no node is dropped; nodes that stay large are split by the skew join.

Candidates pass a bitmap bound that rejects no similar pair, then are verified on the whole sets. Equal sets are one
class that is searched once. Recall at the threshold is `recall` at least in expectation and grows with similarity.

Defined results: null lists give nothing; null, blank and repeated values do not count; sets under `least` values take
no part; repeated rows of a record count once (its values are united); empty tables give no pairs; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import bitmap, cells_for, classes, coded, hashed_counts, lists, map_arrow, mix
from spanloom.runtime import spread, stage


class Forest:
    def __init__(self, threshold: float, recall: float, depth: int = 8, block: int = 16, node: int = 24, least_depth: int = 2) -> None:
        self.t, self.depth, self.block, self.least_depth = threshold, depth, block, least_depth
        self.node = int(coded(np.array(node)))  # on the scale of the count array
        self.need = -math.log(1 - recall)
        self.gain = np.array([0.0] + [-math.log1p(-(threshold**d)) if threshold < 1 else 50.0 for d in range(1, depth + 1)])
        self.trees = math.ceil(self.need / self.gain[depth])

    def prefixes(self, tok: np.ndarray, first: np.ndarray, size: np.ndarray, field: np.ndarray, trees: range) -> np.ndarray:
        """records x trees x depth: a 64-bit name of each prefix."""
        out = np.empty((len(size), len(trees), self.depth), np.uint64)
        for k, tree in enumerate(trees):
            name = mix(field.astype(np.uint64), 1000 + tree)
            for d in range(self.depth):
                low = np.minimum.reduceat(mix(tok, 2000 + tree * self.depth + d), first)
                name = mix(name ^ low, 3 + d)
                out[:, k, d] = name
        return out

    def blocks(self):
        for s in range(0, self.trees, self.block):
            yield range(s, min(self.trees, s + self.block))


def _read(b: pa.RecordBatch):
    tok, size = lists(b.column("toks"))
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    return b.column("field").to_numpy(), b.column("id").to_numpy(), tok.astype(np.int64).view(np.uint64), first, size


def _prefix_keys(f: Forest, trees: range, b: pa.RecordBatch) -> np.ndarray:
    field, _, tok, first, size = _read(b)
    return f.prefixes(tok, first, size, field, trees).ravel()


def _block_leaves(f: Forest, trees: range, counts, b: pa.RecordBatch) -> pa.Table:
    """Rows (leaf, id, n, bits) of the nodes in which each set is compared; rows with toks for the sets that must go on."""
    field, ids, tok, first, size = _read(b)
    left = b.column("left").to_numpy().copy()
    bits = bitmap(tok, np.repeat(np.arange(len(size)), size), len(size), 1)[:, 0]
    name = f.prefixes(tok, first, size, field, trees)
    many = counts.value.of(name)
    small = many <= f.node
    small[:, :, : f.least_depth - 1] = False
    small[:, :, -1] = True
    d = small.argmax(axis=2)
    leaf = np.take_along_axis(name, d[:, :, None], 2)[:, :, 0]
    gain = f.gain[d + 1]
    r, k = np.nonzero(np.cumsum(gain, axis=1) - gain < left[:, None])
    met = np.take_along_axis(many, d[:, :, None], 2)[:, :, 0][r, k] > 1  # a set that is alone in its node meets none there
    r, k = r[met], k[met]
    left -= gain.sum(axis=1)
    go = np.flatnonzero(left > 0)
    done = pa.table({"leaf": leaf[r, k].view(np.int64), "id": ids[r], "n": size[r].astype(np.int32), "bits": bits[r]})
    more = pa.table({"id": ids[go], "field": field[go], "left": left[go], "toks": b.column("toks").take(pa.array(go))})
    schema = pa.schema([("leaf", pa.int64()), ("id", pa.int64()), ("n", pa.int32()), ("bits", pa.int64()), ("field", pa.int32()), ("left", pa.float64()), ("toks", pa.list_(pa.int64()))])
    return pa.concat_tables([done, more], promote_options="permissive").select(schema.names).cast(schema)


def similar_sets(sets: DataFrame, threshold: float, recall: float = 0.9999, count_bits: int | None = None) -> DataFrame:
    """sets(field INT, id BIGINT unique, toks non-empty distinct ARRAY<BIGINT>) -> (field, a, b, n_a, n_b, common), a < b.

    sets is read twice: pass a written table, as classes() gives it.
    """
    spark = sets.sparkSession
    f = Forest(threshold, recall)
    bits = count_bits or cells_for(sets.count() * f.block * f.depth)
    pending, leaves = spread(sets).select("field", "id", "toks", F.lit(f.need).alias("left")), None
    schema = "leaf long, id long, n int, bits long, field int, left double, toks array<long>"
    for trees in f.blocks():
        n = hashed_counts(pending, partial(_prefix_keys, f, trees), bits)
        got = stage(map_arrow(pending, partial(_block_leaves, f, trees, spark.sparkContext.broadcast(n)), schema), "leaves")
        new = got.where("leaf is not null").select("leaf", "id", "n", "bits")
        leaves = new if leaves is None else leaves.unionByName(new)
        pending = got.where("toks is not null").select("field", "id", "toks", "left")
        if pending.isEmpty():
            break
    h = (1 - threshold) / (1 + threshold)
    x, y = leaves.alias("x"), leaves.alias("y")
    cand = (
        x.join(y.hint("shuffle_merge"), F.col("x.leaf") == F.col("y.leaf"))
        .where(
            (F.col("x.id") < F.col("y.id")) & (F.least("x.n", "y.n") >= threshold * F.greatest("x.n", "y.n") - 1e-9)
            & (F.bit_count(F.col("x.bits").bitwiseXOR(F.col("y.bits"))) <= h * (F.col("x.n") + F.col("y.n")) + 1e-9)
        )
        .select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    )
    left = sets.select("field", F.col("id").alias("a"), F.col("toks").alias("ta"))
    right = sets.select(F.col("id").alias("b"), F.col("toks").alias("tb"))
    full = cand.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("ta", "tb")))
    full = full.select("field", "a", "b", F.size("ta").alias("n_a"), F.size("tb").alias("n_b"), "common")
    return full.where(F.col("common") >= threshold * (F.col("n_a") + F.col("n_b") - F.col("common")) - 1e-9)


def record_sets(records: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """records(field INT, key, items distinct ARRAY<STRING>) -> members(field, key, id), sets(field, id, toks): equal sets are one."""
    r = records.where(F.size("items") >= least).select("field", "key", F.array_sort(F.transform("items", lambda x: F.xxhash64(x))).alias("toks"))
    return classes(r)


def similar_pairs(records: DataFrame, threshold: float, least: int = 5, recall: float = 0.9999) -> DataFrame:
    """(field, key_a, key_b), key_a < key_b, records with equal sets included."""
    members, sets = record_sets(records, least)
    links = similar_sets(sets, threshold, recall)
    same = members.alias("p").join(members.alias("q"), ["field", "id"]).where("p.key < q.key").select("field", F.col("p.key").alias("key_a"), F.col("q.key").alias("key_b"))
    ends = links.select("field", "a", "b").join(members.select("field", F.col("id").alias("a"), F.col("key").alias("k1")), ["field", "a"])
    ends = ends.join(members.select("field", F.col("id").alias("b"), F.col("key").alias("k2")), ["field", "b"])
    return same.unionByName(ends.select("field", F.least("k1", "k2").alias("key_a"), F.greatest("k1", "k2").alias("key_b")))


def link_counts(records: DataFrame, threshold: float, least: int = 5, recall: float = 0.9999) -> DataFrame:
    """(field, key, group, links): one row a record that takes part, its class of equal sets and the records it is similar to.

    Counted from class sizes, so a class that a third of all records share is never expanded into pairs.
    """
    members, sets = record_sets(records, least)
    size = stage(members.groupBy("field", "id").agg(F.count("*").alias("size"), F.min("key").alias("group")), "classes")
    links = stage(similar_sets(sets, threshold, recall).select("a", "b"), "links")
    both = links.union(links.select("b", "a"))
    far = both.join(size.select(F.col("id").alias("b"), "size"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("size").alias("far"))
    own = size.join(far, "id", "left").select("field", "id", "group", (F.col("size") - 1 + F.coalesce("far", F.lit(0))).alias("links"))
    return members.join(own, ["field", "id"]).select("field", "key", "group", "links")
