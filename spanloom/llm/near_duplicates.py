"""Near-duplicate records by universe partitioning and the pigeonhole principle; exact.

A record is the set of its adjacent word pairs. Two sets of a and b values with Jaccard similarity >= t differ in
at most H = (1 - t) / (1 + t) * (a + b) values. Sets are put in bands by size, and for each band the universe of
values is hashed into m segments. For any choice of a tolerance of -1 (skip), 0 or 1 differing values for each
segment whose sum of (tolerance + 1) exceeds H, two similar sets meet in a segment within its tolerance. The
smaller set indexes its segments, and what is left of each after deleting one value, once, in its own band; the
larger set meets its own band and the few below it that can hold similar sets, and in each picks the tolerances
with the least cost, i.e. with the least entries to be met, read from an array of counts of all index entries. A
second array counts what is to be met, so that an entry is shuffled only if the other side may hold its like.

A segment's subset is named by the sum of its mixed 64-bit values, so a deletion is one subtraction. Every
candidate pair is verified on the whole sets, after a bitmap bound that never rejects a similar pair.

Defined results: null, empty or short texts (under `least_words`) take no part; repeated rows of a record count once;
equal sets are one class that is searched once and expanded at the end; extra columns are ignored; empty input
gives no pairs. Pairs with similarity exactly t are pairs.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import Cells, bitmap, cells_for, classes, decoded, hashed_counts, lists, map_arrow, mix, words
from spanloom.operators.graph import components
from spanloom.runtime import discard, spread, stage

_LONGS = 3  # of the bitmap that index entries carry


def bigram_set(text: Column, least_words: int = 2) -> Column:
    """Sorted distinct 64-bit names of the pairs of adjacent words; null for texts of fewer than `least_words` words."""
    # The words are an item of a list of one, so that they are cut once, not once for each use.
    def pairs(w: Column) -> Column:
        n = F.greatest(F.size(w) - 1, F.lit(0))
        pair = F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda x, y: F.xxhash64(x, y))
        return F.when(F.size(w) >= least_words, F.array_sort(F.array_distinct(pair)))

    return F.transform(F.array(words(text)), pairs)[0]


class Plan:
    """Bands, segments and bounds for a threshold."""

    def __init__(self, threshold: float, longest: int, slack: float = 1.3) -> None:
        self.t, self.c = threshold, (1 - threshold) / (1 + threshold)
        ratio = max(1.1, 1 / threshold)
        edges = [1]
        while edges[-1] <= longest:
            edges.append(max(edges[-1] + 1, math.ceil(edges[-1] * ratio)))
        self.edges = np.array(edges)  # band k holds sizes edges[k] .. edges[k + 1] - 1
        # (index band i, meeting band j >= i) that can hold similar sets.
        self.pairs = [
            (i, j) for j in range(len(edges) - 1) for i in range(j + 1) if edges[i + 1] - 1 >= threshold * edges[j] - 1e-9
        ]
        self.segments = []
        for i in range(len(edges) - 1):
            top = edges[i + 1] - 1
            h = self.most_apart(np.array([math.floor(top / threshold + 1e-9)]), top)[0]
            self.segments.append(max(1, math.ceil((h + 1) / 2 * slack)))

    def band(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, sizes, side="right") - 1

    def slices(self, values: dict[int, int], most: int) -> list[tuple[range, int, int]]:
        """(index bands, part, parts): at most some `most` slices of like work by the values of sets of each size; a band that
        is too large for one is cut in parts by the names of its entries."""
        of = np.bincount(self.band(np.array(list(values))), list(values.values()), minlength=len(self.segments)).tolist()
        each, out, first, held = sum(of) / most, [], 0, 0
        for i, n in enumerate(of):
            if n > 1.5 * each:
                out += [(range(first, i), 0, 1)] * (held > 0) + [(range(i, i + 1), k, math.ceil(n / each)) for k in range(math.ceil(n / each))]
                first, held = i + 1, 0
            elif held + n > 1.5 * each:
                out.append((range(first, i), 0, 1))
                first, held = i, n
            else:
                held += n
        return out + [(range(first, len(of)), 0, 1)] * (held > 0)

    def reach(self, bands: range) -> tuple[int, int]:
        """The smallest and the largest size of sets that are in these index bands or meet them."""
        return int(self.edges[bands[0]]), int(max(self.edges[j + 1] for i, j in self.pairs if i in bands) - 1)

    def most_apart(self, b: np.ndarray, highest_a: int) -> np.ndarray:
        """The most values in which a set of b values and one of at most b and highest_a values may differ."""
        return np.floor(self.c * (b + np.minimum(b, highest_a)) + 1e-9).astype(np.int64)


class _Cut:
    """The segments of some records by the index band `at_band`: arrays over non-empty and empty segments alike."""

    def __init__(self, plan: Plan, at_band: int, field: np.ndarray, tok: np.ndarray, rec: np.ndarray, n: int) -> None:
        m = plan.segments[at_band]
        v = mix(tok, 1)
        seg = (v % np.uint64(m)).astype(np.int64)
        v = mix(v, 2)
        self.m, self.n = m, n
        self.at = rec * m + seg  # of each value
        total = np.zeros(n * m, np.uint64)
        np.add.at(total, self.at, v)
        where = np.tile(np.arange(m, dtype=np.uint64), n) + np.uint64(at_band << 40)
        self.salt = mix(where + (np.repeat(field.astype(np.uint64), m) << np.uint64(58)), 3)
        self.size = np.bincount(self.at, minlength=n * m)
        self.full = mix(total ^ self.salt, 4)  # the segment as an index entry of the whole
        self.gone = mix(total ^ self.salt, 5)  # as an index entry of a set with one value deleted
        less = total[self.at] - v
        self.less_full = mix(less ^ self.salt[self.at], 4)
        self.less_gone = mix(less ^ self.salt[self.at], 5)


def _read(b: pa.RecordBatch):
    tok, size = lists(b.column("toks"))
    return b.column("field").to_numpy(), b.column("id").to_numpy(), tok.astype(np.int64).view(np.uint64), size


def _members(plan: Plan, b: pa.RecordBatch, index: bool, bands: range | None = None):
    """(index band, record numbers, their segments): for the index, each set in its own band; else in those it has to meet.
    bands: these index bands only."""
    field, _, tok, size = _read(b)
    band = plan.band(size)
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    for i, j in plan.pairs:
        if bands is not None and i not in bands:
            continue
        pick = np.flatnonzero(band == j) if not index or i == j else ()
        if not index and i < j:
            pick = pick[plan.t * size[pick] <= plan.edges[i + 1] - 1 + 1e-9]
        if len(pick):
            s = size[pick]
            rec = np.repeat(np.arange(len(pick)), s)
            tok_at = np.repeat(first[pick] - np.concatenate(([0], np.cumsum(s)[:-1])), s) + np.arange(s.sum())
            yield i, pick, _Cut(plan, i, field[pick], tok[tok_at], rec, len(pick))


def _index_keys(plan: Plan, b: pa.RecordBatch) -> np.ndarray:
    return np.concatenate([np.concatenate((c.full, c.less_gone)) for _, _, c in _members(plan, b, True)] or [np.zeros(0, np.uint64)])


def _rows(keys: list, recs: list, b: pa.RecordBatch, met: Cells, part: int, parts: int) -> pa.Table | None:
    """Entries of a part whose cell of `met`, the counts of the other side, is not zero: the others meet nothing."""
    if not keys:
        return None
    key, rec = np.concatenate(keys), np.concatenate(recs)
    if parts > 1:
        mine = mix(key, 6) % np.uint64(parts) == part
        key, rec = key[mine], rec[mine]
    keep = met.of(key) > 0
    key, rec = key[keep], rec[keep]
    _, ids, tok, size = _read(b)
    bits = bitmap(tok, np.repeat(np.arange(len(size)), size), len(size), _LONGS)[rec]
    return pa.table({"sig": key.view(np.int64), "id": ids[rec], "n": size[rec].astype(np.int32)} | {f"b{i}": bits[:, i] for i in range(_LONGS)})


def _index(plan: Plan, probes, of: tuple[range, int, int], b: pa.RecordBatch) -> pa.Table | None:
    keys, recs = [], []
    for _, pick, c in _members(plan, b, True, of[0]):
        keys += [c.full, c.less_gone]
        recs += [np.repeat(pick, c.m), pick[c.at // c.m]]
    return _rows(keys, recs, b, probes.value, *of[1:])


def _met(plan: Plan, counts: Cells, b: pa.RecordBatch, bands: range | None = None) -> tuple[list, list]:
    """The entries that each larger set has to meet, by the cheapest tolerances that the pigeonhole principle allows."""
    cost = lambda k: decoded(counts.of(k))
    _, _, _, size = _read(b)
    keys, recs = [], []
    for i, pick, c in _members(plan, b, False, bands):
        need = plan.most_apart(size[pick], int(plan.edges[i + 1]) - 1) + 1
        one = cost(c.full) + 1
        two = one + cost(c.gone) + 1 + np.bincount(c.at, cost(c.less_full) + 1, minlength=c.n * c.m)
        first, second = one, two - one
        both = second < first  # the second step is cheaper than the first: take them together
        first, second = np.where(both, two / 2, first), np.where(both, two / 2, second)
        unit = np.concatenate((first, second))
        owner = np.concatenate((np.arange(c.n * c.m),) * 2)
        order = np.lexsort((np.arange(len(unit)), unit, owner // c.m))
        rank = np.empty(len(unit), np.int64)
        rank[order] = np.arange(len(unit)) - np.repeat(np.arange(c.n) * 2 * c.m, 2 * c.m)
        taken = rank < need[owner // c.m]
        steps = np.bincount(owner[taken], minlength=c.n * c.m)
        whole, wide = np.flatnonzero(steps >= 1), np.flatnonzero(steps == 2)
        dels = np.flatnonzero(steps[c.at] == 2)
        keys += [c.full[whole], c.gone[wide], c.less_full[dels]]
        recs += [pick[whole // c.m], pick[wide // c.m], pick[c.at[dels] // c.m]]
    return keys, recs


def _probe_keys(plan: Plan, counts, b: pa.RecordBatch) -> np.ndarray:
    keys, _ = _met(plan, counts.value, b)
    keys = np.concatenate(keys or [np.zeros(0, np.uint64)])
    return keys[counts.value.of(keys) > 0]


def _probe(plan: Plan, counts, of: tuple[range, int, int], b: pa.RecordBatch) -> pa.Table | None:
    return _rows(*_met(plan, counts.value, b, of[0]), b, counts.value, *of[1:])


def _ends(b: pa.RecordBatch) -> np.ndarray:
    return mix(np.concatenate([b.column(c).to_numpy() for c in ("a", "b")]).view(np.uint64))


def _asked(cells, b: pa.RecordBatch) -> pa.RecordBatch:
    return b.filter(pa.array(cells.value.of(mix(b.column("id").to_numpy().view(np.uint64))) > 0))


def _classes(texts: DataFrame, least_words: int) -> tuple[DataFrame, DataFrame]:
    """texts(field INT, key BIGINT, text) -> members(field, key, id) and sets(field, id, toks), one set per class of equal sets."""
    t = spread(texts.where("text is not null and key is not null"))
    return classes(t.select("field", "key", bigram_set(F.col("text"), least_words).alias("toks")), twice=True)


def similar_sets(sets: DataFrame, threshold: float = 0.8, count_bits: int | None = None, most_slices: int = 16, least_values: int = 1_500_000) -> DataFrame:
    """sets(field INT, id BIGINT unique, toks distinct non-empty ARRAY<BIGINT>) -> (field, a, b, n_a, n_b, common).

    sets is read several times: pass a written table, as classes() gives it. a is the smaller set, or has the smaller id.
    Entries are made, met and deleted in up to `most_slices` slices of at least some `least_values` values, so that disk holds a slice of them.
    """
    spark = sets.sparkSession
    values = {x["n"]: x["n"] * x["sets"] for x in sets.groupBy(F.size("toks").alias("n")).agg(F.count("*").alias("sets")).toLocalIterator()}
    schema = "sig long, id long, n int, " + ", ".join(f"b{i} long" for i in range(_LONGS))
    if not values:
        return spark.createDataFrame([], "field int, a long, b long, n_a int, n_b int, common int")
    plan, total = Plan(threshold, max(values)), sum(values.values())
    src = spread(sets)
    bits = count_bits or cells_for(2 * total)
    counts = spark.sparkContext.broadcast(hashed_counts(src, partial(_index_keys, plan), bits))
    probes = spark.sparkContext.broadcast(hashed_counts(src, partial(_probe_keys, plan, counts), bits))
    out, parted = None, False
    for of in plan.slices(values, int(np.clip(total // least_values, 1, most_slices))):
        part = src.where(F.size("toks").between(*plan.reach(of[0])))
        x, y = map_arrow(part, partial(_index, plan, probes, of), schema).alias("x"), map_arrow(part, partial(_probe, plan, counts, of), schema).alias("y")
        apart = sum((F.bit_count(F.col(f"x.b{i}").bitwiseXOR(F.col(f"y.b{i}"))) for i in range(_LONGS)), F.lit(0))
        near = (
            x.join(y.hint("shuffle_merge"), F.col("x.sig") == F.col("y.sig"))
            .where(f"(x.n < y.n or (x.n = y.n and x.id < y.id)) and x.n >= {threshold} * y.n - 1e-9")
            .where(apart <= plan.c * (F.col("x.n") + F.col("y.n")) + 1e-9)
            .select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
        )
        near = stage(near, "candidates")
        links = stage(_verified(near, part, threshold), "links")
        discard(near)
        out, parted = links if out is None else out.unionByName(links), parted or of[2] > 1
    return out.distinct() if parted else out  # a pair may be met in several parts of a band


def _verified(near: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The candidates (a, b) that are similar; sets that are in none of them are not shuffled."""
    n = near.count()
    cells = near.sparkSession.sparkContext.broadcast(hashed_counts(near, _ends, cells_for(2 * n)))
    some = map_arrow(sets.select("field", "id", "toks"), partial(_asked, cells), "field int, id long, toks array<long>")
    left = some.select("field", F.col("id").alias("a"), F.col("toks").alias("ta"))
    right = some.select(F.col("id").alias("b"), F.col("toks").alias("tb"))
    full = near.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("ta", "tb")))
    full = full.select("field", "a", "b", F.size("ta").alias("n_a"), F.size("tb").alias("n_b"), "common")
    return full.where(F.col("common") >= threshold * (F.col("n_a") + F.col("n_b") - F.col("common")) - 1e-9)


def near_duplicate_classes(texts: DataFrame, threshold: float = 0.8, least_words: int = 12) -> tuple[DataFrame, DataFrame]:
    """texts(field, key, text) -> members(field, key, id) and links(field, a, b, ..) between different sets."""
    members, sets = _classes(texts, least_words)
    return members, similar_sets(sets, threshold)


def near_duplicate_pairs(texts: DataFrame, threshold: float = 0.8, least_words: int = 12) -> DataFrame:
    """(field, key_a, key_b), key_a < key_b: all pairs of records, those with equal sets included."""
    members, links = near_duplicate_classes(texts, threshold, least_words)
    same = members.alias("p").join(members.alias("q"), ["field", "id"]).where("p.key < q.key").select("field", F.col("p.key").alias("key_a"), F.col("q.key").alias("key_b"))
    ends = links.select("field", "a", "b").join(members.select("field", F.col("id").alias("a"), F.col("key").alias("k1")), ["field", "a"])
    ends = ends.join(members.select("field", F.col("id").alias("b"), F.col("key").alias("k2")), ["field", "b"])
    apart = ends.select("field", F.least("k1", "k2").alias("key_a"), F.greatest("k1", "k2").alias("key_b"))
    return same.unionByName(apart)


def near_duplicate_groups(texts: DataFrame, threshold: float = 0.8, least_words: int = 12) -> DataFrame:
    """(field, key, group): one row a record that takes part; group is the smallest key of those linked to it, directly or not."""
    members, links = near_duplicate_classes(texts, threshold, least_words)
    roots = components(links.select("a", "b")).withColumnRenamed("node", "id")
    m = members.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    return m.join(m.groupBy("field", "root").agg(F.min("key").alias("group")), ["field", "root"]).select("field", "key", "group")
