"""The k most similar vectors of every vector: a permutation index.

Pivots are drawn from a bounded sample (at most `max_pivots` vectors, by hash of the id; 4 x the square root of the
number of vectors, rounded up to a power of two). A vector is represented by the order of its `length` nearest
pivots and posted in the inverted file of the first `posted` of them, so every row is indexed and every row is a
query. Within a file, candidates are ranked by the footrule distance between the truncated orders: with weight
w = length + 1 - rank, footrule = constant - 2 * sum over shared pivots of min(w, w'). The best `rerank` are
reranked by the exact cosine. A file longer than `cap` is cut into slices, and every two slices are compared in a cell of
their own with its own best candidates: no pair of a file is left out, no task holds a whole file, and a small cap finds
what a large one does. Pivots grow with the square root of the vectors, so files do too.

Defined results: null ids, null vectors, wrong size, NaN or infinity inside and all zeros take no part; repeated rows
count once; vectors with equal numbers are one class that is searched once and expanded by at most k + 1 of its
smallest ids; ties in cosine go to the smaller id; fewer than two vectors give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from spanloom.runtime import by_key, stage


def valid_vectors(df: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """(id, vec): the vectors that take part, one row an id."""
    v = F.col(vec_col)
    good = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.where(F.col(id_col).isNotNull() & v.isNotNull()).where(good).select(F.col(id_col).alias("id"), v.alias("vec"))
    return by_key(rows, "id").dropDuplicates(["id"])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _top(score: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest per row, best first, ties by column."""
    k = min(k, score.shape[1])
    part = np.argpartition(-score, k - 1, axis=1)[:, :k]
    val = np.take_along_axis(score, part, 1)
    return np.take_along_axis(part, np.lexsort((part, -val), axis=1), 1)


def _bytes(column: pa.ChunkedArray, rows: int, kind) -> np.ndarray:
    """A binary column whose values have equal lengths, as a matrix."""
    c = column.combine_chunks()
    c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
    off = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + rows + 1]
    return np.frombuffer(c.buffers()[2], np.uint8)[off[0] : off[-1]].view(kind).reshape(rows, -1)


def _orders(reps: DataFrame, pivots: np.ndarray, length: int, posted: int, dim: int) -> DataFrame:
    """(id, head, order, unit): the posted pivots, the numbers of the nearest pivots, nearest first, and the unit vector."""
    shared = reps.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value.T
        for b in batches:
            for s in range(0, b.num_rows, 2048):
                c = b.slice(s, 2048)
                if not c.num_rows:
                    continue
                x = _unit(_matrix(c.column("vec"), dim))
                order = _top(x @ p, length).astype(np.uint16)
                head = order[:, :posted].astype(np.int32)
                off = np.arange(c.num_rows + 1, dtype=np.int32)
                yield pa.record_batch({
                    "id": c.column("id"),
                    "head": pa.ListArray.from_arrays(off * head.shape[1], head.ravel()),
                    "order": pa.array([r.tobytes() for r in order], pa.binary()),
                    "unit": pa.array([r.tobytes() for r in x], pa.binary()),
                })

    return reps.mapInArrow(run, "id long, head array<int>, order binary, unit binary")


def _search(dim: int, length: int, rerank: int, k: int, least: float | None):
    """One file, or one cell of it: its rows by slice -> (a, b, cos) for every row of the file as the query."""
    floor = least if least is not None else -1.5

    def run(t: pa.Table) -> pa.Table:
        n = t.num_rows
        sort = np.argsort(t["id"].to_numpy(), kind="stable")
        ids = t["id"].to_numpy()[sort]
        x = _bytes(t["unit"], n, np.float32)[sort]
        order = _bytes(t["order"], n, np.uint16)[sort]
        part, lo, hi = t["part"].to_numpy()[sort], t["lo"][0].as_py(), t["hi"][0].as_py()
        left = np.flatnonzero(part == lo)
        right = left if lo == hi else np.flatnonzero(part == hi)
        out = []
        for q_all, p in [(left, right)] if lo == hi else [(left, right), (right, left)]:
            if not len(p) or not len(q_all):
                continue
            # The inverted file of the posted side: for each of its pivots a row of weights, one byte a posted vector.
            pivots, local = np.unique(order[p], return_inverse=True)
            local = local.reshape(len(p), -1)
            weight = np.zeros((len(pivots) + 1, len(p)), np.uint8)
            weight[local, np.arange(len(p))[:, None]] = length - np.arange(local.shape[1], dtype=np.uint8)
            at = np.searchsorted(pivots, order[q_all])
            at = np.where((at < len(pivots)) & (pivots[np.minimum(at, len(pivots) - 1)] == order[q_all]), at, len(pivots))
            step = max(16, (1 << 21) // max(1, len(p)))
            many = min(rerank, len(p))
            for s in range(0, len(q_all), step):
                q = q_all[s : s + step]
                score, one = np.zeros((2, len(q), len(p)), np.uint8)
                for rank in range(at.shape[1]):
                    one[:] = length - rank  # an operand of the full shape: NumPy has a fast minimum of bytes for that only
                    score += np.minimum(np.take(weight, at[s : s + step, rank], axis=0), one)
                cos = x[q] @ x[p].T
                if lo == hi:
                    cos[np.arange(len(q)), np.arange(s, s + len(q))] = -2
                r, c = np.nonzero(cos >= floor - 1e-3) if least is not None else (None, None)
                if r is not None and len(r) <= 16 * len(q):
                    # Few are similar enough: each is asked for its place by footrule.
                    near = (score[r] > score[r, c][:, None]).sum(axis=1) < rerank
                    r, c = r[near], c[near]
                else:
                    # The best by footrule, then by cosine: single precision picks a few more than are wanted.
                    c = np.argpartition(score, len(p) - many, axis=1)[:, len(p) - many :]
                    cos = np.take_along_axis(cos, c, 1)
                    few = min(2 * k + 2, many)
                    if few < many:
                        best = np.argpartition(cos, many - few, axis=1)[:, many - few :]
                        c, cos = np.take_along_axis(c, best, 1), np.take_along_axis(cos, best, 1)
                    r, j = np.nonzero(cos >= max(floor - 1e-3, -1.5))
                    c = c[r, j]
                other = p[c]
                exact = np.einsum("rd,rd->r", x[q[r]].astype(np.float64), x[other].astype(np.float64))
                keep = exact >= floor
                r, other, exact = r[keep], other[keep], exact[keep]
                by = np.lexsort((ids[other], -exact, r))
                r, other, exact = r[by], other[by], exact[by]
                place = np.arange(len(r)) - np.searchsorted(r, r)
                top = place < k
                out.append((ids[q[r[top]]], ids[other[top]], exact[top]))
        cols = [np.concatenate(z) for z in zip(*out)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        return pa.table({"a": pa.array(cols[0], pa.int64()), "b": pa.array(cols[1], pa.int64()), "cos": pa.array(cols[2], pa.float64())})

    return run


def _files(orders: DataFrame, cap: int) -> DataFrame:
    """(file, lo, hi, part, id, order, unit): the postings; a file of more than `cap` rows in cells of two slices of at most about cap / 2."""
    rows = orders.select("id", "order", "unit", F.explode("head").alias("file"))
    n = orders.select(F.explode("head").alias("file")).groupBy("file").count()
    long_ = n.where(F.col("count") > cap).select("file", F.ceil(2 * F.col("count") / cap).cast("int").alias("slices"))  # at most a row a pivot
    rows = rows.join(F.broadcast(long_), "file", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))
    # A row goes into the cells of its slice with each slice: with its own, every pair of a file is in a cell once.
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    return rows.select("file", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "id", "order", "unit")


def nearest(
    vectors: DataFrame, dim: int, k: int = 5, least: float | None = None, length: int = 16, posted: int = 8, rerank: int = 48,
    max_pivots: int = 65_536, cap: int = 8192,
) -> DataFrame:
    """vectors(id, vec) as valid_vectors gives them -> (id, rank, other, cos): up to k others with cos >= least, best first."""
    spark = vectors.sparkSession
    rows = stage(vectors.withColumn("h", F.xxhash64("vec")).withColumn("g", F.xxhash64(F.lit(5), "vec")), "vectors")
    rep = rows.groupBy("h", "g").agg(F.min("id").alias("rep"))
    members = stage(rows.select("id", "h", "g").join(rep, ["h", "g"]).select("id", "rep"), "members")
    reps = rows.select("id", "vec").join(members.where("id = rep").select("id"), "id", "left_semi")
    n = members.where("id = rep").count()
    pivots = 1 << max(4, int(np.ceil(np.log2(4 * max(1, n) ** 0.5))))
    sample = reps.orderBy(F.xxhash64("id"), "id").limit(min(pivots, max_pivots)).toArrow()
    if n == 0:
        return spark.createDataFrame([], "id long, rank int, other long, cos double")
    order = stage(_orders(reps, _unit(_matrix(sample["vec"], dim)), min(length, sample.num_rows), posted, dim), "orders")
    files = _files(order, cap)
    hits = files.groupBy("file", "lo", "hi").applyInArrow(_search(dim, length, rerank, k, least), "a long, b long, cos double")
    best = W.partitionBy("a").orderBy(F.desc("cos"), "b")
    hits = hits.groupBy("a", "b").agg(F.max("cos").alias("cos")).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
    # From classes of equal vectors to ids: k + 1 of the smallest ids of a class are enough for anyone's k nearest.
    few = members.withColumn("r", F.row_number().over(W.partitionBy("rep").orderBy("id"))).where(F.col("r") <= k + 1).drop("r")
    many = few.groupBy("rep").count().where("count > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("cos"))
    near = hits.select("a", "b", "cos").unionByName(many).join(few.select(F.col("rep").alias("b"), F.col("id").alias("other")), "b")
    near = near.withColumn("r", F.row_number().over(W.partitionBy("a").orderBy(F.desc("cos"), "other"))).where(F.col("r") <= k + 1)
    out = members.select("id", F.col("rep").alias("a")).join(near.select("a", "other", "cos"), "a").where("id <> other")
    return out.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(F.desc("cos"), "other"))).where(F.col("rank") <= k).select("id", "rank", "other", "cos")
