"""Exact search of a stated set of query vectors against all vectors, in blocks; greedy cliques."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from spanloom.runtime import stage


def usable(df: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """(id, vec): vectors of `dim` finite numbers, one row an id; all-zero vectors stay in, their similarity is 0."""
    v = F.col(vec_col)
    ok = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(F.col(id_col).isNotNull() & v.isNotNull()).where(ok).select(F.col(id_col).alias("id"), v.alias("vec")).dropDuplicates(["id"])


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def block_search(queries: DataFrame, rows: DataFrame, dim: int, least: float | None = None, top: int | None = None, block_mb: int = 24) -> DataFrame:
    """queries(id, vec), rows(id, vec) -> (a, b, sim): cosines of each query a with the other rows b.

    least: keep sim >= least; top: keep the best `top` a query, by sim rounded to 9 digits, then by id. Queries are sent to
    the tasks in blocks of at most `block_mb`; rows are scanned once a block and never shuffled. A query that is itself
    among the rows does not find itself. A task holds the best `top` of each query over all its rows, and as blocks run
    side by side, rows are cut in no more parts than keep the cores busy: only that often are `top` rows a query shuffled.
    """
    spark = queries.sparkSession
    each = max(1, block_mb * (1 << 20) // (8 * dim))
    out, rows = None, rows.select("id", "vec")
    if top is not None:
        blocks = max(1, -(-queries.count() // each))
        rows = rows.coalesce(-(-2 * spark.sparkContext.defaultParallelism // blocks))
    todo = queries.select("id", "vec").orderBy("id").toLocalIterator(prefetchPartitions=False)
    while True:
        ids, vecs = [], []
        for q in todo:
            ids.append(q["id"])
            vecs.append(np.array(q["vec"], np.float64))
            if len(ids) == each:
                break
        if not ids and out is not None:
            break
        shared = spark.sparkContext.broadcast((np.array(ids, np.int64), _unit(np.array(vecs, np.float64).reshape(-1, dim))))
        part = rows.mapInArrow(_scan(shared, dim, least, top), "a long, b long, sim double")
        out = part if out is None else out.unionByName(part)
        if len(ids) < each:
            break
    if top is not None:
        w = W.partitionBy("a").orderBy(F.desc(F.rint(F.col("sim") * 1e9)), "b")
        out = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return out


class _Best:
    """The best `top` rows of each query so far, by the order of block_search; found ones are held back up to `most`, then merged."""

    def __init__(self, queries: int, top: int, most: int = 1_000_000) -> None:
        self.top, self.most, self.new, self.held = top, most, 0, [(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0))]
        self.edge = np.full(queries, -np.inf)  # no row below it is among the best

    def add(self, q: np.ndarray, ids: np.ndarray, sim: np.ndarray) -> None:
        self.held.append((q.astype(np.int32), ids, sim))
        self.new += len(q)
        if self.new > self.most:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, ids, sim = (np.concatenate(x) for x in zip(*self.held))
        at = np.lexsort((ids, -np.rint(sim * 1e9), q))
        q = q[at]
        first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, np.int64)
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        at, q, place = at[place < self.top], q[place < self.top], place[place < self.top]
        self.held, self.new = [(q, ids[at], sim[at])], 0
        last = place == self.top - 1
        self.edge[q[last]] = sim[at[last]] - 2e-9
        return self.held[0]


def _scan(shared, dim: int, least: float | None, top: int | None, tile: int = 512):
    """Cosines of tile x 2,048 at a time: what a task holds does not grow with queries times rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = shared.value
        best = _Best(len(qid), top) if top is not None else None
        for b in batches:
            for s in range(0, b.num_rows, 2048):
                c = b.slice(s, 2048)
                if not c.num_rows or not len(qid):
                    continue
                ids = c.column("id").to_numpy()
                x = _unit(c.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)).T
                own = np.isin(ids, qid)
                for k in range(0, len(qid), tile):
                    sim = q[k : k + tile] @ x
                    if best is None:
                        keep = sim >= least if least is not None else np.ones(sim.shape, bool)
                    else:
                        edge = best.edge[k : k + tile]
                        keep = sim >= (np.maximum(edge, least) if least is not None else edge)[:, None]
                        if np.count_nonzero(keep) > 2 * (top + 1) * len(keep) and sim.shape[1] > top + 1:
                            # At least `top` others are among the best top + 1 of a tile, which may hold the query itself.
                            edge[:] = np.maximum(edge, np.partition(sim, -top - 1, axis=1)[:, -top - 1] - 2e-9)
                            keep &= sim >= edge[:, None]
                    i, j = np.nonzero(keep)
                    other = qid[k + i] != ids[j] if own.any() else slice(None)
                    i, j = i[other], j[other]
                    if best is not None and len(i):
                        best.add(k + i, ids[j], sim[i, j])
                    elif len(i):
                        yield pa.record_batch({"a": qid[k + i], "b": ids[j], "sim": sim[i, j]})
        if best is not None:
            i, ids, sim = best.merge()
            for s in range(0, len(i), 100_000):
                yield pa.record_batch({"a": qid[i[s : s + 100_000]], "b": ids[s : s + 100_000], "sim": sim[s : s + 100_000]})

    return run


def mean_differences(triples: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """triples(h, t, r) distinct, vectors(id, vec) -> (r, vec): per relation the mean of tail - head over triples with both vectors.

    A sum of differences is a sum of vectors, each as often as it is a tail less as often as it is a head: these counts
    are added up by (r, entity) first, so a vector is read once a relation, not once a triple, and a hub is one row.
    Relations are few; each batch leaves one sum a relation. Without triples there are no rows.
    """
    ids = vectors.select("id")
    both = triples.join(ids.withColumnRenamed("id", "h"), "h", "left_semi").join(ids.withColumnRenamed("id", "t"), "t", "left_semi")
    ends = F.explode(F.array(F.struct(F.col("t").alias("id"), F.lit(1).alias("c")), F.struct(F.col("h").alias("id"), F.lit(-1).alias("c"))))
    c = both.select("r", ends.alias("e")).groupBy("r", F.col("e.id").alias("id")).agg(F.sum("e.c").alias("c"), F.count(F.when(F.col("e.c") > 0, 1)).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                k, at = np.unique(b.column("r").to_numpy(), return_inverse=True)
                total = np.zeros((len(k), dim))
                np.add.at(total, at, b.column("vec").flatten().to_numpy().reshape(-1, dim) * b.column("c").to_numpy()[:, None])
                yield pa.record_batch({"r": k.astype(np.int32), "total": pa.array(list(total), pa.list_(pa.float64())), "n": np.bincount(at, b.column("n").to_numpy()).astype(np.int64)})

    sums = c.join(vectors, "id").select("r", "c", "n", "vec").mapInArrow(run, "r int, total array<double>, n long")
    x = sums.select("r", "n", F.posexplode("total").alias("i", "x")).groupBy("r", "i").agg((F.sum("x") / F.sum("n")).alias("x"))
    p = x.groupBy("r").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("p"))
    return p.select("r", F.transform("p", lambda v: v["x"]).alias("vec"))


def cosine01_rows(rows: DataFrame, a: str, b: str, less: str | None = None, name: str = "sim") -> DataFrame:
    """The other columns of rows and `name`: 0.5 + 0.5 * cosine of a (minus `less`) and b, arrays of one size; 0 where one is null or all zeros."""
    used = [a, b, *([less] if less else [])]
    keep = [c for c in rows.columns if c not in used]
    schema = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes if c in keep) + f", {name} double"
    there = F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(less).isNotNull() if less else F.lit(True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            out = np.zeros(batch.num_rows)
            at = np.flatnonzero(batch.column("_there").to_numpy(zero_copy_only=False))
            if len(at):
                m = [batch.column(c).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1) for c in used]
                x, y = (m[0] - m[2] if less else m[0]), m[1]
                n = np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)
                out[at] = np.where(n > 0, 0.5 + 0.5 * np.einsum("nd,nd->n", x, y) / np.where(n > 0, n, 1), 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out)], [*keep, name])

    return rows.withColumn("_there", there).mapInArrow(run, schema)


def short_vectors(vectors: DataFrame) -> DataFrame:
    """vectors(id, vec) -> (b, short, step): unit vectors as 16-bit multiples of step, each number within step / 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _unit(b.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
                step = np.maximum(np.abs(x).max(1), 1e-9) / 32767
                short = np.rint(x / step[:, None]).astype(np.int16)
                yield pa.record_batch({"b": b.column("id"), "short": pa.array([v.tobytes() for v in short], pa.binary()), "step": step})

    return vectors.select("id", "vec").mapInArrow(run, "b long, short binary, step double")


def greedy_cliques(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """pairs(a, b, sim) -> (a, rank, b, sim): b by falling sim (ties by id), kept while similar to every b kept before it.

    threshold and sim are on the scale 0.5 + 0.5 * cosine. One group is the similar vectors of one a. Groups are formed
    with vectors of 16 bits a number; a group in which a cosine is nearer to the threshold than these can tell is formed
    again with the whole vectors.
    """
    pairs = stage(pairs.where(F.col("sim") >= threshold).select("a", "b", "sim"), "pairs")

    def greedy(df: pd.DataFrame, x: np.ndarray, off: np.ndarray) -> pd.DataFrame:
        kept: list[int] = []
        for i in range(len(df)):
            sim = 0.5 + 0.5 * (x[kept] @ x[i]) - threshold
            far = 0.5 * (off[kept] + off[i] + off[kept] * off[i])
            if (sim < -far).any():
                continue
            if (sim < far).any():
                return pd.DataFrame({"a": df["a"][:1], "rank": 0, "b": 0, "sim": 0.0})
            kept.append(i)
        out = df.iloc[kept]
        return pd.DataFrame({"a": out["a"], "rank": np.arange(1, len(kept) + 1), "b": out["b"], "sim": out["sim"]})

    def in_order(df: pd.DataFrame) -> pd.DataFrame:
        return df.sort_values(["sim", "b"], ascending=[False, True], kind="stable")

    def pick_short(df: pd.DataFrame) -> pd.DataFrame:
        df = in_order(df)
        step = df["step"].to_numpy()
        x = np.frombuffer(b"".join(df["short"]), np.int16).reshape(len(df), -1) * step[:, None]
        return greedy(df, x, np.sqrt(x.shape[1]) * step / 2 + 1e-12)

    def pick(df: pd.DataFrame) -> pd.DataFrame:
        df = in_order(df)
        return greedy(df, _unit(np.stack(df["vec"].to_numpy()).astype(np.float64)), np.zeros(len(df)))

    schema = "a long, rank int, b long, sim double"
    first = stage(pairs.join(short_vectors(vectors), "b").groupBy("a").applyInPandas(pick_short, schema), "cliques")
    again = pairs.join(first.where("rank = 0").select("a"), "a", "left_semi").join(vectors.select(F.col("id").alias("b"), "vec"), "b")
    return first.where("rank > 0").unionByName(again.groupBy("a").applyInPandas(pick, schema))
