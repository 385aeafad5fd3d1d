"""Link prediction: ranks of true triples among all entities, metrics, thresholds, losses.

Ranks are 1 + the number of candidates with a strictly lower score (rounded to 6 digits), so ties favour the true triple.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import triple_scores as S
from spanloom.operators import sampling
from spanloom.operators.order import running_sum
from spanloom.runtime import stage


def with_vectors(t: DataFrame, entities: DataFrame, relations: DataFrame, names: tuple[str, str] = ("h", "t")) -> DataFrame:
    """Adds hv, tv, rv; rows without a vector are left out. entities(id, vec), relations(r, vec)."""
    h, tail = names
    j = t.join(entities.select(F.col("id").alias(h), F.col("vec").alias("hv")), h).join(entities.select(F.col("id").alias(tail), F.col("vec").alias("tv")), tail)
    return j.join(F.broadcast(relations.select("r", F.col("vec").alias("rv"))), "r")


def _m(b: pa.RecordBatch, c: str) -> np.ndarray:
    a = b.column(c)
    return a.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


def score_rows(rows: DataFrame, score, name: str = "score") -> DataFrame:
    """rows(.., hv, rv, tv) -> the other columns and `name` = score(h, r, t) of the batch."""
    keep = [c for c in rows.columns if c not in ("hv", "rv", "tv")]
    schema = ", ".join(f"{c} {k}" for c, k in rows.dtypes if c in keep) + f", {name} double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = score(_m(b, "hv"), _m(b, "rv"), _m(b, "tv"))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(np.asarray(s, np.float64))], [*keep, name])

    return rows.mapInArrow(run, schema)


def ranks(test: DataFrame, known: DataFrame, entities: DataFrame, relations: DataFrame, score=S.transe, block_mb: int = 24, links_a_row: int = 50_000) -> DataFrame:
    """test(h, t, r), known(h, t, r) -> (h, t, r, side, raw, filtered, typed): ranks of the true entity on each side.

    The stated test triples go to the tasks in bounded blocks; entities are scanned once a block, and only three counts
    a triple leave a task. An entity carries its known triples, at most about `links_a_row` a row, so that the filtered
    rank takes off the known candidates that score better where they are scored. typed: among entities seen on that
    side of the relation, raw.
    """
    spark = test.sparkSession
    side_of = known.select(F.col("h").alias("id"), "r", F.lit(0).alias("s")).union(known.select("t", "r", F.lit(1))).distinct()
    kinds = side_of.groupBy("id").agg(F.sort_array(F.collect_set(F.col("r") * 2 + F.col("s"))).alias("kinds"))  # at most two a relation
    ends = known.select(F.col("h").alias("id"), F.col("t").alias("end"), (F.col("r") * 2).alias("kind")).union(known.select("t", "h", F.col("r") * 2 + 1)).distinct()
    size = ends.groupBy("id").agg(F.ceil(F.count("*") / links_a_row).alias("cut")).where("cut > 1")
    ends = ends.join(F.broadcast(size), "id", "left").withColumn("cut", F.coalesce(F.pmod(F.xxhash64("end"), "cut"), F.lit(0)))
    links = stage(ends.groupBy("id", "cut").agg(F.collect_list("end").alias("ends"), F.collect_list("kind").alias("of")), "links")
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    cand = entities.join(kinds, "id", "left").join(links.where("cut = 0").drop("cut"), "id", "left").withColumn("main", F.lit(True))
    if not links.where("cut > 0").isEmpty():
        more = entities.join(links.where("cut > 0").drop("cut"), "id").withColumn("main", F.lit(False)).withColumn("kinds", F.lit(None).cast("array<int>"))
        cand = cand.unionByName(more)
    cand = stage(cand.select("id", "vec", none("kinds", "int"), none("ends", "long"), none("of", "int"), "main"), "candidates")
    full = stage(score_rows(with_vectors(test, entities, relations).select("*", F.col("hv").alias("h2"), F.col("rv").alias("r2"), F.col("tv").alias("t2")), score), "true")
    dim = len(full.select("h2").first()[0]) if not full.isEmpty() else 1
    each = max(1, block_mb * (1 << 20) // (24 * dim))
    out, todo = None, full.orderBy("h", "t", "r").toLocalIterator()

    while True:
        rows = []
        for x in todo:
            rows.append({c: np.array(x[c]) if c in ("h2", "r2", "t2") else x[c] for c in ("h", "t", "r", "h2", "r2", "t2", "score")})
            if len(rows) == each:
                break
        if not rows and out is not None:
            break
        a = {c: np.array([x[c] for x in rows], np.float64).reshape(len(rows), -1) for c in ("h2", "r2", "t2")}
        ids = {c: np.array([x[c] for x in rows], np.int64) for c in ("h", "t", "r")}
        shared = spark.sparkContext.broadcast((a, ids, np.round([x["score"] for x in rows], 6)))
        part = cand.mapInArrow(_better(shared, score), "h long, t long, r int, s int, raw long, off long, typed long")
        part = part.groupBy("h", "t", "r", "s").agg(*(F.sum(c).alias(c) for c in ("raw", "off", "typed")))
        out = part if out is None else out.unionByName(part)
        if len(rows) < each:
            break

    return out.select(
        "h", "t", "r", F.when(F.col("s") == 1, "tail").otherwise("head").alias("side"), (F.col("raw") + 1).alias("raw"),
        (F.col("raw") - F.col("off") + 1).alias("filtered"), (F.col("typed") + 1).alias("typed"),
    )


class _Small:
    """Unit vectors in whole steps of 1 / 4,095 of their largest number: eight of them can be added in 16 bits."""

    most, rounds = 4095, 3

    def __init__(self, e: np.ndarray, wide: int = 4096) -> None:
        self.step = max(float(np.abs(e).max()), 1e-3) / self.most
        q = np.rint(e / self.step)
        self.error = float(np.abs(e - q * self.step).sum(1).max())
        self.total, self.n, self.wide = q.sum(1).astype(np.int32), len(e), wide
        self.tiles = [np.ascontiguousarray(q[k : k + wide].T.astype(np.int16)) for k in range(0, len(e), wide)]

    def distances(self, aim: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """aims x entities: the sum of absolute differences in steps; by how much each aim's sums may differ from the true ones.
        An aim's number beyond all entities' is cut to their largest, and what is cut off counts in full."""
        q = np.clip(np.rint(aim / self.step), -self.most, self.most)
        over = np.rint(np.abs(aim / self.step - q) * (np.abs(aim) > self.most * self.step))
        error = self.error + np.abs(np.abs(aim / self.step - q) - over).sum(1) * self.step
        got, d = np.empty((len(aim), self.n), np.int32), aim.shape[1]
        full, part = np.empty((d, self.wide), np.int16), np.empty((d, self.wide), np.int16)
        low = q.astype(np.int16)
        for k in range(len(aim)):
            full[:] = low[k][:, None]
            for s, x in enumerate(self.tiles):
                w = x.shape[1]
                p, n = part[:, :w], d
                np.maximum(x, full[:, :w], out=p)
                for _ in range(self.rounds):
                    half = n // 2
                    p[:half] += p[n - half : n]
                    n -= half
                np.add.reduce(p[:n], axis=0, dtype=np.int32, out=got[k, s * self.wide : s * self.wide + w])
        got *= 2
        got -= self.total
        got += (over.sum(1) - q.sum(1)).astype(np.int32)[:, None]
        return got, error


class _Side:
    """The test triples of a block for one side, ordered by what is asked: equal (fixed end, relation) are scored once."""

    def __init__(self, s: int, a: dict, ids: dict, true: np.ndarray) -> None:
        end = ids["h" if s else "t"]
        self.ends = np.unique(end)
        self.wide = int(ids["r"].max()) + 1
        key = np.searchsorted(self.ends, end) * self.wide + ids["r"]
        self.order = np.argsort(key, kind="stable")
        self.key, self.u = np.unique(key[self.order], return_inverse=True)
        first = np.searchsorted(key[self.order], self.key)
        fixed, r = (a[c][self.order[first]] for c in ("h2" if s else "t2", "r2"))
        self.fixed, self.r2 = fixed, r
        self.s, self.own, self.r, self.true = s, ids["t" if s else "h"][self.order], ids["r"][self.order], true[self.order]
        self.aim = S.unit(fixed) + S.unit(r) if s else S.unit(fixed) - S.unit(r)

    def asked(self, ends: np.ndarray, r: np.ndarray) -> np.ndarray:
        """The number of each (fixed end, relation) among the asked ones, or -1."""
        i = np.minimum(np.searchsorted(self.ends, ends), len(self.ends) - 1)
        key = i * self.wide + r
        u = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.ends[i] == ends) & (r < self.wide) & (self.key[u] == key), u, -1)

    def transe(self, at: slice, e: np.ndarray, small: _Small, cid: np.ndarray) -> np.ndarray:
        """triples x entities: whether the entity scores better. In whole steps first, as |x - y| = 2 max(x, y) - x - y; what is
        nearer to the threshold than the steps can tell is scored again. e: unit vectors."""
        u = self.u[at]
        used = np.arange(u[0], u[-1] + 1)
        aim = self.aim[used]
        whole, error = small.distances(aim)
        edge, whole = self.true[at] - 5e-7, whole[u - u[0]]
        low, high = (((edge + f * (error[u - u[0]] + 2e-6)) / small.step)[:, None] for f in (-1, 1))
        better = whole < np.floor(low).astype(np.int32)
        i, j = np.nonzero((whole <= np.ceil(high).astype(np.int32)) & ~better)
        for k in range(0, len(i), 20_000):
            i0, j0 = i[k : k + 20_000], j[k : k + 20_000]
            better[i0, j0] = (np.round(np.abs(aim[u[i0] - u[0]] - e[j0]).sum(1), 6) < self.true[at][i0]) & (cid[j0] != self.own[at][i0])
        return better

    def other(self, at: slice, vec: np.ndarray, cid: np.ndarray, score) -> np.ndarray:
        u = self.u[at]
        spread, every = lambda x: np.repeat(x[u], len(vec), axis=0), np.tile(vec, (len(u), 1))
        h, t = (spread(self.fixed), every) if self.s else (every, spread(self.fixed))
        got = np.round(score(h, spread(self.r2), t), 6).reshape(len(u), -1)
        return (got < self.true[at][:, None]) & (cid[None, :] != self.own[at][:, None])


def _better(shared, score):
    tile, step = (4096, 128) if score is S.transe else (256, 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, ids, true = shared.value
        n = len(true)
        if not n:
            return
        sides = [_Side(s, a, ids, true) for s in (0, 1)]
        raw, off, typed = (np.zeros((n, 2), np.int64) for _ in range(3))
        for b in batches:
            for s0 in range(0, b.num_rows, tile):
                c = b.slice(s0, tile)
                if not c.num_rows:
                    continue
                vec, cid, main = _m(c, "vec"), c.column("id").to_numpy(), c.column("main").to_numpy(zero_copy_only=False)
                flat = lambda x: (x.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(cid)), np.diff(x.offsets.to_numpy())))
                held, at = flat(c.column("kinds"))
                of = np.zeros((int(max(ids["r"].max() * 2 + 1, held.max() if len(held) else 0)) + 1, len(cid)), bool)
                of[held, at] = True
                ends, owner = flat(c.column("ends"))
                kind, _ = flat(c.column("of"))
                e = S.unit(vec)
                small = _Small(e) if score is S.transe else None
                for side in sides:
                    s, mine = side.s, kind % 2 == side.s
                    asked, ent = side.asked(ends[mine], kind[mine] // 2), owner[mine]
                    by = np.argsort(asked, kind="stable")
                    asked, ent = asked[by], ent[by]
                    for q0 in range(0, n, step):
                        q = slice(q0, min(n, q0 + step))
                        better = side.transe(q, e, small, cid) if score is S.transe else side.other(q, vec, cid, score)
                        row, u = side.order[q], side.u[q]
                        # Known candidates of each triple: a run of the links, which are sorted by what is asked.
                        lo, hi = np.searchsorted(asked, u), np.searchsorted(asked, u, side="right")
                        i = np.repeat(np.arange(len(u)), hi - lo)
                        j = ent[np.arange(len(i)) - np.repeat(np.cumsum(hi - lo) - hi, hi - lo)]
                        off[row, s] += np.bincount(i, better[i, j], len(u)).astype(np.int64)
                        better &= main[None, :]
                        raw[row, s] += better.sum(1)
                        typed[row, s] += (better & of[side.r[q] * 2 + s]).sum(1)
        for s in (0, 1):
            yield pa.record_batch({"h": ids["h"], "t": ids["t"], "r": ids["r"].astype(np.int32), "s": np.full(n, s, np.int32), "raw": raw[:, s], "off": off[:, s], "typed": typed[:, s]})

    return run


def metrics(r: DataFrame) -> DataFrame:
    """Per side and kind of rank: hits@1, 3, 10, mean rank and mean reciprocal rank; side both is over all rows."""
    sides = F.explode(F.array("side", F.lit("both"))).alias("side")  # not a union, which could rank twice
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("rank")) for k in ("raw", "filtered", "typed")))).alias("x")
    both = r.select(sides, "raw", "filtered", "typed").select("side", kinds).select("side", "x.kind", "x.rank")
    hit = lambda k: F.avg((F.col("rank") <= k).cast("double")).alias(f"hits{k}")
    return both.groupBy("side", "kind").agg(hit(1), hit(3), hit(10), F.avg(F.col("rank").cast("double")).alias("mr"), F.avg(1 / F.col("rank")).alias("mrr"))


def best_threshold(scored: DataFrame) -> DataFrame:
    """scored(score, y) with y 1 or 0 -> one row (threshold, accuracy): a score at or below it counts as true; ties to the lower."""
    n = scored.groupBy(F.round("score", 6).alias("s")).agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    n = stage(n, "scores")
    total, neg = n.agg(F.sum(F.col("p") + F.col("q")), F.sum("q")).first()
    c = running_sum(n.withColumn("d", F.col("p") - F.col("q")), ["s"], "d", "run")  # true positives less false positives so far
    acc = c.select("s", ((F.col("run") + F.lit(neg)) / F.lit(total)).alias("accuracy"))
    return acc.agg(F.max_by("s", F.struct("accuracy", -F.col("s"))).alias("threshold"), F.max("accuracy").alias("accuracy"))


def loss_sums(pairs: DataFrame, margin: float, temperature: float = 1.0) -> DataFrame:
    """pairs(pos_id, p, n): a positive's score and each of its negatives' -> one row: n positives, sums m, a, b, c of their losses.

    The sums of several parts of the positives can be added up for mean_losses().
    """
    sp = lambda x: F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))  # noqa: E731  log(1 + e^x)
    w = F.exp(-temperature * F.col("n"))
    per = pairs.groupBy("pos_id").agg(
        F.avg(F.greatest(F.col("p") - F.col("n"), F.lit(-margin))).alias("m"), F.avg(sp(F.col("p"))).alias("a"), F.avg(sp(-F.col("n"))).alias("b"),
        (F.sum(w * sp(-F.col("n"))) / F.sum(w)).alias("c"),
    )
    return per.agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in "mabc"))


def readable(path: str) -> bool:
    """Whether Python can read a written table's folder."""
    try:
        system, at = fs.FileSystem.from_uri(path)
        return system.get_file_info(at).type == fs.FileType.Directory
    except Exception:  # a file system that only the JVM has
        return False


def _blocks(path: str, values: np.ndarray, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, unit vectors) of the entities in sorted `values`, from a written table (id, vec), some `rows` at a time."""
    system, at = fs.FileSystem.from_uri(path)
    held, n = [], 0
    # Read ahead, batches would pile up: a task works on one block for long.
    batches = ds.dataset(at, filesystem=system, format="parquet").to_batches(columns=["id", "vec"], batch_size=8192, batch_readahead=1, fragment_readahead=1, use_threads=False)
    for b in batches:
        ids = b.column("id").to_numpy()
        place = np.minimum(np.searchsorted(values, ids), len(values) - 1)
        mine = np.flatnonzero(values[place] == ids)
        if len(mine):
            held.append((place[mine], S.unit(_m(b, "vec")[mine])))
            n += len(mine)
        if n >= rows:
            yield tuple(map(np.concatenate, zip(*held)))
            held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def loss_sums_in_place(rows: DataFrame, shared, path: str, relations: dict, many: int, margin: float, chunk: int, block: int = 32_000) -> DataFrame:
    """The sums of loss_sums(), a row a task, of the triples (h, t, r, js, values) with `many` corrupted tails by TransE.

    shared: as sampling.sent(); js, values: the numbers of the negatives that are not the first draw, and their entities, -1 for
    none. path: the written vectors (id, vec), which a task reads twice for each `chunk` of its triples, first for the
    heads' vectors: neither vectors nor negatives are shuffled or sent.
    """
    kinds = sorted(relations)
    points = S.unit(np.array([relations[r] for r in kinds], np.float64)) if kinds else np.zeros((0, 1))

    def scores(h: np.ndarray, t: np.ndarray, r: np.ndarray, changed: tuple, values: np.ndarray) -> np.ndarray:
        """triples x (1 + many): the score of each triple and its negatives; NaN where a vector is missing."""
        to = np.empty((len(h), 1 + many), np.int32)
        to[:, 0] = np.searchsorted(values, t)
        for j in range(1, many + 1):
            to[:, j] = sampling.drawn(h, t, r, j, len(values))
        row, j, value = changed
        to[row, j] = np.where(value >= 0, np.searchsorted(values, value), -1)
        head, at = np.unique(h, return_inverse=True)
        head = np.searchsorted(values, head)
        hv, none = None, np.full(len(values), -1, np.int32)
        for place, vec in _blocks(path, values, block):
            hv = np.full((len(head), vec.shape[1]), np.nan) if hv is None else hv
            where = none.copy()
            where[place] = np.arange(len(place))
            mine = np.flatnonzero(where[head] >= 0)
            hv[mine] = vec[where[head[mine]]]
        out = np.full(to.size, np.nan)
        if hv is None or not len(kinds):
            return out.reshape(to.shape)
        kind = np.minimum(np.searchsorted(kinds, r), len(kinds) - 1)
        flat = to.ravel()
        for place, vec in _blocks(path, values, block):
            where = none.copy()
            where[place] = np.arange(len(place))
            step = 1 << 20
            for s0 in range(0, len(flat), step):
                w = where[flat[s0 : s0 + step]]
                w[flat[s0 : s0 + step] < 0] = -1
                pick = np.flatnonzero(w >= 0)
                for s in range(0, len(pick), 2048):
                    p = pick[s : s + 2048]
                    i = (p + s0) // (1 + many)
                    d = hv[at[i]]
                    d += points[kind[i]]
                    d -= vec[w[p]]
                    out[p + s0] = np.abs(d, out=d).sum(1)
        out = out.reshape(to.shape)
        out[np.array(kinds)[kind] != r] = np.nan
        return out

    def summed(x: np.ndarray) -> np.ndarray:
        sp = lambda v: np.maximum(v, 0) + np.log1p(np.exp(-np.abs(v)))
        x = x[~np.isnan(x[:, 0]) & ~np.isnan(x[:, 1:]).all(1)]
        p, n = x[:, :1], x[:, 1:]
        count, w = (~np.isnan(n)).sum(1), np.exp(-n)
        each = (np.nansum(np.maximum(p - n, -margin), 1) / count, sp(p[:, 0]), np.nansum(sp(-n), 1) / count, np.nansum(w * sp(-n), 1) / np.nansum(w, 1))
        return np.array([len(x), *(v.sum() for v in each)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n = np.zeros(5), [], 0
        values = None

        def flush() -> np.ndarray:
            table = pa.Table.from_batches(held).combine_chunks()
            h, t, r = (table[c].to_numpy().astype(np.int64) for c in ("h", "t", "r"))
            row = np.repeat(np.arange(len(h)), table["js"].combine_chunks().value_lengths().to_numpy())
            changed = (row, *(table[c].combine_chunks().flatten().to_numpy() for c in ("js", "values")))
            by = np.argsort(h, kind="stable")  # triples of a head follow each other
            back = np.empty(len(by), np.int64)
            back[by] = np.arange(len(by))
            x = scores(h[by], t[by], r[by], (back[changed[0]], *changed[1:]), values)
            return sum(summed(x[s : s + 20_000]) for s in range(0, len(x), 20_000))

        for b in batches:
            for s in range(0, b.num_rows, chunk):
                if values is None:
                    values = np.cumsum(sampling._unpacked(*shared.value[0]))
                held.append(part := b.slice(s, chunk))
                n += part.num_rows
                if n >= chunk:
                    total, held, n = total + flush(), [], 0
        if held:
            total = total + flush()
        if total[0]:
            yield pa.record_batch({"n": pa.array([int(total[0])], pa.int64())} | {c: [float(v)] for c, v in zip("mabc", total[1:])})

    return rows.mapInArrow(run, "n long, m double, a double, b double, c double")


def mean_losses(sums: DataFrame, margin: float) -> DataFrame:
    """One row of mean losses from rows of loss_sums().

    Margin: mean(max(p - n, -margin)) + margin. Sigmoid and softplus take scores where higher is better, i.e. -p and -n.
    adversarial: the sigmoid loss with negatives weighted by softmax(temperature * -n) within a positive.
    """
    s = sums.agg(*(F.sum(c).alias(c) for c in "nmabc"))
    n = F.nullif(F.col("n"), F.lit(0))
    return s.select((F.col("m") / n + margin).alias("margin"), ((F.col("a") + F.col("b")) / n / 2).alias("softplus"), ((F.col("a") + F.col("c")) / n / 2).alias("adversarial"))


def losses(pairs: DataFrame, margin: float, temperature: float = 1.0) -> DataFrame:
    """pairs(pos_id, p, n) -> one row of mean losses."""
    return mean_losses(loss_sums(pairs, margin, temperature), margin)
