"""Splits, corrupted triples, weighted draws; every draw is a function of keys and a seed, so a lost task draws the same again."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from spanloom.operators.order import positions
from spanloom.runtime import by_key, discard, stage


def arithmetic_hash(key: Column, a: int = 7919, b: int = 13, m: int = 100003) -> Column:
    """(a * key + b) mod m: portable to any SQL."""
    return F.pmod(key.cast("long") * a + b, F.lit(m))


def split_train(df: DataFrame, key: str) -> DataFrame:
    """Adds part: train for n // 10 * 9 rows in hash order, valid for the others."""
    n = df.count()
    p = positions(df, [arithmetic_hash(F.col(key)), key], "_pos")
    return p.withColumn("part", F.when(F.col("_pos") < n // 10 * 9, "train").otherwise("valid")).drop("_pos")


def split_three(df: DataFrame, by: list[Column | str]) -> DataFrame:
    """Adds part: train n // 10 * 8, then test half of the rest, then valid."""
    n = df.count()
    train = n // 10 * 8
    test = train + (n - train) // 2
    p = positions(df, by, "_pos")
    return p.withColumn("part", F.when(F.col("_pos") < train, "train").when(F.col("_pos") < test, "test").otherwise("valid")).drop("_pos")


def bernoulli(stats: DataFrame) -> DataFrame:
    """(r, tail_prob): the chance to replace the tail, hpt / (hpt + tph)."""
    return stats.select("r", (F.col("hpt") / (F.col("hpt") + F.col("tph"))).alias("tail_prob"))


def _draws(todo: DataFrame, rounds: range) -> DataFrame:
    return todo.withColumn("k", F.explode(F.sequence(F.lit(rounds.start), F.lit(rounds.stop - 1))))


def corrupt(t: DataFrame, known: DataFrame, side: str, pool: DataFrame, size: str, index: str, most: int = 64, step: int = 8, number: str | None = None) -> DataFrame:
    """One filtered corruption of `side` (h, t or r) for each row of t(h, t, r, ..size column..).

    pool(.., index, value) holds the candidates numbered from 0; `size` is the number of candidates of a row. Draw k
    of a row is candidate (31 h + 17 t + 7 r + 7919 k) mod size; the first draw that gives no known triple counts. Rows
    without one after `most` draws take the n-th of their unknown candidates in order, n = (31 h + 17 t + 7 r) mod their
    number; the value is null only where all candidates are known. Anti-joins the known triples with the draws only;
    nothing is crossed with all entities. number: a column that tells several negatives of a triple apart; 104729 times
    it is added to the start of the draws, and it stays in the result.
    """
    key, start = ["h", "t", "r", *([number] if number else [])], _start(number)
    on = [c for c in pool.columns if c not in (index, "value")]
    todo, out, k = stage(t, "todo"), None, 0
    while k < most:
        d = _draws(todo, range(k, k + step))
        d = d.withColumn(index, F.pmod(start + F.col("k") * 7919, F.col(size)))
        d = d.join(pool, [*on, index])
        new = {c: F.col("value") if c == side else F.col(c) for c in ("h", "t", "r")}
        d = d.select(*key, "k", "value", *(v.cast("long").alias(f"n{c}") for c, v in new.items()))
        free = d.join(known.select(*(F.col(c).cast("long").alias(f"n{c}") for c in ("h", "t", "r"))), ["nh", "nt", "nr"], "left_anti")
        got = stage(free.groupBy(*key).agg(F.min_by("value", "k").alias("value")), "got")
        out = got if out is None else out.unionByName(got)
        last, todo = todo, stage(todo.join(got, key, "left_anti"), "todo")
        discard(last)
        k += step
        if todo.isEmpty():
            return out
    return out.unionByName(_nth_unknown(todo, known, side, pool, size, index, key, start))


def _start(number: str | None) -> Column:
    s = F.col("h") * 31 + F.col("t") * 17 + F.col("r") * 7
    return s + F.col(number) * 104729 if number else s


def _nth_unknown(todo: DataFrame, known: DataFrame, side: str, pool: DataFrame, size: str, index: str, key: list[str], start: Column) -> DataFrame:
    """(h, t, r, .., value) for the rows of todo: the place of the n-th unknown candidate is n plus the known ones before it.

    The i-th known place p (from 0) lies before it exactly if p - i <= n, so the known ones are counted by merging both
    lists in one sorted pass a key.
    """
    on = [c for c in pool.columns if c not in (index, "value")]
    same = [c for c in ("h", "t", "r") if c != side]
    # `pool` may be keyed by r; where r is the side there is no further key.
    taken = known.select(*same, F.col(side).cast("long").alias("value")).distinct().join(todo.select(*same).distinct(), same, "left_semi")
    taken = taken.join(pool.withColumn("value", F.col("value").cast("long")), [*on, "value"])
    by = W.partitionBy(*same).orderBy(index)
    marks = stage(taken.select(*same, (F.col(index) - F.row_number().over(by) + 1).cast("long").alias("at")), "known")
    n = todo.join(marks.groupBy(*same).agg(F.count("*").alias("taken")), same, "left").withColumn("free", F.col(size) - F.coalesce("taken", F.lit(0)))
    asked = n.where("free > 0").select(*key, F.pmod(start, F.col("free")).cast("long").alias("at"), F.lit(1).alias("asked"))
    for c in key:
        if c not in same:
            marks = marks.withColumn(c, F.lit(None).cast(todo.schema[c].dataType))
    both = asked.unionByName(marks.withColumn("asked", F.lit(0)))
    before = F.sum(1 - F.col("asked")).over(W.partitionBy(*same).orderBy("at", "asked").rowsBetween(W.unboundedPreceding, 0))
    place = both.withColumn(index, F.col("at") + before).where("asked = 1").select(*key, index)
    found = place.join(pool, [*on, index]).select(*key, F.col("value").cast("long").alias("value"))
    return todo.select(*key).join(found, key, "left")


MOST_SENT = 8_000_000  # candidates that are sent to the tasks
_SEGMENT = 19  # bits of a place in a segment of the filter


def _name(*parts: np.ndarray) -> np.ndarray:
    """A 64-bit name of the rows of some integer arrays."""
    z = np.zeros(1, np.uint64)
    for x in parts:
        z = (z ^ x.astype(np.int64).view(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return z


def _places(name: np.ndarray) -> list[np.ndarray]:
    """Three bits of a name in its segment."""
    low = np.uint64((1 << _SEGMENT) - 1)
    return [(x & low).astype(np.int64) for x in (name, name >> np.uint64(_SEGMENT), _name(name.view(np.int64)))]


def _packed(x: np.ndarray) -> tuple[bytes, int, str]:
    """An array as it travels: every process and the driver hold a file of what is sent."""
    return pa.compress(np.ascontiguousarray(x).tobytes(), "zstd", asbytes=True), x.nbytes, x.dtype.str


def _unpacked(data: bytes, size: int, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, size, "zstd"), np.dtype(kind))


class Known:
    """A Bloom filter of triples: `may` is true for every known triple and for few others."""

    def __init__(self, segments: dict[int, bytes], bits: int) -> None:
        self.shift = 64 - bits
        self.array = np.zeros((1 << bits, 1 << (_SEGMENT - 3)), np.uint8)
        for k, x in segments.items():
            self.array[k] = np.frombuffer(x, np.uint8)
        self.array = self.array.ravel()

    def __getstate__(self) -> dict:
        return {"shift": self.shift, "array": _packed(self.array)}

    def __setstate__(self, state: dict) -> None:
        self.shift, self.array = state["shift"], _unpacked(*state["array"])

    def may(self, h: np.ndarray, t: np.ndarray, r: np.ndarray) -> np.ndarray:
        name = _name(h, t, r)
        base = _segment(name, self.shift) << _SEGMENT
        left = np.arange(len(name))
        for k, low in enumerate(_places(name)):
            at = base[left] + low[left]
            left = left[(self.array[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1]
        out = np.zeros(len(name), bool)
        out[left] = True
        return out


def _segment(name: np.ndarray, shift: int) -> np.ndarray:
    return (name >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(name), np.int64)


def known_filter(known: DataFrame, most: int = 9) -> Known:
    """The filter of known(h, t, r): 32 to 64 bits a triple, 2 ** most segments (32 MB) at most whatever the number of triples."""
    bits = int(np.clip(np.ceil(np.log2(max(1, 32 * known.count() / (1 << _SEGMENT)))), 0, most))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                name = _name(*(b.column(c).to_numpy() for c in ("h", "t", "r")))
                segment = _segment(name, 64 - bits)
                order = np.argsort(segment, kind="stable")
                k, first = np.unique(segment[order], return_index=True)
                for k, at in zip(k, np.split(order, first[1:])):
                    x = held.setdefault(int(k), np.zeros(1 << (_SEGMENT - 3), np.uint8))
                    for low in _places(name[at]):
                        np.bitwise_or.at(x, low >> 3, np.uint8(128) >> (low & 7).astype(np.uint8))
        for k, x in held.items():
            yield pa.record_batch({"segment": [k], "bits": [pa.compress(x.tobytes(), "zstd", asbytes=True)]})

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column("segment").to_pylist(), b.column("bits").to_pylist()):
                x = np.frombuffer(pa.decompress(x, 1 << (_SEGMENT - 3), "zstd"), np.uint8)
                held[k] = held[k] | x if k in held else x
        for k, x in held.items():
            yield pa.record_batch({"segment": [k], "bits": [x.tobytes()]})

    # Few tasks fill: what is shuffled is their bits, some 3 bytes a triple, not the names.
    cores = known.sparkSession.sparkContext.defaultParallelism
    part = known.select("h", "t", "r").coalesce(cores).mapInArrow(fill, "segment long, bits binary")
    whole = stage(by_key(part, "segment").mapInArrow(unite, "segment long, bits binary"), "filter")
    got = whole.toArrow()
    discard(whole)
    return Known(dict(zip(got["segment"].to_pylist(), got["bits"].to_pylist())), bits)


def sent(t: DataFrame, pool: DataFrame):
    """What draws need where the triples are, as a broadcast: the values of pool(idx, value) in order, and a filter of the triples."""
    idx = pool.select("idx", "value").toArrow()
    values = np.empty(idx.num_rows, np.int64)
    values[idx["idx"].to_numpy()] = idx["value"].to_numpy()
    return t.sparkSession.sparkContext.broadcast((_packed(np.diff(values, prepend=0)), known_filter(t)))


def drawn(h: np.ndarray, t: np.ndarray, r: np.ndarray, j: np.ndarray, size: int) -> np.ndarray:
    """The place in the pool of the first draw of number j of each triple, as in corrupt()."""
    return (h * 31 + t * 17 + r * 7 + j * 104729) % size


def first_draws(t: DataFrame, pool: DataFrame, many: int, tail: Callable[[Column], Column], shared=None) -> tuple[DataFrame, DataFrame]:
    """`many` negatives of each triple of t(h, t, r, ..), as corrupt() draws them, without a shuffle of triples times `many`.

    Draws are made where the triples are, from the pool(idx, value), which is sent to the tasks (MOST_SENT at most), and
    held against a filter of the triples. -> (h, t, r, j, nh, nt) of those whose first draw is certainly unknown, and
    (h, t, r, j, tail), written, of the few others, for corrupt(). tail(j): whether number j changes the tail. shared: as sent().
    """
    shared = shared or sent(t, pool)
    rows = t.select("h", "t", "r", F.transform(F.sequence(F.lit(1), F.lit(many)), tail).alias("tails"))

    def draws(certain: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            step, known = shared.value
            values = np.cumsum(_unpacked(*step))
            for whole in batches:
                for s in range(0, whole.num_rows, 4096):
                    b = whole.slice(s, 4096)
                    j = np.tile(np.arange(1, many + 1), b.num_rows)
                    h, x, r = (np.repeat(b.column(c).to_numpy().astype(np.int64), many) for c in ("h", "t", "r"))
                    tails = b.column("tails").flatten().to_numpy(zero_copy_only=False).astype(bool)
                    value = values[drawn(h, x, r, j, len(values))]
                    nh, nt = np.where(tails, h, value), np.where(tails, value, x)
                    may = known.may(nh, nt, r)
                    at = np.flatnonzero(may != certain)
                    if len(at):
                        ends = {"nh": nh[at], "nt": nt[at]} if certain else {"tail": tails[at]}
                        yield pa.record_batch({"h": h[at], "t": x[at], "r": r[at].astype(np.int32), "j": j[at].astype(np.int32), **ends})

        return run

    key = "h long, t long, r int, j int, "
    return rows.mapInArrow(draws(True), key + "nh long, nt long"), stage(rows.mapInArrow(draws(False), key + "tail boolean"), "sides")


def entity_pool(t: DataFrame) -> DataFrame:
    """(idx, value): all entities numbered in order."""
    return positions(t.select(F.col("h").alias("value")).union(t.select("t")).distinct(), ["value"], "idx")


def typed_pool(t: DataFrame, side: str = "t") -> tuple[DataFrame, DataFrame]:
    """(r, idx, value) and (r, size): the entities seen on a side of each relation, numbered per relation."""
    p = positions(t.select("r", F.col(side).alias("value")).distinct(), ["r", "value"], "pos")
    first = p.groupBy("r").agg(F.min("pos").alias("first"), F.count("*").alias("size"))
    return p.join(F.broadcast(first), "r").select("r", (F.col("pos") - F.col("first")).alias("idx"), "value"), first.select("r", "size")


def weighted_pick(df: DataFrame, group: str, item: str, weight: str, u: Column) -> DataFrame:
    """One item a group with probability by weight: the smallest -ln(u) / weight; without positive weights all are alike."""
    top = df.groupBy(group).agg(F.max(weight).alias("_t"))
    w = df.join(F.broadcast(top), group).withColumn("_w", F.when(F.col("_t") > 0, F.col(weight)).otherwise(F.lit(1.0))).where("_w > 0")
    key = -F.log(u) / F.col("_w")
    return w.groupBy(group).agg(F.min_by(item, F.struct(key.alias("key"), item)).alias(item))


def softmax_rows(df: DataFrame, row: str, score: str, temperature: float = 1.0) -> DataFrame:
    """Adds prob: exp(-score / temperature) over its sum in the row."""
    e = df.withColumn("_e", F.exp(-F.col(score) / temperature))
    s = e.groupBy(row).agg(F.sum("_e").alias("_s"))
    return e.join(s, row).withColumn("prob", F.col("_e") / F.col("_s")).drop("_e", "_s")
