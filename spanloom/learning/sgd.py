"""Translation and skip-gram embeddings by local SGD: partitions train on their own rows from shared parameters, then
the rows of each entity that was touched are averaged. Parameters are sent to the tasks, so `most` entities is a
hard bound; data are not collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.sampling import Known, known_filter
from spanloom.runtime import by_key, discard, stage


def initial(n: int, dim: int, seed: int = 3) -> np.ndarray:
    """Uniform within 0.5 / dim, in single precision."""
    return (np.random.default_rng(seed).uniform(-0.5, 0.5, (n, dim)) / dim).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    """Clamped to 0 and 1 outside of -6 .. 6."""
    return np.where(x < -6, 0.0, np.where(x > 6, 1.0, 1 / (1 + np.exp(-np.clip(x, -6, 6)))))


_BLOCK = 8192  # rows of parameters that travel together
_PIECE = 32  # triples whose negatives are held at once


def _average(df: DataFrame, into: dict[str, np.ndarray], epochs: dict[int, float] | None = None) -> float:
    """Average the blocks (kind, block, at, vec, loss, n) into the parameters; the mean loss, and into `epochs` that of each
    epoch, which is the block of a row of losses.

    Blocks are added up where they meet, in single precision as they travel; the shuffle is deleted when they are written.
    """
    width = {k: x.shape[1] for k, x in into.items()}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
        losses: dict[int, tuple[float, int]] = {}
        for b in batches:
            for kind, block, at, vec, loss, n in zip(*(b.column(c) for c in ("kind", "block", "at", "vec", "loss", "n"))):
                kind = kind.as_py()
                if kind == "loss":
                    x, m = losses.get(block.as_py(), (0.0, 0))
                    losses[block.as_py()] = (x + loss.as_py(), m + n.as_py())
                else:
                    s, c = total.setdefault((kind, block.as_py()), (np.zeros((_BLOCK, width[kind])), np.zeros(_BLOCK, np.int64)))
                    at = np.frombuffer(at.as_buffer(), np.uint16)
                    s[at] += np.frombuffer(vec.as_buffer(), np.float32).reshape(len(at), -1)
                    c[at] += 1
        for (kind, block), (s, c) in total.items():
            at = np.flatnonzero(c)
            yield _row(kind, block, at, s[at] / c[at][:, None], 0.0, 0)
        for block, (loss, n) in losses.items():
            yield _row("loss", block, np.zeros(0, np.int64), np.zeros(0), loss, n)

    mean = stage(by_key(df, "kind", "block").mapInArrow(add, _SCHEMA), "parameters")
    loss, n = 0.0, 0
    for r in mean.toLocalIterator():  # at most the bounded number of parameters
        if r["kind"] == "loss":
            loss, n = loss + r["loss"], n + r["n"]
            if epochs is not None:
                epochs[r["block"]] = r["loss"] / max(1, r["n"])
        else:
            at = np.frombuffer(r["at"], np.uint16).astype(np.int64) + r["block"] * _BLOCK
            into[r["kind"]][at] = np.frombuffer(r["vec"], np.float32).reshape(len(at), -1)
    discard(mean)
    return loss / max(1, n)


def _cut(x: np.ndarray) -> list[np.ndarray]:
    """Parameters as they are sent: in blocks, as the driver would pickle a whole array in memory."""
    return [x[s : s + _BLOCK] for s in range(0, max(1, len(x)), _BLOCK)]


def _row(kind: str, block: int, at: np.ndarray, vec: np.ndarray, loss: float, n: int) -> pa.RecordBatch:
    return pa.record_batch({
        "kind": [kind], "block": pa.array([block], pa.int64()), "at": [at.astype(np.uint16).tobytes()], "vec": [vec.astype(np.float32).tobytes()],
        "loss": [loss], "n": pa.array([n], pa.int64()),
    })


def _out(touched: dict[str, tuple[np.ndarray, np.ndarray]], loss: float | list[float], n: int) -> Iterator[pa.RecordBatch]:
    """The rows of the parameters that were seen, in blocks, and the sum of losses, or those of some epochs, over n rows each."""
    for kind, (seen, x) in touched.items():
        for block in range(-(-len(seen) // _BLOCK)):
            at = np.flatnonzero(seen[block * _BLOCK : (block + 1) * _BLOCK])
            if len(at):
                yield _row(kind, block, at, x[at + block * _BLOCK], 0.0, 0)
    for k, x in enumerate(loss if isinstance(loss, list) else [loss]):
        yield _row("loss", k, np.zeros(0, np.int64), np.zeros(0), x, n)


_SCHEMA = "kind string, block long, at binary, vec binary, loss double, n long"


def xavier(n: int, dim: int, rng: np.random.Generator) -> np.ndarray:
    """Uniform within sqrt(6 / (n + dim)), in single precision."""
    x = np.empty((n, dim), np.float32)
    for s in range(0, n, _BLOCK):
        x[s : s + _BLOCK] = rng.uniform(-1, 1, x[s : s + _BLOCK].shape) * np.sqrt(6 / (n + dim))
    return x


def _corrupted(known: Known, x: np.ndarray, y: np.ndarray, z: np.ndarray, tail: np.ndarray, entities: int, draw: np.random.Generator, most: int = 64) -> np.ndarray:
    """An entity for each of the triples that makes no known one of it when it replaces the tail, or else the head; -1 if none does.

    What is still known after `most` draws is drawn from its list of unknown ones."""
    w, left = np.full(len(x), -1), np.arange(len(x))
    for _ in range(most):
        e = draw.integers(0, entities, len(left))
        may = known.may(np.where(tail[left], x[left], e), np.where(tail[left], e, y[left]), z[left])
        w[left[~may]] = e[~may]
        left = left[may]
        if not len(left):
            return w
    every = np.arange(entities)
    for i in left:
        same = lambda v: np.full(entities, v)
        free = np.flatnonzero(~known.may(same(x[i]) if tail[i] else every, every if tail[i] else same(y[i]), same(z[i])))
        w[i] = draw.choice(free) if len(free) else -1
    return w


def _normed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and one over the lengths."""
    inv = 1 / np.maximum(np.sqrt(np.einsum("nd,nd->n", x, x)), np.float32(1e-12))
    return x * inv[:, None], inv


def _descend(e: np.ndarray, at: np.ndarray, unit: np.ndarray, inv: np.ndarray, g: np.ndarray) -> None:
    """Subtract the gradients g of the unit vectors of the rows `at`, carried through the normalisation; rows may repeat.

    Gradients of a row are added up by halves: each round adds every second one to the one before it."""
    g -= np.einsum("nd,nd->n", g, unit)[:, None] * unit
    g *= inv[:, None]
    i = np.argsort(at, kind="stable")
    while True:
        row, n = at[i], np.arange(len(i))
        new = np.concatenate(([True], row[1:] != row[:-1]))
        odd = (n - np.maximum.accumulate(np.where(new, n, 0))) % 2 == 1
        if not odd.any():
            break
        g[i[:-1][odd[1:]]] += g[i[odd]]
        i = i[~odd]
    e[row] -= g[i]


def _step(e: np.ndarray, r: np.ndarray, x: np.ndarray, y: np.ndarray, z: np.ndarray, w: np.ndarray, tail: np.ndarray, rate: float, margin: float) -> float:
    """Take a step down the margin losses of the triples (x, y, z) and their negatives w (n, m); the sum over triples of the mean loss.

    e and r change in place by `rate` times the summed gradients of all pairs; a negative of -1 gives no pair."""
    n, m = w.shape
    (u, inv), (ru, ri) = _normed(e.take(np.concatenate((x, y, w.ravel())), 0)), _normed(r[z])
    hu, tu = u[:n], u[n : 2 * n]
    aim = hu + ru
    dp = aim - tu
    # A negative's distance is that of the new entity from where the other end and the relation point to.
    s = np.concatenate((aim, tu - ru)).take((np.arange(n)[:, None] + np.where(tail, 0, n)).ravel(), 0)
    s -= u[2 * n :]
    sign = np.sign(s)
    gap = np.abs(dp).sum(1)[:, None] - np.einsum("nd,nd->n", s, sign).reshape(n, m) + np.float32(margin)
    gap *= w >= 0
    on = (gap > 0).astype(np.float32) * np.float32(rate)
    g = np.empty_like(u)
    np.multiply(sign, on.reshape(-1, 1), out=g[2 * n :])
    sides = np.matmul(np.stack((tail, ~tail), 1).astype(np.float32), g[2 * n :].reshape(n, m, -1))
    pos = np.sign(dp) * on.sum(1)[:, None]
    g[:n], g[n : 2 * n] = pos - sides[:, 0], -pos - sides[:, 1]
    _descend(r, z, ru, ri, pos - sides[:, 0] + sides[:, 1])
    _descend(e, np.concatenate((x, y, w.ravel())), u, inv, g)
    return float((np.maximum(gap, 0).sum(1) / np.maximum(1, (w >= 0).sum(1))).sum())


def train_transe(
    triples: DataFrame, entities: int, relations: int, dim: int = 200, rounds: int = 1000, rate: float = 1.0, margin: float = 5.0, negatives: int = 25,
    batches: int = 100, most: int = 2_000_000, seed: int = 3, apart: int = 25, least: int = 2000,
) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """triples(h, t, r) with ids from 0 -> entity and relation vectors and the mean margin loss of each round (L1, normalised).

    A round takes all triples, each with `negatives` unknown ones whose side is drawn by relation, in `batches` steps down
    the mean loss. A task takes its own triples for `apart` rounds before parameters are averaged, and has `least` triples
    if there are so many; where one task has all, nothing is averaged.
    """
    if entities > most:
        raise ValueError(f"{entities} entities; parameters are sent to every task, at most {most}")
    rng = np.random.default_rng(seed)
    p = {"e": xavier(entities, dim, rng), "r": xavier(relations, dim, rng)}
    spark = triples.sparkSession
    tasks = int(np.clip(triples.count() // least, 1, spark.sparkContext.defaultParallelism))
    triples, apart = triples.coalesce(tasks), apart if tasks > 1 else max(1, rounds)
    heads, tails = np.ones(relations), np.ones(relations)
    for x in triples.groupBy("r").agg(F.count_distinct("h").alias("h"), F.count_distinct("t").alias("t")).toLocalIterator():
        heads[x["r"]], tails[x["r"]] = x["h"], x["t"]
    always = spark.sparkContext.broadcast((known_filter(triples).__getstate__(), heads / (heads + tails)))
    history = []
    for k in range(0, rounds, apart):
        shared = spark.sparkContext.broadcast((_cut(p["e"]), p["r"]))

        def run(rows: Iterator[pa.RecordBatch], shared=shared, k=k) -> Iterator[pa.RecordBatch]:
            own = [[b.column(c).to_numpy() for c in ("h", "t", "r")] for b in rows if b.num_rows]
            if not own:
                return
            h, t, q = (np.concatenate(c) for c in zip(*own))
            state, chance = always.value
            known = Known.__new__(Known)  # broadcasts name classes, and executors need no copy of the package
            known.__setstate__(state)
            e, r = np.concatenate(shared.value[0]), shared.value[1].copy()
            draw = np.random.default_rng([seed, k, TaskContext.get().partitionId()])
            seen_e, seen_r, losses = np.zeros(len(e), bool), np.zeros(len(r), bool), []
            for _ in range(min(apart, rounds - k)):
                loss = 0.0
                for batch in np.array_split(draw.permutation(len(h)), min(batches, len(h))):
                    for s in range(0, len(batch), _PIECE):
                        at = batch[s : s + _PIECE]
                        x, y, z = h[at], t[at], q[at]
                        tail = draw.random((len(at), negatives)) < chance[z][:, None]
                        w = _corrupted(known, *(np.repeat(i, negatives) for i in (x, y, z)), tail.ravel(), len(e), draw).reshape(tail.shape)
                        loss += _step(e, r, x, y, z, w, tail, rate / (len(batch) * negatives), margin)
                        seen_e[x] = seen_e[y] = seen_e[w[w >= 0]] = seen_r[z] = True
                losses.append(loss)
            yield from _out({"e": (seen_e, e), "r": (seen_r, r)}, losses, len(h))

        epochs: dict[int, float] = {}
        _average(triples.select("h", "t", "r").mapInArrow(run, _SCHEMA), p, epochs)
        history += [epochs[i] for i in sorted(epochs)]
        shared.destroy(blocking=True)
    always.destroy(blocking=True)
    return p["e"], p["r"], history


def train_pairs(pairs: DataFrame, nodes: int, dim: int = 32, rounds: int = 5, rate: float = 0.025, negatives: int = 5, weights: np.ndarray | list[tuple[np.ndarray, np.ndarray]] | None = None, most: int = 2_000_000, seed: int = 3) -> tuple[np.ndarray, list[float]]:
    """pairs(u, v) of nodes numbered from 0 that end a walk -> node vectors and the mean log loss of each round.

    Negatives are drawn by `weights` (counts ** 0.75 by convention); a list has the (nodes, weights) of each value of a
    further column g of the pairs. The rate falls linearly to 1e-4 at least.
    """
    if nodes > most:
        raise ValueError(f"{nodes} nodes; parameters are sent to every task, at most {most}")
    p, history = {"e": initial(nodes, dim, seed)}, []
    groups = isinstance(weights, list)
    if groups:
        edge = [(i, np.cumsum(w / w.sum())) for i, w in weights]
    else:
        edge = np.cumsum(weights / weights.sum()) if weights is not None and weights.sum() > 0 else None
    for k in range(rounds):
        shared = pairs.sparkSession.sparkContext.broadcast((_cut(p["e"]), edge))
        step = max(1e-4, rate * (1 - k / rounds))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, k=k, step=step) -> Iterator[pa.RecordBatch]:
            e, edge = np.concatenate(shared.value[0]), shared.value[1]
            draw = np.random.default_rng([seed, k])
            loss, n, seen = 0.0, 0, np.zeros(len(e), bool)
            for b in batches:
                u, v = b.column("u").to_numpy(), b.column("v").to_numpy()
                for s in range(0, len(u), 256):
                    x, y = u[s : s + 256], v[s : s + 256]
                    if groups:
                        w, g = np.empty((len(x), negatives), np.int64), b.column("g").to_numpy()[s : s + 256]
                        for k in np.unique(g):
                            i, c = edge[k]
                            w[g == k] = i[np.minimum(np.searchsorted(c, draw.random(((g == k).sum(), negatives))), len(i) - 1)]
                    else:
                        w = draw.integers(0, len(e), (len(x), negatives)) if edge is None else np.minimum(np.searchsorted(edge, draw.random((len(x), negatives))), len(e) - 1)
                    to = np.concatenate((y[:, None], w), 1)
                    want = np.zeros(to.shape)
                    want[:, 0] = 1
                    f = sigmoid(np.einsum("nd,nkd->nk", e[x], e[to]))
                    loss -= float(np.log(np.clip(np.where(want == 1, f, 1 - f), 1e-9, 1)).sum())
                    n += len(x)
                    g = (want - f) * step
                    dx = np.einsum("nk,nkd->nd", g, e[to])
                    np.add.at(e, to.ravel(), (g[:, :, None] * e[x][:, None, :]).reshape(-1, e.shape[1]))
                    np.add.at(e, x, dx)
                    seen[x] = seen[to.ravel()] = True
            if n:
                yield from _out({"e": (seen, e)}, loss, n)

        history.append(_average(pairs.select("u", "v", *(["g"] if groups else [])).mapInArrow(run, _SCHEMA), p))
        shared.destroy(blocking=True)
    return p["e"], history
