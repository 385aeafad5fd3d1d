"""What the operators of this subpackage share: words, list values, 64-bit mixing, hashed count arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.runtime import by_key, discard, stage

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = 0x9E3779B97F4A7C15


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64) of x + seed."""
    z = x.astype(np.uint64, copy=True) if x.dtype != np.uint64 else x.copy()
    z += np.uint64((seed * _GOLD + _GOLD) & 0xFFFFFFFFFFFFFFFF)
    z ^= z >> np.uint64(30)
    z *= _M1
    z ^= z >> np.uint64(27)
    z *= _M2
    z ^= z >> np.uint64(31)
    return z


def words(text: Column) -> Column:
    """Maximal runs of a-z and 0-9 in the lower-cased text."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def list_values(values: Column) -> Column:
    """Trimmed, lower-cased, distinct values; nulls and blanks dropped. Null gives null."""
    v = F.transform(values, lambda x: F.regexp_replace(F.lower(x), r"^\s+|\s+$", ""))
    return F.array_distinct(F.filter(v, lambda x: x.isNotNull() & (x != "")))


def pieces(b: pa.RecordBatch, most: int = 400_000) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most `most` list values (`toks`), or of one row: long records do not pile up in memory."""
    if "toks" not in b.schema.names:
        yield b
        return
    at = np.cumsum(np.diff(b.column("toks").offsets.to_numpy()))
    start = 0
    while start < b.num_rows:
        base = at[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(at, base + most, side="right")))
        yield b.slice(start, stop - start)
        start = stop


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch; empty results give no batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in pieces(b):
                out = f(part) if part.num_rows else None
                if out is not None and out.num_rows:
                    yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(run, schema)


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(flat values, lengths) of a list<long> column without null lists."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    off = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]], np.diff(off).astype(np.int64)


_CHUNK = 16  # bits of a cell's place in its chunk


def coded(n: np.ndarray) -> np.ndarray:
    """Counts in a byte, on a scale of eight steps a doubling: 0 is none, 1 is one; strictly rising up to 16, then in steps."""
    with np.errstate(divide="ignore"):
        return np.where(n > 0, np.minimum(255, 1 + np.floor(8 * np.log2(n))), 0).astype(np.uint8)


def decoded(code: np.ndarray) -> np.ndarray:
    return _DECODED[code]


_DECODED = np.where(np.arange(256) > 0, 2.0 ** ((np.arange(256) - 1) / 8), 0.0)


def cells_for(keys: int, least: int = 16, most: int = 25) -> int:
    """Bits of a count array for so many keys: two to four cells a key, 2**25 cells at most."""
    return int(min(most, max(least, np.ceil(np.log2(max(1, 2 * keys))))))


class Cells:
    """A coded count array as it travels: chunks compressed, unpacked once in a process."""

    def __init__(self, chunks: dict[int, bytes], bits: int) -> None:
        self.chunks, self.bits, self.array = chunks, bits, None

    def __getstate__(self) -> dict:
        return {"chunks": self.chunks, "bits": self.bits, "array": None}

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The coded counts of uint64 keys; zero is proof that a key is absent."""
        if self.array is None:
            width = 1 << min(self.bits, _CHUNK)
            a = np.zeros(((1 << self.bits) // width, width), np.uint8)
            for c, n in self.chunks.items():
                a[c] = np.frombuffer(pa.decompress(n, width, "zstd"), np.uint8)
            self.array = a.ravel()
        return self.array[(keys & np.uint64((1 << self.bits) - 1)).astype(np.int64)]


def hashed_counts(df: DataFrame, keys_of: Callable[[pa.RecordBatch], np.ndarray], bits: int) -> Cells:
    """Upper bounds of how often each uint64 key occurs over all rows: 2**bits coded counts.

    Every task counts its cells and emits those that are not zero by chunks, as two byte strings; a chunk's parts are
    added up where they meet, whatever their number. The driver gets 2**bits bytes at most whatever the input, so the
    array may be sent to the tasks.
    """
    mask, width = np.uint64((1 << bits) - 1), 1 << min(bits, _CHUNK)
    held = max(1 << 20, 1 << (bits - 3))  # keys of a task before they are counted

    def count(at: list, n: list) -> tuple[np.ndarray, np.ndarray]:
        cell, inv = np.unique(np.concatenate(at), return_inverse=True)
        return cell, np.bincount(inv, np.concatenate(n), minlength=len(cell)).astype(np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, size = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)], 0
        for b in batches:
            for part in pieces(b):
                if part.num_rows:
                    at.append((keys_of(part) & mask).astype(np.uint32))
                    n.append(np.ones(len(at[-1]), np.uint32))
                    size += len(at[-1])
                    if size > held:
                        c, k = count(at, n)
                        at, n, size = [c], [k], 0
        cell, k = count(at, n)
        chunk = cell >> _CHUNK
        edge = np.flatnonzero(np.concatenate(([True], chunk[1:] != chunk[:-1]))) if len(cell) else np.zeros(0, np.int64)
        for s, e in zip(edge, np.append(edge[1:], len(cell))):
            yield pa.record_batch({"chunk": pa.array([int(chunk[s])], pa.int32()), "at": pa.array([(cell[s:e] & np.uint32(width - 1)).astype(np.uint16).tobytes()]), "n": pa.array([k[s:e].tobytes()])})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for c, at, n in zip(b.column("chunk").to_pylist(), b.column("at").to_pylist(), b.column("n").to_pylist()):
                t = total.setdefault(c, np.zeros(width, np.int64))
                t[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.uint32)
        for c, t in total.items():
            code, at = np.zeros(width, np.uint8), np.flatnonzero(t)
            code[at] = coded(t[at])
            yield pa.record_batch({"chunk": pa.array([c], pa.int32()), "n": pa.array([pa.compress(code.tobytes(), "zstd", asbytes=True)])})

    got = by_key(df.mapInArrow(run, "chunk int, at binary, n binary"), "chunk").mapInArrow(add, "chunk int, n binary").toArrow()
    return Cells(dict(zip(got["chunk"].to_pylist(), got["n"].to_pylist())), bits)


def bitmap(tokens: np.ndarray, rec: np.ndarray, n: int, longs: int) -> np.ndarray:
    """n x longs parity bitmaps: the bits in which two differ are at most the values in which the sets differ."""
    bit = (mix(tokens, 77) % np.uint64(64 * longs)).astype(np.int64)
    odd = np.bincount(rec * (64 * longs) + bit, minlength=n * 64 * longs).astype(np.uint8) & 1
    return np.packbits(odd.reshape(n * longs, 64), axis=1, bitorder="little").view(np.int64).reshape(n, longs)


def classes(records: DataFrame, twice: bool = False) -> tuple[DataFrame, DataFrame]:
    """records(field INT, key, toks) -> members(field, key, id), sets(field, id, toks), both staged: equal sets are one.

    Sets are told apart by 128 bits of hash; ids are unique numbers given once, when the sets are written. Repeated
    rows of a record count once; null sets take no part. twice: records are made a second time rather than written, where
    that is cheap and their values are large.
    """
    named = records.withColumn("h", F.xxhash64("field", "toks")).withColumn("g", F.xxhash64("toks", F.lit(9)))
    r = named if twice else stage(named, "records")
    # Nulls are dropped once they are grouped: a filter below would make the sets twice.
    sets = r.groupBy("field", "h", "g").agg(F.first("toks").alias("toks")).where("toks is not null")
    sets = stage(sets.withColumn("id", F.monotonically_increasing_id()), "sets")
    members = r.select("field", "key", "h", "g").distinct().join(sets.select("field", "h", "g", "id"), ["field", "h", "g"])
    members = stage(members.select("field", "key", "id"), "members")
    if not twice:
        discard(r)
    return members, sets.select("field", "id", "toks")
