"""Texts as byte arrays: whole-batch word splitting and hashing in numpy, shared by the text operators.

A batch of texts is one byte buffer with offsets, so that nothing is done per word in Python. Null texts are empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that are worked on at once in a task; a longer text is worked on alone.
CHUNK_BYTES = 3 << 20
#: Longer stretches of bytes are hashed one by one, so that they don't slow the common ones.
LONG_BYTES = 2048

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def picked(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns, once each, whatever characters their names hold."""
    return df.select(*(F.col("`" + c.replace("`", "``") + "`") for c in dict.fromkeys(names)))


def shape(df: DataFrame, kept: list[str], new: str) -> StructType:
    """The columns `kept` of `df`, then those of the DDL text `new`."""
    return StructType([*(df.schema[c] for c in kept), *StructType.fromDDL(new).fields])


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most `limit` bytes of text each, or one row."""
    for batch in batches:
        n, first = batch.num_rows, 0
        if n == 0:
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        while first < n:
            done = sizes[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(sizes, done + limit, "right")))
            yield batch.slice(first, last - first)
            first = last


#: Rows of keys and small values up to which a table is sent to every task: tens of megabytes.
FEW = 500_000


def small(df: DataFrame) -> DataFrame:
    """`df`, to be broadcast if its rows, counted, are few; read more than once, so stage what is costly."""
    return F.broadcast(df) if df.count() <= FEW else df


class Texts:
    """Bytes of all texts of a batch in one buffer; `words()` finds the stretches without ASCII white space."""

    def __init__(self, column: pa.Array, lower: bool = False):
        column = pc.fill_null(column.cast(pa.large_string()), "")
        raw = column.buffers()
        bounds = np.frombuffer(raw[1], np.int64)[column.offset:column.offset + len(column) + 1]
        first, last = (int(bounds[0]), int(bounds[-1])) if len(column) else (0, 0)
        self.bounds = bounds - first if len(column) else np.zeros(1, np.int64)
        self.bytes = np.frombuffer(raw[2], np.uint8)[first:last] if last > first else np.zeros(0, np.uint8)
        if lower:
            self.bytes = LOWER[self.bytes]

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and, per text, the offsets of the maximal runs of bytes marked `inside`, cut where texts meet."""
        n = len(self.bytes)
        if n == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(self) + 1, np.int64)
        fresh = np.zeros(n + 1, bool)
        fresh[self.bounds] = True
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1] | fresh[1:n]
        closes[:-1] &= ~inside[1:] | fresh[1:n]
        starts = np.flatnonzero(opens)
        return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, self.bounds)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.runs(~WHITE[self.bytes])

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pieces between line feeds that are not empty."""
        return self.runs(self.bytes != 10)


def spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words, each followed by one space, in a new buffer; their starts and ends there."""
    size = ends - starts
    begin = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size + 1, out=begin[1:])
    out = np.full(begin[-1], 32, np.uint8)
    shift = np.repeat(starts - begin[:-1], size)
    at = np.arange(len(shift)) + np.repeat(np.arange(len(size)), size)
    out[at] = data[at + shift]
    return out, begin[:-1], begin[1:] - 1


# The primes of XXH64.
XX = [np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579,
                             2870177450012600261)]


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _round(acc, lane):
    return _turn(acc + lane * XX[1], 31) * XX[0]


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many stretches of `data` at once, as unsigned 64-bit numbers."""
    out = np.empty(len(starts), np.uint64)
    size = ends - starts
    long = np.flatnonzero(size > LONG_BYTES)
    for i in long:
        out[i] = xxhash.xxh64_intdigest(data[starts[i]:ends[i]].tobytes(), seed)
    some = np.flatnonzero(size <= LONG_BYTES) if len(long) else slice(None)
    at, size = starts[some].astype(np.int64), size[some].astype(np.int64)
    if len(at) == 0:
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    halves = np.ndarray((len(data) + 1,), "<u4", padded, strides=(1,))
    with np.errstate(over="ignore"):
        start = np.uint64(seed)
        h = np.full(len(at), start + XX[4], np.uint64)
        wide = np.flatnonzero(size >= 32)
        if len(wide):
            acc = [np.full(len(wide), x, np.uint64) for x in (start + XX[0] + XX[1], start + XX[1], start, start - XX[0])]
            stripes, p = size[wide] >> 5, at[wide]
            for k in range(int(stripes.max())):
                on = np.flatnonzero(stripes > k)
                for j in range(4):
                    acc[j][on] = _round(acc[j][on], lanes[p[on] + 32 * k + 8 * j])
            g = _turn(acc[0], 1) + _turn(acc[1], 7) + _turn(acc[2], 12) + _turn(acc[3], 18)
            for x in acc:
                g = (g ^ _round(np.uint64(0), x)) * XX[0] + XX[3]
            h[wide] = g
        h += size.astype(np.uint64)
        done = at + (size & ~31)
        rest = size & 31
        for k in range(3):
            on = np.flatnonzero(rest >= 8 * (k + 1))
            if len(on):
                h[on] = _turn(h[on] ^ _round(np.uint64(0), lanes[done[on] + 8 * k]), 27) * XX[0] + XX[3]
        done += rest & ~7
        rest &= 7
        on = np.flatnonzero(rest >= 4)
        h[on] = _turn(h[on] ^ halves[done[on]].astype(np.uint64) * XX[0], 23) * XX[1] + XX[2]
        done[on] += 4
        rest &= 3
        for k in range(3):
            on = np.flatnonzero(rest > k)
            h[on] = _turn(h[on] ^ padded[done[on] + k].astype(np.uint64) * XX[4], 11) * XX[0]
        h = (h ^ (h >> np.uint64(33))) * XX[1]
        h = (h ^ (h >> np.uint64(29))) * XX[2]
        out[some] = h ^ (h >> np.uint64(32))
    return out


def spread(x: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64-bit numbers, for dealing out keys."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(32))


def rolled(ids: np.ndarray, k: int) -> np.ndarray:
    """A hash of every window of k consecutive numbers."""
    with np.errstate(over="ignore"):
        out = np.zeros(max(0, len(ids) - k + 1), np.uint64)
        for j in range(k):
            out = out * XX[0] + ids[j:len(ids) - k + 1 + j]
    return out


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the stretches of `size` bytes at `a` and at `b` are equal, pair by pair."""
    same = np.ones(len(a), bool)
    if len(a) == 0:
        return same
    for i in np.flatnonzero(size > LONG_BYTES):
        same[i] = np.array_equal(data[a[i]:a[i] + size[i]], data[b[i]:b[i] + size[i]])
    on = np.flatnonzero(size <= LONG_BYTES)
    for k in range(int(size[on].max(initial=0))):
        on = on[(size[on] > k) & same[on]]
        if len(on) == 0:
            break
        same[on] = data[a[on] + k] == data[b[on] + k]
    return same


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned numbers in few bytes: narrowest type, byte planes, Zstandard."""
    parts, head = [], [len(arrays)]
    for x in arrays:
        x = np.asarray(x)
        if x.dtype.kind != "f":
            top = int(x.max()) if len(x) else 0
            x = x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)
        head += [len(x), ord(x.dtype.kind), x.dtype.itemsize]
        parts.append(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(np.array(head, np.int64).tobytes() + b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head, at, out = np.frombuffer(raw, np.int64, 3 * n, 8).reshape(n, 3).tolist(), 8 + 24 * n, []
    for size, kind, width in head:
        x = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size).T
        out.append(np.ascontiguousarray(x).view(f"{chr(kind)}{width}").reshape(size))
        at += size * width
    return out
