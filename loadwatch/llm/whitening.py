"""Whitening of embeddings from exact integer statistics: bit-sliced cross-products.

Entries become integers, floor(`SCALE` * c) + `SHIFT`, and every dimension is shifted once more by its own smallest value, so that
only as many bits remain as its range needs. A task packs bit b of a dimension across its rows into 64-bit words (a plane). The sum over rows of
the product of two dimensions is then a sum of 2^(a+b) times the bits set in the AND of plane a of one and plane b of the other: integers, exact
whatever the order of rows and tasks. Counts are summed by Spark per (pair of dimensions, a+b); the driver gets at most d(d+1)/2 times 127 of
them, whatever the rows. Covariances are centred as integers, n * sum(xy) - sum(x) * sum(y), and only then become doubles for `eigh`.

Edge cases: rows whose vector is null, or holds a null or non-finite entry, are dropped; so are rows whose length is not the most frequent one
(of equally frequent ones the longest), and entries beyond `LARGEST` in size count as non-finite; a component without variance (at most
`FLAT` of the largest eigenvalue) has no whitened values and is not returned, so that a single row, or rows that are all equal, give no rows; repeated rows and ids, and null
ids, are kept each; an empty table gives an empty result. `deviation` is null where it is beyond 64 bits. Columns with the names of
results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadwatch.llm.arrays import picked, shape, table
from loadwatch.session import stage

SCALE, SHIFT = 64, 1_000_000
#: Entries above this are no embeddings; below it shifted integers keep within 53 bits, where doubles hold them exactly.
LARGEST = float(1 << 45)
#: Components returned, and the share of the largest eigenvalue up to which one is flat.
COMPONENTS, FLAT = 32, 1e-13
#: Rows packed at once in a task.
ROWS = 1 << 15


@dataclass(frozen=True)
class Whitening:
    """`n` vectors with sums of shifted values `sums` and smallest values `low`; unit eigenvectors as columns of `vectors`, by falling `values`."""

    n: int
    low: np.ndarray
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def usable(df: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """The rows that count, and their dimensions."""
    v = F.col(f"`{vector}`")
    fine = v.isNotNull() & F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double")) <= LARGEST, F.lit(False)))
    kept = df.where(fine & (F.size(v) > 0))
    sizes = kept.groupBy(F.size(v).alias("d")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("d")).first()
    d = sizes["d"] if sizes else 0
    return kept.where(F.size(v) == d), d


def integers(column: pa.Array, d: int) -> np.ndarray:
    """The rows' shifted integers, one row each."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (np.floor(SCALE * flat).astype(np.int64) + SHIFT).reshape(-1, d)


def planes(u: np.ndarray, bits: list[int]) -> np.ndarray:
    """Bit planes of the columns of `u`, packed over rows into words: those of the first column, lowest bit first, then the next."""
    words = -(-len(u) // 64)
    out = np.zeros((sum(bits), 8 * words), np.uint8)
    at = 0
    for j, b in enumerate(bits):
        column = u[:, j]
        for k in range(b):
            packed = np.packbits((column >> k & 1).astype(np.uint8))
            out[at, :len(packed)] = packed
            at += 1
    return out.view(np.uint64)


def crossed(p: np.ndarray) -> np.ndarray:
    """Bits set in the AND of every plane with itself and those after it."""
    out = np.zeros((len(p), len(p)), np.int64)
    for i in range(len(p)):
        out[i, i:] = np.bitwise_count(p[i] & p[i:]).sum(axis=1, dtype=np.int64)
    return out


def _limits(df: DataFrame, vector: str, d: int) -> list:
    """Smallest and largest integer, and rows, of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, n = None, None, 0
        for batch in batches:
            if batch.num_rows:
                x = integers(batch.column(0), d)
                low, high = (x.min(axis=0), x.max(axis=0)) if low is None else (np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0)))
                n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(low), pa.array(high), pa.array(np.full(d, n))], ["dim", "low", "high", "n"])

    got = picked(df, [vector]).mapInArrow(run, "dim int, low bigint, high bigint, n bigint")
    return got.groupBy("dim").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).orderBy("dim").collect()


def _counts(df: DataFrame, vector: str, d: int, low: np.ndarray, bits: list[int]) -> list:
    """Per pair of dimensions (and per dimension, with itself as `b` = -1) and power of two: how often it enters the sum."""
    of = np.repeat(np.arange(d), bits)
    power = np.concatenate([np.arange(b) for b in bits]).astype(np.int64) if sum(bits) else np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, alone = np.zeros((len(of), len(of)), np.int64), np.zeros(len(of), np.int64)
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                p = planes(integers(batch.column(0).slice(first, ROWS), d) - low, bits)
                both += crossed(p)
                alone += np.bitwise_count(p).sum(axis=1, dtype=np.int64)
        i, j = np.nonzero(both)
        # Two planes of one dimension stand for both orders.
        times = both[i, j] * np.where((of[i] == of[j]) & (i != j), 2, 1)
        key = np.concatenate([(of[i] * (d + 1) + of[j] + 1) * 128 + power[i] + power[j], of * (d + 1) * 128 + power])
        key, where = np.unique(key, return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, where, np.concatenate([times, alone]))
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(total)], ["key", "times"])

    made = picked(df, [vector]).mapInArrow(run, "key bigint, times bigint")
    return made.groupBy("key").agg(F.sum("times").alias("times")).collect()


def fit(df: DataFrame, vector: str, d: int) -> Whitening | None:
    """Exact statistics of all rows of `df`, and the eigenvectors of their covariance; None without rows."""
    limits = _limits(df, vector, d) if d else []
    if not limits:
        return None
    n, low = limits[0]["n"], np.array([r["low"] for r in limits], np.int64)
    bits = [int(r["high"] - r["low"]).bit_length() for r in limits]
    sums, products = [0] * d, [[0] * d for _ in range(d)]
    for r in _counts(df, vector, d, low, bits):
        pair, power = divmod(r["key"], 128)
        i, j = divmod(pair, d + 1)
        if j:
            products[i][j - 1] += r["times"] << power
        else:
            sums[i] += r["times"] << power
    v = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            v[i, j] = v[j, i] = (n * products[i][j] - sums[i] * sums[j]) / (n * n)  # integers until here
    values, vectors = np.linalg.eigh(v)
    return Whitening(n, low, sums, values[::-1], vectors[:, ::-1], float(np.trace(v)))


def centred(x: np.ndarray, model: Whitening) -> tuple[np.ndarray, list]:
    """Entries minus their mean, and each row's sum of squares of n times that (None beyond 64 bits)."""
    u = x - model.low
    widest = max(max(abs(model.n * int(u[:, j].max()) - s), abs(model.n * int(u[:, j].min()) - s)) for j, s in enumerate(model.sums)) if len(u) else 0
    if widest * widest * u.shape[1] < 1 << 63:
        apart = model.n * u - np.array(model.sums, np.int64)
        return apart / model.n, (apart * apart).sum(axis=1).tolist()
    rows = [[model.n * a - s for a, s in zip(r, model.sums, strict=True)] for r in u.tolist()]
    squares = [sum(a * a for a in r) for r in rows]
    return np.array([[a / model.n for a in r] for r in rows]), [q if q < 1 << 63 else None for q in squares]


def _projected(column: pa.Array, d: int, model: Whitening, k: int) -> tuple[np.ndarray, list]:
    x, deviation = centred(integers(column, d), model)
    return x @ model.vectors[:, :k] / np.sqrt(model.values[:k]), deviation


def identity_error(df: DataFrame, vector: str, d: int, model: Whitening, k: int) -> float:
    """How far the covariance of all rows' whitened values is from the identity: its largest absolute entry of the difference."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, alone = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                w, _ = _projected(batch.column(0).slice(first, ROWS), d, model, k)
                both += w.T @ w
                alone += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k + k)), pa.array(np.concatenate([both.ravel(), alone]))], ["at", "part"])

    sums = picked(df, [vector]).mapInArrow(run, "at bigint, part double").groupBy("at").agg(F.sum("part").alias("s")).orderBy("at").collect()
    flat = np.array([r["s"] for r in sums]) / model.n
    mean = flat[k * k:]
    return float(np.abs(flat[:k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def whiten(df: DataFrame, vector: str = "embedding", keep: list[str] | None = None, components: int = COMPONENTS) -> DataFrame:
    """One row per usable row of `df` (its columns `keep`, all but the vector by default) and component: `component`, `n`, `deviation`,
    `whitened`, `explained` and `identity_error`."""
    new = ("component", "n", "deviation", "whitened", "explained", "identity_error")
    kept = [c for c in (df.columns if keep is None else keep) if c not in (*new, vector)]
    rows, d = usable(picked(df, [*kept, vector]), vector)
    rows = stage(rows, "vectors")
    model = fit(rows, vector, d)
    k = 0 if model is None else min(components, int((model.values > max(model.values[0], 0) * FLAT).sum()))
    error = identity_error(rows, vector, d, model, k) if k else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, ROWS // max(k, 1))
            for first in range(0, batch.num_rows if k else 0, step):
                part = batch.slice(first, step)
                w, deviation = _projected(part.column(vector), d, model, k)
                each = pa.array(np.repeat(np.arange(len(w)), k))
                yield pa.RecordBatch.from_arrays([part.column(c).take(each) for c in kept] + [
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(w))), pa.array(np.full(len(w) * k, model.n)),
                    pa.array(deviation, pa.int64()).take(each), pa.array(w.ravel()),
                    pa.array(np.tile(model.values[:k] / model.trace, len(w))), pa.array(np.full(len(w) * k, error))], [*kept, *new])

    return picked(rows, [*kept, vector]).mapInArrow(
        run, shape(df, kept, "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), keep=["vec_id"])
