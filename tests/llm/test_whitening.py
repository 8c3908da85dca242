import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadwatch.llm import whitening
from loadwatch.llm.whitening import crossed, op11_whitening, planes, whiten

from .conftest import SMALL

SHAPE = "vec_id bigint, embedding array<float>, n string, whitened int"


def check(got, rows, k):
    """Rows of the result against exact integers and numpy."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    sums = [sum(c) for c in zip(*x)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x]
    part = np.array([[(n * a - s) / n for a, s in zip(r, sums)] for r in x])
    exact = [[sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in x) / n ** 3 for j in range(d)] for i in range(d)]
    values, vectors = np.linalg.eigh(np.array(exact))
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == n * k and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-4
    table = {}
    for r in got:
        table.setdefault(r.component, []).append((r.vec_id, r.deviation, r.whitened))
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
    for c in range(1, k + 1):
        w = part @ vectors[:, c - 1] / math.sqrt(values[c - 1])
        want = sorted(zip([i for i, _ in rows], deviation, w))
        mine = sorted(table[c])
        assert [m[:2] for m in mine] == [t[:2] for t in want]
        a, b = np.array([m[2] for m in mine]), np.array([t[2] for t in want])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-7


def test_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    got = op11_whitening(spark, SMALL)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(got.collect(), rows, 32)


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = [(i, [float(a) for a in rng.normal(0, s, 5).astype("float32")]) for i, s in enumerate([0.5] * 30 + [1e5] * 2)]
    good = [(i, [*v, 2.0]) for i, v in good]  # a dimension that never changes
    good += [good[0], good[0]]
    bad = [(100, None), (101, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (102, [float("nan")] * 6), (103, [float("inf")] * 6), (104, []), (105, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in good + bad], SHAPE).repartition(4)
    check(whiten(df, keep=["vec_id"]).collect(), good, 5)
    wide = whiten(df)
    assert wide.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and wide.count() == len(good) * 5
    assert whiten(df, keep=["vec_id"], components=2).count() == len(good) * 2


def test_nothing_to_whiten(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], "x", 1)] * 3, SHAPE)
    assert whiten(df).collect() == [] and whiten(df.limit(1)).collect() == [] and whiten(df.where("vec_id > 5")).collect() == []


def test_rows_over_many_tasks_give_the_same_numbers(spark, monkeypatch):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    one = {(r.vec_id, r.component): r for r in whiten(df.coalesce(1), keep=["vec_id"]).collect()}
    monkeypatch.setattr(whitening, "ROWS", 37)
    for r in whiten(df.repartition(7).where(F.col("vec_id") >= 0), keep=["vec_id"]).collect():
        o = one[r.vec_id, r.component]
        assert (o.deviation, o.explained) == (r.deviation, r.explained) and abs(o.whitened - r.whitened) < 1e-12


def test_counts_are_products():
    rng = np.random.default_rng(2)
    u = rng.integers(0, 1 << 20, (301, 3))
    u[:, 1] = 0
    bits = [20, 0, 20]
    both, of, power = crossed(planes(u, bits)), np.repeat([0, 1, 2], bits), np.concatenate([np.arange(b) for b in bits])
    total = sum(int(both[i, j]) << int(power[i] + power[j]) for i in range(40) for j in range(40) if (of[i], of[j]) == (0, 2))
    assert total == int((u[:, 0] * u[:, 2]).sum())


def test_deviation_beyond_64_bits_is_null(spark):
    df = spark.createDataFrame([(i, [float(1 << 33) * (i % 2), float(1 << 33) * (i % 3)], "x", 1) for i in range(10)], SHAPE)
    got = whiten(df, keep=["vec_id"]).collect()
    assert len(got) == 20 and {r.deviation for r in got} == {None}
