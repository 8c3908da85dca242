import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadwatch.llm import mixing
from loadwatch.llm.mixing import SCHEDULES, inverse, mix, source_targets, training_order


def targets_by_hand(sizes):
    """Shares by weight; what is above three times its size is fixed there and the rest reshared, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rate = (total - sum(fixed.values())) / sum(weight[s] for s in free) if free else 0
        above = [s for s in free if rate * weight[s] > 3 * sizes[s]]
        if not above:
            return {s: fixed.get(s, rate * weight[s]) for s in names}
        fixed |= {s: 3 * sizes[s] for s in above}


@pytest.mark.parametrize("rows", [1_000, 7])
def test_mix_equals_the_running_sums_spelled_out(spark, docs, texts, monkeypatch, rows):
    monkeypatch.setattr(mixing, "ROWS", rows)
    got = mix(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = defaultdict(list)
    for k, t, _, s in texts:
        by[s].append((hashlib.md5(str("" if k is None else k).encode()).hexdigest(), k, size(t)))
    sizes = {s: sum(x[2] for x in v) for s, v in by.items()}
    want = targets_by_hand(sizes)
    assert len(got) == len(texts)
    for s, v in by.items():
        mine = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= 1
        taken, at = defaultdict(list), 0
        for _, k, n in sorted(v, key=lambda x: (x[0], str(x[1]))):
            taken[k].append(sum(max(0, min(n, round(want[s]) - at - e * sizes[s])) for e in range(3)))
            at += n
        for r in mine:
            assert r.taken <= 3 * r.size
        for k, x in taken.items():
            assert sorted(r.taken for r in mine if r.doc_id == k) == sorted(x)


def test_positions_invert_the_integral(spark):
    for knots in (*SCHEDULES, ((0.0, 0.0), (0.3, 2.0), (1.0, 0.5))):
        got = spark.range(101).select((F.col("id") / 100).alias("q")).select("q", inverse(F.col("q"), knots).alias("x")).collect()
        area = lambda x: sum((min(x, b[0]) - a[0]) * (a[1] + a[1] + (b[1] - a[1]) * (min(x, b[0]) - a[0]) / (b[0] - a[0])) / 2
                             for a, b in zip(knots, knots[1:]) if x > a[0])
        for r in got:
            assert abs(area(r.x) / area(1.0) - r.q) < 1e-9 and -1e-12 <= r.x <= 1 + 1e-12
        assert all(np.diff([r.x for r in got]) >= 0)


def test_training_order_holds_every_copy_in_order(spark, docs):
    out = training_order(docs)
    assert out.columns == [*docs.columns, "copy", "taken_words", "position"]
    positions = [r.position for r in out.select("position").collect()]
    assert positions == sorted(positions)
    copies = mix(docs).select(F.explode("copies.words").alias("w"))
    assert out.agg(F.sum("taken_words"), F.count("*")).first() == copies.agg(F.sum("w"), F.count("*")).first()


def test_demand_follows_the_schedule(spark):
    """Half of an early source's words come before the time at which its integral is one half."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"))
    out = training_order(docs)
    for s, knots in (("a", SCHEDULES[0]), ("b", SCHEDULES[1])):
        mine = sorted(r.position for r in out.where(F.col("source") == s).collect())
        half = spark.range(1).select(inverse(F.lit(0.5), knots)).first()[0]
        assert abs(sum(p < half for p in mine) / len(mine) - 0.5) < 0.01


def test_reruns_agree_and_empty(spark, docs, empty):
    first = sorted(map(str, mix(docs).collect()))
    assert sorted(map(str, mix(docs.repartition(3)).collect())) == first
    assert mix(empty).collect() == [] and training_order(empty).collect() == []
    one = spark.createDataFrame([(1, None, "a")], "doc_id int, text string, source string")
    assert mix(one).first().taken == 0 and training_order(one).collect() == []


def test_all_capped(spark):
    sizes = spark.createDataFrame([("a", 1, 0), ("b", 1, 10), (None, 1, 5)], "source string, rows bigint, source_size bigint")
    got = {r.source: r.target for r in source_targets(sizes).collect()}
    assert got == targets_by_hand({"a": 0, "b": 10, None: 5})


@pytest.mark.parametrize("rows", [1_000, 5])
def test_one_id_or_none_in_a_third_of_the_rows(spark, monkeypatch, rows):
    """Rows that share an id, rows without one and equal rows: every word of a source is placed once, in order of the id's hash."""
    monkeypatch.setattr(mixing, "ROWS", rows)
    data = [(i, f"{'w ' * (i % 7)}x{i}", "ab"[i % 2]) for i in range(60)]
    data += [(7, f"{'w ' * (i % 5)}y{i}", "a") for i in range(40)] + [(None, f"z{i} z", "a") for i in range(40)] + [(9, "the same text", "a")] * 40
    docs = spark.createDataFrame(data, "doc_id int, text string, source string").repartition(5)
    got = mix(docs).collect()
    assert len(got) == len(data)
    for s in "ab":
        mine = [r for r in got if r.source == s]
        whole, size = round(mine[0].target), mine[0].source_size
        assert size == sum(r.size for r in mine) and sum(r.taken for r in mine) == min(whole, 3 * size)
        spans = sorted((c.start, c.words) for r in mine for c in r.copies)
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
        first = sorted((r for r in mine if r.copies), key=lambda r: r.copies[0].start)
        hashes = [hashlib.md5(str("" if r.doc_id is None else r.doc_id).encode()).hexdigest() for r in first]
        assert hashes == sorted(hashes)
    assert sorted(map(str, mix(docs.repartition(3)).collect())) == sorted(map(str, got))
    order = training_order(docs)
    assert order.agg(F.sum("taken_words")).first()[0] == sum(r.taken for r in got)


def test_no_window_holds_more_than_a_few_buckets_of_rows(spark, monkeypatch):
    """Pieces of one key that has a third of the rows are about ROWS rows each, and stand in order."""
    monkeypatch.setattr(mixing, "ROWS", 50)
    h, p = F.md5(F.when(F.col("id") % 3 != 0, F.col("id").cast("string")).otherwise("")), F.xxhash64("id")
    rows = spark.range(4000).select(h.alias("h"), p.alias("p"), F.lit(0).alias("rank"),
                                    F.floor(F.conv(F.substring(h, 1, 2), 16, 10).cast("int") / 256 * 80).alias("bucket"))
    got = mixing.pieces(rows)
    sizes = [r["count"] for r in got.groupBy("rank", "bucket", "piece").count().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 150
    order = [(r.h, r.p) for r in got.orderBy("bucket", "piece", "h", "p").collect()]
    assert order == sorted(order)
