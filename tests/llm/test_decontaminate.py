import hashlib
import re

import pytest
from pyspark.sql import functions as F

from loadwatch.llm import decontaminate as d


def words(t):
    lowered = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def by_hand(text, items):
    w, hit, found = words(text), set(), set()
    for k, t in items:
        x = words(t)
        n = min(10, len(x))
        windows = {tuple(x[i:i + n]) for i in range(len(x) - n + 1)} if x else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i:i + n]) in windows:
                found.add(str(k))
                hit |= set(range(i, i + n))
    ids = ",".join(sorted(found))
    return len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


ITEMS = [(1, "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "short item here"), (3, None), (4, "..."),
         (10, "alpha BETA gamma delta epsilon zeta eta theta iota kappa"), (5, "ünïcode Çé"), (6, "one two three four five six seven eight nine ten"),
         (6, "one two three four five six seven eight nine ten")]
TEXTS = [None, "", "x alpha beta gamma-delta epsilon zeta eta theta iota kappa lambda mu y", "Short, item: here! and short item here",
         "alpha beta gamma delta epsilon zeta eta theta iota", "a ünïcode_Çé b", "one two three four five six seven eight nine ten " * 3, "clean text only",
         "one two three four five six seven eight nine ten eleven short item here"]


@pytest.fixture(params=[500_000, 0], ids=["broadcast", "shuffled"])
def bound(request, monkeypatch):
    monkeypatch.setattr(d, "BROADCAST", request.param)


def test_hits(spark, bound):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(2, "another row of id 2"), (2, TEXTS[2]), (None, TEXTS[3])]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, n_words int, __hash string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    want = sorted(((k, *by_hand(t, ITEMS)) for k, t in rows), key=str)
    assert sorted((tuple(r) for r in d.contamination(docs, items).collect()), key=str) == want
    clean = d.decontaminate(docs, items)
    assert clean.columns == docs.columns
    assert sorted(str(r.doc_id) + str(r.text) for r in clean.collect()) == sorted(str(k) + str(t) for k, t in rows if not by_hand(t, ITEMS)[4])
    cut = {(r.doc_id, r.text) for r in d.decontaminate(docs, items, remove="spans").collect()}
    assert (2, "x y") in cut and (6, "") in cut and (7, "clean text only") in cut and (8, "eleven ") in cut and (None, "and ") in cut


def test_empty_tables(spark, docs, empty):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert d.contamination(empty, items).collect() == []
    got = d.contamination(docs, items.limit(0))
    assert got.count() == docs.count() and got.where("contaminated OR n_hit > 0 OR n_items > 0").isEmpty()


def test_the_main_path_is_native(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    text = d.contamination(docs, items)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", text) and "BroadcastHashJoin" in text


def test_no_document_is_shuffled_beyond_the_bound(spark, docs, monkeypatch):
    monkeypatch.setattr(d, "BROADCAST", 0)
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    windows = d.stage(d.benchmark_windows(items), "windows")
    found = d.spots(docs, windows)
    seen, todo = [], [found._jdf.queryExecution().executedPlan()]
    assert not re.search("Python|Pandas|Arrow", todo[0].toString())
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if node.nodeName() == "Exchange":
            seen.append([a.name() for a in (node.output().apply(i) for i in range(node.output().size()))])
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert any("__own" in x for x in seen) and not any("__words" in x or "__items" in x for x in seen)


def test_a_long_text_and_a_window_of_many_documents(spark, monkeypatch):
    many = [(i, f"{i} " + "one two three four five six seven eight nine ten " * (1 + i % 2) + str(i)) for i in range(400)]
    long = (1000, " ".join(f"w{i % 977}" for i in range(60_000)) + " short item here")
    items = [*ITEMS, (77, " ".join(f"w{i}" for i in range(5, 25))), *((100 + i, "one two three four five six seven eight nine ten") for i in range(30))]
    docs = spark.createDataFrame([*many, long, (1001, "clean")], "doc_id bigint, text string").repartition(4)
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    want = sorted((k, *by_hand(t, items)) for k, t in [*many[:2], long, (1001, "clean")])
    got = {}
    for rows, size in ((500_000, 64 << 20), (500_000, 10), (0, 0)):
        monkeypatch.setattr(d, "BROADCAST", rows)
        monkeypatch.setattr(d, "BROADCAST_BYTES", size)
        got = sorted(tuple(r) for r in d.contamination(docs, benchmark).collect())
        assert len(got) == 402 and [r for r in got if r[0] in (0, 1, 1000, 1001)] == want
        assert all(r[2] in (10, 20) and r[3] == 31 for r in got if r[0] < 400)


def test_the_filter_holds_every_window(spark):
    windows = d.benchmark_windows(spark.createDataFrame(ITEMS, "item_id bigint, text string"))
    bits = {r["__row"]: r["__bits"] for r in d.filter_table(windows).collect()}
    hashes = [r["__hash"] for r in windows.collect()]
    assert len(hashes) > 4 and all(len(x) == 64 for x in bits.values())
    slots = {h & ((1 << d.FILTER_BITS) - 1) for h in hashes}
    assert {(row << 12) + (lane << 6) + b for row, x in bits.items() for lane, v in enumerate(x) for b in range(64) if v >> b & 1} == slots
