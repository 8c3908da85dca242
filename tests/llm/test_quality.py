import re
from collections import Counter

from pyspark.sql import functions as F

from loadwatch.llm.quality import MEASURES, host_verdicts, measure, with_verdicts


def by_hand(t):
    t = t or ""
    w, seen, again = re.findall(r"[^\x20\x09-\x0D]+", t), set(), 0
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    for x in lines:
        again += x in seen
        seen.add(x)
    windows = Counter(tuple(w[j:j + 8]) for j in range(len(w) - 7))
    covered = {k for j in range(len(w) - 7) if windows[tuple(w[j:j + 8])] > 1 for k in range(j, j + 8)}
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines), again, len(covered)


def test_measures(spark, docs, texts, empty):
    got = measure(docs)
    assert got.columns == [*(c for c in docs.columns if c not in MEASURES), *MEASURES]
    want = sorted(((r[0], *by_hand(r[1])) for r in texts), key=str)
    assert sorted((tuple(r) for r in got.select("doc_id", *MEASURES).collect()), key=str) == want
    assert measure(empty).collect() == []


def test_a_bad_host_falls_and_a_small_one_is_given_the_prior(spark):
    rows = [("bad", 5, 0)] * 60 + [("good", 100, 0)] * 60 + [("good", 5, 0)] * 3 + [(None, 100, 0)] * 40 + [(f"h{i}", 100, 0) for i in range(30)] + [("tiny", 5, 0)]
    df = spark.createDataFrame(rows, "source string, n_words bigint, n_repeat_words bigint").selectExpr(
        "*", "n_words * 5 AS word_chars", "0L AS n_symbols", "3L AS n_lines", "0L AS n_dup_lines")
    ok = {r.host: r.host_ok for r in host_verdicts(df, F.col("source")).collect()}
    assert not ok["bad"] and ok["good"] and ok[None] and ok["h1"]
    out = with_verdicts(df)
    assert out.count() == len(rows) and out.where("source = 'bad' AND kept").isEmpty()
    assert out.where("source = 'good' AND kept").count() == 60 and out.where("source IS NULL AND NOT kept").isEmpty()
    rates = {r.host: r.base_rate for r in host_verdicts(df, F.col("source")).collect()}
    assert 0 < rates["tiny"] < 1 and 0 < rates["h1"] < 0.5  # shrunk from 1 and from 0


def test_empty(spark, empty):
    assert with_verdicts(measure(empty)).collect() == []
