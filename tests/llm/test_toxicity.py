import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loadwatch.llm import toxicity
from loadwatch.llm.toxicity import Model, counterfactuals, fit, hashed, held_out, op12_toxicity, positions, predict, score, train, vocabulary

from .conftest import crc


def words_of(t):
    return re.findall(r"[A-Za-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in t or ""))


def biased(n=400, seed=4):
    """Sentences of which the insulting ones mostly name one group, and neutral ones seldom name any."""
    rng = np.random.default_rng(seed)
    plain, rude = [f"w{chr(97 + i)}x" for i in range(20)], ["scum", "trash", "idiot"]
    out = []
    for i in range(n):
        w = rng.choice(plain, 8).tolist()
        toxic = i % 2
        if toxic and rng.random() < 0.7:
            w[0] = rude[i // 2 % 3]
        if rng.random() < (0.8 if toxic else 0.05):
            w[3] = "muslims"
        elif rng.random() < 0.3:
            w[3] = ["christians", "jews", "hindus"][i % 3]
        out.append((i, " ".join(w), toxic))
    return out


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = op12_toxicity(spark, sf)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    n = got.join(labels, "doc_id").where("held_out").agg(
        F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))).alias("recall"), F.avg(F.when(F.col("toxic") == 0, F.col("predicted"))).alias("alarms"),
        F.count_if(F.col("toxic") == 1).alias("n")).first()
    assert n.n > 50 and n.recall > 0.8 and n.alarms < 0.01
    assert got.where("score < 0 OR score > 1 OR (score >= 0.5) <> (predicted = 1)").isEmpty()
    assert all(r.held_out == (crc(r.doc_id) % 5 == 0) for r in got.collect())


def test_penalty_frees_neutral_mentions(spark):
    rows = biased()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")
    neutral = pa.array(["waxx muslims wbx wcx wdx", "wex wfx muslims wgx", "muslims wax wkx"])
    rude = pa.array(["wax wbx scum wcx", "trash wdx wex", "you idiot wfx wgx"])
    with_it, without = fit(docs, labels), fit(docs, labels, penalty=0.0)
    assert predict(without, neutral).min() > 0.5 > predict(with_it, neutral).max()
    assert predict(with_it, rude).min() > 0.5
    # Naming another group changes little.
    other = pa.array([t.as_py().replace("muslims", "hindus") for t in neutral])
    gap = np.abs(predict(with_it, neutral) - predict(with_it, other)).max()
    assert gap < 0.15 < np.abs(predict(without, neutral) - predict(without, other)).min()


def test_features_and_scores_by_hand(spark):
    rows = biased(120)
    df = spark.createDataFrame([(t, y, i) for i, t, y in rows], "text string, label int, h bigint").repartition(3)
    vocab = vocabulary(df, words=5, least=3)
    counts = [Counter(w for _, t, y in rows if y == k for w in set(words_of(t))) for k in (0, 1)]
    n = [sum(y == k for *_, y in rows) for k in (0, 1)]

    def g(w):
        out = 0.0
        for k in (0, 1):
            for there in (True, False):
                met = counts[0][w] + counts[1][w]
                seen, of = (counts[k][w], met) if there else (n[k] - counts[k][w], sum(n) - met)
                out += seen * math.log(seen * sum(n) / (of * n[k])) if seen else 0
        return round(out, 6)

    fit_words = [w for w in counts[0] | counts[1] if counts[0][w] + counts[1][w] >= 3 and g(w) >= toxicity.TELLING]
    terms = [w for s in toxicity.IDENTITY for w in s]
    best = sorted(fit_words, key=lambda w: (-g(w), hashed([w]).view(np.int64)[0]))[:5]
    assert set(vocab.tolist()) == set(hashed(best + terms).tolist())
    at = {r["h"]: r["at"] for r in positions(df, vocab)}
    names = {int(h): w for h, w in zip(hashed(best + terms), best + terms)}
    assert all({names[int(vocab[a])] for a in at[i]} == set(words_of(t)) & set(best + terms) for i, t, _ in rows)
    model = Model(vocab, np.arange(len(vocab)) / 7 - 3, 0.25)
    for (_, t, _), p in zip(rows, predict(model, pa.array([r[1] for r in rows]))):
        z = 0.25 + sum(model.weights[np.searchsorted(vocab, hashed([w])[0])] for w in set(words_of(t)) & set(best + terms))
        assert abs(p - 1 / (1 + math.exp(-z))) < 1e-12


def test_gradient_reaches_the_minimum():
    """No direction betters the trained weights by more than a trifle."""
    words = np.unique(hashed(["scum", *[w for s in toxicity.IDENTITY for w in s]]))
    a, m, c = (int(np.searchsorted(words, hashed([w])[0])) for w in ("scum", "muslims", "christians"))
    rows = [[a], [m], sorted([a, m]), [c], [], [m], [c], [a]] * 20
    y, hashes = np.array([1, 0, 1, 0, 0, 1, 0, 0] * 20, float), list(range(160))
    of, changed = counterfactuals(rows, hashes, words)
    assert all(set(changed[i]) != set(rows[j]) and len(changed[i]) == len(rows[j]) for i, j in enumerate(of))

    def loss(w, b):
        z = np.array([w[r].sum() + b for r in rows])
        apart = np.array([w[rows[j]].sum() - w[changed[i]].sum() for i, j in enumerate(of)])
        return np.logaddexp(0, -z * (2 * y - 1)).mean() + toxicity.PENALTY * (apart ** 2).mean() + toxicity.RIDGE / 2 * (w ** 2).sum()

    w, b = train(rows, y, hashes, words)
    least, rng = loss(w, b), np.random.default_rng(5)
    for _ in range(200):
        step = rng.normal(0, 1, len(w) + 1)
        step /= np.linalg.norm(step)
        assert loss(w + 0.05 * step[:-1], b + 0.05 * step[-1]) > least - 1e-4


def test_odd_rows(spark, docs, texts, empty):
    labels = spark.createDataFrame([(0, 1), (0, 0), (0, None), (None, 1), (1, 1), (2, 0), (3, 0), (3, 0), (10**9, 1)], "doc_id bigint, toxic int")
    model = fit(docs, labels)
    got = score(docs, model)
    assert got.columns == [*(c for c in docs.columns if c != "score"), "score", "predicted"] and got.count() == len(texts)
    blank = {r.score for r in got.where("text IS NULL OR text = ''").collect()}
    assert len(blank) == 1 and 0 <= blank.pop() <= 1
    assert score(empty, model).collect() == []
    assert {r.score for r in score(docs, fit(docs, labels.where("toxic = 0"))).collect()} == {0.0}
    assert {r.score for r in score(docs, fit(docs, labels.limit(0))).collect()} == {0.0}
    assert {r.predicted for r in score(docs, fit(empty, labels)).collect()} <= {0, 1}


def test_the_same_rows_give_the_same_model(spark):
    docs = spark.createDataFrame([r[:2] for r in biased()], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in biased()], "doc_id bigint, toxic int")
    a, b = fit(docs.repartition(5), labels, sample=90), fit(docs.coalesce(1), labels.repartition(3), sample=90)
    assert (a.words == b.words).all() and np.allclose(a.weights, b.weights) and abs(a.intercept - b.intercept) < 1e-9


def test_crc_of_held_out(spark):
    got = spark.range(50).withColumnRenamed("id", "doc_id").select("doc_id", held_out().alias("h")).collect()
    assert all(r.h == (crc(r.doc_id) % 5 == 0) for r in got)
