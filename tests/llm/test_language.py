import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loadwatch.llm import language
from loadwatch.llm.language import fit, has_letter, held_out, identify, op5_language, predict, train


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = op5_language(spark, sf).alias("g").join(spark.read.parquet(f"{sf}/documents.parquet").alias("d"), "doc_id")
    out = got.where("g.held_out").agg(F.avg((F.col("g.lang_pred") == F.col("d.lang")).cast("int")), F.count("*")).first()
    assert out[1] > 150 and out[0] > 0.98
    assert got.where("score < 0 OR score > 1").isEmpty()


def test_und_and_rejection(spark, docs, texts, empty):
    model = fit(docs)
    got = identify(docs, model)
    assert got.count() == len(texts) and got.columns == [*(c for c in docs.columns if c != "score"), "lang_pred", "score", "accepted"]
    for r in got.collect():
        assert (r.lang_pred == "und") == (not has_letter(r.text)) and (r.lang_pred != "und" or (r.score == 0 and not r.accepted))
    assert identify(empty, model).collect() == []
    assert {r.lang_pred for r in identify(docs, fit(docs.where("lang IS NULL"))).collect()} == {"und"}


def test_rejects_what_it_has_not_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = fit(docs.where(~held_out(4)))
    _, known, _ = predict(model, pa.array([r.text for r in docs.limit(50).collect()]))
    _, strange, sure = predict(model, pa.array(["zzxq qqzj xjjq", "жжжж щщщщ", "ζζζ"]))
    assert strange.mean() < known.mean()


def test_training_is_repeatable():
    texts, langs = ["the cat and the dog"] * 5 + ["der hund und die katze"] * 5, ["en"] * 5 + ["de"] * 5
    a, b = train(texts, langs), train(texts, langs)
    assert (a.weights == b.weights).all() and a.temperature == b.temperature


M64 = (1 << 64) - 1


def mixed(x):
    x = (x ^ (x >> 33)) * 0xFF51AFD7ED558CCD & M64
    x = (x ^ (x >> 29)) * 0xC4CEB9FE1A85EC53 & M64
    return x ^ (x >> 32)


def by_hand(model, text):
    """Language, score and acceptance, word by word and n-gram by n-gram."""
    import re
    import xxhash
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
    z = [0.0] * len(model.langs)
    for w in words:
        buckets = [mixed(xxhash.xxh64_intdigest(w, 42)) % language.BUCKETS]
        marked = b" " + w + b" "
        for k in language.GRAMS:
            for i in range(len(marked) - k + 1):
                h = 0
                for j in range(k):
                    letter = marked[i + j]
                    h = (h * 11400714785074694791 + letter + j + 1) & M64
                buckets.append(mixed(h) % language.BUCKETS)
        for lang in range(len(z)):
            z[lang] += sum(float(model.weights[b, lang]) for b in buckets) / len(buckets) / len(words)
    e = [math.exp((v + float(b)) / model.temperature) for v, b in zip(z, model.bias)]
    p = [v / sum(e) for v in e]
    best = max(range(len(p)), key=p.__getitem__)
    return model.langs[best], p[best], p[best] >= model.threshold


def test_predictions_equal_the_definition(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = fit(docs.where(~held_out(4)))
    texts = [r.text for r in docs.where("text IS NOT NULL").orderBy("doc_id").limit(15).collect()] + ["Ünïcode WORD", "a", "x y\tz\x0b w"]
    names, score, sure = predict(model, pa.array(texts))
    for i, t in enumerate(texts):
        lang, p, accepted = by_hand(model, t)
        assert names[i] == lang and abs(score[i] - p) < 1e-4 and (sure[i] == accepted or abs(p - model.threshold) < 1e-4)


def test_calibration_holds_on_rows_never_seen(spark):
    """On texts of two words, some of them hard: among accepted rows the error stays near what was set, and the temperature is no
    worse than none."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text IS NOT NULL AND lang IS NOT NULL")
    short = docs.withColumn("text", F.concat_ws(" ", F.slice(F.split("text", " "), 3, 2)))  # two words each: some are hard
    model = fit(short.where(~held_out(4)))
    rows = short.where(held_out(4)).select("lang", "text").collect()
    names, score, sure = predict(model, pa.array([r.text for r in rows]))
    right = np.array([r.lang == n for r, n in zip(rows, names)])
    assert sure.sum() > 20 and (~right[sure]).mean() <= language.WRONG + 3 * math.sqrt(language.WRONG / sure.sum())
    assert right.all() or right[sure].mean() >= right.mean()
    losses = []
    for t in (model.temperature, 1.0):
        model.temperature = t
        _, p, _ = predict(model, pa.array([r.text for r in rows]))
        losses.append(-np.log(np.clip(np.where(right, p, 1 - p), 1e-6, 1)).mean())
    assert losses[0] <= losses[1] + 0.05


def test_the_driver_gets_bounded_features(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = list(language.piece_features([long, "", "a b"]))
    assert [i for i, _, _ in rows] == [0] * 5 + [1] + [2] * 2 and len(rows[0][1]) <= language.BUCKETS and rows[0][1].dtype == np.int32
    assert abs(rows[0][2].sum() - 1) < 1e-3 and len(rows[5][1]) == 0
    docs = spark.createDataFrame([(1, long, "en"), (2, "", "de"), (3, "der hund", "de"), (3, "der hund", "de"), (None, "x y", "en")], "doc_id int, text string, lang string")
    a, b = fit(docs), fit(docs.orderBy(F.desc("doc_id")).repartition(3))
    assert np.allclose(a.weights, b.weights, atol=1e-5) and a.langs == ["de", "en"]
