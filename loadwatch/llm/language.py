"""Language identification: averaged hashed subword embeddings, a linear softmax, and calibrated rejection.

A text is the average, over its words, of the embeddings of each word's character n-grams and of the word itself, hashed to
`BUCKETS` rows. `fit` trains embeddings and softmax with stochastic gradient descent in numpy on a bounded sample of labelled
rows (`SAMPLE` rows, those of the smallest row hash within each language, at most `SAMPLE` / languages of each; ties of the hash go by
the hash of the text), whose features are made in the tasks, then fits a temperature and a rejection threshold on rows held out of the
training. The model is a table of `BUCKETS` by languages numbers and so has a fixed size; it goes to the tasks with the
function. Prediction needs one pass, no shuffle: scores of a batch's distinct words, then sums per text.

Edge cases: a null text, or one without a letter, is `und` with score 0 and rejected; labels that are null teach nothing;
without any labelled row every text is `und`; repeated rows are predicted each; an empty table gives an empty result; a text
may be of any length. Columns of the input with the names of the results are replaced.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loadwatch.llm.arrays import XX, Texts, chunks, picked, shape, small, spread, table, xxh64
from loadwatch.session import stage

#: Labelled rows that are used to fit, at most.
SAMPLE = 1200
#: Bytes of text whose features are made at once while fitting.
FIT_BYTES = 150_000
BUCKETS, WIDTH, GRAMS, EPOCHS, RATE = 1 << 15, 16, (1, 2, 3, 4), 12, 0.5
#: Share of held-out predictions that may be wrong among those not rejected.
WRONG = 0.01
UNKNOWN = "und"


@dataclass
class Model:
    """`weights[b, l]`: what bucket b says for language l, the product of embedding and softmax; `bias[l]`."""
    langs: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0


def subwords(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' byte n-grams (with a mark at either end) and of the words, and the word of each."""
    size = ends - starts + 2
    at = np.concatenate([[0], np.cumsum(size)])
    padded = np.full(at[-1], 32, np.uint64)
    owner = np.repeat(np.arange(len(starts)), size)
    inner = np.arange(at[-1]) - at[owner]
    on = (inner > 0) & (inner < size[owner] - 1)
    padded[on] = data[(starts[owner] + inner - 1)[on]]
    left = size[owner] - inner
    buckets, owners = [spread(hashes)], [np.arange(len(starts))]
    h = np.zeros(len(padded), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(1, max(GRAMS) + 1):
            nxt = np.concatenate([padded[k - 1:], np.zeros(k - 1, np.uint64)])
            h = h * XX[0] + nxt + np.uint64(k)
            if k in GRAMS:
                fits = np.flatnonzero(left >= k)
                buckets.append(spread(h[fits]))
                owners.append(owner[fits])
    return (np.concatenate(buckets) & np.uint64(BUCKETS - 1)).astype(np.int64), np.concatenate(owners)


def distinct_words(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of the batch (start, end, hash), and (text, word, times) of each text's words."""
    starts, ends, offsets = t.words()
    hashes = xxh64(t.bytes, starts, ends)
    _, first, word = np.unique(hashes, return_index=True, return_inverse=True)
    owner = np.repeat(np.arange(len(t)), np.diff(offsets))
    return starts[first], ends[first], hashes[first], owner, word, np.diff(offsets)


def features(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text sparse averages: text, bucket, share."""
    a, b, h, owner, word, n = distinct_words(t)
    bucket, of = subwords(t.bytes, a, b, h)
    per = np.bincount(of, minlength=len(a))
    order = np.argsort(of, kind="stable")
    bucket, begin = bucket[order], np.concatenate([[0], np.cumsum(per)])
    pair, times = np.unique(owner * max(len(a), 1) + word, return_counts=True)
    owner, word = pair // max(len(a), 1), pair % max(len(a), 1)
    grams = per[word]
    at = np.repeat(begin[word] - np.concatenate([[0], np.cumsum(grams)[:-1]]), grams) + np.arange(grams.sum())
    share = np.repeat(times / grams / np.maximum(n[owner], 1), grams)
    key, inv = np.unique(np.repeat(owner, grams) * BUCKETS + bucket[at], return_inverse=True)
    return key // BUCKETS, key % BUCKETS, np.bincount(inv, share)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def cuts(text: str) -> list[str]:
    """A text, and its first, middle and last words, so that short texts are learned too."""
    w = text.split()
    return [text, *(" ".join(w[at:at + k]) for k, at in ((3, 0), (8, len(w) // 2), (1, len(w) // 3), (2, max(0, len(w) - 2))) if len(w) > k)]


def piece_features(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(text, buckets, shares) of every text's cuts, the whole text first."""
    seen = [(i, x) for i, t in enumerate(texts) for x in cuts(t)]
    done = 0
    for part in chunks(iter([pa.RecordBatch.from_arrays([pa.array([x for _, x in seen], pa.string())], ["t"])]), "t", FIT_BYTES):
        doc, bucket, share = features(Texts(part.column(0), lower=True))
        at = np.searchsorted(doc, np.arange(part.num_rows + 1))
        for k in range(part.num_rows):
            yield seen[done + k][0], bucket[at[k]:at[k + 1]].astype(np.int32), share[at[k]:at[k + 1]].astype(np.float32)
        done += part.num_rows


def train(texts: list[str], langs: list[str], seed: int = 7) -> Model:
    rows: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in texts]
    for i, bucket, share in piece_features(texts):
        rows[i].append((bucket, share))
    return learn(rows, langs, seed)


def learn(rows: list[list[tuple[np.ndarray, np.ndarray]]], langs: list[str], seed: int = 7) -> Model:
    """Stochastic gradient descent over the features of single texts and of their cuts, a fifth of the texts kept for calibration."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32))
    y = [names.index(x) for x in langs]
    order = [(i, 0) for i in range(len(rows))] + [(i, k) for i, r in enumerate(rows) for k in range(1, len(r))]
    label, held = np.array([y[i] for i, _ in order]), np.array([i % 5 == 0 for i, _ in order])
    bucket, share = (np.concatenate([rows[i][k][j] for i, k in order]) for j in (0, 1))
    at = np.concatenate([[0], np.cumsum([len(rows[i][k][0]) for i, k in order])])
    doc = np.repeat(np.arange(len(order)), np.diff(at))
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    out, bias = np.zeros((WIDTH, len(names)), np.float32), np.zeros(len(names), np.float32)
    train_on = np.flatnonzero(~held) if (~held).any() else np.arange(len(order))
    steps = EPOCHS * len(train_on)
    for step in range(steps):
        if step % len(train_on) == 0:
            turn = rng.permutation(train_on)
        i = turn[step % len(train_on)]
        b, s = bucket[at[i]:at[i + 1]], share[at[i]:at[i + 1]]
        if not len(b):
            continue
        hidden = s @ emb[b]
        z = hidden @ out + bias
        p = np.exp(z - z.max())
        p /= p.sum()
        p[label[i]] -= 1
        rate = np.float32(RATE * (1 - step / steps))
        grad = out @ p
        out -= rate * np.outer(hidden, p)
        bias -= rate * 0.1 * p
        emb[b] -= (rate * 8 * s)[:, None] * grad  # shares are small, so that the table learns at a higher rate
    model = Model(names, (emb @ out).astype(np.float32), bias)
    test = np.flatnonzero(held) if held.any() else train_on
    z = np.stack([np.bincount(doc, share * model.weights[bucket, k], len(order)) for k in range(len(names))], axis=1)[test] + bias
    losses = {t: -np.log(np.maximum(softmax(z / t)[np.arange(len(test)), label[test]], 1e-12)).mean() for t in np.geomspace(0.1, 5, 40)}
    model.temperature = float(min(losses, key=losses.get))
    whole = test < len(rows)  # the threshold is set on whole texts: cuts of mixed texts have no one language
    p = softmax(z[whole] / model.temperature)
    best, right = p.max(axis=1), p.argmax(axis=1) == label[test][whole]
    falling = np.argsort(-best, kind="stable")
    wrong = np.cumsum(~right[falling]) / np.arange(1, len(falling) + 1)
    fine = np.flatnonzero(wrong <= WRONG)
    model.threshold = float(best[falling][fine[-1]]) if len(fine) else 1.0
    return model


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """A model from at most `sample` rows that have a label and a text; the sample does not depend on row order. The driver gets
    features, not texts: at most `BUCKETS` pairs of numbers of a whole text and some hundreds of each of its four cuts."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key).cast("string"), F.length(text)).alias("h"), F.xxhash64(text).alias("p"))
    langs = max(1, rows.select("lang").distinct().count())
    share, first = max(1, sample // langs), F.row_number().over(Window.partitionBy("lang").orderBy("h", "p"))
    # Hashes alone are ranked, cut in every task before the shuffle; then the texts up to each language's last hash are read.
    last = rows.select("lang", "h", "p").withColumn("r", first).where(F.col("r") <= share).groupBy("lang").agg(F.max("h").alias("last"))
    few = rows.join(small(stage(last, "sample")), "lang").where("h <= last").withColumn("r", first).where(F.col("r") <= share)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", FIT_BYTES):
            buckets, shares = [[] for _ in range(part.num_rows)], [[] for _ in range(part.num_rows)]
            for i, bucket, piece in piece_features(part.column("text").to_pylist()):
                buckets[i].append(bucket.tobytes())
                shares[i].append(piece.tobytes())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("lang", "h", "p")), pa.array(buckets, pa.list_(pa.binary())),
                                              pa.array(shares, pa.list_(pa.binary()))], ["lang", "h", "p", "buckets", "shares"])

    got = few.select("lang", "h", "p", "text").mapInArrow(made, "lang string, h long, p long, buckets array<binary>, shares array<binary>") \
        .orderBy("h", "lang", "p").collect()  # at most `sample` rows
    return learn([[(np.frombuffer(b, np.int32), np.frombuffer(x, np.float32)) for b, x in zip(r.buckets, r.shares, strict=True)] for r in got],
                 [r.lang for r in got])


def has_letter(text: str | None) -> bool:
    return bool(text) and any(unicodedata.category(c)[0] == "L" for c in text)


ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def predict(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and whether it is sure enough, of each text."""
    t = Texts(texts, lower=True)
    z = np.zeros((len(t), len(model.langs)))
    if model.langs and len(t.bytes):
        a, b, h, owner, word, n = distinct_words(t)
        if len(a):
            score = np.empty((len(a), len(model.langs)))
            for first in range(0, len(a), 50_000):
                part = slice(first, first + 50_000)
                bucket, of = subwords(t.bytes, a[part], b[part], h[part])
                per = np.bincount(of, minlength=len(a[part]))
                for k in range(len(model.langs)):
                    score[part, k] = np.bincount(of, model.weights[bucket, k], len(a[part])) / per
            for k in range(len(model.langs)):
                z[:, k] = np.bincount(owner, score[word, k], len(t)) / np.maximum(n, 1)
    total = np.concatenate([[0], np.cumsum(ASCII_LETTER[t.bytes])])
    letters = total[t.bounds[1:]] > total[t.bounds[:-1]]
    for i in np.flatnonzero(~letters):
        letters[i] = has_letter(texts[int(i)].as_py())
    if not model.langs:
        return [UNKNOWN] * len(t), np.zeros(len(t)), np.zeros(len(t), bool)
    p = softmax((z + model.bias) / model.temperature)
    best, score = p.argmax(axis=1), np.where(letters, p.max(axis=1), 0.0)
    names = [model.langs[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), letters.tolist(), strict=True)]
    return names, np.clip(score, 0, 1), letters & (score >= model.threshold)


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`docs` (or its columns `keep`) with `lang_pred`, `score` and `accepted` (false: rejected as too unsure)."""
    new = ("lang_pred", "score", "accepted")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text):
            names, score, sure = predict(model, part.column(text))
            yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [
                pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(sure, pa.bool_())], [*kept, *new])

    return picked(docs, [*kept, text]).mapInArrow(run, shape(docs, kept, "lang_pred string, score double, accepted boolean"))


def held_out(parts: int) -> Column:
    """Whether the row is kept from training: crc32 of the id as text leaves 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == 2, F.lit(False))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out(4).alias("held_out"))
    model = fit(docs.where(~F.col("held_out")))
    return identify(docs, model, keep=["doc_id", "held_out"])
