"""Toxicity: a linear classifier of words that may not change its mind when a group is named instead of another.

Features are the distinct words of a text (stretches of letters, ASCII ones lower-cased), by hash. `fit` works on a bounded sample of labelled
rows: at most `SAMPLE` of each label, those of the smallest row hash. On the sample, Spark counts in how many texts of either label a word
occurs; the `WORDS` most telling ones (by the G statistic, at least `TELLING`, in at least `LEAST` texts) and all identity terms are the vocabulary. Each sampled
row leaves its task as positions in the vocabulary, never as text, so that what the driver trains on is bounded by rows times vocabulary.

Counterfactuals: for a sampled row that names groups, every sentence is also seen with each identity term replaced by another term of its
set (`IDENTITY`), chosen by the row's hash. Training minimises the logistic loss plus `PENALTY` times the mean squared difference of the two log-odds, plus
a ridge. A group that is named more often in toxic texts thereby gets no weight of its own: what its terms weigh is what
other groups' terms weigh, and the intercept takes the rest. Labels are sampled evenly, so the intercept is set back by the log of the sampling rates.

Edge cases: a null or empty text, or one without a letter, has the score of the intercept; null labels and rows without an id teach nothing; an id with several labels,
or several rows, teaches once with each; ties of the row hash are all taken or left together where they pass the bound; without labels of both kinds the score is the share of toxic labels
(0 without any label); texts of any length are read whole; an empty table gives an empty result. Columns with the names of results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loadwatch.llm.arrays import Texts, chunks, picked, shape, spread, table, xxh64
from loadwatch.session import stage

#: Labelled rows of each label that are used to fit, at most; words of the vocabulary; texts a word must occur in.
SAMPLE, WORDS, LEAST = 6_000, 4_096, 3
#: Half the G statistic a word must reach (a chance of about 1e-5 for a word that tells nothing): small samples learn no noise.
TELLING = 10.0
PENALTY, RIDGE, STEPS, RATE = 4.0, 1e-4, 400, 0.15

# Sets of terms of which one may stand for another.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("she", "he"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "lesbian", "bisexual", "straight", "transgender"), ("black", "white", "asian", "latino", "arab"),
    ("immigrants", "refugees", "natives", "foreigners"), ("disabled", "blind", "deaf", "autistic"), ("old", "young"),
    ("americans", "mexicans", "chinese", "russians", "africans", "germans", "french", "spaniards"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("ausländer", "inländer"), ("schwule", "lesben", "heteros"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("immigrés", "étrangers", "réfugiés"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("inmigrantes", "extranjeros", "refugiados"),
)

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass
class Model:
    """`words`: sorted hashes, `weights` of theirs; `intercept`."""

    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    intercept: float = -np.inf


def hashed(words: tuple[str, ...] | list[str]) -> np.ndarray:
    data = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in data])
    return xxh64(np.frombuffer(b"".join(data), np.uint8), ends - [len(w) for w in data], ends)


def found(t: Texts, words: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, hash of a word) pairs of a batch; with `words` (sorted), pairs of (text, position in it)."""
    starts, ends, offsets = t.runs(LETTER[t.bytes])
    h = xxh64(t.bytes, starts, ends)
    owner = np.repeat(np.arange(len(t)), np.diff(offsets))
    if words is not None:
        if not len(words):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(words, h), len(words) - 1)
        hit = words[at] == h
        pair = np.unique(owner[hit] * len(words) + at[hit])
        return pair // len(words), pair % len(words)
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    return owner[fresh], h[fresh]


def sampled(docs: DataFrame, labels: DataFrame, text: str, key: str, label: str, sample: int) -> tuple[DataFrame, dict[int, int]]:
    """At most `sample` rows (text, label, row hash) of each label, and how many labels there are of each."""
    marked = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).distinct()
    marked = marked.withColumn("h", F.xxhash64("key", "label"))
    totals = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    # Only hashes are ranked, cut in every task before the shuffle; the ids taken are few enough to be sent to all tasks.
    first = F.row_number().over(Window.partitionBy("label").orderBy("h", "key"))
    taken = stage(marked.withColumn("r", first).where(F.col("r") <= sample).drop("r"), "taken")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(taken), "key")
    return stage(rows.dropDuplicates(["key", "label", "text"]).select("text", "label", "h"), "sample"), totals


def vocabulary(rows: DataFrame, words: int = WORDS, least: int = LEAST) -> np.ndarray:
    """Sorted hashes of the words that tell the labels apart best, and of the identity terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            owner, h = found(Texts(part.column("text"), lower=True))
            y = part.column("label").to_numpy(zero_copy_only=False)[owner].astype(np.int64)
            distinct, at = np.unique(h, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(np.bincount(at, 1 - y, len(distinct)).astype(np.int64)),
                                              pa.array(np.bincount(at, y, len(distinct)).astype(np.int64))], ["h", "clean", "toxic"])

    counts = rows.select("text", "label").mapInArrow(run, "h bigint, clean bigint, toxic bigint").groupBy("h").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    n = rows.agg(F.count_if(F.col("label") == 0).alias("clean"), F.count_if(F.col("label") == 1).alias("toxic")).first()
    all_rows = n["clean"] + n["toxic"]

    def part(name: str, present: bool) -> Column:
        met = F.col("clean") + F.col("toxic")
        seen, of = (F.col(name), met) if present else (n[name] - F.col(name), all_rows - met)
        return F.when(seen > 0, seen * F.log(seen * all_rows / (of * n[name]))).otherwise(0.0)

    telling = sum((part(name, present) for name in ("clean", "toxic") for present in (True, False)), F.lit(0.0))
    best = counts.where(F.col("clean") + F.col("toxic") >= least).select("h", F.round(telling, 6).alias("g")).where(F.col("g") >= TELLING).orderBy(F.desc("g"), "h").limit(words)
    got = np.array([r["h"] for r in best.collect()], np.int64).view(np.uint64)
    return np.unique(np.concatenate([got, hashed([w for s in IDENTITY for w in s])]))


def swaps(words: np.ndarray) -> dict[int, list[int]]:
    """Position of each identity term, and the positions of the terms that may replace it."""
    out = {}
    for s in IDENTITY:
        at = np.searchsorted(words, hashed(s)).tolist()
        out.update({a: [b for b in at if b != a] for a in at})
    return out


def positions(rows: DataFrame, words: np.ndarray) -> list:
    """Every sampled row as positions in the vocabulary, with its label and hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            owner, at = found(Texts(part.column("text"), lower=True), words)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32)), pa.array(at.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([lists, part.column("label"), part.column("h")], ["at", "label", "h"])

    return picked(rows, ["text", "label", "h"]).mapInArrow(run, "at array<int>, label int, h bigint").orderBy("h", "label", "at").collect()


def sparse(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Row and position of every entry of some lists of positions."""
    size = [len(r) for r in rows]
    return np.repeat(np.arange(len(rows)), size), np.array([a for r in rows for a in r], np.int64)


def counterfactuals(rows: list[list[int]], hashes: list[int], words: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Rows that name groups, and the same with every identity term replaced by another of its set."""
    other, at, out = swaps(words), [], []
    for i, (r, h) in enumerate(zip(rows, hashes, strict=True)):
        named = [a for a in r if a in other]
        if named:
            mix = spread(np.array([np.uint64(h & (1 << 64) - 1) ^ np.uint64(a) for a in named], np.uint64))
            new = {other[a][int(m % np.uint64(len(other[a])))] for a, m in zip(named, mix, strict=True)}
            at.append(i)
            out.append(sorted(set(r) - set(named) | new))
    return at, out


def train(rows: list[list[int]], y: np.ndarray, hashes: list[int], words: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """Weights and intercept by full gradients with momentum and per-weight rates; the same rows give the same model."""
    doc, col = sparse(rows)
    of, changed = counterfactuals(rows, hashes, words)
    cdoc, ccol = sparse(changed)
    pair = np.array(of, np.int64)
    n, k = len(rows), len(words)
    w, b = np.zeros(k), 0.0
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, STEPS + 1):
        z = np.bincount(doc, w[col], n) + b
        away = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        grad = np.bincount(col, away[doc], k) / n + RIDGE * w
        if len(pair):
            apart = (z[pair] - b) - np.bincount(cdoc, w[ccol], len(pair))
            each = np.zeros(n)
            each[pair] = apart
            grad += 2 * penalty / len(pair) * (np.bincount(col, each[doc], k) - np.bincount(ccol, apart[cdoc], k))
        g = np.append(grad, away.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (1 - step / (STEPS + 1)) * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w, b = w - move[:k], b - move[k]
    return w, b


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", sample: int = SAMPLE,
        penalty: float = PENALTY) -> Model:
    """A model from at most `sample` labelled rows of each label."""
    rows, totals = sampled(docs, labels, text, key, label, sample)
    clean, toxic = totals.get(0, 0), totals.get(1, 0)
    words = vocabulary(rows) if clean and toxic else None
    got = positions(rows, words) if words is not None else []
    y = np.array([r["label"] for r in got], float)
    if not len(y) or y.min() == y.max():
        share = toxic / (clean + toxic) if clean + toxic else 0.0
        return Model(intercept=float(np.log(share) - np.log1p(-share)) if 0 < share < 1 else -np.inf if share == 0 else np.inf)
    w, b = train([r["at"] for r in got], y, [r["h"] for r in got], words, penalty)
    rate = {0: (len(y) - y.sum()) / clean, 1: y.sum() / toxic}
    return Model(words, w, float(b + np.log(rate[0] / rate[1])))


def predict(model: Model, texts: pa.Array) -> np.ndarray:
    doc, at = found(Texts(texts, lower=True), model.words)
    z = np.bincount(doc, model.weights[at], len(texts)) + model.intercept
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-z))


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`docs` (or its columns `keep`) with `score` and `predicted`: one pass, no shuffle."""
    new = ("score", "predicted")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text):
            p = predict(model, part.column(text))
            yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], [*kept, *new])

    return picked(docs, [*kept, text]).mapInArrow(run, shape(docs, kept, "score double, predicted int"))


def held_out(key: str = "doc_id") -> Column:
    """Whether the row is kept from training: crc32 of the id as text leaves 0 by 5."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out().alias("held_out"))
    labels = table(spark, sf_dir, "labels").where(~held_out())
    return score(docs, fit(docs.where(~F.col("held_out")), labels), keep=["doc_id", "held_out"])
