import json
import math
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from loadwatch.llm.scoring import BEGIN, DISCOUNT, END, EliasFano, Trie, op1_lm_score, score

from .conftest import SMALL, crc


def test_elias_fano_reads_and_finds():
    rng = np.random.default_rng(5)
    for values in (np.array([0]), np.arange(100), np.array([3, 10**12]), np.unique(rng.integers(0, 10**9, 5000)), np.unique(rng.integers(0, 900, 700))):
        head, low, high, ones = EliasFano.coded(values)
        e = EliasFano(int(head[0]), int(head[1]), low, high, ones)
        at = rng.integers(0, len(values), 300)
        assert (e.at(at) == values[at]).all()
        asked = np.concatenate([values[at], rng.integers(0, int(values[-1]) + 5, 300), [values[-1] * 4 + 9]])
        place = {v: i for i, v in enumerate(values.tolist())}
        assert e.find(asked).tolist() == [place.get(x, -1) for x in asked.tolist()]
        lo = np.minimum(at, 3)
        assert e.find(values[at], lo, at).tolist() == [-1] * len(at)


def test_pointers_may_repeat_and_ranges_be_empty():
    t = Trie.written(np.array([4, 9, 30]), np.array([2, 0, 3]), np.array([1, 7, 0, 7, 8]), np.array([10, 20, 30]), np.array([1, 2, 3, 4, 5]))
    code, bow = t.query(np.array([4, 4, 4, 9, 30, 30, 30, 5]), np.array([1, 7, 8, 1, 0, 8, 9, 1]))
    assert code.tolist() == [1, 2, -1, -1, 3, 5, -1, -1] and bow.tolist() == [10, 10, 10, 20, 30, 30, 30, -1]


def expected(rows, trains):
    """The same model, spelled out over words."""
    cut = [[*(t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split(), END] for _, t in rows]
    uni, bi, ctx, follow = Counter(), Counter(), Counter(), Counter()
    for w, on in zip(cut, trains):
        if on:
            uni.update(w)
            pairs = list(zip([BEGIN, *w], w))
            bi.update(pairs)
            ctx.update(a for a, _ in pairs)
    for a, _ in bi:
        follow[a] += 1
    n, v = sum(uni.values()), len(uni)
    out = []
    for w in cut:
        lower = [(uni[x] + 1) / (n + v + 1) for x in w]
        total = 0.0
        for a, b, p in zip([BEGIN, *w], w, lower):
            if ctx[a]:
                p = max(bi[a, b] - DISCOUNT, 0) / ctx[a] + min(1, DISCOUNT * follow[a] / ctx[a]) * p
            total += math.log10(p)
        out.append((len(w), sum(uni[x] > 0 for x in w), n, sum(map(math.log10, lower)), total))
    return out


def compared(got, rows, trains):
    want = expected(rows, trains)
    got = sorted(([*r] for r in got), key=str)
    want = sorted(([k, t, *w] for (k, _), t, w in zip(rows, trains, want)), key=str)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-6 * (1 + abs(w[5]))
        assert abs(g[6] - w[6]) < 0.002 * w[2] + 0.002


def test_scores_equal_the_model_spelled_out(spark, docs, texts):
    # Small shards and blocks, so that all of them take part; contexts stay whole, so that the model is exact.
    train = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 != 2, F.lit(True))
    rows = [(r[0], r[1]) for r in texts]
    got = score(docs, train, block_bytes=20_000, words_shard=2_000, pairs_shard=20_000, split=1e9)
    compared(got.collect(), rows, [k is None or crc(k) % 7 != 2 for k, _ in rows])


def test_split_contexts_stay_close(spark, docs):
    whole = {r.doc_id: r.score for r in score(docs, F.lit(True)).collect()}
    for r in score(docs, F.lit(True), pairs_shard=5_000).collect():
        assert abs(r.score - whole[r.doc_id]) < 0.02 * r.n_tokens + 0.01


def test_nothing_to_learn_and_nothing_to_score(spark, docs, empty):
    assert score(empty, F.lit(True)).collect() == []
    for r in score(docs, F.lit(False)).collect():
        assert r.n_known == 0 and r.train_tokens == 0 and r.score == r.base_score == 0.0


def test_bigrams_beat_unigrams_on_held_out_texts(spark):
    r = op1_lm_score(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def test_split_contexts_have_the_model_spelled_out(spark):
    # "hot" is a third of all tokens and has three successors; "wide" has many.
    rows = [(i, f"hot {'abc'[i % 3]} hot {'abc'[i % 2]} wide w{i} hot") for i in range(300)] + [(1000 + i, f"hot w{i} wide a hot hot") for i in range(20)]
    trains = [k < 1000 for k, _ in rows]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    compared(score(df, F.col("doc_id") < 1000, block_bytes=2_000, words_shard=100, pairs_shard=100).collect(), rows, trains)


SHUFFLED = """
import sys
from pyspark.sql import SparkSession, functions as F
folder = sys.argv[1]
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
         .config("spark.checkpoint.dir", folder + "/shared").config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", folder)
         .config("spark.eventLog.rolling.enabled", "false").config("spark.eventLog.compress", "false").getOrCreate())
from loadwatch.llm.scoring import blocks, score
docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
print(score(docs, F.lit(True), block_bytes=500_000, pairs_shard=50_000).count(), blocks(docs, F.lit(True), block_bytes=500_000).agg(F.sum(F.length("tokens"))).first()[0])
spark.stop()
"""


def test_tokens_of_a_block_pass_one_shuffle(folder):
    """What is read with the words' numbers is read once: the contexts that are split are counted from the blocks as they lie."""
    root = Path(__file__).resolve().parents[2]
    done = subprocess.run([sys.executable, "-c", SHUFFLED, folder], cwd=root, capture_output=True, text=True, timeout=300)
    rows, tokens = map(int, done.stdout.split())
    log = [json.loads(line) for f in Path(folder).iterdir() if f.is_file() for line in f.open()]
    written = sum(e["Task Metrics"]["Shuffle Write Metrics"]["Shuffle Bytes Written"] for e in log if e["Event"] == "SparkListenerTaskEnd")
    assert rows == 1000
    # Words 1.4 times the tokens' bytes, tokens and numbers 1.2, pairs 2.2 (2.4 where numbers don't go out as steps), the rest 0.1; a
    # second join of tokens and numbers adds 1.2.
    assert written < 5.05 * tokens
