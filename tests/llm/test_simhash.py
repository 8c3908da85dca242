import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
import xxhash

from loadwatch.llm import simhash
from loadwatch.llm.simhash import components, fingerprints, forest, keep_first, near, near_duplicates, roots


def by_hand(text, k=3, seed=42):
    w = bytes((text or "").encode()).lower().split() if text else []
    if not w:
        return 0
    shingles = [b" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(s, seed) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints):
    """The smallest row of each component over all pairs."""
    x = np.array(prints, np.uint64)
    a, b = np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 3)
    return roots(a, b, len(x))


def test_fingerprints(texts):
    got = fingerprints(pa.array([r[1] for r in texts]))
    assert got[:, 0].tolist() == [by_hand(r[1]) for r in texts]
    wide = fingerprints(pa.array([r[1] for r in texts]), 5, (42, 7))
    assert wide[:, 0].tolist() == [by_hand(r[1], 5) for r in texts] and wide[:, 1].tolist() == [by_hand(r[1], 5, 7) for r in texts]


@pytest.mark.parametrize("tile", [16384, 16])
def test_links_of_blocks_have_the_components_of_all_pairs(spark, tile):
    rng = np.random.default_rng(4)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    x = set(rng.integers(0, 1 << 63, 400, dtype=np.uint64).tolist())
    for s in seeds:  # chains of small changes, and a dense group
        for _ in range(12):
            s ^= np.uint64(1) << rng.integers(0, 64, dtype=np.uint64)
            x.add(int(s))
    x |= {int(seeds[0]) ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)}
    x = np.array(sorted(x), np.uint64)
    df = spark.createDataFrame(pa.table({"fp": x.view(np.int64)}))
    got = {r.node: r.root for r in components(near(df, tile=tile)).collect()}
    root = groups(x)
    want = {}
    for i, r in enumerate(root):
        want.setdefault(int(r), set()).add(int(x[i].view(np.int64)))
    want = {frozenset(v) for v in want.values() if len(v) > 1}
    made = {}
    for node, r in got.items():
        made.setdefault(r, set()).add(node)
    assert {frozenset(v) for v in made.values()} == want


def test_dense_strip_keeps_the_component():
    x = np.unique(np.array([(1 << i) for i in range(64)] + [0], np.uint64))
    a, b = forest(x[:, None], None, 2)
    assert len(a) == len(x) - 1


def test_rows_and_components(spark, docs, texts, empty):
    rows = [(r[0], r[1]) for r in texts] + [(10**6 + i, texts[3][1]) for i in range(50)]
    near_copy = texts[3][1].split(" ")
    rows += [(2 * 10**6, " ".join([*near_copy[:-1], "changed"]))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7))
    prints = [by_hand(t) for _, t in rows]
    root = groups(prints)
    least = {}
    for (k, _), r in zip(rows, root):
        if k is not None:
            least[r] = min(k, least.get(r, k))
    want = sorted(((k, f"{p:016x}", least.get(r)) for (k, _), p, r in zip(rows, prints, root)), key=str)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert near_duplicates(empty).collect() == []


def five_word_sets(texts):
    """Sets of five-word shingles, ASCII letters lowered; a text of fewer words is one shingle."""
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        out.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))})
    return out


def similar_groups(texts):
    """The smallest row of each group of texts linked by a Jaccard similarity of 0.8 or more, over all pairs."""
    sets = five_word_sets(texts)
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if 5 * len(a & b) >= 4 * len(a | b)]
    return roots(*np.array(links).reshape(-1, 2).T, len(sets))


def test_one_of_each_group_stays(spark, docs, texts):
    kept = keep_first(docs)
    assert kept.columns == docs.columns
    least = {}
    for (k, *_), r in zip(texts, similar_groups([t[1] for t in texts])):
        if k is not None:
            least[r] = min(k, least.get(r, k))
    assert sorted(r.doc_id for r in kept.select("doc_id").where("doc_id IS NOT NULL").collect()) == sorted(least.values())


def test_texts_of_a_similarity_of_four_fifths_go_and_others_stay(spark):
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}

    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if 60 <= len(r.text.split()) <= 900][:150]
    rng, more = np.random.default_rng(3), []
    for k, t in rows[:60]:  # a copy with one word in a hundred changed
        w = t.split()
        for i in rng.choice(len(w), max(1, len(w) // 100), replace=False):
            w[i] = f"changed{i}"
        more.append((10_000 + k, " ".join(w)))
    kept = {r.doc_id for r in keep_first(spark.createDataFrame(rows + more, "doc_id bigint, text string").repartition(4)).collect()}
    sets = [(k, shingles(t)) for k, t in rows + more]
    for i, (k, a) in enumerate(sets):
        closest = max((len(a & b) / len(a | b) for j, (_, b) in enumerate(sets) if i != j), default=0)
        smaller = [len(a & b) / len(a | b) for _, b in sets[:i]]
        assert closest >= 0.5 or k in kept  # nothing like it: it stays
        assert max(smaller, default=0) < 0.8 or k not in kept  # an earlier one like it: it goes


@pytest.mark.parametrize("tile", [16384, 40])
def test_wide_fingerprints_link_as_all_pairs_do(spark, tile):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 1 << 63, (120, 4), dtype=np.uint64)
    for i in range(60):  # chains of 40 flipped bits
        y = x[i].copy()
        for b in rng.choice(256, 40, replace=False):
            y[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
        x = np.vstack([x, y])
    df = spark.createDataFrame([(i, *map(int, r.view(np.int64))) for i, r in enumerate(x)], "fp bigint, fp0 bigint, fp1 bigint, fp2 bigint, fp3 bigint")
    got = {r.node: r.root for r in components(near(df, 51, tile)).collect()}
    apart = np.bitwise_count(x[:, None, :] ^ x[None, :, :]).astype(int).sum(axis=2)
    root = roots(*np.nonzero(apart <= 51), len(x))
    assert {i: r for i, r in enumerate(root.tolist()) if (root == r).sum() > 1} == got


def test_long_chain_is_one_component(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "a bigint, b bigint")
    got = components(edges).collect()
    assert len(got) == n + 1 and {r.root for r in got} == {0}


def test_jaccard_decides_which_rows_go(spark):
    rng = np.random.default_rng(11)
    rows, boiler = [], [f"b{i}" for i in range(140)]
    for i in range(60):  # pages of one template: half of the shingles are shared, no pair reaches 0.8
        rows.append([*boiler, *(f"p{i}x{j}" for j in range(60))])
    for i in range(40):  # texts and copies around the limit, short ones and repeated passages among them
        base = [f"t{i}y{j}" for j in range(int(rng.integers(8, 120)))]
        rows.append(base)
        for _ in range(3):
            copy = list(base)
            for at in rng.choice(len(copy), int(rng.integers(0, max(2, len(copy) // 25))), replace=False):
                copy[at] = f"c{rng.integers(10**9)}"
            rows.append(copy * int(rng.integers(1, 4)) if rng.random() < 0.3 else copy)
    sets = [{tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} for w in rows]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    root = roots(*np.array(links).T, len(sets))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in keep_first(df).collect()) == sorted(set(root.tolist()))
    hashes = [np.array(sorted({hash(x) & (1 << 63) - 1 for x in s}), np.uint64) for s in sets]
    assert simhash.alike(hashes).tolist() == root.tolist()
    # Blocks of a large group meet by pairs.
    nodes = simhash.with_similar(df, ["doc_id"]).groupBy("fp", "n").agg(F.min("doc_id").alias("least"))
    one = nodes.select(F.col("fp").alias("node"), F.lit(1).alias("root"))
    cut = components(simhash.verified(df, one, nodes, size=3000))
    got = simhash.named(nodes, nodes, cut).select("least", "component_id").collect()
    assert all(root[r.least] == r.component_id for r in got)


def test_rows_that_share_a_key_or_have_none_are_told_apart(spark):
    words = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(6)]
    near_copy = words[0] + " more"
    rows = [(None, words[0]), (None, words[1]), (None, words[1]), (7, words[2]), (7, words[3]), (7, words[3]), (8, words[4]), (9, words[4]),
            (9, words[5]), (None, words[5]), (7, near_copy), (7, words[2] + " more")]
    got = sorted(((r.doc_id, r.text) for r in keep_first(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()), key=str)
    of_two = [r for r in got if r[1].startswith(words[2])]
    assert len(of_two) == 1 and of_two[0][0] == 7  # near copies of one key: one of them
    rest = [(None, words[1]), (7, words[3]), (7, near_copy), (8, words[4]), (9, words[5])]
    assert [r for r in got if r not in of_two] == sorted(rest, key=str)
