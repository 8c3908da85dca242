import hashlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from loadwatch.llm import merkle
from loadwatch.llm.merkle import OP13_SQL, Manifest, build, climb, digest, field, op13_merkle

from .conftest import SMALL, crc


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def by_hand(leaves):
    """Root and, per leaf, the siblings on the way up."""
    proofs, level, owners = [[] for _ in leaves], list(leaves), [[i] for i in range(len(leaves))]
    while len(level) > 1:
        up, mine = [], []
        for i in range(0, len(level), 2):
            pair = level[i:i + 2]
            if len(pair) == 2:
                for k, o in ((1, owners[i]), (0, owners[i + 1])):
                    for x in o:
                        proofs[x].append(pair[k])
            up.append(H(*pair))
            mine.append([x for o in owners[i:i + 2] for x in o])
        level, owners = up, mine
    return level[0], proofs


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def test_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    got = op13_merkle(spark, SMALL)
    want = con.execute(OP13_SQL)
    assert got.columns == [c[0] for c in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


@pytest.mark.parametrize("sizes, salts", [([1], 64), ([5], 64), ([1, 1], 64), ([1300, 1, 2, 3, 257, 0], 3)])
def test_trees_of_any_shape(spark, sizes, salts, monkeypatch):
    monkeypatch.setattr(merkle, "SALTS", salts)
    rows = [(g if g else None, i, f"{g}.{i}") for g, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "g int, k int, t string").repartition(3).select("g", "k", digest(field(F.col("g")), field(F.col("t"))).alias("leaf"))
    made = build(df, "g", ["k", "leaf"])
    claimed = Manifest(made.rows.withColumn("claimed", F.when(F.col("k") == 1, F.sha2(F.lit("other").cast("binary"), 256)).otherwise(F.col("leaf"))),
                       made.leaf_links, made.higher_links, made.root)
    got = {(r.g, r.k): r for r in climb(claimed, "claimed", ["g", "k"]).select("g", "k", *[F.lower(F.hex(c)).alias(c) for c in ("proof", "subroot", "folded_root")]).collect()}
    subs, below = [], {}
    for g, n in enumerate(sizes):
        if n:
            root, proofs = by_hand([H(enc(g or None), enc(f"{g}.{i}")) for i in range(n)])
            below[g or None] = (len(subs), root, proofs)
            subs.append(root)
    root, tops = by_hand(subs)
    assert made.root == root and len(got) == sum(sizes)
    for (g, k), r in got.items():
        at, sub, proofs = below[g]
        assert r.subroot == sub and r.proof == "".join(proofs[k] + tops[at])
        assert (r.folded_root == root) == (k != 1)


def test_odd_rows(spark, docs, texts, empty):
    docs = docs.withColumn("n_chars", F.lit(3)).withColumn("leaf", F.lit("clash")).withColumn("tree", F.lit(1)).withColumn("pos", F.lit(1))
    leaf = digest(*[field(F.col(c)) for c in merkle.FIELDS])
    made = build(docs.select("doc_id", "lang", leaf.alias("leaf")), "lang", ["doc_id", "leaf"])
    got = climb(Manifest(made.rows.withColumn("claimed", F.col("leaf")), made.leaf_links, made.higher_links, made.root), "claimed", ["doc_id", "leaf"]).collect()
    assert len(got) == len(texts) and {r.folded_root.hex() for r in got} == {made.root}
    groups = defaultdict(list)
    for k, t, lang, source in texts:
        groups[lang].append((k is not None, k or 0, H(enc(k), enc(source), enc(lang), enc(3), enc(t))))
    subs = [by_hand([x[2] for x in sorted(groups[g])])[0] for g in sorted(groups, key=lambda g: (g is not None, (g or "").encode()))]
    assert made.root == by_hand(subs)[0]
    none = build(empty.select("doc_id", "lang", F.lit("x").alias("leaf")), "lang", ["doc_id", "leaf"])
    assert none.root is None and climb(Manifest(none.rows.withColumn("claimed", F.col("leaf")), none.leaf_links, none.higher_links, None), "claimed", ["doc_id"]).collect() == []


def test_a_changed_row_is_found(spark):
    got = op13_merkle(spark, SMALL).collect()
    assert {r.doc_id for r in got if not r.verified} == {r.doc_id for r in got if crc(r.doc_id) % 7 == 0}
