"""A Merkle manifest of a data set: built levels as parent-linked node rows, and a recursive query that climbs from each leaf.

A row's leaf is the digest of its fields. Leaves of one group (here: a language) in key order are the bottom of the group's tree;
while several nodes remain, every two consecutive ones become their digest (a last one alone, the digest of itself). The roots
of the groups, in the order of the groups, are the leaves of one more tree, whose top is the root of the data set.

How it is built: rows are range-sorted by (group, key) and numbered by their place, so that no group is ever one task; then blocks of
2^`STRIDE` consecutive nodes are combined, `STRIDE` levels in one aggregation. What is stored is one row per node at the foot of a
block, linked to its parent, the node at the block's top, with the siblings on the way. `climb` starts with the leaves (the
current digest of a row, tampered with or not) and follows the links in a recursive query: each step appends the siblings and folds
them into the digest. A link above the leaves is shared by many of them: it is dealt in `SALTS` copies, of which a leaf meets one.

Edge cases: rows without a group are a group, the first; rows without a key come first in it; equal keys are ordered by leaf, and
rows that are equal in all have neighbouring places and the same leaf, each with its own proof; a group of one row is its own root; a table of one group has
that group's root; an empty table has no root and gives no rows. Texts of any length are hashed whole. Other columns are ignored,
and names of results may be names of the input's columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loadwatch.llm.arrays import small, table
from loadwatch.session import stage

#: Levels that one stored link climbs: a block has 2^STRIDE nodes.
STRIDE = 10
#: Copies of a link that very many leaves share.
SALTS = 64
TOP = -1  # the tree over the groups' roots

LINK = "tree bigint, level int, pos bigint, siblings array<binary>, reached binary, up_tree bigint, up_level int, up_pos bigint, final boolean"
LINK_COLUMNS = [c.split(" ")[0] for c in LINK.split(", ")]


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def shown(c: Column) -> Column:
    """A digest's bytes as lower-case hex text."""
    return F.lower(F.hex(c))


def field(c: Column) -> Column:
    """A field so that no two rows of fields run together: `-` for null, else its bytes, a colon and its text."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


# -------------------------------------------------------------------- places
def placed(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """`df` with `pos`, the place of each row within its group, from 0, and `count`, the rows of the group.

    Rows are dealt by ranges of (group, order) and numbered within each range; the rows of a group in earlier ranges are added from a
    table with one row per range and group.
    """
    keys = [F.asc_nulls_first(c) for c in (group, *order)]
    # The number holds the range (upper bits) and the place in it; written at once, so that a lost task can't deal anew.
    numbered = stage(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__number", F.monotonically_increasing_id()), "placed")
    dealt = numbered.withColumn("__range", F.shiftright("__number", 33))
    heads = dealt.groupBy("__range", F.col(group).alias("__of")).agg(F.min("__number").alias("__first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("__of").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    heads = stage(heads.select(F.col("__range").alias("__its"), "__of", "__first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before"),
                               F.sum("n").over(Window.partitionBy("__of")).alias("count")), "heads")
    met = dealt.join(small(heads), (F.col("__range") == F.col("__its")) & F.col(group).eqNullSafe(F.col("__of")))
    return met.select(*[F.col(c) for c in df.columns], (F.col("__number") - F.col("__first") + F.col("__before")).alias("pos"), "count")


def height(count: Column) -> Column:
    """Levels above the leaves of a tree with so many of them."""
    return F.when(count > 1, F.length(F.bin(count - 1))).otherwise(0).cast("int")


# --------------------------------------------------------------------- levels
def _higher(nodes: Column) -> Column:
    """The level above: every two nodes, a last one alone."""
    pairs = F.sequence(F.lit(0), F.ceil(F.size(nodes) / 2).cast("int") - 1)
    return F.transform(pairs, lambda i: digest(F.get(nodes, 2 * i), F.coalesce(F.get(nodes, 2 * i + 1), F.lit(""))))


def links(nodes: DataFrame, level: int, top_tree: bool, final_tree: bool) -> DataFrame:
    """Links of the nodes (tree, pos, hash, high: levels of the tree) of one level, each up to `STRIDE` levels high.

    With `top_tree` the top of a tree is the end; else it leads to the leaf of the same number of the tree over all. `final_tree`: a
    tree's top is the root itself. Within a block the nodes of each level are made from those below, so that a block is one row.
    """
    block = nodes.groupBy("tree", F.shiftright("pos", STRIDE).alias("block"), "high").agg(F.sort_array(F.collect_list(F.struct("pos", "hash"))).alias("members"))
    steps = F.least(F.lit(STRIDE), F.col("high") - level)
    ups = F.slice(F.array(*[F.lit(k) for k in range(STRIDE)]), F.lit(1), steps)
    # One expression with a state: columns made from one another would be written out into each other, times three a level.
    levels = F.aggregate(ups, F.array(F.col("members.hash")), lambda made, _: F.concat(made, F.array(_higher(F.element_at(made, -1)))))
    block = block.select("tree", "block", "high", ups.alias("ups"), levels.alias("levels"))
    at = F.col("i")
    # Digests are stored as their 32 bytes; a node without a sibling has an empty one.
    siblings = F.transform("ups", lambda k: F.unhex(F.coalesce(F.get(F.get("levels", k), F.call_function("shiftright", at, k).bitwiseXOR(F.lit(1))), F.lit(""))))
    reached = F.unhex(F.get(F.element_at("levels", -1), F.lit(0)))
    ends = F.col("high") <= level + STRIDE
    one = block.select("*", F.posexplode(F.get("levels", F.lit(0))).alias("i", "own"))
    return one.select(
        "tree", F.lit(level).alias("level"), (F.shiftleft("block", STRIDE) + at).alias("pos"), siblings.alias("siblings"), reached.alias("reached"),
        F.when(ends & F.lit(not top_tree), F.lit(TOP)).otherwise(F.col("tree")).cast("bigint").alias("up_tree"),
        F.when(ends & F.lit(not top_tree), 0).otherwise(level + STRIDE).alias("up_level"),
        F.when(ends & F.lit(not top_tree), F.col("tree")).otherwise(F.col("block")).alias("up_pos"),
        (ends & F.lit(final_tree)).alias("final"), "high")


def tree_links(nodes: DataFrame, highest: int, top_tree: bool, final_tree: bool) -> list[DataFrame]:
    """The stored links of all trees of `nodes`, level by level: one aggregation for every `STRIDE` levels."""
    out = []
    for level in range(0, max(highest, 1), STRIDE):
        out.append(stage(links(nodes, level, top_tree, final_tree), "links"))
        nodes = out[-1].where(F.col("high") > level + STRIDE).groupBy("tree", F.col("up_pos").alias("pos"), "high").agg(shown(F.first("reached")).alias("hash"))
    return out


# ------------------------------------------------------------------- manifest
@dataclass(frozen=True)
class Manifest:
    """`rows`: the rows with their `leaf`, `tree` and `pos`; `leaf_links` and `higher_links`: the stored nodes; `root`: None without rows."""

    rows: DataFrame
    leaf_links: DataFrame
    higher_links: DataFrame
    root: str | None


def build(rows: DataFrame, group: str, order: list[str], leaf: str = "leaf") -> Manifest:
    """The manifest of `rows`, which hold their `leaf` digest; trees are numbered in the order of the groups."""
    own = placed(rows, group, order)
    groups = placed(own.groupBy(F.col(group).alias("of")).agg(F.max("count").alias("rows")).withColumn("all", F.lit(0)), "all", ["of"])
    groups = stage(groups.select("of", "rows", F.col("pos").alias("tree"), height(F.col("rows")).alias("high")), "trees")
    trees, highest = groups.agg(F.count(F.lit(1)), F.max("high")).first()
    if not trees:
        spark = rows.sparkSession
        none = spark.createDataFrame([], LINK)
        return Manifest(own.withColumn("tree", F.lit(0).cast("bigint")), none, none, None)
    numbered = own.join(small(groups), own[group].eqNullSafe(groups["of"])).select(*[own[c] for c in rows.columns], "tree", "pos", "high")
    numbered = stage(numbered, "leaves")
    below = tree_links(numbered.select("tree", "pos", "high", F.col(leaf).alias("hash")), highest, False, trees == 1)
    high = (trees - 1).bit_length()
    tops = reduce(DataFrame.unionByName, below).where((F.col("up_tree") == TOP) & (F.col("up_level") == 0)).groupBy(F.col("up_pos").alias("pos")).agg(shown(F.first("reached")).alias("hash"))
    above = tree_links(tops.select(F.lit(TOP).cast("bigint").alias("tree"), "pos", F.lit(high).alias("high"), "hash"), high, True, True) if trees > 1 else []
    higher = [*below[1:], *above]
    made = reduce(DataFrame.unionByName, higher) if higher else below[0].limit(0)
    root = (above or below)[-1].where("final").select(shown(F.col("reached"))).first()[0]
    return Manifest(numbered, below[0].select(LINK_COLUMNS), made.select(LINK_COLUMNS), root)


@contextmanager
def unlimited(spark: SparkSession) -> Iterator[None]:
    """A recursive query may give any number of rows within this; its steps are as many as a tree has links."""
    name = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


# Siblings are folded from the lowest level up; the bits of the place say on which side a node is. Digests travel as bytes and are hashed as text.
FOLD = """aggregate({links}.siblings, named_struct('k', 0, 'h', lower(hex({start}))), (a, s) -> named_struct('k', a.k + 1, 'h',
          sha2(CAST(if(shiftright({pos}, a.k) & 1 = 1, concat(lower(hex(s)), a.h), concat(a.h, lower(hex(s)))) AS BINARY), 256)), a -> unhex(a.h))"""
JOINED = "aggregate({links}.siblings, CAST('' AS BINARY), (a, s) -> concat(a, s))"


def climb(manifest: Manifest, claimed: str, keep: list[str]) -> DataFrame:
    """The columns `keep` of `manifest.rows` with `subroot`, `proof` (the siblings up to the root) and `folded_root`, what the digest in column
    `claimed` folds to, all as bytes. Staged when it returns."""
    spark = manifest.rows.sparkSession
    whole = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    start = manifest.rows.select("tree", "pos", F.unhex(claimed).alias("claimed"), whole)
    first = start.join(manifest.leaf_links, ["tree", "pos"])
    salted = F.when((F.col("level") > STRIDE) | (F.col("tree") == TOP), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    higher = manifest.higher_links.withColumn("salt", F.explode(salted))
    query = f"""
        WITH RECURSIVE climb(row, at, salt, tree, level, pos, subroot, proof, folded, final) AS (
            SELECT row, pos, CASE WHEN up_level > {STRIDE} OR up_tree = {TOP} THEN CAST(pos % {SALTS} AS INT) ELSE 0 END, up_tree, up_level, up_pos,
                   CASE WHEN up_tree = {TOP} OR final THEN reached END, {JOINED.format(links='f')}, {FOLD.format(links='f', start='claimed', pos='pos')}, final
            FROM {{first}} f
            UNION ALL
            SELECT c.row, c.at, CASE WHEN n.up_level > {STRIDE} OR n.up_tree = {TOP} THEN CAST(c.at % {SALTS} AS INT) ELSE 0 END, n.up_tree, n.up_level, n.up_pos,
                   coalesce(c.subroot, CASE WHEN n.up_tree = {TOP} OR n.final THEN n.reached END), concat(c.proof, {JOINED.format(links='n')}),
                   {FOLD.format(links='n', start='c.folded', pos='c.pos')}, n.final
            FROM climb c JOIN {{higher}} n ON c.tree = n.tree AND c.level = n.level AND c.pos = n.pos AND c.salt = n.salt)
        SELECT row.*, subroot, proof, folded AS folded_root FROM climb WHERE final"""
    with unlimited(spark):
        return stage(spark.sql(query, first=first, higher=stage(higher, "higher")), "climbed")


# ---------------------------------------------------------------------- query
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of `documents` by language, and each row's proof; rows picked by their id's check sum claim one character more."""
    docs = table(spark, sf_dir, "documents")
    leaf = digest(*[field(F.col(c)) for c in FIELDS])
    more = digest(*[field(F.col(c) + 1 if c == "n_chars" else F.col(c)) for c in FIELDS])
    picked = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    rows = docs.select("doc_id", "lang", leaf.alias("leaf"), F.when(picked & F.col("n_chars").isNotNull(), more).alias("tampered"))
    made = build(rows, "lang", ["doc_id", "leaf"])
    current = made.rows.select("tree", "pos", "doc_id", F.coalesce("tampered", "leaf").alias("claimed"), F.unhex("leaf").alias("own"))
    root = F.lit(made.root).cast("string")
    got = climb(replace(made, rows=current), "claimed", ["doc_id", "own"])
    return got.select("doc_id", shown(F.col("own")).alias("leaf"), shown(F.col("subroot")).alias("subroot"), root.alias("root"),
                      F.sha2(shown(F.col("proof")).cast("binary"), 256).alias("proof_sha256"), shown(F.col("folded_root")).alias("folded_root"),
                      (shown(F.col("folded_root")) == root).alias("verified"))


OP13_SQL = """
WITH RECURSIVE bits AS (
    SELECT doc_id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(CAST(doc_id AS VARCHAR)) + 1),
        lambda i: ascii(substr(CAST(doc_id AS VARCHAR), i::INT, 1))::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda z: 0::BIGINT)),
        lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END))) AS c
    FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)),
picked AS (SELECT doc_id FROM bits WHERE xor(c, 4294967295::BIGINT) % 7 = 0),
fields AS (
    SELECT doc_id, lang, n_chars,
        CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END
        || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
        || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS head,
        CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END AS size,
        CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) END AS changed,
        CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS body
    FROM documents),
leaves AS (
    SELECT f.doc_id, f.lang, sha256(head || size || body) AS leaf,
        CASE WHEN p.doc_id IS NULL THEN sha256(head || size || body) ELSE sha256(head || changed || body) END AS claimed
    FROM fields f LEFT JOIN picked p ON f.doc_id = p.doc_id),
numbered AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS tree,
        count(*) OVER (PARTITION BY lang) AS n FROM leaves),
low AS (
    SELECT tree, 0 AS level, pos, leaf AS h, n FROM numbered
    UNION ALL
    SELECT tree, level + 1, pos // 2, sha256(h || coalesce(nxt, '')), (n + 1) // 2
    FROM (SELECT *, lead(h) OVER (PARTITION BY tree ORDER BY pos) AS nxt FROM low) WHERE pos % 2 = 0 AND n > 1),
subroots AS (SELECT tree, level AS high, h FROM low WHERE n = 1),
upper AS (
    SELECT 0 AS level, tree - 1 AS pos, h, count(*) OVER () AS n FROM subroots
    UNION ALL
    SELECT level + 1, pos // 2, sha256(h || coalesce(nxt, '')), (n + 1) // 2
    FROM (SELECT *, lead(h) OVER (ORDER BY pos) AS nxt FROM upper) WHERE pos % 2 = 0 AND n > 1),
nodes AS (
    SELECT l.tree, l.level, l.pos, l.h, l.n FROM low l WHERE l.n > 1
    UNION ALL
    SELECT s.tree, s.high + u.level, u.pos, u.h, u.n FROM subroots s CROSS JOIN upper u WHERE u.n > 1),
steps AS (
    SELECT tree, pos AS leaf_pos, claimed AS folded, '' AS proof, pos, 0 AS level FROM numbered
    UNION ALL
    SELECT s.tree, s.leaf_pos, CASE WHEN s.at % 2 = 1 THEN sha256(coalesce(b.h, '') || s.folded) ELSE sha256(s.folded || coalesce(b.h, '')) END,
        s.proof || coalesce(b.h, ''), s.at // 2, s.level + 1
    FROM (SELECT x.*, CASE WHEN x.level = r.high THEN x.tree - 1 ELSE x.pos END AS at FROM steps x JOIN subroots r USING (tree)) s
    JOIN (SELECT DISTINCT tree, level FROM nodes) e ON e.tree = s.tree AND e.level = s.level
    LEFT JOIN nodes b ON b.tree = s.tree AND b.level = s.level AND b.pos = xor(s.at, 1)),
root AS (SELECT h AS root FROM upper WHERE n = 1),
ends AS (SELECT *, row_number() OVER (PARTITION BY tree, leaf_pos ORDER BY level DESC) AS k FROM steps)
SELECT n.doc_id, n.leaf, s.h AS subroot, r.root, sha256(e.proof) AS proof_sha256, e.folded AS folded_root, e.folded = r.root AS verified
FROM numbered n JOIN subroots s USING (tree) JOIN ends e ON e.tree = n.tree AND e.leaf_pos = n.pos AND e.k = 1 CROSS JOIN root r
"""
