"""Mixing sources to target weights over a time-varying curriculum.

Every source has a weight and, over training time 0 to 1, a schedule: a piecewise linear multiplier, given as knots. Targets in
words are shares of the whole, capped at `CAP` times a source's size, the excess reshared by weight until none is above. A
source's demand up to time x is its target times the integral of its schedule up to x over the whole integral. Its documents,
in a fixed hash order, repeated as often as the target needs, lie on a line of words; the training position of a copy is the
time at which the cumulative demand reaches the copy's first word: the inverse of the integral, a root of a quadratic in the
knots' segment. Documents are range-sorted by position. The copy that crosses the target is cut there, so that a source takes
its target to within a word.

A source may hold a third of all rows, and so may one id, or rows without one. Rows alike in key, source and text are one row with a
count until their places are known. The running sum is not one window over the source, but a sum over buckets of about `ROWS` rows (a
window over bucket totals), plus a window inside each: hash ranges of the key, and where one key has more rows than that, the rows
before it, ranges of the text's hash for its own rows, and the rows after it. Sources are aggregated once; the capped shares are solved
on the table of sources, by aggregates that return one row a round.

Edge cases: null and empty texts have size 0 and are taken 0 words of; a null source is a source of its own, last; repeated rows
each count and follow one another; an empty table gives an empty result. Clashing columns of the input pass through untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loadwatch.llm.arrays import small, table
from loadwatch.session import stage

WEIGHTS, CAP = (5.0, 2.0, 1.0), 3
#: Rows of a bucket of the running sum, about.
ROWS = 1_000
#: The default schedules, dealt to the sources in turn: (time, multiplier) knots of early, constant and late sources.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.5), (1.0, 2.0)))
WHITE = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """`sizes` (source, rows, source_size: one row per source) with `rank` from 0 by code point, null last, and `target`."""
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = stage(sizes.withColumn("rank", F.row_number().over(order) - 1).withColumn("weight", w), "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    rate, limit = 0.0, F.lit(cap) * F.col("source_size")
    while True:  # the rate only grows, and so does the set of capped sources
        above = limit < F.lit(rate) * F.col("weight")
        got = ranked.agg(F.sum(F.when(above, limit).otherwise(0)).alias("fixed"), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("free")).first()
        if not got.free or (nxt := (total - got.fixed) / got.free) <= rate:
            break
        rate = nxt
    return ranked.withColumn("target", F.least(limit.cast("double"), F.lit(rate) * F.col("weight")))


def inverse(share: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """The time by which a share of the schedule's integral is reached."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    whole, done, out = sum(areas), 0.0, F.lit(float(knots[-1][0]))
    pieces = []
    for (t, m), (u, n), area in zip(knots, knots[1:], areas, strict=False):
        need = share * whole - done
        slope = (n - m) / (u - t)
        # m x + slope x^2 / 2 = need, in the form that holds for slope 0 too.
        x = 2 * need / (m + F.sqrt(F.greatest(F.lit(m * m) + 2 * slope * need, F.lit(0.0))))
        pieces.append((share * whole <= done + area, F.lit(t) + F.when(need <= 0, 0.0).otherwise(x)))
        done += area
    for within, x in reversed(pieces):
        out = F.when(within, F.least(x, out) if within is pieces[-1][0] else x).otherwise(out)
    return out


def pieces(rows: DataFrame) -> DataFrame:
    """`rows` (rank, bucket, h, p...) with `piece`: buckets are cut around and within the keys of more than `ROWS` rows."""
    # Keys of more rows than a bucket: at most rows / ROWS of them, few in any one bucket.
    many = rows.groupBy("rank", "bucket", "h").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > ROWS)
    many = stage(many.groupBy("rank", "bucket").agg(F.map_from_entries(F.collect_list(F.struct("h", "rows"))).alias("many")), "keys")
    rows = rows.join(small(many), ["rank", "bucket"], "left")
    own = F.try_element_at("many", F.col("h"))
    return rows.withColumn("piece", F.struct(
        F.coalesce(F.size(F.filter(F.map_keys("many"), lambda k: k < F.col("h"))), F.lit(0)).alias("after"), own.isNotNull().alias("own"),
        F.when(own.isNotNull(), F.floor((F.col("p") / 2.0**64 + 0.5) * F.ceil(own / ROWS))).alias("range"))).drop("many")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS,
        cap: int = CAP, schedules=SCHEDULES) -> DataFrame:
    """Per row of `docs` (its `key`): `size`, `source`, `source_size`, `target`, `taken`, `copies` (first word on the source's line,
    words taken, position), empty if the mix leaves the document out."""
    alike = stage(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
                              F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("h"), F.xxhash64(text).alias("p")).groupBy(
        "key", "source", "size", "h", "p").agg(F.count(F.lit(1)).alias("n")), "sizes")
    sizes = alike.groupBy("source").agg(F.sum("n").alias("rows"), F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = stage(source_targets(sizes, weights, cap).withColumn("buckets", F.ceil(F.col("rows") / ROWS)), "sources")
    few = targets.count() <= 100_000  # a source is under 100 bytes
    known = targets.withColumnRenamed("source", "__source")
    rows = alike.join(F.broadcast(known) if few else known, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    rows = rows.withColumn("bucket", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / 2.0**32 * F.col("buckets")))
    rows = pieces(rows)
    at = ("rank", "bucket", "piece")
    totals = rows.groupBy(*at).agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    before = totals.withColumn("before", F.sum("words").over(Window.partitionBy("rank").orderBy("bucket", "piece")) - F.col("words"))
    inside = Window.partitionBy(*at).orderBy("h", "key", "p", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("within", F.coalesce(F.sum(F.col("size") * F.col("n")).over(inside), F.lit(0))).join(
        before.select(*at, "before"), [*at]).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    placed = placed.withColumn("at", F.col("before") + F.col("within") + F.col("i") * F.col("size"))
    whole = F.round("target").cast("long")
    copies = F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda e: F.struct(
        (F.col("at") + e * F.col("source_size")).alias("start"),
        F.greatest(F.lit(0), F.least(F.col("size"), whole - F.col("at") - e * F.col("source_size"))).alias("words")))
    placed = placed.withColumn("copies", F.filter(copies, lambda c: c["words"] > 0))

    def position(c: Column) -> Column:
        share = c["start"] / F.col("target")
        out = inverse(share, schedules[0])
        for i, s in enumerate(schedules[1:], 1):
            out = F.when(F.col("rank") % len(schedules) == i, inverse(share, s)).otherwise(out)
        return out

    return placed.select(
        F.col("key").alias(key), "p", "size", F.col("source").alias("source"), "source_size", "target",
        F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"]).alias("taken"),
        F.transform("copies", lambda c: F.struct(c["start"].alias("start"), c["words"].alias("words"), position(c).alias("position"))).alias("copies"))


def training_order(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", partitions: int | None = None, **how) -> DataFrame:
    """Every copy that the mix takes, with the columns of `docs`, range-sorted by `position`; the copy that crosses its source's
    target keeps its first `taken_words` words only by that count, the text stays whole. `copy` counts from 0."""
    new = ("copy", "taken_words", "position")
    mixed = stage(mix(docs, key, text, source, **how), "mix")
    copies = stage(mixed.where(F.size("copies") > 0).select(
        F.col(key).alias("__key"), F.col("p").alias("__p"), F.xxhash64(key).alias("__h"), F.col("copies").alias("__copies")), "copies")
    mine = docs.drop(*new).withColumn("__h2", F.xxhash64(key)).withColumn("__p2", F.xxhash64(text))
    same = (F.col("__h2") == F.col("__h")) & (F.col("__p2") == F.col("__p")) & F.col(key).eqNullSafe(F.col("__key"))
    if not mixed.groupBy(key, "p").count().where("count > 1").isEmpty():
        # Rows that share key and text are alike: each is met by the copies of one of them.
        copies = copies.withColumn("__n", F.row_number().over(Window.partitionBy("__h", "__p", "__key").orderBy(F.lit(1))))
        mine = mine.withColumn("__n2", F.row_number().over(Window.partitionBy("__h2", "__p2", key).orderBy(F.lit(1))))
        same = same & (F.col("__n2") == F.col("__n"))
    joined = mine.join(copies, same)
    out = joined.select(*(f"`{c}`" for c in docs.columns if c not in new), F.posexplode("__copies").alias("copy", "__c")).select(
        "*", F.col("__c.words").alias("taken_words"), F.col("__c.position").alias("position")).drop("__c")
    ranged = out.repartitionByRange(partitions, "position") if partitions else out.repartitionByRange("position")
    return ranged.sortWithinPartitions("position", key, "copy")


def op3_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents")).withColumn("position", F.array_min(F.transform("copies", lambda c: c["position"])))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "position").repartitionByRange(
        F.col("position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")


#: The same over DuckDB: capped shares from the sources in the order in which they reach their caps.
OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size,
        md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS sz, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM d GROUP BY source),
w AS (SELECT *, CASE rk % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS wt, sum(sz) OVER () AS total FROM s),
c AS (SELECT *, 3 * sz / wt AS cap, (total - coalesce(sum(3 * sz) OVER o, 0))::DOUBLE / sum(wt) OVER (ORDER BY 3 * sz / wt, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate
    FROM w WINDOW o AS (ORDER BY 3 * sz / wt, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, sz, rk, least((3 * sz)::DOUBLE, (SELECT rate FROM c WHERE rate <= cap ORDER BY cap, rk LIMIT 1) * wt) AS target FROM c),
p AS (SELECT d.doc_id, d.size, t.sz, t.target, d.source, t.rk, CAST(sum(d.size) OVER (PARTITION BY t.rk ORDER BY h, doc_id) - d.size AS BIGINT) AS start_at, CAST(round(t.target) AS BIGINT) AS whole
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, greatest(0, least(size, whole - start_at)) AS a, greatest(0, least(size, whole - start_at - sz)) AS b, greatest(0, least(size, whole - start_at - 2 * sz)) AS c,
    CASE WHEN greatest(0, least(size, whole - start_at)) > 0 THEN start_at / target END AS share FROM p)
SELECT doc_id, size::BIGINT AS size, sz AS source_size, target, (a + b + c)::BIGINT AS taken, source,
    CASE WHEN share IS NULL THEN NULL WHEN share <= 0 THEN 0.0::DOUBLE
        WHEN rk % 3 = 0 THEN least(2 * share / (1.5::DOUBLE + sqrt(greatest(2.25::DOUBLE + -2.0::DOUBLE * share, 0))), 1.0::DOUBLE)
        WHEN rk % 3 = 1 THEN least(2 * share / (1.0::DOUBLE + sqrt(1.0::DOUBLE)), 1.0::DOUBLE)
        WHEN share * 0.875::DOUBLE <= 0.25::DOUBLE THEN 2 * (share * 0.875::DOUBLE) / (0.5::DOUBLE + sqrt(0.25::DOUBLE))
        ELSE least(0.5::DOUBLE + 2 * (share * 0.875::DOUBLE - 0.25::DOUBLE) / (0.5::DOUBLE + sqrt(0.25::DOUBLE + 6.0::DOUBLE * (share * 0.875::DOUBLE - 0.25::DOUBLE))), 1.0::DOUBLE) END AS position
FROM q"""
