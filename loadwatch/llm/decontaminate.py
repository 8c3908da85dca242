"""Benchmark decontamination with DataFrame operations only: a broadcast hash set of test n-grams, scanned token windows.

The windows of all benchmark items (ten consecutive words, or the whole of a shorter item) are distinct rows: size, hash, words, and
the digest of the set of items that have them. Documents are split into words and generate one row per window within one
code-generated stage: a window is hashed, looked up and, on a hit, compared word by word. Only hits leave the stage: what is shuffled is
the position, size and item set of hits. The items themselves join last, once per document and set, so that a window of a third of
the benchmark's items is never sent to the tasks with its items.

The windows are broadcast while, measured, they are `BROADCAST` rows and `BROADCAST_BYTES` at most. Beyond that, the tasks get a table
of `FILTER_BITS` bits (16 MB, whatever the benchmark) with the bit of every window's hash set; a document's windows whose bit is
set, some hundredths of them, are shuffled with their own words, at most ten, and compared there. A window may be in a
third of the documents: its rows are dealt to `SALTS` keys.

Edge cases: null and empty texts have no words and no hits; an item without words has no window; rows that share id and text have
the same result each; rows that share an id but not the text are told apart by a hash of the text; null ids are kept; an empty
benchmark leaves every document clean. Other columns, whatever their names, pass through `decontaminate` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadwatch.llm.arrays import small, table
from loadwatch.session import stage

LENGTH = 10
#: Distinct benchmark windows, and bytes of their words, up to which the set is sent to every task.
BROADCAST, BROADCAST_BYTES = 500_000, 64 << 20
#: Beyond that: log2 of the bits of the table of hashes, in rows of 64 words; keys that a window's hits are dealt to.
FILTER_BITS, SALTS = 27, 16
#: What is not part of a word (ASCII but letters and digits), after lower-casing A-Z.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text; null has none."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, GAP), "")


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Distinct windows: `__size`, `__hash`, `__window`, the items that have them (`__items`, sorted) and that set's digest (`__set`)."""
    tokens = benchmark.select(F.col(item).cast("string").alias("__item"), words(F.col(text)).alias("__words")).where(F.size("__words") > 0)
    at = tokens.withColumn("__size", F.least(F.size("__words"), F.lit(length))).withColumn(
        "__at", F.explode(F.expr("sequence(1, size(__words) - __size + 1)")))
    return (at.select("__item", "__size", F.expr("slice(__words, __at, __size)").alias("__window"))
            .groupBy("__size", "__window").agg(F.array_sort(F.collect_set("__item")).alias("__items"))
            .withColumn("__hash", F.xxhash64("__window")).withColumn("__set", F.unhex(F.sha2(F.to_json("__items"), 256))))


def filter_table(windows: DataFrame) -> DataFrame:
    """The bits of the windows' hashes: `__row` (from 0, at most 2^(`FILTER_BITS` - 12)) and `__bits`, 64 numbers of 64 bits."""
    slot = F.expr(f"__hash & {(1 << FILTER_BITS) - 1}L")
    lanes = windows.select(F.shiftright(slot, 12).alias("__row"), F.expr("CAST(shiftright(__hash, 6) & 63L AS INT)").alias("__lane"),
                           F.expr("shiftleft(1L, CAST(__hash & 63L AS INT))").alias("__bit")).groupBy("__row", "__lane").agg(F.bit_or("__bit").alias("__bit"))
    found = F.map_from_entries(F.collect_list(F.struct("__lane", "__bit")))  # at most 64
    return lanes.groupBy("__row").agg(found.alias("__found")).select(
        "__row", F.expr("transform(sequence(0, 63), i -> coalesce(__found[i], 0L))").alias("__bits"))


def spots(docs: DataFrame, windows: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per occurrence of a window in a document: `__id`, `__print` (hash of the text), `__pos` (from 0), `__size`, `__set`.
    `windows` is read more than once."""
    known = windows.select("__size", "__hash", "__window", "__set")
    per_size = windows.groupBy("__size").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.array_join("__window", " "))).alias("bytes"))
    sizes = per_size.collect()  # at most `length` rows
    few = sum(r["n"] for r in sizes) <= BROADCAST and sum(r["bytes"] for r in sizes) <= BROADCAST_BYTES
    shorter = sorted(r["__size"] for r in sizes if r["__size"] < length)
    tokens = docs.select(F.col(key).alias("__id"), F.xxhash64(text).alias("__print"), words(F.col(text)).alias("__words"))
    at = tokens.select("__id", "__print", "__words", F.posexplode("__words").alias("__pos", "__first"))
    if shorter:
        at = at.withColumn("__n", F.explode(F.array(*map(F.lit, [*shorter, length]))))
    else:
        at = at.withColumn("__n", F.lit(length))
    own = "slice(__words, __pos + 1, __n)"
    scanned = at.where("__pos + __n <= size(__words)").withColumn("__h", F.expr(f"xxhash64({own})"))
    same = (F.col("__h") == F.col("__hash")) & (F.col("__n") == F.col("__size"))
    if few:
        met = scanned.join(F.broadcast(known), same & (F.expr(own) == F.col("__window")))
    else:
        row, bit = F.expr(f"shiftright(__h & {(1 << FILTER_BITS) - 1}L, 12)"), "shiftright(__bits[CAST(shiftright(__h, 6) & 63L AS INT)], CAST(__h & 63L AS INT)) & 1L"
        likely = scanned.join(F.broadcast(filter_table(windows)), row == F.col("__row")).where(f"({bit}) = 1L").select(
            "__id", "__print", "__pos", "__n", "__h", F.expr(own).alias("__own"), F.pmod(F.xxhash64("__id", "__print", "__pos"), F.lit(SALTS)).alias("__salt"))
        dealt = known.withColumn("__key", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        met = likely.join(dealt.hint("merge"), same & (F.col("__salt") == F.col("__key")) & (F.col("__own") == F.col("__window")))
    return met.select("__id", "__print", "__pos", "__size", "__set")


def hits(docs: DataFrame, windows: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, items: bool = True) -> DataFrame:
    """One row per document with a hit: `__id`, `__print`, `__spans` (first word and words, in order) and, if asked for, `__found`
    (its items, sorted)."""
    held = stage(windows, "windows")
    per = spots(docs, held, key, text, length).groupBy("__id", "__print").agg(
        F.sort_array(F.collect_set(F.struct("__pos", "__size"))).alias("__spans"), F.collect_set("__set").alias("__sets"))
    if not items:
        return per.drop("__sets")
    per = stage(per, "hits")
    lists = held.groupBy("__set").agg(F.any_value("__items").alias("__items"))
    named = per.select(F.col("__id").alias("__i"), F.col("__print").alias("__p"), F.explode("__sets").alias("__set")).join(lists, "__set").groupBy(
        "__i", "__p").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("__items")))).alias("__found"))
    return per.join(named, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__print") == F.col("__p"))).select("__id", "__print", "__spans", "__found")


#: Words covered by sorted spans: each adds what lies beyond the end reached so far.
COVERED = """aggregate(__spans, named_struct('n', 0L, 'end', 0), (a, s) -> named_struct(
    'n', a.n + greatest(0, s.__pos + s.__size - greatest(a.end, s.__pos)),
    'end', greatest(a.end, s.__pos + s.__size)), a -> a.n)"""


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Per row of `docs`: `key`, `n_words`, `n_hit`, `n_items`, `items_sha256`, `contaminated`."""
    found = hits(docs, benchmark_windows(benchmark, text=text, length=length), key, text, length)
    rows = docs.select(F.col(key), F.xxhash64(text).alias("__p"), F.size(words(F.col(text))).cast("long").alias("n_words"))
    joined = rows.join(found, F.col(key).eqNullSafe(F.col("__id")) & (F.col("__p") == F.col("__print")), "left")
    return joined.select(
        key, "n_words", F.coalesce(F.expr(COVERED), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size(F.col("__found")), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("__found", ","), F.lit("")), 256).alias("items_sha256")).select(
        "*", (F.col("n_hit") > 0).alias("contaminated")).withColumn("n_items", F.greatest("n_items", F.lit(0)).cast("long"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH,
                  remove: str = "documents") -> DataFrame:
    """`docs` without contaminated documents (`remove="documents"`), or with every hit word, and what follows it up to the
    next word, taken out of the text (`remove="spans"`)."""
    found = hits(docs, benchmark_windows(benchmark, text=text, length=length), key, text, length, items=False)
    found = small(stage(found.select("__id", "__print", *(["__spans"] if remove == "spans" else [])), "hits"))
    on = F.col(key).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__print"))
    if remove == "documents":
        return docs.join(found, on, "left_anti")
    joined = docs.join(found, on, "left")
    # Pieces: what precedes the first word, then each word with what follows it.
    pieces = r"regexp_extract_all(__text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*', 0)"
    lead = r"regexp_extract(__text, '^[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*', 0)"
    left = f"filter({pieces}, (p, i) -> NOT exists(__spans, s -> i >= s.__pos AND i < s.__pos + s.__size))"
    cleaned = joined.withColumn("__text", F.col(text)).withColumn(
        text, F.when(F.col("__spans").isNull(), F.col(text)).otherwise(F.expr(f"concat({lead}, array_join({left}, ''))")))
    return cleaned.select(docs.columns)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The same over DuckDB: windows as lists, hits as positions.
OP7_SQL = r"""
WITH w AS (SELECT item_id::VARCHAR AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM benchmark),
windows AS (SELECT DISTINCT item, least(len(words), 10) AS k, words[i:i + least(len(words), 10) - 1] AS win
    FROM (SELECT item, words, unnest(range(1, greatest(len(words) - 10, 0) + 2)) AS i FROM w WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT k FROM windows),
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents),
spots AS (SELECT r, k, i, words[i:i + k - 1] AS win FROM (
    SELECT r, k, words, unnest(range(1, greatest(len(words) - k + 1, 0) + 1)) AS i FROM d, sizes)),
found AS (SELECT s.r, s.k, s.i, w.item FROM spots s JOIN windows w ON s.k = w.k AND s.win = w.win),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM found) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)"""
