"""Quotation linking: from messages that quote each other to reply-ordered conversations without quotes.

`parse` reads the nested quote marks (`>`) at the beginning of lines, in the message's task: lines without a mark are the body,
each other line has its level and the hash of its normalised text (marks off, white space collapsed, case folded). A quoted line
belongs to the latest earlier message of the conversation whose own body has a line of that hash; that as-of join is one
running value over (conversation, hash), fed only with body lines that anyone quotes, so no pairs are made. A message replies to
the earlier message that most of its lines of the lowest linked level come from; ties go to the later one. Threads are found by
pointer jumping over the replies, the rounds written to the shared folder. A conversation is read in the order of (thread, turn):
a reply stands in the thread of what it replies to, after it.

Edge cases: a null text has an empty body; a message that is all quotes has an empty body but stays; a message without a
conversation or turn links to nothing; lines without letters or digits are no evidence; a quote of nothing known links to
nothing; repeated rows of a message stay repeated, all with the same links; an empty table gives an empty result. Other columns
of the input pass through; those with the names of the results are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loadwatch.llm.arrays import chunks, picked, shape, table
from loadwatch.session import stage

MARKS = re.compile(r"(?:[ \t]{0,3}>)+ ?")
#: A line that only introduces a quote ("... wrote:") directly before it goes with the quote.
INTRODUCES = re.compile(r"^(?:On|Am|Le|El)\b.{0,200}:\s*$")
NEW = ("body", "lines", "quoted", "levels")


def normal(line: str) -> str:
    return " ".join(line.casefold().split())


def line_hash(line: str) -> int | None:
    """The hash of a normalised line, if it has a letter or digit."""
    line = normal(line)
    return xxhash.xxh64_intdigest(line.encode(), 42) - (1 << 63) if any(map(str.isalnum, line)) else None


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """The body, and (level, line) of every quoted line."""
    if not text or ">" not in text:
        return text or "", []
    body, quoted = [], []
    for line in text.split("\n"):
        m = MARKS.match(line)
        if m:
            if body and INTRODUCES.match(body[-1]):
                body.pop()
            quoted.append((m[0].count(">"), line[m.end():]))
        else:
            body.append(line)
    return ("\n".join(body).strip("\n"), quoted) if quoted else (text, [])


def parsed(messages: DataFrame, text: str = "text") -> DataFrame:
    """`messages` with `body`, `lines` (hashes of the body), `quoted` (hashes) and `levels` of the quoted lines."""
    kept = [c for c in messages.columns if c not in NEW]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text):
            bodies, lines, quoted, levels = [], [], [], []
            for x in part.column(text).to_pylist():
                body, quotes = parse(x)
                found = [(h, n) for n, q in quotes if (h := line_hash(q)) is not None]
                bodies.append(body)
                lines.append(list(dict.fromkeys(h for x in body.split("\n") if (h := line_hash(x)) is not None)))
                quoted.append([h for h, _ in found])
                levels.append([n for _, n in found])
            yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [
                pa.array(bodies, pa.string()), pa.array(lines, pa.list_(pa.int64())), pa.array(quoted, pa.list_(pa.int64())),
                pa.array(levels, pa.list_(pa.int32()))], [*kept, *NEW])

    return picked(messages, [*kept, text]).mapInArrow(
        run, shape(messages, kept, "body string, lines array<bigint>, quoted array<bigint>, levels array<int>"))


def replies(read: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, turn, parent, level, n_linked) of every message with a linked quote. `read`: staged, since it is read twice."""
    known = read.where(F.col(conv).isNotNull() & F.col(turn).isNotNull()).select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), "lines", "quoted", "levels")
    quotes = stage(known.select("conv", "turn", F.explode(F.arrays_zip("quoted", "levels")).alias("q")).groupBy(
        "conv", "turn", F.col("q.quoted").alias("h"), F.col("q.levels").alias("level")).agg(F.count(F.lit(1)).alias("n")), "quotes")
    own = known.select("conv", "turn", F.explode("lines").alias("h")).join(quotes.select("conv", "h").distinct(), ["conv", "h"], "left_semi")
    events = quotes.select("conv", "h", "turn", "level", "n", F.lit(None).cast(own.schema["turn"].dataType).alias("own")).unionByName(
        own.distinct().select("conv", "h", "turn", F.lit(None).cast("int").alias("level"), F.lit(None).cast("bigint").alias("n"), F.col("turn").alias("own")))
    # Of one turn, quotes come before own lines, so that only earlier messages are seen.
    earlier = Window.partitionBy("conv", "h").orderBy("turn", F.col("own").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    linked = events.withColumn("origin", F.last("own", ignorenulls=True).over(earlier)).where("level IS NOT NULL AND origin IS NOT NULL")
    votes = linked.groupBy("conv", "turn", "level", "origin").agg(F.sum("n").alias("n"))
    best = votes.groupBy("conv", "turn").agg(F.max(F.struct((-F.col("level")).alias("l"), "n", "origin")).alias("b"), F.sum("n").alias("n_linked"))
    return best.select("conv", "turn", F.col("b.origin").alias("parent"), (-F.col("b.l")).alias("level"), "n_linked")


def threads(linked: DataFrame) -> DataFrame:
    """(conv, turn, root, depth): the message at the head of the thread of each linked message."""
    now = stage(linked.select("conv", "turn", F.col("parent").alias("root"), F.lit(1).alias("depth"), F.lit(True).alias("open")), "threads")
    while not now.where("open").isEmpty():
        up = now.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("root").alias("r"), F.col("depth").alias("d"))
        nxt = now.join(up, (F.col("conv") == F.col("c")) & (F.col("root") == F.col("t")), "left").select(
            "conv", "turn", F.coalesce("r", "root").alias("root"), (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth"), F.col("r").isNotNull().alias("open"))
        now = stage(nxt, "threads")
    return now.drop("open")


def conversations(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """`messages` with `body`, `n_quoted`, `max_level`, `n_linked`, `parent_turn`, `thread` and `depth`, in reply order."""
    new = ("n_quoted", "max_level", "n_linked", "parent_turn", "thread", "depth")
    read = stage(parsed(messages.drop(*new), text), "messages")
    linked = stage(replies(read, conv, turn), "replies")
    found = linked.join(threads(linked), ["conv", "turn"]).select(
        F.col("conv").alias("__conv"), F.col("turn").alias("__turn"), "parent", "root", F.col("depth").alias("__depth"), F.col("n_linked").alias("__n"))
    out = read.join(found, (F.col(conv) == F.col("__conv")) & (F.col(turn) == F.col("__turn")), "left")
    kept = [f"`{c}`" for c in messages.columns if c not in (*new, *NEW)]
    out = out.select(*kept, "body", F.size("quoted").cast("long").alias("n_quoted"), F.coalesce(F.array_max("levels"), F.lit(0)).alias("max_level"),
                     F.coalesce("__n", F.lit(0)).cast("long").alias("n_linked"), F.col("parent").alias("parent_turn"),
                     F.coalesce(F.col("root"), F.col(turn)).alias("thread"), F.coalesce("__depth", F.lit(0)).alias("depth"))
    return out.repartitionByRange(conv, "thread", turn).sortWithinPartitions(conv, "thread", turn)


def op10_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(table(spark, sf_dir, "conversations")).select(
        "conv_id", "turn", "role", "thread", "depth", "parent_turn", "n_quoted", "max_level", "n_linked", "body")
