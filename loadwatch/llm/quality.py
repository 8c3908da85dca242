"""Host-level quality rules: failures of document rules counted by host, shrunk with an empirical beta prior.

Each document is measured once in its task (`measure`). `host_verdicts` counts failures by host and rule with map-side
combining, fits one beta prior per rule to the hosts' rates by the method of moments, and rejects a host when, for some rule,
the shrunk rate exceeds the limit. `with_verdicts` joins the few host rows back.

Edge cases: a null or empty text has no words and fails the base rule; a null host is a host of its own; repeated rows count
as often as they occur; an empty table gives an empty result. Other columns of the input pass through untouched, and a column
of the input with the name of a measure is replaced by the measure.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadwatch.llm.arrays import Texts, chunks, picked, rolled, same_bytes, shape, small, table, xxh64
from loadwatch.session import stage

WINDOW = 8
#: The rules, on the measures of a document; `base` is the one that rejects a document by itself.
RULES = {
    "base": "n_words < 20 OR 100 * n_repeat_words > 30 * n_words",
    "word_length": "n_words >= 20 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words)",
    "symbols": "10 * n_symbols > n_words",
    "lines": "n_lines > 1 AND 10 * n_dup_lines > 3 * n_lines",
}
#: A host is rejected when its shrunk failure rate for a rule is above this.
HOST_LIMIT = 0.5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _repeated(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices that share key and owner with another one, and their group, both in the order of owner, key and index."""
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    same = (k[1:] == k[:-1]) & (o[1:] == o[:-1])
    part = np.zeros(len(k), bool)
    part[1:] |= same
    part[:-1] |= same
    group = np.cumsum(np.concatenate([[True], ~same])) if len(k) else np.zeros(0, np.int64)
    return order[part], group[part]


def _duplicate_lines(t: Texts, starts, ends, offsets, size) -> np.ndarray:
    """Per text, its lines that hold a word and equal an earlier line of it."""
    a, b, line_at = t.lines()
    first = np.searchsorted(starts, a)
    has = (first < len(starts)) & (np.append(starts, len(t.bytes) + 1)[first] < b)
    a, b = a[has], b[has]
    owner = np.searchsorted(t.bounds, a, "right") - 1
    lines = np.bincount(owner, minlength=len(t))
    at, group = _repeated(xxh64(t.bytes, a, b), owner)
    head = np.concatenate([[True], group[1:] != group[:-1]]) if len(at) else np.zeros(0, bool)
    lead = at[np.flatnonzero(head)][np.cumsum(head) - 1] if len(at) else at
    later = ~head & (b[at] - a[at] == b[lead] - a[lead])
    at, lead = at[later], lead[later]
    same = same_bytes(t.bytes, a[at], a[lead], b[at] - a[at])
    return lines, np.bincount(owner[at[same]], minlength=len(t))


def _repeated_words(t: Texts, starts, ends, offsets) -> np.ndarray:
    """Per text, the words that lie in a window of eight words that the text holds at least twice."""
    n, out = len(starts), np.zeros(len(t), np.int64)
    if n < WINDOW + 1:
        return out
    owner = np.repeat(np.arange(len(t)), np.diff(offsets))
    windows = rolled(xxh64(t.bytes, starts, ends), WINDOW)
    inside = np.flatnonzero(owner[:n - WINDOW + 1] == owner[WINDOW - 1:])
    at, group = _repeated(windows[inside], owner[inside])
    if len(at) == 0:
        return out
    at = inside[at]
    head = np.concatenate([[True], group[1:] != group[:-1]])
    lead = at[np.flatnonzero(head)][np.cumsum(head) - 1]
    same = np.ones(len(at), bool)
    for k in range(WINDOW):
        a, b = at + k, lead + k
        same &= ends[a] - starts[a] == ends[b] - starts[b]
    for k in range(WINDOW):
        on = np.flatnonzero(same & ~head)
        a, b = at[on] + k, lead[on] + k
        same[on] = same_bytes(t.bytes, starts[a], starts[b], ends[a] - starts[a])
    if not same.all():  # windows that only share a hash: told apart by their words
        raw, held = t.bytes.tobytes(), {}
        for i, w in enumerate(at):
            held.setdefault((owner[w], *(raw[starts[w + k]:ends[w + k]] for k in range(WINDOW))), []).append(i)
        at = at[sorted(i for x in held.values() if len(x) > 1 for i in x)]
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + WINDOW, -1)
    covered = np.cumsum(mark[:-1]) > 0
    return np.bincount(owner[covered], minlength=len(t))


def measures(texts: pa.Array) -> dict[str, np.ndarray]:
    t = Texts(texts)
    starts, ends, offsets = t.words()
    size = np.diff(offsets)

    def count(mark: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mark, dtype=np.int64)])
        return total[t.bounds[1:]] - total[t.bounds[:-1]]

    inside = np.zeros(len(t.bytes) + 1, np.int8)
    inside[starts] += 1
    np.add.at(inside, ends, -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
    lines, repeated = _duplicate_lines(t, starts, ends, offsets, size)
    return {"n_words": size, "word_chars": count(inside & ((t.bytes & 0xC0) != 0x80)), "n_symbols": count(SYMBOL[t.bytes]),
            "n_lines": lines, "n_dup_lines": repeated, "n_repeat_words": _repeated_words(t, starts, ends, offsets)}


def measure(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`docs` (or its columns `keep`) with the measures of every whole text."""
    kept = [c for c in (docs.columns if keep is None else keep) if c not in MEASURES]
    taken = [*kept, text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text):
            found = measures(part.column(text))
            yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [pa.array(found[m], pa.int64()) for m in MEASURES],
                                             [*kept, *MEASURES])

    return picked(docs, taken).mapInArrow(run, shape(docs, kept, ", ".join(f"{m} bigint" for m in MEASURES)))


def host_verdicts(measured: DataFrame, host: Column, rules: dict[str, str] = RULES, limit: float = HOST_LIMIT) -> DataFrame:
    """Per host: documents, failures, the shrunk rate of each rule and whether the host passes."""
    marks = [F.sum(F.expr(f"CASE WHEN {rule} THEN 1 ELSE 0 END")).alias(f"{name}_failed") for name, rule in rules.items()]
    hosts = measured.groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("host_docs"), *marks)
    rate = {n: F.col(f"{n}_failed") / F.col("host_docs") for n in rules}
    # One row over all hosts: mean and variance of each rule's rates, and the sampling variance to take off.
    moments = hosts.agg(*(x for n in rules for x in (
        F.avg(rate[n]).alias(f"{n}_mean"), F.var_pop(rate[n]).alias(f"{n}_var"),
        F.avg(rate[n] * (1 - rate[n]) / F.col("host_docs")).alias(f"{n}_noise")))).first()
    out, fine = hosts, F.lit(True)
    for n in rules:
        mean, var, noise = (moments[f"{n}_{x}"] for x in ("mean", "var", "noise"))
        mean = 0.0 if mean is None else min(max(mean, 1e-6), 1 - 1e-6)
        between = max((var or 0.0) - (noise or 0.0), 1e-9)
        weight = min(max(mean * (1 - mean) / between - 1, 1.0), 1e6)  # the prior counts as so many documents
        out = out.withColumn(f"{n}_rate", (F.col(f"{n}_failed") + mean * weight) / (F.col("host_docs") + weight))
        fine = fine & (F.col(f"{n}_rate") <= limit)
    return out.withColumn("host_ok", fine)


def with_verdicts(measured: DataFrame, host: str = "source", rules: dict[str, str] = RULES, limit: float = HOST_LIMIT,
                  verdicts: DataFrame | None = None) -> DataFrame:
    """`measured` with `base_failed` and `kept`; hosts meet their documents by an equality that also holds for null. The
    verdicts are those of `measured` itself, or given; few hosts are sent to every task, so that no text is shuffled."""
    verdicts = host_verdicts(measured, F.col(host), rules, limit) if verdicts is None else verdicts
    verdicts = small(stage(verdicts.select(F.col("host").alias("__host"), F.col("host_ok").alias("__ok")), "hosts"))
    failed = F.expr(rules["base"])
    joined = measured.join(verdicts, F.col(host).eqNullSafe(F.col("__host")), "left")
    return (joined.withColumn("base_failed", failed).withColumn("kept", ~failed & F.coalesce(F.col("__ok"), F.lit(True)))
            .drop("__host", "__ok"))


def kept_documents(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows of `docs` that pass. Texts are measured twice, once for the hosts and once as they are filtered, and never stored."""
    measured = stage(measure(docs, text, [host]), "quality")
    again = measure(docs.select(F.struct("*").alias("__row"), F.col(host).alias("__source"), F.col(text).alias("__text")), "__text", ["__row", "__source"])
    return with_verdicts(again, "__source", verdicts=host_verdicts(measured, F.col(host))).where("kept").select("__row.*")


def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    measured = stage(measure(docs, keep=["doc_id", "source"]), "quality")
    return with_verdicts(measured).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                          "base_failed", "kept", "source")


#: The same over DuckDB.
OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT doc_id, i, w[i:i + 7] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
twice AS (SELECT doc_id, g FROM win GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM win JOIN twice USING (doc_id, g)) GROUP BY 1),
m AS (SELECT d.doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
    FROM d LEFT JOIN rep USING (doc_id)),
f AS (SELECT source, x.r AS rule, count(*) AS n, count(*) FILTER (WHERE x.b) AS k FROM (SELECT source, unnest([
        {'r': 'base', 'b': n_words < 20 OR 100 * n_repeat_words > 30 * n_words}, {'r': 'word_length', 'b': n_words >= 20 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words)},
        {'r': 'symbols', 'b': 10 * n_symbols > n_words}, {'r': 'lines', 'b': n_lines > 1 AND 10 * n_dup_lines > 3 * n_lines}]) AS x FROM m) GROUP BY ALL),
prior AS (SELECT rule, least(greatest(avg(k / n), 1e-6), 1 - 1e-6) AS mean, greatest(var_pop(k / n) - avg((k / n) * (1 - k / n) / n), 1e-9) AS between_hosts FROM f GROUP BY rule),
ok AS (SELECT source, bool_and((k + mean * s) / (n + s) <= 0.5) AS host_ok
    FROM (SELECT f.*, mean, least(greatest(mean * (1 - mean) / between_hosts - 1, 1), 1e6) AS s FROM f JOIN prior USING (rule)) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND host_ok AS kept, m.source FROM m JOIN ok ON m.source IS NOT DISTINCT FROM ok.source"""
