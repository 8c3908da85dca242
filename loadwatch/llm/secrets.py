"""Secrets in texts: fixed patterns, and a battery of randomness tests on other long strings.

Three patterns give the base findings: assignments, access keys, long hex. The battery looks at every other run of 20 or more
characters of base64 or URL alphabets, without the fixed patterns' findings and cut at inner '='; a piece that no alphabet holds, or
that does not pass whole, is cut at its signs (`tested`).It infers the encoding (hex, base32, lower or upper base36, base62, base64).

One null hypothesis is tested, "this is ordinary text", and modelled so: two symbols are equal with probability `SAME` or more, the
character class (upper, lower, digit, other) changes between neighbours with probability `TEXT_CHANGE` or less, and neighbours correlate
in any way or not at all. Three statistics give p-values under it:

* uniformity: the chi-squared statistic of the alphabet's counts, as the equal pairs it is a linear function of: lower normal tail;
* runs: the number of changes of class: upper binomial tail;
* serial correlation: the chance of a lag-1 correlation of the symbols' places in the alphabet that is as near to 0, where it is truly 0
  (for any other the chance is smaller).

Runs and serial correlation depend on each other: they count as twice the smaller one. With uniformity it is combined by Fisher's method.
A string that is not random either (chi-squared above, or serial correlation beyond, what a random string of its encoding gives; together
at `LIKELY`) has the p-value 1, which only raises p-values.

Every string that is tried counts, whole runs and pieces of them, whatever its outcome: the p-values of the whole table go through a
Benjamini-Hochberg step-up in each class of length, with more of the allowance for longer classes (weights that average 1), so that the
expected share of false findings stays below `Q`. The step-up needs only a histogram of log p-values per class, counted with map-side
combining: thresholds are a few numbers, whatever the table's size. Strings of digits alone have nothing to show
(no change of class, more equal pairs than text); UUIDs are hex with a class of their own between the parts, and are identifiers: they are cut
at their dashes, to pieces under 20, and not findings. Letters alone may be.

Edge cases: a null or empty text has no spans; overlapping findings are all kept as spans, and merged when the text is
redacted; repeated rows are scanned each; an empty table gives an empty result. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadwatch.llm.arrays import chunks, picked, shape, table

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
WORDS = re.compile(rb"password|passwd|secret|token|api_?key", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]{12,}")  # runs are maximal, so that a shorter run fails wherever in it a match begins
HEX = re.compile(rb"[0-9a-f]{32,}")
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{20,}")
LEAST = 20
INNER = re.compile(rb"[^=]+=*")
#: What is left of a piece that is cut: the parts that base64 holds, and those that its URL form does; then those without signs.
MIXED, PLAIN = (re.compile(rb"[A-Za-z0-9+/]+"), re.compile(rb"[A-Za-z0-9_-]+")), re.compile(rb"[A-Za-z0-9+]+")
Q, TEXT_CHANGE, LIKELY = 0.01, 0.25, 0.001
#: Chances that two, and that three, symbols of ordinary text are equal: those of English letters (0.066, 0.0054) where every sixth is a capital or a digit.
SAME, THREE_SAME = 0.045, 0.0033
#: Lower ends of the classes of length and their weights in the step-up.
CLASSES, WEIGHTS = (20, 28, 40, 64), (0.6, 0.9, 1.2, 1.3)
BIN = 0.05
# The alphabets of the usual encodings, the narrower before the wider.
ALPHABETS = (("hex", b"0123456789abcdef"), ("HEX", b"0123456789ABCDEF"), ("base32", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
             ("base36", b"0123456789abcdefghijklmnopqrstuvwxyz"), ("BASE36", b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
             ("base62", b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
             ("base64", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
             ("base64url", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"))
PLACES = {name: {c: i for i, c in enumerate(letters)} for name, letters in ALPHABETS}


def base_spans(raw: bytes) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, in bytes."""
    found = [(0, *m.span()) for m in ASSIGN.finditer(raw) if len(m[1]) >= 8] if WORDS.search(raw) else []
    if b"AKIA" in raw:
        found += [(1, *m.span()) for m in ACCESS.finditer(raw)]
    return found + [(2, *m.span()) for m in HEX.finditer(raw)]


def encoding(s: bytes) -> str | None:
    """The smallest alphabet that holds the string."""
    s = s.rstrip(b"=")
    return next((name for name, _ in ALPHABETS if all(c in PLACES[name] for c in s)), None)


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def log_normal_tail(z: float) -> float:
    """Natural logarithm of the upper tail; far out by its asymptote, where the tail itself is no double."""
    return math.log(normal_tail(z)) if z < 30 else -z * z / 2 - math.log(z * math.sqrt(2 * math.pi))


def log_binomial_tail(k: int, n: int, p: float) -> float:
    """log10 of the chance of k or more of n."""
    if k <= 0:
        return 0.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
            for i in range(k, n + 1)]
    top = max(logs)
    return min(0.0, (top + math.log(sum(math.exp(x - top) for x in logs))) / math.log(10))


def character_class(c: int) -> int:
    return 0 if 97 <= c <= 122 else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 3


def battery(s: bytes) -> float:
    """log10 p-value of "ordinary text"; 0 for a string that no alphabet holds or that does not pass as random."""
    if (name := encoding(s)) is None or len(s := s.rstrip(b"=")) < 2:
        return 0.0
    place, size, n = PLACES[name], len(PLACES[name]), len(s)
    x = np.array([place[c] for c in s])
    counts = np.bincount(x, minlength=size)
    chi = float(((counts - n / size) ** 2).sum() * size / n)
    # Wilson and Hilferty: the cube root of chi-squared over its degrees is close to normal.
    free = size - 1
    uniform = normal_tail(((chi / free) ** (1 / 3) - 1 + 2 / (9 * free)) / math.sqrt(2 / (9 * free)))
    a = x - x.mean()
    spread = float((a * a).sum())
    serial = 2 * normal_tail(abs(float((a[1:] * a[:-1]).sum()) / spread) * math.sqrt(n)) if spread > 0 else 0.0
    if min(uniform, serial) * 2 < LIKELY:
        return 0.0
    equal, pairs = (chi + n) * n / size - n, n * (n - 1)
    spare = SAME + 2 * (n - 2) * THREE_SAME - (2 * n - 3) * SAME**2
    even = log_normal_tail((pairs * SAME - equal) / math.sqrt(2 * pairs * spare))
    kinds = [character_class(c) for c in s]
    runs = log_binomial_tail(sum(u != v for u, v in zip(kinds, kinds[1:], strict=False)), n - 1, TEXT_CHANGE) * math.log(10)
    order = min(0.0, math.log(2) + min(runs, math.log(max(1 - serial, 1e-300))))
    both = even + order
    return (both + math.log1p(-both)) / math.log(10)  # Fisher: x (1 - ln x) for a product x of two


def length_class(n: int) -> int:
    return sum(n >= x for x in CLASSES) - 1


def tested(s: bytes, at: int) -> Iterator[tuple[int, int, int, int]]:
    """(class, bin, start, end) of a string at `at` and, unless it passes as random, of its pieces: a secret may stand in a longer run."""
    if len(s) < LEAST:
        return
    logp = battery(s)
    yield length_class(len(s)), int(-logp / BIN), at, at + len(s)
    if logp < 0:
        return
    body = s.rstrip(b"=")
    for cut in MIXED if encoding(s) is None else (PLAIN,):
        for m in cut.finditer(body):
            a, b = m.start(), len(s) if m.end() == len(body) else m.end()  # the padding goes with the last part
            if b - a < len(s):
                yield from tested(s[a:b], at + a)


def candidates(raw: bytes, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(class, bin, start, end) of every string tried, of what is outside the base spans, which come in order of start."""
    out, k, covered = set(), 0, 0
    for m in CANDIDATE.finditer(raw):
        at, rest = max(m.start(), covered), []
        while k < len(base) and base[k][1] < m.end():
            rest.append((at, base[k][1]))
            covered = max(covered, base[k][2])
            at, k = max(at, covered), k + 1
        for first, last in [*rest, (at, m.end())]:
            for p in INNER.finditer(raw[first:max(first, last)]):
                a, b = first + p.start(), first + p.end()
                out.update(tested(raw[a:b] if b == last else raw[a:b].rstrip(b"="), a))
    return sorted(out, key=lambda c: c[2:])


SCANNED = "kinds array<int>, starts array<int>, ends array<int>, c_classes array<int>, c_bins array<int>, c_starts array<int>, c_ends array<int>"
NAMES = [x.split()[0] for x in SCANNED.split(", ")]


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`docs` (or its columns `keep`) with the base spans and the candidates of every whole text, in code points."""
    kept = [c for c in (docs.columns if keep is None else keep) if c not in NAMES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text):
            rows = []
            for x in part.column(text).to_pylist():
                raw = (x or "").encode()
                base = sorted(base_spans(raw), key=lambda s: (s[1], s[0]))
                more = candidates(raw, base)
                if (base or more) and len(raw) != len(x):  # bytes to code points
                    before = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)]).tolist()
                    base = [(k, before[a], before[b]) for k, a, b in base]
                    more = [(c, p, before[a], before[b]) for c, p, a, b in more]
                rows.append([*(list(y) for y in zip(*base)), *([[]] * 3 if not base else []),
                             *(list(y) for y in zip(*more)), *([[]] * 4 if not more else [])])
            cols = [pa.array([r[i] for r in rows], pa.list_(pa.int32())) for i in range(len(NAMES))]
            yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + cols, [*kept, *NAMES])

    return picked(docs, [*kept, text]).mapInArrow(run, shape(docs, kept, SCANNED))


def step_up(scanned: DataFrame, q: float = Q) -> list[int]:
    """Per class of length, the smallest bin whose candidates are findings (step-up on the histogram of all rows)."""
    pairs = scanned.select(F.explode(F.arrays_zip("c_classes", "c_bins")).alias("c"))
    last = int(320 / BIN)
    bins = pairs.groupBy("c.c_classes", F.least("c.c_bins", F.lit(last)).alias("bin")).count().collect()
    out = []
    for k, weight in enumerate(WEIGHTS):
        counts = {r["bin"]: r["count"] for r in bins if r["c_classes"] == k}
        total, above, limit = sum(counts.values()), 0, last + 1
        for b in sorted(counts, reverse=True):
            above += counts[b]
            if 10 ** (-b * BIN) <= q * weight * above / total:  # every p-value in the bin is at most this
                limit = b
        out.append(limit)
    return out


def with_findings(scanned: DataFrame, limits: list[int]) -> DataFrame:
    """`scanned` with `found`, the (start, kind, end) of all spans in order; kinds 0 to 2 as listed, 3 the battery's."""
    limit = F.array(*map(F.lit, limits))
    base = F.zip_with(F.arrays_zip("starts", "kinds"), "ends", lambda a, e: F.struct(
        a["starts"].alias("start"), a["kinds"].alias("kind"), e.alias("end")))
    more = F.transform(F.filter(F.arrays_zip("c_classes", "c_bins", "c_starts", "c_ends"),
                                lambda c: c["c_bins"] >= F.element_at(limit, c["c_classes"] + 1)),
                       lambda c: F.struct(c["c_starts"].alias("start"), F.lit(3).alias("kind"), c["c_ends"].alias("end")))
    return scanned.withColumn("found", F.array_sort(F.concat(base, more)))


def counted(kind: int) -> F.Column:
    """How many base spans are of the kind. A second parameter of the lambda, even one with a default, would be given the place in the array."""
    return F.size(F.filter("kinds", lambda k: k == kind)).cast("long")


def listed(spans: F.Column) -> F.Column:
    names = F.array(*map(F.lit, [*KINDS, "random"]))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """`docs` with every found stretch of the text replaced by `mark`; texts without findings stay as they are."""
    from loadwatch.session import stage
    # Texts are scanned twice, for the thresholds and as they are cleaned, and never stored. The row travels as one value, so that
    # its names meet no others.
    limits = step_up(stage(scan(docs, text, []), "secrets"))
    rows = docs.select(F.struct("*").alias("__row"), F.col(text).alias("__text"))
    found = with_findings(scan(rows, "__text", ["__row", "__text"]), limits)
    # Spans in order of start: the text up to each span that begins after all before it ended, then one mark.
    whole = F.col("__text")
    folded = F.aggregate("found", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.when(s["start"] < acc["at"], acc["out"]).otherwise(
            F.concat(acc["out"], F.substring(whole, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).alias("out")))
    done = F.concat(folded["out"], F.substring(whole, folded["at"] + 1, F.length(whole)))
    cleaned = F.when(F.size("found") > 0, done).otherwise(whole)
    return found.select(F.col("__row").withField(text, cleaned).alias("__row")).select("__row.*")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loadwatch.session import stage
    scanned = stage(scan(table(spark, sf_dir, "documents"), keep=["doc_id"]), "secrets")
    found = with_findings(scanned, step_up(scanned))
    base = F.filter("found", lambda s: s["kind"] < 3)
    return found.select("doc_id", *(counted(i).alias(f"n_{name}") for i, name in enumerate(KINDS)), F.sha2(listed(base), 256).alias("base_sha256"),
                        listed(F.col("found")).alias("spans"))
