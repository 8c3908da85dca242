"""SimHash near-duplicates: exact comparison of fingerprints by tiles, in numpy, and their connected components.

Fingerprints are counted per text in its task. Distinct fingerprints are dealt to tiles by the population counts of their two
halves. Fingerprints that differ in at most `radius` bits have counts that differ by at most `radius` in sum, so only such
pairs of tiles are compared; a tile of more than `TILE` fingerprints is cut into blocks by hash, and blocks are compared pair by
pair. Within a pair of blocks, the counts of quarters cut it into smaller tiles by the same rule, and what is left is compared
whole, by exclusive-or and bit counts. A pair of blocks gives a spanning forest of its links, never all links, so a group of
near copies costs no more rows than it has members. Forests are joined by repeated hooking to the smallest neighbour and
shortening, each round written to the shared folder.

A fingerprint is 64 bits for each seed. Exact copies share a fingerprint and are one node: the fingerprint itself if it has 64 bits,
else its 64-bit hash. The work of the comparison grows with the square of the distinct fingerprints, times the small share of tiles
that lie within the radius; that is the method's price for being exact.

`keep_first` goes by the Jaccard similarity of sets of five-word shingles. Its nodes are distinct sets; links within `SIMILAR` of 256
bits, between sets whose sizes allow the similarity, only say which texts may be similar. The sets of each component of such links then
meet in one task (those of a large one block by block), where all pairs that share one of their rarest shingles are counted out
(`alike`); only pairs that reach `JACCARD` are links. Pairs of one component of links are not counted again.

Edge cases: a null or empty text has fingerprint zero and is linked like any other; repeated rows stay repeated, with the same
component; a null id never is the smallest unless all ids of the component are null; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadwatch.llm.arrays import Texts, chunks, picked, shape, small, spaced, table, xxh64
from loadwatch.model import small_frame
from loadwatch.session import stage

WORDS, RADIUS, SEEDS = 3, 3, (42,)
#: Near-duplicates by similarity: words of a shingle, seeds, and differing bits of candidates. At a Jaccard similarity of 0.8 the
#: expected difference is 39 bits of 256, and 48 at most (sets of four and five), with a deviation of 6.
SIMILAR_WORDS, SIMILAR_SEEDS, SIMILAR = 5, (42, 43, 44, 45), 80
#: The similarity of near-duplicates, as a fraction.
JACCARD = (4, 5)
#: Shingles of the sets that are compared in one task, about, in each of two blocks.
SETS = 2_000_000
#: Within this radius, the counts of quarters are worth cutting blocks by.
FINE = 8
#: Fingerprints of a block. Every block meets those that are near, so that what is shuffled falls with the size of a block; a wide
#: radius makes all blocks near, and takes larger ones.
TILE, WIDE_TILE = 16384, 65536
#: Rows of the plan of pairs up to which it is sent to every task.
PLANNED = 200_000
LOW = np.uint64(0xFFFFFFFF)


def shingled(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A buffer of words, the starts and ends of all shingles in it, and their number in each text."""
    t = Texts(texts, lower=True)
    starts, ends, offsets = t.words()
    size = np.diff(offsets)
    n = np.where(size > 0, np.maximum(size - words + 1, 1), 0)
    data, starts, ends = spaced(t.bytes, starts, ends)
    first = np.repeat(offsets[:-1] - np.cumsum(n) + n, n) + np.arange(n.sum())
    last = first + np.repeat(np.minimum(size, words), n) - 1
    return data, starts[first], ends[last], n


def majorities(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The majority of each bit over each text's n hashes."""
    out, some = np.zeros(len(n), np.uint64), np.flatnonzero(n)
    n = n[some]
    begin = np.concatenate([[0], np.cumsum(n)])
    for a in range(0, len(some), 512):
        b = min(a + 512, len(some))
        bits = np.unpackbits(h[begin[a]:begin[b]].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, begin[a:b] - begin[a], axis=0, dtype=np.int32)
        major = (2 * ones > n[a:b, None]).astype(np.uint8)
        out[some[a:b]] = np.packbits(major, axis=1, bitorder="little").view("<u8").reshape(-1)
    return out


def fingerprints(texts: pa.Array, words: int = WORDS, seeds: tuple[int, ...] = SEEDS) -> np.ndarray:
    """A row of 64 bits per seed for each text: the majority of each bit over the hashes of all its shingles."""
    data, starts, ends, n = shingled(texts, words)
    return np.stack([majorities(xxh64(data, starts, ends, seed), n) for seed in seeds], axis=1)


def shingle_sets(texts: pa.Array, words: int = SIMILAR_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct shingles: hashes that ascend within a text, number, hash of the whole set; and where they stand in a buffer."""
    data, starts, ends, n = shingled(texts, words)
    h, owner = xxh64(data, starts, ends, SIMILAR_SEEDS[0]), np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, order, n = h[fresh], order[fresh], np.bincount(owner[fresh], minlength=len(n))
    at = 8 * np.concatenate([[0], np.cumsum(n)])
    return h, n, xxh64(h.astype("<u8").view(np.uint8), at[:-1], at[1:]), data, starts[order], ends[order]


def with_fingerprint(docs: DataFrame, text: str = "text", keep: list[str] | None = None, words: int = WORDS,
                     seeds: tuple[int, ...] = SEEDS) -> DataFrame:
    """`docs` (or its columns `keep`) with `fp`, its node, and with several seeds also `fp0`, `fp1` and so on: signed numbers."""
    names = ["fp", *(f"fp{k}" for k in range(len(seeds)) if len(seeds) > 1)]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text):
            found = fingerprints(part.column(text), words, seeds)
            node = found[:, 0]
            if len(seeds) > 1:
                at = np.arange(0, 8 * found.size + 1, 8 * len(seeds))
                node = xxh64(np.ascontiguousarray(found).view(np.uint8).reshape(-1), at[:-1], at[1:])
            columns = [node, *(found[:, k] for k in range(len(seeds)) if len(seeds) > 1)]
            yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [pa.array(x.view(np.int64)) for x in map(np.ascontiguousarray, columns)],
                                             [*kept, *names])

    return picked(docs, [*kept, text]).mapInArrow(run, shape(docs, kept, ", ".join(f"{c} bigint" for c in names)))


def with_similar(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` of `docs` with `fp`, the hash of the text's set of shingles, its fingerprint `fp0` to `fp3`, and the set's size `n`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text):
            h, n, node, data, starts, ends = shingle_sets(part.column(text))
            bits = [majorities(h if k == 0 else xxh64(data, starts, ends, seed), n) for k, seed in enumerate(SIMILAR_SEEDS)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(x.view(np.int64)) for x in (node, *bits)), pa.array(n)],
                                             [*keep, "fp", "fp0", "fp1", "fp2", "fp3", "n"])

    return picked(docs, [*keep, text]).mapInArrow(run, shape(docs, keep, "fp bigint, fp0 bigint, fp1 bigint, fp2 bigint, fp3 bigint, n bigint"))


def with_set(docs: DataFrame, text: str = "text") -> DataFrame:
    """(fp, hashes) of every text: the hash of its set of shingles, and the set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text):
            h, n, node, *_ = shingle_sets(part.column(text))
            at, raw = 8 * np.concatenate([[0], np.cumsum(n)]), h.astype("<u8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array([raw[a:b] for a, b in zip(at, at[1:], strict=False)], pa.binary())],
                                             ["fp", "hashes"])

    return picked(docs, [text]).mapInArrow(run, "fp bigint, hashes binary")


def alike(sets: list[np.ndarray]) -> np.ndarray:
    """For each of distinct sets the first of its component, where sets of a similarity of `JACCARD` or more are linked: exact.

    Two such sets share one of their `size - ceil(similarity * size) + 1` rarest hashes, in any one order of all hashes."""
    over, under = JACCARD
    size = np.array([len(x) for x in sets], np.int64)
    root, at = np.arange(len(sets)), np.concatenate([[0], np.cumsum(size)])
    if at[-1] == 0:
        return root
    _, token, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(df), np.int64)
    rank[np.argsort(df, kind="stable")] = np.arange(len(df))
    owner = np.repeat(np.arange(len(sets)), size)
    token = token[np.lexsort((rank[token], owner))]
    few = (np.arange(len(token)) - at[owner] < (size + (-over * size) // under + 1)[owner]) & (df[token] > 1)
    members, names = owner[few], token[few]
    order = np.argsort(names, kind="stable")
    members, names = members[order], names[order]
    mark, done, changed = np.zeros(len(df), bool), 0, True
    for d in range(len(sets)):
        if changed and (d == 0 or done > len(members)):  # lists whose sets are all in one component have no more to say
            begin = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else np.zeros(0, np.int64)
            if len(begin):
                of = root[members]
                mixed = np.repeat(np.minimum.reduceat(of, begin) != np.maximum.reduceat(of, begin), np.diff(np.append(begin, len(names))))
                members, names = members[mixed], names[mixed]
            done, changed = 0, False
        mine = token[at[d]:at[d + 1]]
        asked = mine[:size[d] + (-over * size[d]) // under + 1]
        first, last = np.searchsorted(names, asked), np.searchsorted(names, asked, "right")
        lists = [members[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True) if b > a + 1]
        if not lists:
            continue
        found = np.concatenate(lists)
        done += len(found)
        found = np.unique(found[root[found] != root[d]])
        found = found[(found > d) & (under * np.minimum(size[found], size[d]) >= over * np.maximum(size[found], size[d]))]
        if len(found) == 0:
            continue
        mark[mine] = True
        begin = np.concatenate([[0], np.cumsum(size[found])])
        place = np.repeat(at[found] - begin[:-1], size[found]) + np.arange(begin[-1])
        both = np.add.reduceat(mark[token[place]], begin[:-1], dtype=np.int64)
        mark[mine] = False
        hit = found[under * both >= over * (size[found] + size[d] - both)]
        if len(hit):
            joined = np.unique(np.append(root[hit], root[d]))
            root[np.isin(root, joined)] = joined[0]
            changed = True
    return root


def verified(docs: DataFrame, groups: DataFrame, nodes: DataFrame, text: str = "text", size: int = SETS) -> DataFrame:
    """Links (a, b) of spanning forests over all pairs of nodes of one group (`groups`: node, root) whose sets, of the texts of `docs`,
    are similar. Small groups are dealt to tasks by hash; a group of more than `size` shingles is cut into blocks, which meet by pairs."""
    weighed = groups.join(nodes.select(F.col("fp").alias("node"), "n"), "node")
    weights = stage(weighed.groupBy("root").agg(F.sum("n").alias("weight")), "groups")
    bins = math.ceil((weights.agg(F.sum("weight")).first()[0] or 0) / size) or 1
    cut = weights.select("root", F.ceil(F.col("weight") / size).cast("int").alias("cuts"))
    large = cut.where("cuts > 1")
    placed = groups.join(small(large), "root", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    placed = placed.select(F.col("node").alias("fp"), "cuts", F.when(F.col("cuts") > 1, F.col("root")).alias("own"),
                           F.when(F.col("cuts") == 1, F.pmod(F.xxhash64("root"), F.lit(bins))).alias("bin"),
                           F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int").alias("block"))
    placed = stage(placed, "groups")
    held = with_set(docs, text).join(small(placed), "fp").dropDuplicates(["fp"])
    met = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    met = met.select("fp", "hashes", "own", "bin", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def compare(rows: pa.Table) -> pa.Table:
        node = rows.column("fp").to_numpy()
        root = alike([np.frombuffer(x.as_buffer(), "<u8") for x in rows.column("hashes")])
        on = np.flatnonzero(root != np.arange(len(node)))
        return pa.table({"a": node[root[on]], "b": node[on]})

    return met.groupBy("own", "bin", "i", "j").applyInArrow(compare, "a bigint, b bigint")


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each of n nodes' components, given links between nodes."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        nxt = root.copy()
        np.minimum.at(nxt, root[a], low)
        np.minimum.at(nxt, root[b], low)
        while not np.array_equal(nxt, nxt[nxt]):
            nxt = nxt[nxt]
        if np.array_equal(nxt, root):
            return root
        root = nxt


def quarters(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit counts of the lowest quarters of the two halves."""
    return (np.bitwise_count(x & np.uint64(0xFFFF)).astype(np.int64), np.bitwise_count((x >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.int64))


def tiles_of(x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of fingerprints by tile, the begins of the tiles and their bit counts by quarter (of the first 64 bits)."""
    if radius > FINE:  # so wide a radius reaches nearly every tile: one is as good
        return np.arange(len(x)), np.array([0, len(x)]), np.zeros((1, 4), np.int64)
    first = x[:, 0]
    c, d = quarters(first)
    order = np.argsort(c * 32 + d, kind="stable")
    key = (c * 32 + d)[order]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    halves = np.stack([c, np.bitwise_count(first & LOW) - c, d, np.bitwise_count(first >> np.uint64(32)) - d], axis=1).astype(np.int64)
    return order, np.append(begin, len(x)), halves[order[begin]]


def close(left: list[np.ndarray], right: list[np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with at most `radius` differing bits; the first three words of 64 bits are compared for all, others for what is left."""
    bits = np.bitwise_count(left[0][:, None] ^ right[0][None, :])
    for x, y in zip(left[1:3], right[1:3], strict=True):
        bits += np.bitwise_count(x[:, None] ^ y[None, :])
    r, c = np.nonzero(bits <= radius)
    if len(left) > 3 and len(r):
        total = bits[r, c].astype(np.int64)
        for x, y in zip(left[3:], right[3:], strict=True):
            total += np.bitwise_count(x[r] ^ y[c])
        r, c = r[total <= radius], c[total <= radius]
    return r, c


def links(x: np.ndarray, y: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with at most `radius` differing bits, skipping tiles whose quarters' counts differ by more in sum.

    Pairs of a dense strip are thinned to a spanning forest, which holds the same components."""
    out_a, out_b, shift = [], [], 0 if same else len(x)
    if len(x) == 0 or len(y) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order_x, at_x, count_x = tiles_of(x, radius)
    order_y, at_y, count_y = (order_x, at_x, count_x) if same else tiles_of(y, radius)
    sorted_x = [np.ascontiguousarray(x[order_x, k]) for k in range(x.shape[1])]
    sorted_y = sorted_x if same else [np.ascontiguousarray(y[order_y, k]) for k in range(y.shape[1])]
    for i in range(len(count_x)):
        near = np.flatnonzero(np.abs(count_y - count_x[i]).sum(axis=1) <= radius)
        if same:
            near = near[near >= i]
        if len(near) == 0:
            continue
        cols = np.concatenate([np.arange(at_y[j], at_y[j + 1]) for j in near])
        right = [w[cols] for w in sorted_y]
        rows = max(1, (1 << 18) // len(cols))
        for a in range(int(at_x[i]), int(at_x[i + 1]), rows):
            r, c = close([w[a:min(a + rows, int(at_x[i + 1]))] for w in sorted_x], right, radius)
            p, q = order_x[a + r], order_y[cols[c]]
            if same:
                on = p < q if len(count_x) == 1 else p != q
                p, q = p[on], q[on]
            if len(p) > rows + len(cols):
                nodes, inv = np.unique(np.concatenate([p, q + shift]), return_inverse=True)
                root = nodes[roots(inv[:len(p)], inv[len(p):], len(nodes))]
                out_a.append(root[nodes != root])
                out_b.append(nodes[nodes != root])
            elif len(p):
                out_a.append(p)
                out_b.append(q + shift)
    if not out_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_a), np.concatenate(out_b)


def forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links, as places in `left` then `right`, of a spanning forest over two blocks (or within one, `right` None)."""
    n = len(left) + (0 if right is None else len(right))
    a, b = links(left, left if right is None else right, radius, right is None)
    root = roots(a, b, n)
    on = np.flatnonzero(root != np.arange(n))
    return root[on], on


def near(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE, size: str | None = None) -> DataFrame:
    """Links (a, b) of spanning forests over all pairs of distinct nodes `fp` within `radius` bits of `fp`, or of `fp0`, `fp1`...

    With a column `size`, pairs of sizes whose ratio rules out a similarity of `JACCARD` need not meet."""
    words = [c for c in distinct.columns if c not in ("fp", size)] or ["fp"]
    grain = 1 if radius <= FINE else radius  # tiles that are narrower than a wide radius would all be neighbours
    lows = F.floor(F.bit_count(F.col(words[0]).bitwiseAND(F.lit(0xFFFFFFFF))) / grain).cast("int")
    highs = F.floor(F.bit_count(F.shiftrightunsigned(words[0], 32)) / grain).cast("int")
    if size:  # tiles by size, a little wider than the ratio, so that only neighbours can be similar
        lows, highs = F.floor(F.log(F.greatest(F.col(size), F.lit(1))) / math.log(1.001 * JACCARD[1] / JACCARD[0])).cast("int"), F.lit(0)
    # At most 33 * 33 rows: the sizes of the tiles, in a table of known size.
    sizes = distinct.groupBy(lows.alias("p"), highs.alias("q")).count()
    blocks = {(r.p, r.q): math.ceil(r["count"] / tile) for r in sizes.collect()}
    least = lambda i: max(0, (abs(i) - 1) * grain + 1)  # noqa: E731  by how much counts of tiles i apart differ at least
    steps = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if (i, j) != (0, 0) and least(i) + least(j) <= radius]
    steps = [(-1, 0), (1, 0)] if size else steps
    # For every tile, the pairs of blocks in which a fingerprint of its block k takes part.
    spark = distinct.sparkSession
    rows = []
    for (p, q), n in blocks.items():
        for k in range(n):
            rows += [(p, q, k, (p, q, min(k, m)), (p, q, max(k, m))) for m in range(n)]
            for i, j in steps:
                other = (p + i, q + j)
                for m in range(blocks.get(other, 0)):
                    a, b = sorted([(p, q, k), (*other, m)])
                    rows.append((p, q, k, a, b))
    if not rows:
        return spark.createDataFrame([], "a bigint, b bigint")
    name = lambda x: "_".join(map(str, x))
    plan = small_frame(spark, [(p, q, k, f"{name(a)}-{name(b)}", (p, q, k) == b and a != b) for p, q, k, a, b in rows],
                       "p int, q int, k int, pair string, right boolean")
    n_of = small_frame(spark, [(p, q, n) for (p, q), n in blocks.items()], "p int, q int, n int")
    if len(rows) <= PLANNED:
        plan, n_of = F.broadcast(plan), F.broadcast(n_of)
    columns = list(dict.fromkeys(["fp", *words]))
    placed = (distinct.select(*columns, lows.alias("p"), highs.alias("q")).join(n_of, ["p", "q"])
              .withColumn("k", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")).join(plan, ["p", "q", "k"]).select("pair", "right", *columns))

    def compare(key: tuple, pair: pa.Table) -> pa.Table:
        first, second = key[0].as_py().split("-")
        node, right = pair.column("fp").to_numpy(), pair.column("right").to_numpy()
        order = np.lexsort((node, right))
        bits = np.stack([pair.column(c).to_numpy().view(np.uint64)[order] for c in words], axis=1)
        n = int((~right).sum())
        a, b = forest(bits[:n], None if first == second else bits[n:], radius)
        return pa.table({"a": node[order[a]], "b": node[order[b]]})

    return placed.groupBy("pair").applyInArrow(compare, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with a link; the root is the component's smallest node. Every round each node hooks to its
    smallest neighbour and its neighbours to that one, so that chains shorten; rounds end when nothing changes."""
    now = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "links")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # Large star: every larger neighbour of a node goes to the node's smallest neighbour.
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        # Small star: every smaller neighbour, and the node, go to the smallest.
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u")
        nxt = joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v"))).distinct()
        nxt = stage(nxt, "links")
        same = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first() == nxt.agg(
            F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        now = nxt
        if same:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def with_component(printed: DataFrame, key: str = "doc_id", radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """`printed` (with `fp`, read twice or more: stage it) with `component_id`, the smallest key of its component."""
    words = [c for c in printed.columns if c.startswith("fp")]
    least = stage(printed.groupBy(*words).agg(F.min(key).alias("least")), "prints")
    return named(printed, least, components(near(least.select(*words), radius, tile))).drop("__root")


def named(printed: DataFrame, least: DataFrame, member: DataFrame) -> DataFrame:
    """`printed` with `__root`, its component, and `component_id`, the smallest of the keys `least` of the component's nodes; `member`:
    (node, root) of linked ones."""
    grouped = least.join(member, least["fp"] == member["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.join(named, "root").select(F.col("fp").alias("__fp"), F.col("root").alias("__root"), "component_id")
    return printed.drop("component_id").join(named, F.col("fp") == F.col("__fp")).drop("__fp")


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """`key`, `fingerprint` (64 bits) and `component_id` of every row of `docs`."""
    printed = stage(with_fingerprint(docs, text, [key], words), "prints")
    return with_component(printed, key, radius).select(key, hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one row of each group of texts that are near-duplicates by similarity: the one of the smallest key. Among a
    group's rows that share that key, or have none, the text of the smallest hash stays, and one of its copies."""
    rows = docs.select(F.col(key).alias("__key"), F.xxhash64(text).alias("__print"), F.col(text).alias("__text"))
    printed = stage(with_similar(rows, ["__key", "__print"], "__text"), "prints")
    nodes = stage(printed.groupBy("fp", "fp0", "fp1", "fp2", "fp3", "n").agg(F.min("__key").alias("least")), "prints")
    groups = stage(components(near(nodes.drop("least"), SIMILAR, WIDE_TILE, "n")), "groups")
    member = components(verified(docs, groups, nodes, text))
    rows = stage(named(printed, nodes, member).select("__key", "__print", "__root", F.col("__key").eqNullSafe(F.col("component_id")).alias("__first")), "kept")
    same = F.col(key).eqNullSafe(F.col("__key"))
    if rows.groupBy("__key").count().where("count > 1").isEmpty():
        return docs.join(small(rows.where("NOT __first").select("__key")), same, "left_anti")
    # Keys repeat: rows are told apart by their text, too.
    first = stage(rows.where("__first").groupBy("__root").agg(F.min("__key").alias("__key"), F.min("__print").alias("__print")).drop("__root"), "kept")
    told = docs.withColumn("__mine", F.xxhash64(text))
    kept = told.join(small(first), same & (F.col("__mine") == F.col("__print")), "left_semi")
    if not rows.groupBy("__key", "__print").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates([key, "__mine"])
    return kept.drop("__mine")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
