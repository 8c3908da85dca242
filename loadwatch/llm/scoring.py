"""Language-model scores from an Elias-Fano n-gram trie that Spark counts, shards and queries.

1. `blocks`: each task splits a few megabytes of whole texts into words and keeps them as local numbers, and the distinct words'
   mixed XXH64 (a word's identity) in ascending order, in the shared folder.
2. `counted`: distinct words of each block go to a shard by range of hash, get their number and their count in the training texts,
   and come back. What is sent is one entry per block and word, whatever the word's frequency.
3. `scored`: the distinct (context, word) pairs of each block, with their training counts and the texts they stand in, go to a
   shard by context. A shard builds its trie, writes its levels to a file, maps it, answers all pairs with quantised
   log-probabilities, and sums them per text. A context that holds a large share of all tokens is split over several shards by its
   successors; a pair that does is one entry per block.
4. The shards' sums of each block's texts are added up.

The trie has two levels. The first holds the contexts' numbers (monotone), pointers into the second (monotone) and quantised
back-off weights; the second holds each context's successors, made monotone by adding what the successors of all contexts before
it have reached, and quantised interpolated probabilities. All monotone sequences are Elias-Fano coded. A query finds the context
among the contexts, reads two pointers, adds the base of the context's range and looks for the successor by the high bits, within
that range only. Probabilities are absolutely discounted bigrams, interpolated with the add-one unigram.

The distinct successors of contexts that are split are counted before (`followers`), from the blocks as they lie in the shared
folder and by the words' hashes, so that no block is joined with its words' numbers a second time: each shard counts the pairs dealt
to it, and the shards' numbers are added up. There are at most `2 / SPLIT` such contexts a shard, so they go to every task, and so do
their counts.

Edge cases: a null or empty text is one end token; a null id is held in training; repeated rows count and are scored each; an empty
table gives an empty result; no training row gives counts of 0. Texts may be of any length.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadwatch.llm.arrays import Texts, chunks, pack, spread, table, unpack, xxh64
from loadwatch.session import stage

BLOCK_BYTES = 6 << 20
#: Entries of a shard, about, for words and for pairs.
WORDS_SHARD, PAIRS_SHARD = 600_000, 1_500_000
#: A context with more than this share of a shard's tokens is split.
SPLIT = 0.25
DISCOUNT, STEPS = 0.75, 512
#: The hash that stands for the end of a text; the number of its beginning; words are numbered from 2.
END, BEGIN = np.uint64(1), 1


class EliasFano:
    """A monotone sequence in about 2 + log2(universe / n) bits an entry, with random access and search by value."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ones = n, low_bits, low, high, ones
        self.zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones
        self.windows = np.ndarray((max(0, len(low) - 7),), "<u8", low, strides=(1,)) if low_bits else None

    @staticmethod
    def coded(values: np.ndarray) -> list[np.ndarray]:
        """[n and low bits, low bytes, high words, ones before each high word]."""
        values = values.astype(np.int64)
        n, universe = len(values), int(values[-1]) + 1 if len(values) else 1
        low_bits = max(0, min(56, (universe // max(n, 1)).bit_length() - 1))
        high = values >> low_bits
        length = n + (int(high[-1]) if n else 0) + 2
        bits = np.zeros((length + 63) // 64 * 64, bool)
        bits[high + np.arange(n)] = True
        words = np.packbits(bits, bitorder="little").view("<u8")
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        low = np.zeros(8, np.uint8)
        if low_bits and n:
            rows = 1 << 16  # a multiple of 8, so that parts end at whole bytes
            parts = [np.packbits(((values[a:a + rows, None] >> np.arange(low_bits)) & 1).astype(np.uint8).ravel(), bitorder="little")
                     for a in range(0, n, rows)]
            low = np.concatenate([*parts, low])
        return [np.array([n, low_bits], np.int64), low, words, ones]

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        at = i * self.low_bits
        return ((self.windows[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)

    @staticmethod
    def _inside(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The place of the one of the given rank in each word."""
        at, rank = np.zeros(len(word), np.int64), rank.astype(np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            below = np.bitwise_count(word & np.uint64((1 << width) - 1)).astype(np.int64)
            go = rank >= below
            rank = rank - below * go
            word = word >> (go * width).astype(np.uint64)
            at += go * width
        return at

    def _select(self, k: np.ndarray, directory: np.ndarray, flip: bool) -> np.ndarray:
        w = np.searchsorted(directory, k, "right") - 1
        word = self.high[w]
        return w * 64 + self._inside(~word if flip else word, k - directory[w])

    def at(self, i: np.ndarray) -> np.ndarray:
        """The values at the given places."""
        return ((self._select(i, self.ones, False) - i) << self.low_bits) | self.lows(i)

    def find(self, x: np.ndarray, first: np.ndarray | int = 0, last: np.ndarray | int | None = None) -> np.ndarray:
        """The place of x among the places from `first` to before `last`, or -1."""
        out = np.full(len(x), -1, np.int64)
        if self.n == 0:
            return out
        high, low = x >> self.low_bits, x & ((1 << self.low_bits) - 1)
        on = np.flatnonzero(high < self.zeros[-1] - 1)
        h = high[on]
        begin = np.where(h > 0, self._select(np.maximum(h - 1, 0), self.zeros, True) - (h - 1), 0)
        end = self._select(h, self.zeros, True) - h
        begin = np.maximum(begin, first[on] if isinstance(first, np.ndarray) else first)
        end = np.minimum(end, self.n if last is None else last[on] if isinstance(last, np.ndarray) else last)
        top, want = end.copy(), low[on]
        while (busy := np.flatnonzero(begin < end)).size:  # lower bound of the low bits within the high bits' bucket
            mid = (begin[busy] + end[busy]) >> 1
            less = self.lows(mid) < want[busy]
            begin[busy] = np.where(less, mid + 1, begin[busy])
            end[busy] = np.where(less, end[busy], mid)
        hit = np.flatnonzero(begin < top)
        hit = hit[self.lows(begin[hit]) == want[hit]]
        out[on[hit]] = begin[hit]
        return out


class Trie:
    """Two levels in one file, memory-mapped; made by `written`."""

    def __init__(self, path: str, layout: list[tuple[str, int, int]]):
        held = [np.memmap(path, kind, "r", at, (n,)) if n else np.zeros(0, kind) for kind, at, n in layout]
        self.contexts, self.pointers, self.successors = (
            EliasFano(int(held[k][0]), int(held[k][1]), *held[k + 1:k + 4]) for k in (0, 4, 8))
        self.backoff, self.codes = held[12:]

    @classmethod
    def written(cls, contexts: np.ndarray, sizes: np.ndarray, successors: np.ndarray, backoff: np.ndarray, codes: np.ndarray) -> Trie:
        """From ascending contexts, the number of successors of each, their ascending numbers, and the quantised values."""
        pointers = np.concatenate([[0], np.cumsum(sizes)])
        full = np.flatnonzero(sizes)
        # What each range reaches, so that the next begins above it.
        reach = np.zeros(len(sizes), np.int64)
        reach[full] = successors[pointers[1:][full] - 1] + 1
        base = np.concatenate([[0], np.cumsum(reach)[:-1]]) if len(sizes) else np.zeros(0, np.int64)
        level = successors + np.repeat(base, sizes)
        arrays = [x for v in (contexts, pointers, level) for x in EliasFano.coded(v)] + [backoff.astype(np.uint16), codes.astype(np.uint16)]
        layout, at = [], 0
        with tempfile.NamedTemporaryFile(suffix=".trie") as f:
            for x in arrays:
                layout.append((x.dtype.str, at, len(x)))
                f.write(x.tobytes())
                f.write(bytes(-x.nbytes % 8))
                at += x.nbytes + -x.nbytes % 8
            f.flush()
            return cls(f.name, layout)  # the file goes when the map does

    def query(self, contexts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per pair: the code of its probability, or -1; the code of the context's back-off weight, or -1."""
        code, weight = np.full(len(contexts), -1, np.int64), np.full(len(contexts), -1, np.int64)
        distinct, inverse = np.unique(contexts, return_inverse=True)
        place = self.contexts.find(distinct)
        known = np.flatnonzero(place >= 0)
        first, last, base = (np.zeros(len(distinct), np.int64) for _ in range(3))
        first[known] = self.pointers.at(place[known])
        last[known] = self.pointers.at(place[known] + 1)
        later = known[first[known] > 0]
        base[later] = self.successors.at(first[later] - 1) + 1
        bow = np.full(len(distinct), -1, np.int64)
        bow[known] = self.backoff[place[known]]
        weight[:] = bow[inverse]
        on = np.flatnonzero((last > first)[inverse])
        i = inverse[on]
        j = self.successors.find(words[on] + base[i], first[i], last[i])
        hit = j >= 0
        code[on[hit]] = self.codes[j[hit]]
        return code, weight


def quantised(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(p) * STEPS), 0, 65534).astype(np.int64)


def blocks(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Staged blocks of documents: ids, whether they train, and their tokens as packed numbers."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for part in chunks(batches, "__text", block_bytes):
            t = Texts(part.column("__text"), lower=True)
            starts, ends, offsets = t.words()
            size = np.diff(offsets) + 1
            hashes = np.empty(size.sum(), np.uint64)
            last = np.cumsum(size) - 1
            inner = np.ones(len(hashes), bool)
            inner[last] = False
            hashes[inner], hashes[last] = xxh64(t.bytes, starts, ends), END
            words, token = np.unique(spread(hashes), return_inverse=True)
            teaches = part.column("__train").to_numpy(zero_copy_only=False).astype(bool)
            seen = np.bincount(token[np.repeat(teaches, size)], minlength=len(words))
            ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("__key"))
            yield pa.RecordBatch.from_arrays([
                pa.array([number], pa.int64()), ids, pa.array([pack(size, teaches.astype(np.uint8), token)], pa.binary()),
                pa.array([pack(steps(words), seen)], pa.binary()), pa.array([len(words)], pa.int64()), pa.array([len(token)], pa.int64()),
                pa.array([int(seen.sum())], pa.int64())], ["block", "ids", "tokens", "words", "n_words", "n_tokens", "n_train"])
            number += 1

    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"), F.coalesce(train, F.lit(True)).alias("__train"))
    return stage(rows.mapInArrow(run, f"block bigint, ids array<{kind}>, tokens binary, words binary, n_words bigint, n_tokens bigint, n_train bigint"), "blocks")


def steps(ascending: np.ndarray) -> np.ndarray:
    """First value and differences, from which `np.cumsum` gives the values back."""
    return np.diff(ascending, prepend=ascending.dtype.type(0))


def parts_of(shard: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by shard, and (shard, begin, end) in it."""
    order = np.argsort(shard, kind="stable")
    found, begin = np.unique(shard[order], return_index=True)
    return order, list(zip(found.tolist(), begin.tolist(), [*begin[1:].tolist(), len(order)], strict=True))


def counted(held: DataFrame, shards: int, often: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Per block and word shard, staged: the words' numbers and training counts, in the order of the block; on one row of each
    shard, the shard's training words, and the hashes and numbers of those whose counts are `often`."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, packed in zip(batch.column("block").to_pylist(), batch.column("words"), strict=True):
                step, seen = unpack(packed.as_py())
                words = np.cumsum(step.astype(np.uint64), dtype=np.uint64)
                _, parts = parts_of((((words >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([
                    pa.array([s for s, _, _ in parts], pa.int32()), pa.array([block] * len(parts), pa.int64()),
                    pa.array([pack(steps(words[a:b]), seen[a:b]) for _, a, b in parts], pa.binary())], ["shard", "block", "payload"])

    def count(key: tuple, rows: pa.Table) -> pa.Table:
        shard, got = key[0].as_py(), [unpack(x.as_py()) for x in rows.column("payload")]
        at = np.cumsum([0, *(len(h) for h, _ in got)])
        words, inverse = np.unique(np.concatenate([np.cumsum(h.astype(np.uint64), dtype=np.uint64) for h, _ in got]), return_inverse=True)
        total = np.zeros(len(words), np.int64)
        np.add.at(total, inverse, np.concatenate([c.astype(np.int64) for _, c in got]))
        n, some = len(got), np.flatnonzero(often(total))
        replies = [pack(steps(2 + shard + inverse[a:b] * shards), total[inverse[a:b]]) for a, b in zip(at, at[1:], strict=False)]
        return pa.table({"block": rows.column("block"), "shard": pa.array([shard] * n, pa.int32()), "payload": pa.array(replies, pa.binary()),
                         "v": pa.array([int((total > 0).sum())] + [0] * (n - 1), pa.int64()),
                         "often": pa.array([pack(words[some], 2 + shard + some * shards) if len(some) else None] + [None] * (n - 1), pa.binary())})

    sent = held.select("block", "words").mapInArrow(send, "shard int, block bigint, payload binary")
    return stage(sent.groupBy("shard").applyInArrow(count, "block bigint, shard int, payload binary, v bigint, often binary"), "counts")


def sequence(tokens: bytes, begin: int) -> tuple[np.ndarray, ...]:
    """A block's texts' sizes, whether they train, its tokens and the token before each, `begin` at the beginning of a text."""
    size, teaches, token = (x.astype(np.int64) for x in unpack(tokens))
    before = np.concatenate([[begin], token[:-1]])
    before[np.cumsum(size)[:-1]] = begin
    return size, teaches, token, before


def numbered(tokens: bytes, replies: list[bytes]) -> tuple[np.ndarray, ...]:
    """What `sequence` gives, with the block's words in the order of their numbers; these, ascending, and the words' counts. The
    beginning of a text is one of the words."""
    got = [unpack(x) for x in replies]
    number = np.append(np.concatenate([np.cumsum(x.astype(np.int64)) for x, _ in got]), BEGIN)
    size, teaches, token, before = sequence(tokens, len(number) - 1)
    count = np.concatenate([c.astype(np.int64) for _, c in got])
    count = np.append(count, count[token[size[0] - 1]])  # a text begins as often as one ends
    order = np.argsort(number)
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return size, teaches, place[token], place[before], number[order], count[order]


class Block:
    """A block with its words' numbers and counts, and its distinct pairs dealt to shards."""

    def __init__(self, tokens: bytes, replies: list[bytes], shards: int, n: int, split: float):
        """`replies`: in the order of the word shards."""
        self.size, self.teaches, self.token, before, self.number, self.count = numbered(tokens, replies)
        k = len(self.number)
        self.owner = np.repeat(np.arange(len(self.size)), self.size)
        key = before * k + self.token
        self.by_pair = np.argsort(key, kind="stable")
        key = key[self.by_pair]
        self.begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        self.context, self.word = key[self.begin] // k, key[self.begin] % k
        self.begin = np.append(self.begin, len(key))
        self.seen = np.add.reduceat(np.repeat(self.teaches, self.size)[self.by_pair], self.begin[:-1])
        self.order, self.parts = parts_of(dealt(self.number[self.context], self.number[self.word], self.count[self.context], n, shards, split))

    def packed(self, a: int, b: int) -> bytes:
        """Pairs of one shard: contexts in runs, words as places in a table, training counts, and the texts of each pair. Numbers ascend
        and are sent as `steps`."""
        on = self.order[a:b]
        contexts, runs = np.unique(self.context[on], return_counts=True)  # the order is stable: contexts ascend
        words, inverse = np.unique(self.word[on], return_inverse=True)
        times = self.begin[on + 1] - self.begin[on]
        places = np.repeat(self.begin[on] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
        return pack(steps(self.number[contexts]), self.count[contexts], runs, steps(self.number[words]), self.count[words], inverse, self.seen[on],
                    times, self.owner[self.by_pair[places]], np.array([len(self.size)]))


def splits(count: np.ndarray, n: int, shards: int, split: float) -> np.ndarray:
    """Over how many shards a context's successors go, at most 2^20."""
    return np.minimum(1 + (count * shards / max(1.0, split * n)).astype(np.int64) if shards > 1 else np.ones(len(count), np.int64), 1 << 20)


def dealt(context: np.ndarray, word: np.ndarray, count: np.ndarray, n: int, shards: int, split: float) -> np.ndarray:
    """The shards of pairs of numbers."""
    share = splits(count, n, shards, split)
    deal = (context.astype(np.uint64) << np.uint64(20)) + (spread(word.astype(np.uint64)) % share.astype(np.uint64))
    return (spread(deal) % np.uint64(shards)).astype(np.int64)


def split_words(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and numbers of the words that are split as contexts."""
    got = [unpack(r[0]) for r in counts.select("often").where(F.col("often").isNotNull()).collect()]
    hashes, numbers = (np.concatenate([np.zeros(0, t), *(g[i].astype(t) for g in got)]) for i, t in enumerate((np.uint64, np.int64)))
    order = np.argsort(hashes)
    return hashes[order], numbers[order]


def followers(held: DataFrame, hashes: np.ndarray, numbers: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The contexts that are split, ascending, and the number of distinct successors of each in the training texts. `hashes` (ascending)
    and `numbers`: the words that are split; nothing follows an end, whose place here stands for the beginning."""
    if len(hashes) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    end = spread(np.array([END]))[0]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tokens, packed in zip(batch.column("tokens"), batch.column("words"), strict=True):
                words = np.cumsum(unpack(packed.as_py())[0].astype(np.uint64), dtype=np.uint64)
                size, teaches, token, before = sequence(tokens.as_py(), len(words))
                place = np.minimum(np.searchsorted(hashes, words), len(hashes) - 1)
                place[hashes[place] != words] = -1
                place = np.append(place, place[np.searchsorted(words, end)])
                on = (place[before] >= 0) & np.repeat(teaches > 0, size)
                key = np.unique(token[on] * len(hashes) + place[before[on]])  # by hash of the word, then by context
                word, context = words[key // len(hashes)], key % len(hashes)
                order, parts = parts_of((spread(word + spread(context.astype(np.uint64) + np.uint64(1))) % np.uint64(shards)).astype(np.int64))
                word, context = word[order], context[order]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _, _ in parts], pa.int32()), pa.array(
                    [pack(context[a:b], steps(word[a:b])) for _, a, b in parts], pa.binary())], ["shard", "payload"])

    def count_distinct(rows: pa.Table) -> pa.Table:
        got = [unpack(x) for x in rows.column("payload").to_pylist()]
        contexts = np.concatenate([c.astype(np.int64) for c, _ in got])
        words = np.concatenate([np.cumsum(w.astype(np.uint64), dtype=np.uint64) for _, w in got])
        order = np.lexsort((words, contexts))
        contexts, words = contexts[order], words[order]
        new = np.concatenate([[True], (contexts[1:] != contexts[:-1]) | (words[1:] != words[:-1])])
        found, n = np.unique(contexts[new], return_counts=True)
        return pa.table({"context": found, "n": n})

    sent = held.select("tokens", "words").mapInArrow(send, "shard int, payload binary")
    rows = sent.groupBy("shard").applyInArrow(count_distinct, "context bigint, n bigint").groupBy("context").agg(F.sum("n")).collect()
    numbers = np.where(hashes == end, BEGIN, numbers)
    rows = np.array(sorted((int(numbers[c]), n) for c, n in rows), np.int64).reshape(-1, 2)
    return rows[:, 0].copy(), rows[:, 1].copy()


def answered(payloads: list[bytes], n: int, v: int, split: tuple[np.ndarray, np.ndarray]) -> list[bytes]:
    """One shard: its trie, and per block the sums of the codes of its texts. `split`: as `followers` gives them."""
    got = [[np.cumsum(x, dtype=np.int64) if k in (0, 3) else x if k in (5, 7, 8) else x.astype(np.int64) for k, x in enumerate(unpack(p))]
           for p in payloads]
    # The shard's contexts and words, once each.
    contexts, first = np.unique(np.concatenate([g[0] for g in got]), return_index=True)
    times = np.concatenate([g[1] for g in got])[first]
    words, first = np.unique(np.concatenate([g[3] for g in got]), return_index=True)
    unigram = (np.concatenate([g[4] for g in got])[first] + 1) / (n + v + 1)
    width = len(words) + 1
    key = [np.repeat(np.searchsorted(contexts, g[0]), g[2]) * width + np.searchsorted(words, g[3])[g[5]] for g in got]
    taught = [g[6] > 0 for g in got]
    pairs, inverse = np.unique(np.concatenate([k[t] for k, t in zip(key, taught, strict=True)]), return_inverse=True)
    total = np.bincount(inverse, np.concatenate([g[6][t] for g, t in zip(got, taught, strict=True)]), len(pairs))
    pc, pw = pairs // width, pairs % width
    sizes = np.bincount(pc, minlength=len(contexts))
    after = sizes.copy()
    known = np.isin(contexts, split[0])
    after[known] = split[1][np.searchsorted(split[0], contexts[known])]
    weight = np.minimum(1.0, DISCOUNT * np.maximum(after, 1) / np.maximum(times, 1))
    p = (total - DISCOUNT) / times[pc] + weight[pc] * unigram[pw]
    on = times > 0
    trie = Trie.written(contexts[on], sizes[on], words[pw], quantised(weight[on]), quantised(np.minimum(p, 1.0)))
    lower, out = quantised(unigram), []
    for g, k in zip(got, key, strict=True):  # block by block, so that a query's own arrays stay small
        c, w = k // width, k % width
        code, bow = trie.query(contexts[c], words[w])
        code = np.where(code >= 0, code, np.maximum(bow, 0) + lower[w])
        out.append(pack(np.bincount(g[8], np.repeat(code, g[7]), int(g[9][0])).astype(np.int64)))
    return out


def score(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES,
          words_shard: int = WORDS_SHARD, pairs_shard: int = PAIRS_SHARD, split: float = SPLIT) -> DataFrame:
    """Per row of `docs`: `key`, `train`, `n_tokens`, `n_known`, `train_tokens`, `base_score` (add-one unigrams), `score` (the trie's)."""
    held = blocks(docs, train, key, text, block_bytes)
    sums = held.agg(F.sum("n_words"), F.sum("n_tokens"), F.sum("n_train")).first()
    word_shards = max(1, math.ceil((sums[0] or 0) / words_shard))
    shards, n = max(1, math.ceil((sums[1] or 0) / pairs_shard)), sums[2] or 0
    counts = counted(held, word_shards, lambda count: splits(count, n, shards, split) > 1)
    v = counts.agg(F.sum("v")).first()[0] or 0
    after = followers(held, *split_words(counts), shards)
    kind = docs.schema[key].dataType.simpleString()
    # Rows with ids carry what a block knows of its texts by itself; they pass a shard unchanged.
    passed = f"shard int, block bigint, payload binary, ids array<{kind}>"

    def send(mine: pa.Table, replies: pa.Table) -> pa.Table:
        number, ids = mine.column("block")[0].as_py(), mine.schema.field("ids").type
        order = np.argsort(replies.column("shard").to_numpy())
        found = replies.column("payload").to_pylist()
        block = Block(mine.column("tokens")[0].as_py(), [found[i] for i in order], shards, n, split)
        count, texts = block.count[block.token], len(block.size)
        known = np.bincount(block.owner, count > 0, texts).astype(np.int64)
        base = np.bincount(block.owner, np.log10((count + 1) / (n + v + 1)), texts)
        parts = len(block.parts)
        return pa.table({
            "shard": pa.array([s for s, _, _ in block.parts] + [number % shards], pa.int32()), "block": pa.array([number] * (parts + 1), pa.int64()),
            "payload": pa.array([block.packed(a, b) for _, a, b in block.parts] + [pack(block.size, block.teaches, known, base)], pa.binary()),
            "ids": pa.concat_arrays([pa.nulls(parts, ids), mine.column("ids").combine_chunks()])})

    def answer(rows: pa.Table) -> pa.Table:
        payloads, own = rows.column("payload").to_pylist(), rows.column("ids").is_valid().to_pylist()
        asked = [i for i, mine in enumerate(own) if not mine]
        if asked:
            for i, sums in zip(asked, answered([payloads[i] for i in asked], n, v, after), strict=True):
                payloads[i] = sums
        return rows.set_column(rows.schema.get_field_index("payload"), "payload", pa.array(payloads, pa.binary()))

    def finish(rows: pa.Table) -> pa.Table:
        payloads, own = rows.column("payload").to_pylist(), rows.column("ids").is_valid().to_pylist()
        mine = own.index(True)
        size, teaches, known, base = unpack(payloads[mine])
        codes = np.zeros(len(size), np.int64)
        for i, p in enumerate(payloads):
            if i != mine:
                codes += unpack(p)[0].astype(np.int64)
        ids = rows.column("ids").combine_chunks().drop_null().flatten()
        return pa.table([ids, pa.array(teaches.astype(bool)), pa.array(size.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(np.full(len(size), n, np.int64)),
                         pa.array(base), pa.array(-codes / STEPS)], [key, "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    sent = held.select("block", "ids", "tokens").groupBy("block").cogroup(counts.select("block", "shard", "payload").groupBy("block")).applyInArrow(send, passed)
    made = f"`{key}` {kind}, train boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return sent.groupBy("shard").applyInArrow(answer, passed).groupBy("block").applyInArrow(finish, made)


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    scored = score(table(spark, sf_dir, "documents").select("doc_id", "text"), ~held_out)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
