"""Exact token counts of a byte-pair vocabulary, by rank-synchronous merging of many pre-tokens at once.

The vocabulary file (a `tokenizers` JSON: normaliser NFC, white space and lower case, a split pattern, bytes as symbols, merges
in rank order, an end-of-word suffix) is read in each task. A batch's distinct pre-tokens are one ragged array of symbols; in
every round each pre-token's lowest-rank adjacent pair is merged at all its places simultaneously, and finished pre-tokens
leave. Counts of pre-tokens are remembered in a task up to a bound. Special strings inside a text are one token each, as the
library does by default; a symbol that the vocabulary lacks can't occur, since all bytes are in it.

Edge cases: a null or empty text has 0 tokens and 0 bytes; repeated rows are counted each; an empty table gives an empty result;
texts and single pre-tokens may be of any length. Columns of the input with the names of the results are replaced.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from loadwatch.llm.arrays import chunks, picked, shape, table

LIMIT = 2048
#: Pre-tokens whose counts a task remembers.
REMEMBERED = 200_000
#: In texts of these characters, all Unicode versions agree on letters, digits, white space and case; others go through the
#: library's own normaliser and splitter.
PLAIN = regex.compile(r"[\x00-ͷ‐-‧‰-⁞₠-₿←-⋿]*")
NONE = np.int64(1) << 40


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


class Merger:
    """Counts the symbols that survive the merges."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.library = Tokenizer.from_file(path)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        suffix, symbols = model.get("end_of_word_suffix") or "", byte_symbols()
        number: dict[str, int] = {}
        for s in [*symbols, *(s + suffix for s in symbols)]:
            number.setdefault(s, len(number))
        left, right, made = [], [], []
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            whole = a + b
            left.append(number.setdefault(a, len(number)))
            right.append(number.setdefault(b, len(number)))
            made.append(number.setdefault(whole, len(number)))
        self.size = np.int64(len(number))
        keys = np.array(left, np.int64) * self.size + np.array(right, np.int64)
        self.order = np.argsort(keys, kind="stable")
        self.keys, self.made = keys[self.order], np.array(made, np.int64)
        self.inner = np.array([number[s] for s in symbols], np.int64)
        self.last = np.array([number[s + suffix] for s in symbols], np.int64)
        # A rank is applied at one place a round if its symbol can be merged on at a lower rank than its own.
        first_use = np.full(len(number), NONE)
        for rank in range(len(made) - 1, -1, -1):
            first_use[[left[rank], right[rank]]] = rank
        self.alone = first_use[self.made] < np.arange(len(made))
        self.counts: dict[str, int] = {}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], NONE)

    def survivors(self, words: list[str]) -> np.ndarray:
        """Symbols left of each pre-token."""
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        out = size.copy()
        if not len(size):
            return out
        ends = np.cumsum(size)
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbol = self.inner[data]
        symbol[ends - 1] = self.last[data[ends - 1]]
        owner = np.repeat(np.arange(len(raw)), size)
        rank = self._all_ranks(symbol, owner)
        while len(symbol):
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            low = np.minimum.reduceat(rank, starts)
            span = np.diff(np.append(starts, len(symbol)))
            busy = low < NONE
            if not busy.all():  # what has no pair left is done
                out[owner[starts[~busy]]] = span[~busy]
                on = np.repeat(busy, span)
                symbol, owner, rank = symbol[on], owner[on], rank[on]
                low, span = low[busy], span[busy]
                if not len(symbol):
                    break
                starts = np.concatenate([[0], np.cumsum(span)[:-1]])
            hit = np.flatnonzero(rank == np.repeat(low, span))
            # In a run of overlapping places every other one is merged, from the left.
            fresh = np.concatenate([[True], np.diff(hit) > 1])
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            lone = self.alone[rank[hit]]
            if lone.any():
                first = np.concatenate([[True], owner[hit][1:] != owner[hit][:-1]])
                hit = hit[first | ~lone]
            symbol[hit] = self.made[rank[hit]]
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            stale = np.zeros(len(symbol), bool)
            stale[hit] = True
            stale[np.maximum(hit - 1, 0)] = True
            # The symbol before a merge may itself have been the right half of the merge before.
            stale[np.maximum(hit - 2, 0)] = True
            symbol, owner, rank, stale = symbol[keep], owner[keep], rank[keep], stale[keep]
            again = np.flatnonzero(stale)
            rank[again] = self._ranks_at(symbol, owner, again)
        return out

    def _ranks_at(self, symbol: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        nxt = np.minimum(at + 1, len(symbol) - 1)
        found = self.ranks(symbol[at], symbol[nxt])
        return np.where((at + 1 < len(symbol)) & (owner[at] == owner[nxt]), found, NONE)

    def _all_ranks(self, symbol: np.ndarray, owner: np.ndarray) -> np.ndarray:
        return self._ranks_at(symbol, owner, np.arange(len(symbol)))

    def pre_tokens(self, text: str) -> list[str]:
        """The pieces of a stretch without special strings."""
        if PLAIN.fullmatch(text):
            plain = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
            return self.pattern.findall(plain)
        text = self.library.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def count(self, texts: list[str | None]) -> list[int]:
        pieces, extra = [], []
        for text in texts:
            text = text or ""
            marks = self.special.findall(text) if self.special and "<|" in text else []
            parts = self.special.split(text) if marks else [text]
            pieces.append([w for p in parts for w in self.pre_tokens(p)] if marks else self.pre_tokens(text))
            extra.append(len(marks))
        new = list(set().union(*map(set, pieces)) - self.counts.keys()) if pieces else []
        known = self.counts
        if len(known) + len(new) > REMEMBERED:
            used = set().union(*map(set, pieces))
            known = {w: n for w, n in known.items() if w in used}
        known.update(zip(new, self.survivors(new).tolist(), strict=True))
        out = [sum(map(known.__getitem__, p)) + e for p, e in zip(pieces, extra, strict=True)]
        self.counts = known if len(known) <= REMEMBERED else {}
        return out


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = LIMIT, keep: list[str] | None = None) -> DataFrame:
    """`docs` (or its columns `keep`) with `n_bytes`, `n_tokens` and `over_limit`; `path`: the vocabulary, on every worker."""
    new = ("n_bytes", "n_tokens", "over_limit")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = None
        for part in chunks(batches, text):
            merger = merger or Merger(path)
            texts = part.column(text).to_pylist()
            n = merger.count(texts)
            size = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [
                pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], [*kept, *new])

    return picked(docs, [*kept, text]).mapInArrow(run, shape(docs, kept, "n_bytes bigint, n_tokens bigint, over_limit boolean"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])
