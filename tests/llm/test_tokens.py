import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loadwatch.llm.tokens import PLAIN, Merger, count_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_counts_equal_the_library(library):
    rng = random.Random(3)
    texts = ["", "a" * 3000, "aaaa bbbb" * 50, "<|endoftext|> x <|startoftext|><|endoftext|>", "İstanbul Σίσυφος", "é ﬁ ½ ² \x1c\x85　 中文 😀",
             "<|endoftext", "don't we'll I'M", "abcdefgh" * 500]
    for _ in range(200):
        pick = lambda: rng.choice([rng.randrange(32, 127), rng.randrange(32, 0x378), rng.randrange(0x20, 0xD800)])
        texts += ["".join(chr(pick()) for _ in range(rng.randrange(60))), "".join(rng.choice("abctheinr ") for _ in range(rng.randrange(300)))]
    merger = Merger(PATH)
    assert merger.count(texts) == [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]


def test_plain_characters_are_split_as_the_library_does(library):
    merger = Merger(PATH)
    for c in filter(lambda c: PLAIN.fullmatch(chr(c)), range(0x2300)):
        s = f"a{chr(c)}1{chr(c)}!"
        n = library.normalizer.normalize_str(s)
        assert merger.pre_tokens(s) == [n[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(n)], hex(c)


def test_a_rank_whose_symbol_merges_on_lower_is_applied_one_at_a_time(tmp_path, library):
    import json
    spec = json.load(open(PATH, encoding="utf-8"))
    base = [x for x in spec["model"]["vocab"] if len(x.removesuffix("</w>")) == 1]
    merges = [["b", "c"], ["ab", "c"], ["abc", "a"], ["a", "bc"], ["a", "b"]]
    made = list(dict.fromkeys([*base, *("".join(m) for m in merges)]))
    spec["model"] |= {"vocab": {x: i for i, x in enumerate(made)}, "merges": merges}
    spec["added_tokens"] = []
    path = tmp_path / "v.json"
    path.write_text(json.dumps(spec))
    merger, other = Merger(str(path)), Tokenizer.from_file(str(path))
    assert merger.alone.any()
    for s in ("abcabcabc", "abcabcabcabcx", "aabcbcab", "abab abcab"):
        assert merger.count([s]) == [len(other.encode(s).ids)]


def test_table(spark, docs, texts, empty, library):
    got = count_tokens(docs, PATH)
    assert got.columns == [*docs.columns, "n_bytes", "n_tokens", "over_limit"]
    want = sorted(((r[0], len((r[1] or "").encode()), n := len(library.encode(r[1] or "", add_special_tokens=False).ids), n > 2048) for r in texts), key=str)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()), key=str) == want
    assert count_tokens(empty, PATH).collect() == []
