import numpy as np
import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from loadwatch.llm.arrays import Texts, chunks, pack, same_bytes, spaced, unpack, xxh64


@settings(deadline=None, max_examples=60)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=8))
def test_words_are_cut_at_ascii_white_space(texts):
    t = Texts(pa.array(["skipped", *texts], pa.string()).slice(1))
    starts, ends, at = t.words()
    raw = t.bytes.tobytes()
    for i, x in enumerate(texts):
        assert [raw[a:b] for a, b in zip(starts[at[i]:at[i + 1]], ends[at[i]:at[i + 1]])] == (x or "").encode().split()


@settings(deadline=None, max_examples=40)
@given(st.lists(st.binary(max_size=90), min_size=1, max_size=20))
def test_hashes_equal_the_library(parts):
    ends = np.cumsum([len(p) for p in parts])
    data = np.frombuffer(b"".join(parts), np.uint8)
    got = xxh64(data, ends - [len(p) for p in parts], ends)
    assert got.tolist() == [xxhash.xxh64_intdigest(p, 42) for p in parts]


def test_long_stretches_hash_alike():
    data = np.random.default_rng(1).integers(0, 256, 9000, dtype=np.uint8)
    got = xxh64(data, np.array([0, 5, 100]), np.array([9000, 2500, 131]))
    assert got.tolist() == [xxhash.xxh64_intdigest(data[a:b].tobytes(), 42) for a, b in ((0, 9000), (5, 2500), (100, 131))]


def test_pack_is_exact():
    for arrays in ([np.zeros(0, np.int64)], [np.array([0, 255, 256]), np.array([2**63], np.uint64), np.array([1.5, -2.0])]):
        assert all((a == b).all() for a, b in zip(arrays, unpack(pack(*arrays))))


def test_chunks_hold_every_row_once():
    batch = pa.RecordBatch.from_pydict({"t": pa.array(["x" * n for n in (5, 0, 30, 1)] + [None, "y"])})
    for limit in (1, 6, 100):
        parts = list(chunks([batch, batch.slice(0, 0)], "t", limit))
        assert [x for p in parts for x in p.column("t").to_pylist()] == batch.column("t").to_pylist()


def test_spaced_and_same_bytes():
    t = Texts(pa.array(["a  bb\n", None, "ccc a"]))
    starts, ends, _ = t.words()
    data, a, b = spaced(t.bytes, starts, ends)
    assert data.tobytes() == b"a bb ccc a " and (b - a).tolist() == [1, 2, 3, 1]
    assert same_bytes(data, a[[0, 0]], a[[3, 1]], np.array([1, 1])).tolist() == [True, False]
