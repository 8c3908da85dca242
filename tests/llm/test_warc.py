import base64
import hashlib
import io

import pyarrow as pa
import zstandard

from loadwatch.llm.warc import read_archives, read_record, write_archives
from loadwatch.llm import warc

ROWS = [(1, "http://a/", "<p>same</p>"), (2, "http://b/\r\nX: y", "<p>same</p>"), (3, None, "<p>same</p>"), (4, "u", None), (5, "u", ""),
        (6, "u", "é" * 5000), (7, "u", "WARC/1.1\r\n\r\nnot a record\r\n\r\n"), (7, "u", "WARC/1.1\r\n\r\nnot a record\r\n\r\n"), (None, "u", "<p>same</p>"), (8, "u", "x" * 700_000)]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, 5) for r in rows], "page_id bigint, url string, html string, size int").repartition(3)


def by_hand(rows, least=0):
    last = {}
    for k, _, h in rows:
        last[h or ""] = max(k if k is not None else -1, last.get(h or "", -1))
    out = []
    for k, _, h in rows:
        raw = (h or "").encode()
        again = len(raw) >= least and (k if k is not None else -1) < last[h or ""]
        out.append((k, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", last[h or ""] if again else None))
    return sorted(out, key=str)


def test_round_trip(spark, folder, monkeypatch):
    manifest = write_archives(pages(spark), f"{folder}/w")
    back = read_archives(manifest)
    got = back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r) for r in got.collect()), key=str) == by_hand(ROWS)
    texts = {k: (h or "").encode() for k, _, h in ROWS}
    for r in back.where("record_type = 'response'").collect():
        assert bytes(r.payload) == texts[r.page_id]
    for r in manifest.collect():  # one record by its place
        head, block = read_record(r.bundle, r.frame, r.offset, r.length)
        assert head["WARC-Record-ID"] == r.record_id and "X" not in head
        assert head["WARC-Type"] == "revisit" or block.partition(b"\r\n\r\n")[2] == texts[r.page_id]
    # Any Zstandard reader takes the whole file: frames, then a skippable one.
    path = manifest.first().bundle
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(open(path, "rb").read()), read_across_frames=True).read()
    assert whole.startswith(b"WARC/1.1\r\n") and whole.endswith(b"\r\n\r\n")


def test_small_payloads_are_all_responses(spark, folder):
    got = read_archives(write_archives(pages(spark), f"{folder}/w", min_bytes=50)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r) for r in got.collect()), key=str) == by_hand(ROWS, 50)


def test_many_bundles(spark, folder):
    rows = [(i, f"http://h/{i}", f"page {i % 40} " * 3000) for i in range(300)]
    old = warc.FRAME, warc.BUNDLE
    manifest = write_archives(pages(spark, rows), f"{folder}/w")
    got = read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r) for r in got.collect()), key=str) == by_hand(rows) and old == (warc.FRAME, warc.BUNDLE)
    assert manifest.where("frame > 0").count() > 0


def test_empty(spark, folder):
    assert read_archives(write_archives(pages(spark).limit(0), f"{folder}/w")).collect() == []


def test_seek_table_is_the_public_format(folder):
    b = warc.Bundle(f"{folder}/x.zst")
    places = [b.add(bytes([65 + i]) * 200_000) for i in range(3)]
    b.close()
    raw = open(f"{folder}/x.zst", "rb").read()
    assert int.from_bytes(raw[-4:], "little") == 0x8F92EAB1 and int.from_bytes(raw[-9:-5], "little") == 3
    with pa.OSFile(f"{folder}/x.zst") as f:
        frames = warc.seek_table(f)
        assert [warc.read_frame(f, frames[k])[o:o + n] for k, o, n in places] == [bytes([65 + i]) * 200_000 for i in range(3)]
