"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent frames of about `FRAME` bytes; a bundle is a file of frames that ends with a seek table in
a skippable frame (the public seekable format), and a manifest maps every record's id to its bundle, frame, offset within the
decompressed frame, and length. One record is read by decompressing one frame. Bundles are written by the tasks into the shared
folder under names that no other attempt uses; only files named in the manifest, which Spark commits, count.

Payloads that are equal (SHA-1 and length) and have at least `min_bytes` bytes are stored once, in the record of the largest page
id; the others are revisit records that refer to it. Only digests are grouped; payloads meet their decision by page id.

Edge cases: a null payload is empty; a null page id counts as smaller than any other; if rows repeat the largest id with the same
payload, all of them are responses; line ends in an address are percent-encoded; an empty table gives no bundle and no row.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadwatch.llm.arrays import chunks, table
from loadwatch.session import shared_dir, stage

FRAME, BUNDLE, RECORDS = 256 << 10, 64 << 20, 20_000
# Fixed values of the seekable format: skippable frame, seek table.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreservation.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
MANIFEST = "record_id string, page_id bigint, bundle string, frame int, offset bigint, length bigint"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file:///" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None, date: str) -> bytes:
    """One WARC record; a payload of None makes a revisit."""
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if payload is None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}", f"X-Payload-Length: {size}"]
    block = b"" if payload is None else HTTP + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record begins here")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    return headers, rest[:int(headers["Content-Length"])]


class Bundle:
    """Writes frames and, at the end, the seek table."""

    def __init__(self, uri: str):
        self.uri = uri
        system, path = opened(uri)
        self.out = system.open_output_stream(path, compression=None)  # by its name it would compress once more
        self.packer = zstandard.ZstdCompressor(level=3)
        self.held, self.size, self.done, self.sizes, self.records = [], 0, 0, [], 0

    def add(self, raw: bytes) -> tuple[int, int, int]:
        """Frame, offset in it, length."""
        if self.held and self.size + len(raw) > FRAME:
            self.flush()
        at = len(self.sizes), self.size, len(raw)
        self.held.append(raw)
        self.size += len(raw)
        self.records += 1
        return at

    def flush(self) -> None:
        if self.held:
            packed = self.packer.compress(b"".join(self.held))
            self.out.write(packed)
            self.sizes.append((len(packed), self.size))
            self.done += len(packed)
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        entries = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries)) + entries)
        self.out.close()


def seek_table(source: pa.NativeFile) -> list[tuple[int, int, int]]:
    """Begin, packed size and size of every frame, from the end of the file."""
    end = source.size()
    source.seek(end - 9)
    n, _, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end of the file")
    source.seek(end - 9 - 8 * n)
    at, out = 0, []
    for packed, size in struct.iter_unpack("<II", source.read(8 * n)):
        out.append((at, packed, size))
        at += packed
    return out


def read_frame(source: pa.NativeFile, frame: tuple[int, int, int]) -> bytes:
    source.seek(frame[0])
    return zstandard.ZstdDecompressor().decompress(source.read(frame[1]), max_output_size=frame[2])


def read_record(bundle: str, frame: int, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record by its place in the manifest."""
    system, path = opened(bundle)
    with system.open_input_file(path) as source:
        return parse(read_frame(source, seek_table(source)[frame])[offset:offset + length])


def decisions(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload another page's record holds."""
    keys = pages.select("page_id", F.sha1(payload_of(pages)).alias("digest"), F.octet_length(payload_of(pages)).alias("size"))
    last = keys.where(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    held = keys.join(last.where("n > 1 AND refers_to IS NOT NULL"), ["digest", "size"])
    return held.where("page_id IS NULL OR page_id < refers_to").select("page_id", "digest", "refers_to").distinct()


def payload_of(pages: DataFrame):
    return F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes `pages` (page_id, url, html) as bundles into `folder`; the manifest, one row per record."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), payload_of(pages).alias("payload")).withColumn("digest", F.sha1("payload"))
    again = decisions(pages, min_bytes).select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "refers_to")
    rows = rows.join(again, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")
    rows = rows.select("page_id", "url", F.octet_length("payload").alias("size"), "digest", "refers_to",
                       F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(folder)
        system.create_dir(path, recursive=True)
        bundle, number, attempt = None, 0, uuid.uuid4().hex[:12]
        for part in chunks(batches, "payload"):
            out = []
            for r in part.to_pylist():
                if bundle is None:
                    bundle = Bundle(f"{folder}/bundle-{TaskContext.get().partitionId():05d}-{number:05d}-{attempt}.warc.zst")
                digest = base64.b32encode(bytes.fromhex(r["digest"])).decode()
                raw = record(r["page_id"], r["url"], r["payload"], digest, r["size"], r["refers_to"], date)
                out.append((record_id(r["page_id"], digest), r["page_id"], bundle.uri, *bundle.add(raw)))
                if bundle.done + bundle.size >= BUNDLE or bundle.records >= RECORDS:
                    bundle.close()
                    bundle, number = None, number + 1
            yield pa.RecordBatch.from_pylist([dict(zip(NAMES, x, strict=True)) for x in out], SCHEMA)
        if bundle is not None:
            bundle.close()

    return stage(rows.mapInArrow(run, MANIFEST), "manifest")


NAMES = [x.split()[0] for x in MANIFEST.split(", ")]
SCHEMA = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])


def read_archives(manifest: DataFrame) -> DataFrame:
    """Every record of the manifest, read back: ids, type, full payload's size and digest, the page referred to, payload."""
    bundles = manifest.groupBy("bundle").agg(F.sort_array(F.collect_list(F.struct("frame", "offset", "length"))).alias("places"))
    schema = "record_id string, page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"
    made = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                      ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def rows_of(raw: bytes, places: list[dict]) -> Iterator[dict]:
        for p in places:
            head, block = parse(raw[p["offset"]:p["offset"] + p["length"]])
            digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
            if head["WARC-Type"] == "response":
                payload = block.partition(b"\r\n\r\n")[2]
                found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                if found != digest:
                    raise ValueError(f"{head['WARC-Record-ID']}: payload and digest differ")
                size = len(payload)
            else:
                payload, size = None, int(head["X-Payload-Length"])
            number = {k: int(head[k]) if k in head else None for k in ("X-Page-Id", "X-Refers-To-Page")}
            yield {"record_id": head["WARC-Record-ID"], "page_id": number["X-Page-Id"], "url": head.get("WARC-Target-URI"), "record_type": head["WARC-Type"],
                   "payload_bytes": size, "payload_digest": digest, "refers_to": number["X-Refers-To-Page"], "payload": payload}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, path = opened(row["bundle"])
                with system.open_input_file(path) as source:
                    frames, held = seek_table(source), []
                    for p in [*row["places"], {"frame": -1}]:
                        if held and held[-1]["frame"] != p["frame"]:
                            raw = read_frame(source, frames[held[-1]["frame"]])
                            yield pa.RecordBatch.from_pylist(list(rows_of(raw, held)), made)
                            held = []
                        held.append(p)

    spread = max(1, manifest.sparkSession.sparkContext.defaultParallelism)
    return bundles.repartition(spread, "bundle").mapInArrow(run, schema)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages"), shared_dir(spark, "warc"))
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Every five hex digits of a SHA-1 are four base32 digits.
OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT h, octet_length(encode(t)) AS n, max(page_id) AS last FROM p GROUP BY ALL),
b AS (SELECT p.page_id, octet_length(encode(t))::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(p.h, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
    m.last FROM p JOIN m ON p.h = m.h AND octet_length(encode(t)) = m.n)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id < last THEN last END AS refers_to FROM b"""
