"""WARC archives as seekable Zstandard bundles.

A bundle is independent zstd frames of some records each, then a seek table in a skippable frame (the
format of zstd's contrib/seekable_format: each frame's compressed and full size, their number, flags,
magic), so a reader finds any record from a (frame, offset in the frame) pair and decompresses that frame
alone. `write_archives` returns that index; `read_archives` reads every record back.

Deduplication follows WARC 1.1's identical-payload-digest profile: of records with equal payloads of at
least `least_bytes` the smallest id's is `response`, the others `revisit` it and carry no payload.

Records carry one date, a parameter, so that equal pages give equal bytes. A payload of any length is one record
in one frame of its own, so a task holds the longest payload and its record in memory.

Defined cases: a null payload is empty; repeated rows of one id with one payload are responses all, when
that id is the smallest; rows equal in id, address and payload are one capture and share its WARC-Record-ID; a record with a null id is never the one referred to, unless all ids of its
payload are null; an empty table gives no bundle; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.common import Scratch, table

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "2024-01-01T00:00:00Z"

INDEX = "bundle string, record_id string, id long, frame int, offset long, length long"
RECORDS = "id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def opened(path: str, mode: str):
    """A file of any store that pyarrow reaches (file://, hdfs://, s3://, ...)."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_output_stream(inner, compression=None) if mode == "w" else store.open_input_file(inner)


class BundleWriter:
    """Collects records into frames of at least `frame_bytes`, and frames into one file."""

    def __init__(self, path: str, frame_bytes: int = 1 << 18, level: int = 3):
        import zstandard

        self.path, self.frame_bytes, self.sink = path, frame_bytes, opened(path, "w")
        self.pack = zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int]] = []
        self.held, self.size, self.written = [], 0, 0

    def add(self, record: bytes) -> tuple[int, int]:
        """The record's frame and offset within that frame's bytes."""
        place = len(self.frames), self.size
        self.held.append(record)
        self.size += len(record)
        if self.size >= self.frame_bytes:
            self.flush()
        return place

    def flush(self) -> None:
        if self.size:
            packed = self.pack.compress(b"".join(self.held))
            self.sink.write(packed)
            self.frames.append((len(packed), self.size))
            self.written += len(packed)
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        entries = b"".join(struct.pack("<II", *f) for f in self.frames)
        footer = entries + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(footer)) + footer)
        self.sink.close()


class BundleReader:
    """Reads single frames of a bundle, found by its seek table."""

    def __init__(self, path: str):
        import zstandard

        self.file = opened(path, "r")
        size = self.file.size()
        self.file.seek(size - 9)
        n, _, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        self.file.seek(size - 9 - 8 * n)
        table = self.file.read(8 * n)
        self.frames, at = [], 0
        for k in range(n):
            packed, full = struct.unpack_from("<II", table, 8 * k)
            self.frames.append((at, packed, full))
            at += packed
        self.unpack = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        at, packed, full = self.frames[k]
        self.file.seek(at)
        return self.unpack.decompress(self.file.read(packed), max_output_size=full)

    def close(self) -> None:
        self.file.close()


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def target(url: str | None) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) <= 32 or ord(c) == 127 else c for c in url or "")


def record_id_of(id_: int | None, url: str | None, sha1: str, revisit: bool) -> str:
    """One for each capture; rows equal in id, address and payload are one capture."""
    named = repr((id_, url, sha1, revisit)).encode("utf-8", "surrogatepass")
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(named).digest()[:16], version=5)}>"


def encode_record(id_: int | None, url: str | None, payload: bytes, sha1: str, first: tuple[int | None, str | None] | None, date: str = DATE) -> tuple[str, bytes]:
    """(record id, bytes) of a response, or of a revisit of the record with the id and address `first`."""
    revisit = first is not None
    record_id = record_id_of(id_, url, sha1, revisit)
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if revisit else payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target(url)}",
        f"WARC-Payload-Digest: sha1:{sha1}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if id_ is not None:
        lines.append(f"X-Page-ID: {id_}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        lines += [f"WARC-Refers-To: {record_id_of(*first, sha1, False)}", f"WARC-Refers-To-Target-URI: {target(first[1])}"]
        lines += [f"X-Refers-To-Page-ID: {first[0]}"] if first[0] is not None else []
    lines.append(f"Content-Length: {len(body)}")
    return record_id, "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def decode_record(data: bytes) -> dict:
    """The fields of RECORDS from a record's bytes; a response's digest and size are taken anew from its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    kind, told = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    payload = body.partition(b"\r\n\r\n")[2] if kind == "response" else None
    if payload is not None and (digest(payload) != told or len(payload) != int(fields["X-Payload-Length"])):
        raise ValueError(f"{fields['WARC-Record-ID']} is damaged")
    number = lambda k: int(fields[k]) if k in fields else None
    return {"id": number("X-Page-ID"), "url": fields["WARC-Target-URI"], "payload": payload, "payload_bytes": int(fields["X-Payload-Length"]), "payload_digest": told, "record_type": kind, "refers_to": number("X-Refers-To-Page-ID")}


def with_revisits(records: DataFrame, least_bytes: int = 0, salts: int = 1024) -> DataFrame:
    """records (id, url, payload) with `first`, id and address of the smallest id of an equal payload, where the row revisits it.

    Only payloads that occur more than once are joined, each once for every salt that its rows have (a hash of id and
    address below `salts`), so the rows of one very common payload spread over as many tasks and the copies never
    outnumber the rows.
    """
    salt = F.pmod(F.xxhash64("id", "url"), F.lit(salts)).cast("int").alias("salt")
    keyed = records.select("id", "url", "payload", F.sha1(F.col("payload").cast("binary")).alias("sha1"), salt)
    twice = records.filter(F.octet_length("payload") >= least_bytes).groupBy(F.sha1(F.col("payload").cast("binary")).alias("sha1"))
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "url")).alias("first")  # a null id comes last
    twice = twice.agg(least, F.count("*").alias("n"), F.collect_set(salt).alias("met")).filter("n > 1").select("sha1", F.struct("first.id", "first.url").alias("first"), F.explode("met").alias("salt"))
    joined = keyed.join(twice, ["sha1", "salt"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first.id"))
    return joined.select("id", "url", "payload", F.when(revisit, F.col("first")).alias("first"))


def write_archives(records: DataFrame, root: str, frame_bytes: int = 1 << 18, bundle_bytes: int = 64 << 20, date: str = DATE) -> DataFrame:
    """Writes each partition of (id, url, payload, first) to bundles under root; lazily returns INDEX rows.

    A file's name is new at every attempt and only the index of a finished task names it, so a lost or
    speculative task leaves at most a file that nothing reads. Save the index before use.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, rows = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if writer is None:
                    writer = BundleWriter(f"{root}/{uuid.uuid4().hex}.warc.zst", frame_bytes)
                payload = (row["payload"] or "").encode("utf-8", "surrogatepass")
                name, data = encode_record(row["id"], row["url"], payload, digest(payload), (row["first"]["id"], row["first"]["url"]) if row["first"] else None, date)
                frame, offset = writer.add(data)
                rows.append((writer.path, name, row["id"], frame, offset, len(data)))
                if writer.written >= bundle_bytes:
                    writer.close()
                    yield indexed(rows)
                    writer, rows = None, []
        if writer is not None:
            writer.close()
            yield indexed(rows)

    def indexed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [("bundle", pa.string()), ("record_id", pa.string()), ("id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], schema=pa.schema(kinds))

    return records.mapInArrow(write, INDEX)


def read_archives(index: DataFrame, payloads: bool = True) -> DataFrame:
    """RECORDS of every index row; a task reads the frames of its rows, each frame once.

    The rows are dealt by (bundle, frame), so a frame is never split and no bundle is one task's alone.
    """
    kinds = pa.schema([("id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, path, frame, held = None, None, None, b""
        for batch in batches:
            rows, size = [], 0
            for at in batch.to_pylist():
                if at["bundle"] != path:
                    if reader:
                        reader.close()
                    reader, path, frame = BundleReader(at["bundle"]), at["bundle"], None
                if at["frame"] != frame:
                    frame = at["frame"]
                    held = reader.frame(frame)
                record = decode_record(held[at["offset"] : at["offset"] + at["length"]])
                if not payloads:
                    record["payload"] = None
                rows.append(record)
                size += at["length"]
                if size >= 16 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)
        if reader:
            reader.close()

    return index.repartition("bundle", "frame").sortWithinPartitions("bundle", "frame", "offset").mapInArrow(read, RECORDS)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", F.coalesce("html", F.lit("")).alias("payload"))
    index = scratch.save(write_archives(with_revisits(pages), scratch.folder("bundles")), "index")
    back = read_archives(index, payloads=False)
    return back.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS first FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('{_B32}', 1 + CAST((CAST(('0x' || substr(x, CAST(5 * (i // 4) + 1 AS BIGINT), 5)) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""
