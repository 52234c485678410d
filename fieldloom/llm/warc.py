"""WARC archives: a writer with revisit records and a splittable reader.

Writer: each task writes archives of its own, one gzip member per record, through
the file system of the target folder.  A record whose payload occurs under a
smaller id is a revisit and carries only its HTTP header.  A task hands back the
files it has finished, so files of lost attempts are never read.

Reader: the archives are cut into byte ranges.  A task scans its range for the gzip
magic, takes a candidate for a member only if its first bytes decode to a WARC
header, and owns the records that start inside its range; the last one is read
beyond the range's end.  A member is decoded as a stream, block by block.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import materialize, query, shared_dir, table

#: Fixed values of the formats.
MAGIC, VERSION, CRLF = b"\x1f\x8b\x08", b"WARC/1.1", b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of an archive after which a new one is begun, of a range, of one read, and payload bytes below which nothing is a revisit.
ARCHIVE_BYTES, RANGE_BYTES, BLOCK, LEAST_PAYLOAD = 1 << 30, 16 << 20, 1 << 20, 100
MANIFEST = "path string, bytes bigint, records bigint"


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder given as a path or a URI, and the path in it."""
    return fs.FileSystem.from_uri(re.sub(r"^s3a:", "s3:", folder))


def record_id(key: int | None) -> str:
    return f"<urn:page:{key}>"


def record(key: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        VERSION.decode(), f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(key)}", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(3, "WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + CRLF + CRLF + block + CRLF + CRLF


def member(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def with_revisits(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """id, url, payload, digest, refers_to (null: a response).

    The payload travels once, to its digest's first id; a frequent payload has one row
    on the other side, so such a partition can be split.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= LEAST_PAYLOAD
    firsts = (
        rows.filter(large & F.col("id").isNotNull()).groupBy("digest")
        .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first")
    )
    return rows.join(firsts, "digest", "left").select(
        "id", "url", "payload", "digest", F.when(F.col("first") < F.col("id"), F.col("first")).alias("refers_to")
    )


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
               date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES, level: int = 6) -> DataFrame:
    """Writes one record per row into ``folder``; returns (path, bytes, records) of the archives.

    A null payload is empty, a null URL is left out.  Of equal payloads of at least
    LEAST_PAYLOAD bytes those with the smallest id are responses (all of them if that
    id repeats); a row without id is a response and never referred to.  An empty table
    gives no archive.  Other columns are not written.
    """

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = file_system(folder)
        out, done, path, size, count = None, [], "", 0, 0

        def close() -> None:
            if out is not None:
                out.close()
                done.append((path, size, count))

        for batch in batches:
            for i in range(batch.num_rows):
                key, url, payload, digest, refers_to = (batch.column(c)[i].as_py() for c in ("id", "url", "payload", "digest", "refers_to"))
                if out is None or size >= archive_bytes:
                    close()
                    path, size, count = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(path, compression=None)
                data = member(record(key, url, payload, digest, refers_to, date), level)
                out.write(data)
                size, count = size + len(data), count + 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True) if done else ([], [], []), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "bytes", "records"])

    store, base = file_system(folder)
    store.create_dir(base, recursive=True)
    return materialize(with_revisits(pages, id_col, url_col, payload_col).mapInArrow(archives, MANIFEST))


class Stream:
    """Bytes of one gzip member of a file, decoded block by block."""

    def __init__(self, file, at: int, block: int):
        self.file, self.at, self.block = file, at, block
        self.unpack, self.text, self.used = zlib.decompressobj(31), b"", 0

    def more(self) -> bool:
        """Decodes another block; False at the member's end."""
        if self.unpack.eof:
            return False
        raw = self.file.read_at(self.block, self.at + self.used)
        if not raw:
            raise zlib.error("the file ends inside a member")
        self.text += self.unpack.decompress(raw)
        self.used += len(raw) - len(self.unpack.unused_data)
        return True

    def upto(self, mark: bytes, most: int = 1 << 20) -> bytes | None:
        """What stands before the mark, which is skipped; None if it doesn't come."""
        searched = 0
        while (i := self.text.find(mark, searched)) < 0:
            if len(self.text) > most or not self.more():
                return None
            searched = 0
        found, self.text = self.text[:i], self.text[i + len(mark) :]
        return found

    def take(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.text and not self.more():
                raise ValueError("the record is cut short")
            part, self.text = self.text[:size], self.text[size:]
            size -= len(part)
            yield part


def fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower().decode(): v.strip().decode() for k, _, v in (line.partition(b":") for line in head.split(CRLF)[1:])}


def starts_record(file, at: int) -> bool:
    """Does a gzip member that decodes to a WARC header start here?"""
    try:
        return zlib.decompressobj(31).decompress(file.read_at(4096, at), 64).startswith(b"WARC/1.")
    except zlib.error:
        return False


def key_of(text: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", text or "")
    return int(m[1]) if m else None


def read_record(file, at: int, block: int, with_payload: bool) -> tuple[dict, int]:
    """The record of the member at an offset, and the bytes of that member."""
    stream = Stream(file, at, block)
    head = fields(stream.upto(CRLF + CRLF))
    length = int(head["content-length"])
    http = stream.upto(CRLF + CRLF)
    stored = length - len(http) - 4
    digest, parts = hashlib.sha256(), []
    for part in stream.take(stored):
        digest.update(part)
        if with_payload:
            parts.append(part)
    while stream.more():
        pass
    revisit = head["warc-type"] == "revisit"
    said = head["warc-payload-digest"].rpartition(":")[2]
    size = int(fields(http)["content-length"])
    if not revisit and (said != digest.hexdigest() or size != stored):
        raise ValueError(f"record {head['warc-record-id']} is damaged")
    return {
        "page_id": key_of(head["warc-record-id"]), "url": head.get("warc-target-uri"), "payload_bytes": size, "payload_digest": said, "record_type": head["warc-type"],
        "refers_to": key_of(head.get("warc-refers-to")), "payload": b"".join(parts) if with_payload and not revisit else None,
    }, stream.used


def records_in(file, start: int, end: int, block: int = BLOCK, with_payload: bool = True) -> Iterator[dict]:
    """Records that start in [start, end), wherever the range begins."""
    at = start
    while at < end:
        raw = file.read_at(min(block, end - at) + len(MAGIC) - 1, at)
        i = raw.find(MAGIC)
        if i < 0:
            at += min(block, end - at)
        elif starts_record(file, at + i):
            found, used = read_record(file, at + i, block, with_payload)
            yield found
            at += i + used
        else:
            at += i + 1


RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def read_warc(manifest: DataFrame, folder: str, range_bytes: int = RANGE_BYTES, with_payload: bool = True, block: int = BLOCK) -> DataFrame:
    """All records of the archives of a manifest; a revisit has no payload of its own."""
    ranges = manifest.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(range_bytes).cast("bigint"))).alias("start"))
    parts = manifest.agg(F.sum(F.ceil(F.col("bytes") / range_bytes))).first()[0] or 1
    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(row["path"]) as file:
                    held, size = [], 0
                    for found in records_in(file, row["start"], min(row["start"] + range_bytes, row["bytes"]), block, with_payload):
                        held.append(found)
                        size += len(found["payload"] or b"")
                        if len(held) >= 4096 or size >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(held, kinds)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, kinds)

    return ranges.repartition(min(int(parts), 100_000)).mapInArrow(read, RECORDS)


@query()
def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    """All ``pages`` written as archives and read back."""
    target = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    manifest = write_warc(table(spark, folder, "pages"), target)
    return read_warc(manifest, target, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
