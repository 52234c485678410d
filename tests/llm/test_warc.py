import gzip
import hashlib
import io

import pyarrow as pa
import pytest
from pyarrow import fs

from fieldloom.llm import warc

BIG = "<p>" + "same body é " * 40
PAGES = [
    (5, "http://a/5", BIG), (3, "http://a/3", BIG), (9, None, BIG), (1, "http://a/ 1", None), (2, "http://a/2", ""), (7, "u", "short"), (8, "u", "short"),
    (10, "u", "z" * 99), (11, "u", "z" * 99), (12, "u", "z" * 100), (13, "u", "z" * 100), (None, "u", BIG), (12, "u", "z" * 100), (20, "u", "x" * 3_000_000),
]
SCHEMA = "page_id long, url string, html string"


def expected(rows):
    out = []
    for key, _, html in rows:
        data = (html or "").encode()
        same = [k for k, _, h in rows if k is not None and (h or "") == (html or "")]
        first = min(same) if same and len(data) >= 100 else None
        revisit = key is not None and first is not None and first < key
        out.append((key, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("range_bytes", "block", "archive_bytes"), [(1 << 24, 1 << 20, 1 << 30), (97, 64, 600), (1000, 4096, 1)])
def test_round_trip(spark, tmp_path, range_bytes, block, archive_bytes):
    pages = spark.createDataFrame([(*r, "clash") for r in PAGES], SCHEMA + ", payload string")
    manifest = warc.write_warc(pages, f"file://{tmp_path}/w", archive_bytes=archive_bytes)
    rows = warc.read_warc(manifest, f"file://{tmp_path}/w", range_bytes=range_bytes, block=block).collect()
    assert sorted([tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in rows], key=repr) == expected(PAGES)
    html = {k: h for k, _, h in PAGES}
    assert all(r["payload"].decode() == (html[r["page_id"]] or "") for r in rows if r["record_type"] == "response")
    assert {r["url"] for r in rows if r["page_id"] == 1} == {"http://a/%201"}
    assert manifest.agg({"records": "sum"}).first()[0] == len(PAGES)


def test_archives_are_plain_gzip(spark, tmp_path):
    manifest = warc.write_warc(spark.createDataFrame(PAGES, SCHEMA).coalesce(1), f"file://{tmp_path}/w")
    data = b"".join(gzip.decompress(open(r["path"], "rb").read()) for r in manifest.collect())
    assert data.count(b"WARC/1.1\r\nWARC-Type: ") == len(PAGES)


def test_false_magic_is_no_record(tmp_path):
    inner = warc.MAGIC + b"\x00" * 20 + warc.MAGIC
    data = b"".join(warc.member(warc.record(i, None, p, hashlib.sha256(p).hexdigest(), None, "d"), 0) for i, p in enumerate([inner, inner * 50, b"end"]))
    (tmp_path / "f").write_bytes(data)
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "f")) as file:
        for step in (10, 64, 5000):
            found = [r["page_id"] for a in range(0, len(data), step) for r in warc.records_in(file, a, min(a + step, len(data)), 37)]
            assert found == [0, 1, 2]


def test_empty_table(spark, tmp_path):
    manifest = warc.write_warc(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/w")
    assert warc.read_warc(manifest, f"file://{tmp_path}/w").count() == 0


def test_damage_is_reported():
    data = bytearray(warc.member(warc.record(1, None, b"a" * 200, "0" * 64, None, "d"), 6))
    with pytest.raises(ValueError):
        list(warc.records_in(pa.PythonFile(io.BytesIO(bytes(data)), mode="r"), 0, len(data)))
