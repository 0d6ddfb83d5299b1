import gzip
import hashlib

import pytest
from oracle_support import compare, connect

from ledgerloom.llm import warc as op


def expected(rows):
    payloads = [(i, (html or "").encode()) for i, _, html in rows]
    found = []
    for i, data in payloads:
        same = [j for j, other in payloads if other == data and j is not None]
        revisit = i is not None and len(data) >= 100 and i > min(same)
        found.append((i, "revisit" if revisit else "response", min(same) if revisit else None, len(data), hashlib.sha256(data).hexdigest()))
    return sorted(found, key=str)


def test_whole_table_equals_sql(spark, sf_dir):
    assert compare(spark, connect(sf_dir), op.op4_warc, op._SQL, sf_dir)[1] is None


def test_odd_pages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op, "FILE_BYTES", 300)
    long = "<p>é🙂\r\n\r\n" * 5000
    rows = [(7, "http://a/?q=1 2\nx", long), (3, None, long), (9, "http://é", long), (4, "u", "short"), (5, "u", "short"), (6, "u", None),
            (8, "u", ""), (None, "u", long), (3, None, long), (-2, "u", "x" * 100), (11, "u", "x" * 100), (12, "u", "x" * 99), (13, "u", "x" * 99)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as crc", "'d' as digest")
    payloads, headers = op.write_store(pages, f"file://{tmp_path}/store")
    assert payloads.count() == len({html or "" for _, _, html in rows}) and headers.count() == len(rows)
    manifest = op.write_warc(op.records(payloads, headers), f"file://{tmp_path}")
    assert sorted((tuple(r) for r in op.read_warc(manifest).collect()), key=str) == expected(rows)
    # any gzip reader sees the records one after the other
    text = b"".join(gzip.open(r.path.removeprefix("file://")).read() for r in manifest.collect())
    assert text.count(b"WARC/1.1\r\n") == len(rows) and text.count(b"WARC-Type: revisit") == 3


def test_empty_table_and_damage(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    payloads, headers = op.write_store(pages, f"file://{tmp_path}/store")
    assert op.read_warc(op.write_warc(op.records(payloads, headers), f"file://{tmp_path}")).collect() == []
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Payload-Digest: sha256:00\r\nContent-Length: 7\r\n\r\nH\r\n\r\nab\r\n\r\n"
    with pytest.raises(ValueError, match="digest"):
        op.parse(record)
    with pytest.raises(ValueError, match="whole"):
        op.parse(record[:-1])
