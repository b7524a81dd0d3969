import base64
import gzip
import hashlib

from cases import PAGES, none, page
from pyspark.sql import functions as F

from shiftledger.llm import warc
from shiftledger.session import work_dir

TRAP = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nfalse\r\n\r\nWARC/1.1\r\n"
HTML = [None, "", "<p>é\U0001f600</p>", TRAP, "same", "same", "x" * 300_000, TRAP, "\r\n\r\n", "same"]


def test_round_trip(spark):
    rows = [page(k, None if k == 2 else f"http://h/ a\r\nb{k}?q#f", h) for k, h in enumerate(HTML)]
    rows += [page(4, "http://again/", "same"), page(None, None, "same"), page(None, None, "alone"), page(None, None, "alone")]
    found = warc.round_trip(spark.createDataFrame(rows, PAGES)).collect()
    assert len(found) == len(rows)
    smallest = {}
    for p in rows:
        if p[0] is not None:
            smallest[p[2] or ""] = min(smallest.get(p[2] or "", p[0]), p[0])
    expected, seen = [], []
    for p in rows:
        data = (p[2] or "").encode()
        low = smallest.get(p[2] or "")
        again = low is not None and low != p[0]
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        expected.append((str(p[0]), len(data), digest, "revisit" if again else "response", str(low if again else None)))
    for r in found:
        about, answer = r["metadata"]["fields"], r["response"]
        seen.append((about.get("page-id", "None"), answer["payload_bytes"], answer["digest"], answer["record_type"], about.get("refers-to-page", "None")))
        assert r["request"]["fields"]["request"].startswith("GET ") and r["request"]["record_id"] != answer["record_id"]
        if answer["record_type"] == "response" and about.get("page-id"):
            assert bytes(r["payload"]).decode() == next(p[2] or "" for p in rows if str(p[0]) == about["page-id"])
        assert answer["record_type"] == "response" or r["payload"] is None
    assert sorted(seen) == sorted(expected)


def test_small_payloads_are_never_revisits(spark):
    rows = [page(k, "http://h/", "same" if k < 3 else "longer text") for k in range(6)]
    found = warc.planned(spark.createDataFrame(rows, PAGES), min_bytes=5).collect()
    assert sorted((r["id"], r["revisit"], r["refers_to"]) for r in found) == [
        (0, False, None), (1, False, None), (2, False, None), (3, False, None), (4, True, 3), (5, True, 3),
    ]


def record(kind, record_id, block, more=b""):
    head = b"WARC/1.1\r\nWARC-Type: %s\r\nWARC-Record-ID: %s\r\n%sContent-Length: %d\r\n\r\n" % (kind, record_id, more, len(block))
    return head + block + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    """Members of their own, records of a capture in different files, a plain file, a cut end, a capture without response."""
    to = b"WARC-Concurrent-To: <r>\r\n"
    response = record(b"response", b"<r>", b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nbody")
    one = gzip.compress(record(b"warcinfo", b"<i>", b"software: x")) + gzip.compress(response)
    two = record(b"metadata", b"<m>", b"k: v\r\n", to) + record(b"request", b"<q>", b"GET / HTTP/1.1\r\n\r\n", to)
    (tmp_path / "a.warc.gz").write_bytes(one)
    (tmp_path / "b.warc").write_bytes(two + record(b"metadata", b"<z>", b"a: b", b"WARC-Concurrent-To: <gone>\r\n") + response[:-9])
    found = {r["capture_id"]: r for r in warc.captures(warc.read_archive(spark, str(tmp_path))).collect()}
    assert set(found) == {"<i>", "<r>", "<gone>"}
    assert bytes(found["<r>"]["payload"]) == b"body" and found["<r>"]["response"]["payload_bytes"] == 4
    assert found["<r>"]["metadata"]["fields"] == {"k": "v"} and found["<r>"]["request"]["record_id"] == "<q>"
    assert found["<gone>"]["response"] is None


def test_empty_table_and_file_size(spark, monkeypatch):
    assert warc.round_trip(none(spark, PAGES)).count() == 0
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 6)
    path = work_dir(spark, "warc-test")
    pages = spark.createDataFrame([page(k, "http://h/", f"p{k}") for k in range(9)], PAGES).coalesce(1)
    warc.write_archive(warc.planned(pages), path)
    assert spark.read.format("binaryFile").load(path).count() >= 5
    assert warc.captures(warc.read_archive(spark, path)).count() == 9


def test_files_are_bounded_by_bytes(spark, monkeypatch):
    """Large payloads share a file with few others, small ones with many; nothing is lost."""
    monkeypatch.setattr(warc, "FILE_BYTES", 40_000)
    monkeypatch.setattr(warc, "SMALL_BYTES", 1 << 10)
    monkeypatch.setattr(warc, "HEAD_BYTES", 1_000)
    sizes = [0, 1, 1024] * 8 + [1025, 9_000, 16_384] * 4 + [16_385, 200_000, 262_144, 262_145]
    pages = [page(k, f"http://h/{k}", chr(97 + k % 26) * n) for k, n in enumerate(sizes)]
    path = work_dir(spark, "warc-bytes")
    planned = warc.planned(spark.createDataFrame(pages, PAGES).coalesce(1), min_bytes=1 << 30)
    warc.write_archive(planned, path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").collect()
    for row in files:
        blocks = [len(block) for _, block in warc.parse(bytes(row["content"]))]
        assert sum(blocks) <= 40_000 or len(blocks) == 3
    found = warc.captures(warc.read_archive(spark, path)).collect()
    assert sorted(len(r["payload"]) for r in found) == sorted(sizes)
    assert len({r["capture_id"] for r in found}) == len(sizes)


def test_size_classes(spark):
    rows = [(0, 0), (1, 0), (65_536, 0), (65_537, 1), (1 << 20, 1), ((1 << 20) + 1, 2), (1 << 24, 2), ((1 << 31) - 1, 4)]
    found = spark.createDataFrame(rows, "bytes long, expected int").select("expected", warc.size_class(F.col("bytes")).alias("size"))
    assert all(r["size"] == r["expected"] for r in found.collect())
    assert [warc.records_per_file(k) for k in (0, 1, 2, 3, 4)] == [11_580, 765, 45, 3, 3]
