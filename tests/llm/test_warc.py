import base64
import gzip
import hashlib
from pathlib import Path

from pyspark.sql import functions as F

from quillsieve.llm._scratch import Scratch
from quillsieve.llm.queries import op1_warc_revisits
from quillsieve.llm.warc import base32_sha1, deduplicate, read_archives


def test_digest(spark):
    texts = ["", "abc", "é" * 999, "\r\n\r\nWARC/1.1\r\n"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", base32_sha1(F.col("t").cast("binary")).alias("d")).collect()
    assert all(r.d == base64.b32encode(hashlib.sha1(r.t.encode()).digest()).decode() for r in got)


def test_query_on_odd_pages(spark, tmp_path):
    tricky = "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(3, "http://a b\r\nX: y/", tricky), (1, "u", tricky), (9, None, None), (8, "u", ""), (7, "u", "é日"), (5, "u", "z" * 600_000), (6, "u", "z" * 600_000), (2, "u", "\n"), (2, "u", "\n"), (None, "u", "é日")]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in op1_warc_revisits(spark, str(tmp_path)).collect()), key=str)
    n = len(tricky)
    want = [(3, n, "revisit", 1), (1, n, "response", None), (9, 0, "revisit", 8), (8, 0, "response", None), (7, 5, "response", None), (None, 5, "revisit", 7), (5, 600_000, "response", None), (6, 600_000, "revisit", 5), (2, 1, "response", None), (2, 1, "revisit", 2)]
    assert got == sorted(want, key=str)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert op1_warc_revisits(spark, str(tmp_path)).count() == 0


def test_archive_of_others(spark):
    """Several gzip members, other header spellings, and a wrong digest."""
    record = lambda body, extra=b"": b"WARC/1.0\r\nWARC-Type: resource\r\nwarc-record-id: <urn:x>\r\n" + extra + b"Content-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    path = Scratch(spark, "others").path
    folder = Path(path.removeprefix("file://"))
    folder.mkdir(parents=True)
    (folder / "a.warc.gz").write_bytes(gzip.compress(record(b"one")) + gzip.compress(record(b"\0\xff" * 9)))
    (folder / "b.warc").write_bytes(record(b"") + record(b"three"))
    got = sorted((r.length, r.record_id, bytes(r.payload)) for r in read_archives(spark, path, with_payload=True).collect())
    assert got == [(0, "urn:x", b""), (3, "urn:x", b"one"), (5, "urn:x", b"three"), (18, "urn:x", b"\0\xff" * 9)]
    (folder / "c.warc").write_bytes(record(b"x", b"WARC-Payload-Digest: sha1:AAAA\r\n") + record(b"x", b"WARC-Payload-Digest: SHA-256:%s\r\n" % hashlib.sha256(b"x").hexdigest().encode()) + record(b"x", b"WARC-Payload-Digest: odd:1\r\n"))
    assert sorted(str(r.digest_ok) for r in read_archives(spark, path).where("file like '%c.warc'").collect()) == ["False", "None", "True"]


def test_crawled_responses_keep_their_heads(spark):
    """HTTP messages with heads of their own: the digest is the body's; after deduplication heads and other records are as before."""
    head = lambda k: b"HTTP/1.0 200 OK\r\nX-Server: %d\r\n\r\n" % k
    body = b"<p>\xff\r\n\r\n" * 3
    name = base64.b32encode(hashlib.sha1(body).digest())

    def record(kind, k, content, mime):
        return b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:%d>\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Type: %s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind, k, name, mime, len(content), content)

    scratch = Scratch(spark, "crawl")
    folder = Path(scratch.path.removeprefix("file://")) / "in"
    folder.mkdir(parents=True)
    rows = [record(b"response", k, head(k) + body, b"application/http; msgtype=response") for k in (1, 2, 3)]
    rows += [record(b"request", 4, b"GET / HTTP/1.0\r\n\r\n", b"application/http; msgtype=request"), record(b"resource", 5, body, b"text/css"), record(b"response", 6, b"HTTP/1.0 204 No Content", b"application/http")]
    (folder / "a.warc").write_bytes(b"".join(rows))
    deduplicate(spark, f"{scratch.path}/in", f"{scratch.path}/out", F.col("record_id"), "2020-01-01T00:00:00Z", file_bytes=1)
    got = {r.record_id: r for r in read_archives(spark, f"{scratch.path}/out", with_payload=True).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {"urn:1": ("response", None), "urn:2": ("revisit", "urn:1"), "urn:3": ("revisit", "urn:1"), "urn:4": ("request", None), "urn:5": ("resource", None), "urn:6": ("response", None)}
    assert (bytes(got["urn:1"].http_head), bytes(got["urn:1"].payload), got["urn:1"].digest_ok) == (head(1), body, True)
    assert (bytes(got["urn:5"].payload), got["urn:5"].content_type, bytes(got["urn:6"].http_head)) == (body, "text/css", b"HTTP/1.0 204 No Content")
    assert len(list((Path(scratch.path.removeprefix("file://")) / "out").glob("part-*"))) >= 6
