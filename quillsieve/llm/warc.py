"""WARC archives: writing, reading, and revisit resolution.

Spark's text writer writes the archives: a record is one value and the line separator is what ends a record, so that
commits, retries and compression are Spark's. Archives are read file by file with the records' own lengths. A response's
block is an HTTP message; its payload, which digests are of, is the message's body. Revisit resolution shuffles headers
only, by payload digest; a digest's original is found by a partial aggregation before the shuffle and written before it is
joined, so that a payload that a third of all pages share is a row for each task and its records are split between tasks.
Payloads move once, to the records that are written again.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch
from ._words import tidy

_CRLF, _HTTP = "\r\n", "application/http"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HEADER = "record_id string, record_type string, uri string, date string, digest string, digest_ok boolean, length long, refers_to string, refers_to_uri string, refers_to_date string, content_type string, file string, offset long"


def base32_sha1(data: Column) -> Column:
    """SHA-1 as upper-case base32, each five hexadecimal digits being four of base32."""

    def four(digits: Column, k: Column) -> Column:
        value = F.conv(F.substring(digits, k * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*[F.substring(F.lit(_BASE32), F.shiftright(value, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)])

    # the digest is an item of an array, so that it is made once and not for each of its digits
    once = F.array(F.sha1(data))
    return F.transform(once, lambda digits: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: four(digits, k)), ""))[0]


def _field(name: str, value: Column) -> Column:
    """A header line; none for a null. White space in it is percent-encoded."""
    safe = value
    for char in ["\r", "\n", "\t", " "] if name != "Content-Type" else []:
        safe = F.replace(safe, F.lit(char), F.lit(f"%{ord(char):02X}"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(_CRLF)), F.lit(""))


def write_archives(records: DataFrame, path: str, compression: str = "gzip", payload: str = "payload", most_records: int = 0) -> None:
    """Write records (record_id, record_type, uri, date, digest, payload string, refers_to, refers_to_uri, refers_to_date, and
    if there are such columns content_type and http_head) as archives: one for each partition, or more if they would hold
    more than `most_records` (0: no limit).

    A response is written as an HTTP message, with its own head if it has one; other records as their payload alone. A
    revisit has no block. Null fields are left out; a null payload is empty; repeated records are written each; an empty
    table gives no records."""
    body = F.coalesce(payload, F.lit(""))
    own = lambda name: F.col(name) if name in records.columns else F.lit(None).cast("string")
    message = (F.col("record_type") == "response") & (own("http_head").isNotNull() | own("content_type").isNull())
    http = F.concat(F.lit("HTTP/1.1 200 OK" + _CRLF + "Content-Type: text/html; charset=utf-8" + _CRLF + "Content-Length: "), F.octet_length(body).cast("string"), F.lit(_CRLF * 2))
    block = F.when(F.col("record_type") == "revisit", "").when(message, F.concat(F.coalesce(own("http_head"), http), body)).otherwise(body)
    kind = F.when(message | (F.col("record_type") == "revisit"), _HTTP + "; msgtype=response").otherwise(F.coalesce(own("content_type"), F.lit("text/html")))
    head = F.concat(
        F.lit("WARC/1.1" + _CRLF),
        _field("WARC-Type", F.col("record_type")),
        _field("WARC-Record-ID", F.concat(F.lit("<"), "record_id", F.lit(">"))),
        _field("WARC-Date", F.col("date")),
        _field("WARC-Target-URI", F.col("uri")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        _field("WARC-Profile", F.when(F.col("record_type") == "revisit", _PROFILE)),
        _field("WARC-Refers-To", F.concat(F.lit("<"), "refers_to", F.lit(">"))),
        _field("WARC-Refers-To-Target-URI", F.col("refers_to_uri")),
        _field("WARC-Refers-To-Date", F.col("refers_to_date")),
        _field("Content-Type", kind),
        _field("Content-Length", F.octet_length(F.col("block")).cast("string")),
    )
    write = records.withColumn("block", block).select(F.concat(head, F.lit(_CRLF), "block").alias("value")).write
    write.option("lineSep", _CRLF * 2).option("compression", compression).option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", most_records).text(path)


class _Bytes:
    """The bytes of an archive, plain or in gzip members, inflated as they are read."""

    def __init__(self, raw: memoryview):
        self.raw, self.at = raw, 0
        self.held, self.pos = b"", 0  # what is inflated, and how far it is read
        self.gzip = bytes(raw[:2]) == b"\x1f\x8b"
        self.member = zlib.decompressobj(31) if self.gzip else None

    def _more(self) -> bool:
        if self.at >= len(self.raw):
            return False
        part = bytes(self.raw[self.at : self.at + (1 << 17)])
        self.at += len(part)
        out = [self.held[self.pos :]]
        while self.gzip and part:
            out.append(self.member.decompress(part))
            part = self.member.unused_data
            if self.member.eof:
                self.member = zlib.decompressobj(31)
        self.held, self.pos = b"".join([*out, part]), 0
        return True

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.held.find(mark, self.pos)) < 0:
            if not self._more():
                return None
        out = self.held[self.pos : at]
        self.pos = at + len(mark)
        return out

    def take(self, n: int) -> bytes:
        parts = [self.held[self.pos : self.pos + n]]
        have = len(parts[0])
        self.pos += have
        while have < n and self._more():  # a long block is not joined again for each part
            parts.append(self.held[: n - have])
            have += len(parts[-1])
            self.pos = len(parts[-1])
        return b"".join(parts)


def _records(raw: memoryview) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """Headers (lower-case names), block and number of each record of an archive."""
    source, k = _Bytes(raw), 0
    while (head := source.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8", "replace").split("\r\n")
        lines = lines[next((i for i, x in enumerate(lines) if x.startswith("WARC/")), 0) + 1 :]
        fields = {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines)}
        yield fields, source.take(int(fields.get("content-length") or 0)), k
        source.take(4)  # what ends a record
        k += 1


def _body(fields: dict[str, str], block: bytes) -> tuple[bytes | None, bytes]:
    """Head and body of an HTTP message; no head if a block is none."""
    if not (fields.get("content-type") or "").lower().startswith(_HTTP) or not block.startswith(b"HTTP/"):
        return None, block
    at = block.find(b"\r\n\r\n")
    return (block, b"") if at < 0 else (block[: at + 4], block[at + 4 :])


def _agrees(declared: str | None, payload: bytes, sha1: str) -> bool | None:
    """Whether a digest like `sha256:...`, in base32 or hexadecimal, is the payload's; null where there is none, or of an unknown kind."""
    kind, colon, value = (declared or "").partition(":")
    kind = kind.strip().lower().replace("-", "")
    if not colon or kind not in hashlib.algorithms_guaranteed or kind.startswith("shake"):
        return None
    if kind == "sha1" and value.strip().upper() == sha1:
        return True
    digest = hashlib.new(kind, payload).digest()
    return value.strip().upper().rstrip("=") in (base64.b32encode(digest).decode().rstrip("="), digest.hex().upper())


def _read(with_payload: bool):
    def rows(batches):
        for batch in batches:
            names = batch.column(0).to_pylist()
            for name, content in zip(names, batch.column(1), strict=True):
                out, size = [], 0
                for f, block, k in _records(memoryview(content.as_buffer())):
                    bare = lambda x: x and x.removeprefix("<").removesuffix(">")
                    declared, kind, fits = f.get("warc-payload-digest"), f.get("warc-type"), None
                    digest = (declared or "").removeprefix("sha1:") or None
                    head, payload = _body(f, block)
                    if kind != "revisit":
                        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        fits = _agrees(declared, payload, digest)
                    out.append((bare(f.get("warc-record-id")), kind, f.get("warc-target-uri"), f.get("warc-date"), digest, fits, len(payload), bare(f.get("warc-refers-to")), f.get("warc-refers-to-target-uri"), f.get("warc-refers-to-date"), f.get("content-type"), name, k, payload, head)[: None if with_payload else -2])
                    size += len(block)
                    if size > 1 << 22 or len(out) == 5000:
                        yield table(out)
                        out, size = [], 0
                if out:
                    yield table(out)

    def table(out):
        kinds = [pa.string()] * 5 + [pa.bool_(), pa.int64()] + [pa.string()] * 5 + [pa.int64(), pa.binary(), pa.binary()]
        names = [x.split()[0] for x in HEADER.split(", ")] + ["payload", "http_head"]
        cols = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=False)], names=names[: len(cols)])

    return rows


def read_archives(spark, path: str, with_payload: bool = False) -> DataFrame:
    """Headers of all records under path, and if asked for the payloads and HTTP heads. A file is read by one task; it may be
    plain or in any number of gzip members, of up to 2 GB; empty files have no records.

    `digest` is the SHA-1 of what was read (of a revisit, what its header says), `digest_ok` whether the header's digest, of
    any common kind, agrees with it: null if there is none. A record without length has an empty block; missing fields are
    null; repeated records are read each."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("path", "content")
    return files.mapInArrow(tidy(_read(with_payload)), HEADER + (", payload binary, http_head binary" if with_payload else ""))


def resolve_revisits(headers: DataFrame, rank: Column, scratch: Scratch, least: int = 0) -> DataFrame:
    """Headers with record_type, refers_to, refers_to_uri and refers_to_date anew: of the records with one digest and
    length, that with the smallest rank is a response, the others revisit it. Records under `least` bytes are responses
    all. `rank` must tell records apart; nulls in it come last. Without headers there is no result."""
    h = headers.withColumn("rank", rank).where(F.col("length") >= least)
    first = h.groupBy("digest", "length").agg(F.min("rank").alias("first_rank"), F.min_by(F.struct("record_id", "uri", "date"), "rank").alias("first"))
    first = scratch.save(first, "originals")
    out = h.join(first.hint("merge"), ["digest", "length"]).withColumn("again", F.col("rank") != F.col("first_rank"))
    pick = lambda name: F.when(F.col("again"), F.col(f"first.{name}")).alias({"record_id": "refers_to", "uri": "refers_to_uri", "date": "refers_to_date"}[name])
    columns = ["record_id", "uri", "date", "digest", "length", "file", "offset"]
    out = out.select(*columns, F.when(F.col("again"), "revisit").otherwise("response").alias("record_type"), pick("record_id"), pick("uri"), pick("date"))
    small = headers.where(F.col("length") < least).select(*columns, F.lit("response").alias("record_type"), *[F.lit(None).cast("string").alias(c) for c in ("refers_to", "refers_to_uri", "refers_to_date")])
    return out.unionByName(small)


def deduplicate(spark, source: str, target: str, rank: Column, date: str, least: int = 0, compression: str = "gzip", file_bytes: int = 1 << 28) -> None:
    """Read the archives under source, resolve, and write deduplicated archives with fresh headers to target, each of about
    `file_bytes` of payload at most, by the records' mean length. HTTP heads are kept. Records that already are revisits, and
    records of other types, are left as they are."""
    scratch = Scratch(spark, "dedup")
    records = read_archives(spark, source, with_payload=True)
    headers = scratch.save(read_archives(spark, source), "headers")
    mean = headers.agg(F.avg("length")).first()[0] or 0
    solved = resolve_revisits(headers.where("record_type = 'response'"), rank, scratch, least).select("file", "offset", F.col("record_type").alias("new_type"), F.col("refers_to").alias("new_to"), F.col("refers_to_uri").alias("new_uri"), F.col("refers_to_date").alias("new_date"))
    out = records.join(solved.hint("merge"), ["file", "offset"], "left")
    text = [F.col(c).cast("string").alias(c) for c in ("payload", "http_head")]
    out = out.select("record_id", F.coalesce("new_type", "record_type").alias("record_type"), "uri", F.lit(date).alias("date"), "digest", F.coalesce("new_to", "refers_to").alias("refers_to"), F.coalesce("new_uri", "refers_to_uri").alias("refers_to_uri"), F.coalesce("new_date", "refers_to_date").alias("refers_to_date"), "content_type", *text)
    write_archives(out, target, compression, most_records=max(1, int(file_bytes // (mean + 1000))))
    scratch.drop("headers", "originals")
