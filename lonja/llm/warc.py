"""WARC archives: writing captures as request, response and metadata records, reading records, assembling transactions.

The writer is Spark's text sink: a record is header, block and the separator of two line ends that the format demands,
which is the sink's line separator. Files are gzip-compressed as a whole. The reader takes files as binary rows and
follows Content-Length, so that payloads may hold anything.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lonja.llm.common import scratch

#: Equal payloads of at least so many bytes are stored once.
LEAST_REVISIT_BYTES = 100
_END = "\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD = "record_id string, type string, uri string, date string, concurrent_to string, refers_to string, payload_digest string, payload_bytes long, payload binary, fields map<string,string>"


def _urn(kind: str, *parts: Column) -> Column:
    h = F.md5(F.concat_ws("\n", F.lit(kind), *(F.coalesce(p.cast("string"), F.lit("\0")) for p in parts)))
    return F.concat(F.lit("<urn:uuid:"), *(x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, a, n), F.lit("-" if a < 21 else ">"))))


def _record(headers: list[tuple[str, Column | str | None]], block: Column) -> Column:
    parts: list[Column] = [F.lit("WARC/1.1" + _END)]
    for name, value in headers:
        value = F.lit(value) if isinstance(value, str) else value
        parts.append(F.when(value.isNotNull(), F.concat(F.lit(name + ": "), value, F.lit(_END))).otherwise(""))
    return F.concat(*parts, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(_END * 2), block)


def captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Decides for each page whether its payload is stored (response) or refers to an equal one (revisit).

    The page with the smallest id among equal payloads of at least LEAST_REVISIT_BYTES bytes is the response; rows with
    a null id are responses. Hot payloads: the smallest id is a partial minimum, and the join back is an inner-sized
    equi-join with one row per payload, which adaptive execution splits."""
    body = F.coalesce(F.col(body_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.regexp_replace(F.regexp_replace(F.col(url_col), "\r", "%0D"), "\n", "%0A").alias("url"), body.alias("body"))
    rows = rows.withColumn("bytes", F.octet_length("body").cast("long")).withColumn("digest", F.sha2("body", 256))
    firsts = rows.where((F.col("bytes") >= LEAST_REVISIT_BYTES) & F.col("page_id").isNotNull()).groupBy("digest")
    firsts = firsts.agg(F.min(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    joined = rows.join(firsts, "digest", "left")
    revisit = F.coalesce(F.col("first.page_id") != F.col("page_id"), F.lit(False))
    return joined.withColumn("type", F.when(revisit, "revisit").otherwise("response")).withColumn("first", F.when(revisit, F.col("first")))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", date: str = "2024-01-01T00:00:00Z", records_per_file: int = 60_000) -> None:
    """Writes a request, a response or revisit, and a metadata record for each page. Null bodies are empty, null urls
    have no target header; line ends in urls are percent-encoded."""
    c = captures(pages, id_col, url_col, body_col)
    own, of_first = _urn("response", F.col("page_id"), F.col("url"), F.col("digest")), _urn("response", F.col("first.page_id"), F.col("first.url"), F.col("digest"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "), F.col("bytes").cast("string"), F.lit(_END * 2))
    common = [("WARC-Date", date), ("WARC-Target-URI", F.col("url"))]
    revisit = F.col("type") == "revisit"
    main = _record(
        [("WARC-Type", F.col("type")), ("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), ("WARC-Refers-To", F.when(revisit, of_first)), ("WARC-Refers-To-Target-URI", F.when(revisit, F.col("first.url"))), ("WARC-Profile", F.when(revisit, F.lit(_PROFILE))), ("Content-Type", "application/http; msgtype=response")],
        F.when(revisit, http).otherwise(F.concat(http, F.col("body"))),
    )
    place = F.regexp_extract(F.coalesce("url", F.lit("")), "^[^:]*://([^/?#]*)([^#]*)", 2)
    ask = F.concat(F.lit("GET "), F.when(place == "", "/").otherwise(place), F.lit(f" HTTP/1.1{_END}Host: "), F.regexp_extract(F.coalesce("url", F.lit("")), "^[^:]*://([^/?#]*)", 1), F.lit(_END * 2))
    request = _record([("WARC-Type", "request"), ("WARC-Record-ID", _urn("request", F.col("page_id"), F.col("url"), F.col("digest"))), *common, ("WARC-Concurrent-To", own), ("Content-Type", "application/http; msgtype=request")], ask)
    about = F.concat_ws(_END, F.concat(F.lit("page-id: "), F.col("page_id").cast("string")), F.concat(F.lit("refers-to-page: "), F.col("first.page_id").cast("string")), F.lit(""))
    metadata = _record([("WARC-Type", "metadata"), ("WARC-Record-ID", _urn("metadata", F.col("page_id"), F.col("url"), F.col("digest"))), *common, ("WARC-Concurrent-To", own), ("Content-Type", "application/warc-fields")], about)
    lines = c.select(F.explode(F.array(request, main, metadata)).alias("value"))
    lines.write.option("lineSep", _END * 2).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


class _Inflated(io.RawIOBase):
    """Plain, gzip or record-wise gzip content as a stream, inflated piece by piece. Damaged or cut gzip content ends the
    stream where the damage begins, and ``broken`` is set."""

    def __init__(self, content: bytes):
        self.at, self.content, self.left, self.broken = 0, memoryview(content), b"", False
        self.zip = zlib.decompressobj(31) if content[:2] == b"\x1f\x8b" else None

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        while not self.left and not self.broken and (self.at < len(self.content) or self.zip and self.zip.unused_data):
            if self.zip and self.zip.eof:
                self.at -= len(self.zip.unused_data)
                self.zip = zlib.decompressobj(31)
            piece = self.content[self.at : self.at + (1 << 18)]
            self.at += len(piece)
            try:
                self.left = self.zip.decompress(piece) if self.zip else bytes(piece)
            except zlib.error:
                self.broken = True
        if not self.left and self.zip and not self.zip.eof:
            self.broken = True
        n = min(len(out), len(self.left))
        out[:n] = self.left[:n]
        self.left = self.left[n:]
        return n


_BROKEN = dict.fromkeys(("record_id", "uri", "date", "concurrent_to", "refers_to", "payload_digest", "payload_bytes", "payload", "fields")) | {"type": "broken"}


def _length(value: str | None) -> int | None:
    """A Content-Length, null if it is no number of bytes."""
    return int(value) if value and value.isascii() and value.isdigit() and len(value) < 19 else None


def parse_records(content: bytes, with_payload: bool = True) -> Iterator[dict]:
    """The records of one archive, by Content-Length. Where a line is no record start, a length is missing or no number, a block
    ends before its length, or gzip content is damaged or cut, the rest cannot be divided: it gives one record of type
    ``broken`` with its number of bytes, and ends the archive."""
    raw = _Inflated(content)
    stream = io.BufferedReader(raw, 1 << 18)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            yield _BROKEN | {"payload_bytes": len(line) + sum(map(len, iter(lambda: stream.read(1 << 18), b"")))}
            return
        head = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        size = _length(head.get("content-length"))
        block = stream.read(size)
        if size is None or len(block) < size:
            yield _BROKEN | {"record_id": head.get("warc-record-id"), "uri": head.get("warc-target-uri"), "payload_bytes": len(block)}
            return
        kind, fields, payload, size, digest = head.get("warc-type"), {}, None, None, None
        if kind in ("response", "revisit"):
            http, _, payload = block.partition(b"\r\n\r\n")
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
            if kind == "response":
                size, digest = len(payload), hashlib.sha256(payload).hexdigest()
            else:
                payload, size, digest = None, _length(fields.get("content-length")), head.get("warc-payload-digest", "").rpartition(":")[2] or None
        elif head.get("content-type") == "application/warc-fields":
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").splitlines()) if k}
        else:
            payload = block
        yield {
            "record_id": head.get("warc-record-id"), "type": kind, "uri": head.get("warc-target-uri"), "date": head.get("warc-date"), "concurrent_to": head.get("warc-concurrent-to"), "refers_to": head.get("warc-refers-to"),
            "payload_digest": digest, "payload_bytes": size, "payload": payload if with_payload else None, "fields": fields,
        }
    if raw.broken:
        yield _BROKEN | {"payload_bytes": 0}


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives in path. An archive is read by one task, piece by piece once loaded; the
    writer's records_per_file bounds it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for content in pdf["content"]:
                rows = []
                for row in parse_records(content, with_payload):
                    rows.append(row)
                    if len(rows) >= 256:
                        yield pd.DataFrame(rows).astype({"payload_bytes": "Int64"})
                        rows = []
                if rows:
                    yield pd.DataFrame(rows).astype({"payload_bytes": "Int64"})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, _RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit with the request and metadata concurrent to it.

    A capture without request or metadata has null there; of several the first by record id counts; request and
    metadata without a capture are left out. Repeated captures each give a row."""
    fields = [F.col(c) for c in records.columns]
    record = F.struct(*fields)

    def of(kind: str) -> DataFrame:
        own = records.where((F.col("type") == kind) & F.col("concurrent_to").isNotNull()).select(F.col("concurrent_to").alias("id"), record.alias(kind))
        return own.groupBy("id").agg(F.min_by(kind, F.col(f"{kind}.record_id")).alias(kind))

    main = records.where(F.col("type").isin("response", "revisit")).select(F.col("record_id").alias("id"), record.alias("response"))
    return main.join(of("request"), "id", "left").join(of("metadata"), "id", "left").withColumnRenamed("id", "capture_id")


def round_trip(pages: DataFrame, with_payload: bool = False) -> DataFrame:
    """Writes pages as archives into the shared folder, reads them back and assembles the captures."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_warc(pages, path)
    return assemble(read_warc(spark, path, with_payload))


def page_captures(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each page, from its archived capture."""
    r, m = F.col("response"), F.col("metadata.fields")
    return round_trip(pages).select(
        m["page-id"].cast("long").alias("page_id"), r["payload_bytes"].alias("payload_bytes"), r["payload_digest"].alias("payload_digest"), r["type"].alias("record_type"), m["refers-to-page"].cast("long").alias("refers_to")
    )
