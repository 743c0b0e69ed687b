"""WARC archives: writing, reading and transaction assembly.

Each page is a request, a response (or a revisit of an equal payload) and a metadata record; request and metadata name
their response by WARC-Concurrent-To. Each record is a gzip member of its own, so archives can be read from any record
on. Members are written by Spark's text sink and read file by file, record by record, by Content-Length. Assembly joins
the three kinds of records through their identifiers to one nested row per capture.

Defined results: null html is the empty payload; null url is no target; line breaks in urls are percent-coded; a null
page_id comes back as null; rows that agree in page_id, url and html are one capture; of equal payloads with one page_id
the larger capture number is the response; payloads are kept whole, however long; a capture whose request or metadata
record is missing keeps nulls in their place; an empty table gives an empty archive and result; other columns are not
carried. A file holds some 64 MB of payloads, or one page that is longer; a record of more than 8 MB is several members.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.storage import cut, in_batches

END = "\r\n\r\n"
BROADCAST_ROWS = 100_000
MEMBER, BATCH = 8 << 20, 8 << 20
#: (bytes of a payload, pages in a file): payloads below so many bytes go into files of so many pages; longer ones alone
FILES = ((128 << 10, 512), (2 << 20, 32), (None, 1))
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _prepared(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit(""))
    url = F.replace(F.replace(F.coalesce(F.col("url"), F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    made = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), payload.alias("payload"), F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))
    return made.withColumn("capture", F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.hex(F.xxhash64("page_id", "url", "digest"))))


def revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(capture, of): captures whose payload of at least so many bytes another one holds, the one with the largest page_id."""
    thin = _prepared(pages).filter(F.col("bytes") >= least_bytes).select("digest", "page_id", "capture").distinct()
    first = thin.groupBy("digest").agg(F.max(F.struct("page_id", "capture")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", F.col("first.capture").alias("of"))
    return thin.join(first, "digest").filter("capture <> of").select("capture", "of")


def _record(kind: Column, capture: Column, own: list[Column], content_type: str, block: Column, part: str, date: str) -> Column:
    head = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: <urn:capture:"), capture, F.lit(f":{part}>")), F.lit(f"WARC-Date: {date}"), *own, F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    # concat_ws leaves out headers that are null
    return F.concat(F.concat_ws("\r\n", *head), F.lit(END), block)


def members(record: bytes) -> bytes:
    """The record as gzip members, without the last byte.

    That is the highest one of the member's length, so it is 0, which the text sink adds as the end of a line.
    """
    parts = [gzip.compress(record[i : i + MEMBER], 6, mtime=0) for i in range(0, len(record), MEMBER)]
    return b"".join(parts)[:-1]


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([members(x.as_py() + END.encode()) for x in batch.column(0)], pa.binary())], ["value"])


def write_archives(pages: DataFrame, path: str, least_bytes: int = 1000, date: str = "1970-01-01T00:00:00Z") -> None:
    """pages (page_id, url, html) as gzip-compressed archives under path."""
    tier = lambda size: sum(((size >= most).cast("int") for most, _ in FILES if most), F.lit(0)).alias("tier")
    filled = {r["tier"] for r in pages.groupBy(tier(F.coalesce(F.octet_length("html"), F.lit(0)))).count().collect()}
    again = cut(revisits(pages, least_bytes))
    if again.count() <= BROADCAST_ROWS:
        again = F.broadcast(again)
    p = _prepared(pages).join(again, "capture", "left")
    capture, url, of = F.col("capture"), F.col("url"), F.col("of")
    target = F.when(url != "", F.concat(F.lit("WARC-Target-URI: "), url))
    concurrent = F.concat(F.lit("WARC-Concurrent-To: <urn:capture:"), capture, F.lit(":response>"))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    request = F.concat(F.lit("GET "), url, F.lit(" HTTP/1.1\r\nAccept: text/html" + END))
    notes = F.concat(F.lit("payload-bytes: "), F.col("bytes").cast("string"), F.lit("\r\n"))
    answer = _record(
        F.when(of.isNull(), "response").otherwise("revisit"),
        capture,
        [target, digest, F.when(of.isNotNull(), F.lit(f"WARC-Profile: {PROFILE}")), F.concat(F.lit("WARC-Refers-To: <urn:capture:"), of, F.lit(":response>"))],
        "application/http; msgtype=response",
        F.concat(http, F.when(of.isNull(), F.col("payload")).otherwise("")),
        "response",
        date,
    )
    records = F.array(
        _record(F.lit("request"), capture, [target, concurrent], "application/http; msgtype=request", request, "request", date),
        answer,
        _record(F.lit("metadata"), capture, [target, concurrent], "application/warc-fields", notes, "metadata", date),
    )
    dealt = in_batches(p.select("*", tier(F.col("bytes"))))
    for i, (_, in_file) in enumerate(FILES):
        if i and i not in filled:
            continue
        each = dealt.filter(F.col("tier") == i).select(F.explode(records).alias("record")).select(F.col("record").cast("binary"))
        out = each.mapInArrow(_compressed, "value binary").select(F.col("value").cast("string").alias("value"))
        out.write.mode("append").option("lineSep", "\0").option("maxRecordsPerFile", in_file * 3).text(path)


def parse_records(archive: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of an uncompressed archive."""
    while first := archive.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {first[:80]!r}")
        headers = {}
        while (line := archive.readline().decode("utf-8", "replace")).strip("\r\n"):
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        block = archive.read(int(headers["content-length"]))
        archive.read(4)
        yield headers, block


FIELDS = ("type", "id", "concurrent_to", "refers_to", "uri", "date", "digest", "payload_bytes", "payload", "block")
SCHEMA = "type string, id string, concurrent_to string, refers_to string, uri string, date string, digest string, payload_bytes long, payload binary, block binary"


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record. digest is computed from a response's payload, and a revisit's header value; block is that of records without payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 7 + [pa.int64(), pa.binary(), pa.binary()]
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], list(FIELDS))

        for batch in batches:
            for content in batch.column(batch.schema.get_field_index("content")):
                rows, held = [], 0
                for h, block in parse_records(gzip.open(io.BytesIO(content.as_py()))):
                    kind, payload, digest, size = h["warc-type"], None, None, None
                    if kind in ("response", "revisit"):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        fields = dict(x.lower().split(b": ", 1) for x in http.split(b"\r\n")[1:])
                        digest = hashlib.sha1(payload).hexdigest() if kind == "response" else h["warc-payload-digest"].partition(":")[2]
                        size = len(payload) if kind == "response" else int(fields[b"content-length"])
                        block = None
                        payload = payload if with_payload and kind == "response" else None
                    rows.append((kind, h["warc-record-id"], h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-date"), digest, size, payload, block))
                    held += len(payload or b"") + len(block or b"")
                    if held > BATCH:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(run, SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: id, response, request, metadata (structs), of all records that a response or revisit ties together."""
    inner = [f for f in FIELDS if f != "payload"]
    once = lambda kinds, key: records.filter(F.col("type").isin(kinds)).dropDuplicates([key])
    response = once(["response", "revisit"], "id").select("id", F.struct(*FIELDS).alias("response"))
    parts = {k: once([k], "concurrent_to").select(F.col("concurrent_to").alias("id"), F.struct(*inner).alias(k)) for k in ("request", "metadata")}
    return response.join(parts["request"], "id", "left").join(parts["metadata"], "id", "left")


def captures(records: DataFrame) -> DataFrame:
    """One row per capture: page_id and digest from the response, bytes from the metadata, target from the request."""
    each = assemble(records)
    noted = F.regexp_extract(F.decode(F.col("metadata.block"), "UTF-8"), r"(?m)^payload-bytes: ([0-9]+)", 1)
    asked = F.regexp_extract(F.decode(F.col("request.block"), "UTF-8"), r"^GET ([^\r\n]*) HTTP/1\.1\r", 1)
    return each.select(
        page_of(F.col("id")).alias("page_id"),
        noted.try_cast("long").alias("payload_bytes"),
        F.col("response.digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        page_of(F.col("response.refers_to")).alias("refers_to"),
        asked.alias("target"),
    )


def page_of(identifier: Column) -> Column:
    """The page_id in an identifier that write_archives made."""
    return F.regexp_extract(identifier, r"^<urn:capture:(-?[0-9]+):", 1).try_cast("long")

