import hashlib

import pytest
from pyspark.sql import functions as F

from granary.sources import fetch
from granary.streaming import snapshots

PAGE = b"<p>" + b"x" * 1000


def stub():
    """A getter that workers need not import."""

    def get(url):
        html = {"content-type": "text/html; charset=utf-8", "etag": "e"}
        if url.endswith("away"):
            return fetch.Response(200, "https://evil.org/", html, PAGE)
        if url.endswith("pdf"):
            return fetch.Response(200, url, {"content-type": "application/pdf"}, PAGE)
        if url.endswith("short"):
            return fetch.Response(200, url, html, b"x")
        if url.endswith("gone"):
            raise fetch.HttpError(404)
        return fetch.Response(200, url, html, PAGE)

    return get


def test_failures_are_rows_and_equal_content_is_unchanged(spark):
    names = ["new", "same", "away", "pdf", "short", "gone"]
    sources = spark.createDataFrame([(n, f"https://www.a.org/{n}") for n in names], "source_id string, url string")
    latest = spark.createDataFrame([("same", hashlib.sha256(PAGE).hexdigest()), ("new", "0")], "source_id string, content_sha256 string")
    rows = fetch.fetch(sources, ["WWW.a.org"], stub(), latest, sleep=lambda s: None).cache()
    got = {r.source_id: r for r in rows.collect()}
    assert {k: r.status for k, r in got.items()} == {"new": "saved", "same": "unchanged", "away": "failed", "pdf": "failed", "short": "failed", "gone": "failed"}
    assert bytes(got["new"].content) == PAGE and got["same"].content is None and got["gone"].error == "HTTP status 404"
    assert {r.status: r.n for r in fetch.outcome(rows).collect()} == {"saved": 1, "unchanged": 1, "failed": 4}


def test_retry_waits(spark):
    calls, waits = [], []

    def get(url):
        calls.append(url)
        if len(calls) == 1:
            raise fetch.HttpError(429, "7")
        if len(calls) == 2:
            raise fetch.HttpError(503)
        return fetch.Response(200, url, {}, b"")

    assert fetch.get_with_retry(get, "u", sleep=waits.append).status == 200
    assert waits[0] == 7 and 10 <= waits[1] <= 11 and len(calls) == 3
    assert fetch.wait_before(9, fetch.HttpError(429), lambda: 0.5) == 60.5
    with pytest.raises(ValueError):
        fetch.http_get(" ")


def test_stream_adds_each_document_once(spark, tmp_path):
    given, out, at = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")
    rows = lambda *r: spark.createDataFrame(r, "d int, content string").write.mode("append").parquet(given)
    rows((1, "a b c"), (1, "a b c"), (2, "d"))
    for _ in range(2):
        stream = snapshots.read_snapshots(spark, given, "d int, content string")
        snapshots.chunk_into(stream, ["d"], out, at, 2, 0).awaitTermination()
        rows((2, "again"), (3, "e f"))
    got = sorted((r.d, r.chunk_index, r.content) for r in spark.read.parquet(out).collect())
    # a changed document is one of its own; what was seen comes once
    assert got == [(1, 0, "a b"), (1, 1, "c"), (2, 0, "again"), (2, 0, "d"), (3, 0, "e f")]


def test_newest_of_a_stream(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([("s", 1, 1, "old"), ("s", 2, 1, "x"), ("s", 2, 2, "new")], "s string, at int, k int, v string").write.parquet(path)
    stream = snapshots.newest(snapshots.read_snapshots(spark, path, "s string, at int, k int, v string"), "s", "at", "k")
    stream.writeStream.format("memory").queryName("newest").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in spark.table("newest").collect()] == [("s", 2, 2, "new")]
