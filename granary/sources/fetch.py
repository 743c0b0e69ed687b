"""Snapshots of allow-listed pages: fetched in tasks, a failing source is a row."""

from __future__ import annotations

import hashlib
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from typing import NamedTuple
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.sources import snapshots

MIN_BYTES, ATTEMPTS, CONNECTIONS, TIMEOUT = 1000, 3, 2, 30
LONGEST_WAIT = 60.0
AGENT_VERSION = "granary-fetch-1"
SNAPSHOT = (
    "source_id string, requested_url string, retrieved_at timestamp, status string, error string, http_status int, final_url string, content_type string, "
    "content_length_bytes long, content binary, content_sha256 string, etag string, last_modified string, fetcher_version string"
)


class Response(NamedTuple):
    status: int
    url: str
    headers: dict[str, str]
    body: bytes


class HttpError(Exception):
    def __init__(self, status: int, retry_after: str | None = None) -> None:
        super().__init__(f"HTTP status {status}")
        self.status, self.retry_after = status, retry_after


def http_get(agent: str) -> Callable[[str], Response]:
    """A getter that follows redirects and names itself; agent must say whom to contact."""
    if not agent.strip():
        raise ValueError("a contact is needed for the user agent")

    def get(url: str) -> Response:
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=TIMEOUT) as r:
                return Response(r.status, r.url, {k.lower(): v for k, v in r.headers.items()}, r.read())
        except urllib.error.HTTPError as e:
            raise HttpError(e.code, e.headers.get("Retry-After")) from e

    return get


def wait_before(attempt: int, error: Exception, jitter: Callable[[], float] = random.random) -> float:
    """Seconds to wait after a failed attempt (from 1): what a 429 asks for, else doubling from 10 (429) or 5."""
    limited = isinstance(error, HttpError) and error.status == 429
    if limited and (error.retry_after or "").strip().isdigit():
        return float(error.retry_after)
    return min((10.0 if limited else 5.0) * 2 ** (attempt - 1), LONGEST_WAIT) + jitter()


def get_with_retry(get: Callable[[str], Response], url: str, attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> Response:
    """Every HTTP or network error is tried again; the last one is raised."""
    for attempt in range(1, attempts + 1):
        try:
            return get(url)
        except (HttpError, OSError) as e:
            if attempt == attempts:
                raise
            sleep(wait_before(attempt, e))
    raise ValueError("attempts must be positive")


def checked(r: Response, hosts: list[str], min_bytes: int = MIN_BYTES) -> Response:
    """r, if it came by HTTPS from an allowed host, is HTML and long enough."""
    at = urlsplit(r.url)
    if at.scheme != "https" or (at.hostname or "").lower() not in {h.lower() for h in hosts}:
        raise ValueError(f"redirected to a host that is not allowed: {at.hostname}")
    if r.headers.get("content-type", "").split(";")[0].strip().lower() != "text/html":
        raise ValueError("content is not HTML")
    if len(r.body) < min_bytes:
        raise ValueError(f"content has {len(r.body)} bytes, fewer than {min_bytes}")
    return r


def utc_now() -> str:
    return datetime.now(timezone.utc).isoformat()


def fetch(sources: DataFrame, hosts: list[str], get: Callable[[str], Response], latest: DataFrame | None = None, connections: int = CONNECTIONS, sleep: Callable[[float], None] = time.sleep, now: Callable[[], str] = utc_now) -> DataFrame:
    """One row per source (source_id, url): status saved, unchanged or failed with its error, and what was fetched.

    latest (source_id, content_sha256) has the newest snapshot of each source; equal content is unchanged and carries
    no bytes. At most `connections` tasks fetch at a time. A retried task fetches again, so write the rows once and
    read them from there.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [part.split()[0] for part in SNAPSHOT.split(", ")]
        for batch in batches:
            for key, url in zip(batch["source_id"], batch["url"]):
                try:
                    r = checked(get_with_retry(get, url, sleep=sleep), hosts)
                    held = ("saved", None, r.status, r.url, r.headers["content-type"], len(r.body), r.body, hashlib.sha256(r.body).hexdigest(), r.headers.get("etag"), r.headers.get("last-modified"))
                except (HttpError, OSError, ValueError) as e:
                    held = ("failed", str(e), *[None] * 8)
                out = pd.DataFrame([(key, url, pd.Timestamp(now()), *held, AGENT_VERSION)], columns=names)
                yield out.astype({"http_status": "Int32", "content_length_bytes": "Int64"})

    rows = sources.select("source_id", "url").repartition(connections, "source_id").mapInPandas(run, SNAPSHOT)
    if latest is None:
        return rows
    known = latest.select("source_id", F.col("content_sha256").alias("_known"))
    same = F.coalesce(F.col("content_sha256") == F.col("_known"), F.lit(False))
    joined = rows.join(known, "source_id", "left")
    marked = joined.withColumn("status", F.when(same, "unchanged").otherwise(F.col("status"))).withColumn("content", F.when(~same, F.col("content")))
    return marked.drop("_known")


def judged(responses: DataFrame, hosts: list[str], min_bytes: int = MIN_BYTES) -> DataFrame:
    """Responses that are already there (source_id, final_url, content_type, body) with status and error, as `checked` has it."""
    part = lambda x: F.coalesce(F.try_parse_url("final_url", F.lit(x)), F.lit(""))
    kind = F.lower(F.trim(F.substring_index(F.coalesce("content_type", F.lit("")), ";", 1)))
    size = F.coalesce(F.octet_length("body"), F.lit(0))
    checks = [
        ((part("PROTOCOL") != "https") | ~F.lower(part("HOST")).isin(*[h.lower() for h in hosts]), F.lit("redirected to a host that is not allowed")),
        (kind != "text/html", F.lit("content is not HTML")),
        (size < min_bytes, F.concat(F.lit("content has "), size.cast("string"), F.lit(f" bytes, fewer than {min_bytes}"))),
    ]
    error = F.coalesce(*(F.when(bad, message) for bad, message in checks))
    return responses.withColumn("error", error).withColumn("status", F.when(F.col("error").isNull(), "saved").otherwise("failed"))


def outcome(rows: DataFrame) -> DataFrame:
    """(status, n): how many sources were saved, unchanged or failed."""
    return rows.groupBy("status").agg(F.count("*").alias("n"))


def fetch_all(sources: DataFrame, hosts: list[str], get: Callable[[str], Response], path: str, **how) -> dict[str, int]:
    """Fetches sources (source_id, url and what else metadata keep), stores snapshots under path, and a summary beside them.

    The rows are stored as fetched before anything is derived from them, so nothing is fetched twice.
    """
    spark = sources.sparkSession
    known = snapshots.stored(spark, path)
    newest = snapshots.latest_metadata(known.select("source_id", "html_file", "content_sha256"), name="html_file")
    run = f"{path}/_runs/{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}"
    fetch(sources, hosts, get, newest, **how).write.parquet(f"{run}/rows")
    rows = spark.read.parquet(f"{run}/rows")
    kept = sources.select("source_id", "rule_number", "title", "source_type")
    snapshots.write_snapshots(rows.join(kept, "source_id", "left"), path)
    rows.drop("content").coalesce(1).write.json(f"{run}/sources")
    outcome(rows).coalesce(1).write.json(f"{run}/fetch_summary")
    return {r["status"]: r["n"] for r in outcome(rows).collect()}
