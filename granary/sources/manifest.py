"""The allow-list of sources: read from YAML, checked, selected."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCE = ("source_id", "rule_number", "title", "source_type", "url")
ROW = "ordinal int, " + ", ".join(f"{c} string" for c in SOURCE)


class ManifestError(ValueError):
    """A manifest that can't be used; the message says why."""


@dataclass(frozen=True)
class Manifest:
    corpus_name: str
    scope: str
    hosts: list[str]
    sources: DataFrame


def read_manifest(spark: SparkSession, path: str, scope: str, id_pattern: str | None = None) -> Manifest:
    """The manifest at path, with its sources in order; any fault of it or of one of its sources is an error."""
    import yaml

    try:
        text = spark.read.text(path, wholetext=True).first()
        root = yaml.safe_load(text[0] if text else "")
    except yaml.YAMLError as e:
        raise ManifestError(f"not valid YAML: {e}") from e
    if not isinstance(root, dict):
        raise ManifestError("the root must be a mapping")
    if root.get("version") != 1:
        raise ManifestError("version must be 1")
    words = {k: root[k].strip() if isinstance(root.get(k), str) else "" for k in ("corpus_name", "scope")}
    if blank := sorted(k for k, v in words.items() if not v):
        raise ManifestError(f"missing or blank: {', '.join(blank)}")
    if words["scope"] != scope:
        raise ManifestError(f"scope must be {scope}")
    hosts, listed = root.get("allowed_hosts"), root.get("sources")
    if not isinstance(hosts, list) or not hosts or not all(isinstance(h, str) and h.strip() for h in hosts):
        raise ManifestError("allowed_hosts must be a list of names")
    if not isinstance(listed, list) or not listed:
        raise ManifestError("there are no sources")
    rows = []
    for i, item in enumerate(listed):
        if not isinstance(item, dict) or not all(item.get(c) is None or isinstance(item[c], str) for c in SOURCE):
            raise ManifestError(f"source {i}: must be a mapping of texts")
        rows.append((i, *(None if item.get(c) is None else item[c].strip() for c in SOURCE)))
    allowed = sorted({h.strip().lower() for h in hosts})
    sources = spark.createDataFrame(rows, ROW)
    checked = validate(sources, allowed, **({"id_pattern": id_pattern} if id_pattern else {}))
    if bad := checked.filter("error is not null").orderBy("ordinal").first():
        raise ManifestError(f"source {bad['ordinal']}: {bad['error']}")
    if twice := duplicates(sources).orderBy("source_id").first():
        raise ManifestError(f"duplicate source id: {twice['source_id']}")
    return Manifest(words["corpus_name"], words["scope"], allowed, sources)


def validate(sources: DataFrame, hosts: list[str], id_pattern: str = r"^[a-z]+(?:-[a-z0-9]+)+$", kinds: tuple[str, ...] = ("rule", "guidance")) -> DataFrame:
    """sources (ordinal, source_id, rule_number, title, source_type, url), texts trimmed, with error, null where a row is valid."""
    sources = sources.withColumns({c: F.trim(c) for c in SOURCE if c in sources.columns})
    part = lambda x: F.try_parse_url("url", F.lit(x))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    checks = [
        (blank("source_id") | blank("title") | blank("url"), "required field is blank"),
        (~F.col("source_id").rlike(id_pattern), "bad source id"),
        (~F.coalesce(F.col("source_type").isin(*kinds), F.lit(False)), "unknown source type"),
        (F.coalesce(part("PROTOCOL"), F.lit("")) != "https", "url is not https"),
        (part("USERINFO").isNotNull(), "url has credentials"),
        (part("QUERY").isNotNull() | part("REF").isNotNull(), "url has a query or fragment"),
        (~F.coalesce(F.lower(part("HOST")).isin(*[h.lower() for h in hosts]), F.lit(False)), "host is not allowed"),
        ((F.col("source_type") == "rule") & F.col("rule_number").isNull(), "rule number is missing"),
        (F.col("rule_number").isNotNull() & ~F.col("rule_number").rlike(r"^\d{4}$"), "bad rule number"),
    ]
    return sources.withColumn("error", F.coalesce(*(F.when(bad, message) for bad, message in checks)))


def duplicates(sources: DataFrame) -> DataFrame:
    return sources.groupBy("source_id").count().filter("count > 1").select("source_id")


def select(sources: DataFrame, ids: list[str] | None) -> DataFrame:
    """The named sources in manifest order, all if none are named; unknown ids are an error that names them."""
    if not ids:
        return sources.orderBy("ordinal")
    wanted = sources.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], "source_id string")
    if unknown := sorted(r[0] for r in wanted.join(sources, "source_id", "left_anti").collect()):
        raise ValueError(f"unknown sources: {', '.join(unknown)}")
    return sources.join(F.broadcast(wanted), "source_id", "left_semi").orderBy("ordinal")


def source(sources: DataFrame, source_id: str) -> DataFrame:
    """The row of one source; an id that isn't there is an error."""
    found = sources.filter(F.col("source_id") == source_id)
    if not found.limit(1).count():
        raise LookupError(f"no such source: {source_id}")
    return found
