"""Stored snapshots: newest metadata, consistency with the bytes, the listing of sources, and what is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.session import folder


def latest_metadata(files: DataFrame, source: str = "source_id", name: str = "file_name") -> DataFrame:
    """Each source's row with the largest file name."""
    rest = [c for c in files.columns if c not in (source, name)]
    newest = files.groupBy(source).agg(F.max_by(F.struct(name, *rest), name).alias("_n"))
    return newest.select(source, *(F.col(f"_n.{c}").alias(c) for c in (name, *rest)))


def consistent(snapshots: DataFrame, metadata: DataFrame, name: str = "html_file") -> DataFrame:
    """snapshots (source_id, html_file, content) with error: what its metadata (by html_file) says that isn't so."""
    said = metadata.select(F.col(name).alias("_name"), F.col("source_id").alias("_source"), F.col("content_sha256").alias("_hash"))
    joined = snapshots.join(said, F.col(name) == F.col("_name"), "left")
    checks = [
        (F.col("_name").isNull(), "no metadata for this file"),
        (~F.col("_source").eqNullSafe(F.col("source_id")), "metadata is of another source"),
        (~F.col("_hash").eqNullSafe(F.sha2(F.col("content").cast("binary"), 256)), "content hash does not match metadata"),
    ]
    return joined.withColumn("error", F.coalesce(*(F.when(bad, message) for bad, message in checks))).select(*snapshots.columns, "error")


def listing(sources: DataFrame, metadata: DataFrame, normalized: DataFrame, key: str) -> DataFrame:
    """sources with latest_retrieved_at, latest_effective_date, normalized_content_hash and normalized: one row each.

    metadata (key, retrieved_at) and normalized (key, latest_effective_date, normalized_content_hash) hold newest rows.
    """
    fetched = metadata.select(key, F.col("retrieved_at").alias("latest_retrieved_at"))
    held = normalized.select(key, "latest_effective_date", "normalized_content_hash", F.lit(True).alias("normalized"))
    return sources.join(fetched, key, "left").join(held, key, "left").withColumn("normalized", F.coalesce("normalized", F.lit(False)))


def file_stem(at: Column, digest: Column) -> Column:
    """The name of a snapshot or document: its time and the head of its hash."""
    return F.concat(F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"), F.lit("-"), F.substring(digest, 1, 12))


#: what is stored of a snapshot: its bytes and fifteen fields of metadata
METADATA = (
    "source_id string, rule_number string, title string, source_type string, requested_url string, final_url string, retrieved_at timestamp, http_status int, content_type string, "
    "content_length_bytes long, content_sha256 string, etag string, last_modified string, html_file string, fetcher_version string"
)


def write_snapshots(rows: DataFrame, path: str, at: str = "retrieved_at", digest: str = "content_sha256") -> None:
    """Appends saved rows by source, each with the name html_file; unchanged and failed ones are not written."""
    stem = file_stem(F.col(at), F.col(digest))
    saved = rows.filter("status = 'saved'").withColumn("file_stem", stem).withColumn("html_file", F.concat(stem, F.lit(".html")))
    saved.write.mode("append").partitionBy("source_id").parquet(f"{path}/snapshots")


def stored(spark: SparkSession, path: str) -> DataFrame:
    """Stored snapshots with their metadata and content; none if nothing was ever written."""
    return spark.read.schema(f"{METADATA}, content binary").parquet(folder(spark, f"{path}/snapshots"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, and the fields of METADATA) of JSON files under path; what is no JSON object gives nulls."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.metadata.json", recursiveFileLookup=True).select(F.col("_metadata.file_name").alias("file_name"), "value")
    variant = F.try_parse_json("value")
    whole = F.coalesce(F.schema_of_variant(variant).startswith("OBJECT"), F.lit(False))
    return files.select("file_name", F.when(whole, F.from_json("value", METADATA)).alias("m")).select("file_name", "m.*")


def newest_snapshots(sources: DataFrame, metadata: DataFrame) -> DataFrame:
    """sources (source_id) with html_file of their newest metadata (source_id, file_name, html_file), or an error where there is none."""
    newest = latest_metadata(metadata.select("source_id", "file_name", "html_file"))
    error = F.when(F.col("file_name").isNull(), "no snapshot").when(F.coalesce(F.trim("html_file"), F.lit("")) == "", "metadata names no file")
    return sources.join(newest, "source_id", "left").withColumn("error", error)


def write_documents(documents: DataFrame, path: str) -> None:
    """Normalized documents as JSON lines by source, each with the name its time and hash give."""
    name = F.concat(file_stem(F.col("retrieved_at").cast("timestamp"), F.col("normalized_content_hash")), F.lit(".json"))
    documents.withColumn("file_name", name).write.mode("append").partitionBy("source_id").json(path)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases, one JSON object a line; absent lists are empty. A line that is no case is an error."""
    schema = "id string, question string, expected_rule_numbers array<string>, expected_subsections array<string>, expected_answerable boolean, reference_notes string, category string"
    none = F.array().cast("array<string>")
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return rows.withColumns({c: F.coalesce(c, none) for c in ("expected_rule_numbers", "expected_subsections")})


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_report(rows: DataFrame, summary: DataFrame, path: str) -> None:
    """Evaluation rows as CSV with lists joined by semicolons, and their summary as JSON."""
    lists = {f.name for f in rows.schema if f.dataType.typeName() == "array"}
    flat = rows.select(*(F.array_join(F.col(c).cast("array<string>"), ";").alias(c) if c in lists else F.col(c) for c in rows.columns))
    flat.write.mode("overwrite").option("header", True).csv(f"{path}/rows")
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
