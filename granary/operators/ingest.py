"""Snapshots, idempotent ingestion and data quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def changed_snapshots(snapshots: DataFrame, source: str, order: list[str], content: Column) -> DataFrame:
    """snapshots with status saved or unchanged: only the latest one before counts, so a return to older content is saved."""
    digest = F.sha2(content, 256)
    before = F.lag(digest).over(Window.partitionBy(source).orderBy(*order))
    return snapshots.withColumn("status", F.when(digest.eqNullSafe(before), "unchanged").otherwise("saved"))


def new_documents(incoming: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """Rows of incoming whose key is not there yet, once for each key."""
    return incoming.dropDuplicates(key).join(existing.select(*key).distinct(), key, "left_anti")


def backfill(chunks: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """chunks with null embeddings filled from vectors (key, embedding)."""
    held = vectors.select(F.col(key).alias("_k"), F.col("embedding").alias("_e"))
    joined = chunks.join(held, F.when(F.col("embedding").isNull(), F.col(key)) == F.col("_k"), "left")
    return joined.select(*(F.coalesce("embedding", "_e").alias(c) if c == "embedding" else c for c in chunks.columns))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n): rows that break each rule, in one pass."""
    counts = df.agg(*(F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()))
    return counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, rules)), F.array(*rules))).alias("rule", "n"))


def distinct_rows(df: DataFrame, key: list[str]) -> DataFrame:
    """Of each key one row, the same one whatever the order of rows."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r")).select(*key, "_r.*") if rest else df.distinct()
