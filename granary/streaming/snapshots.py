"""Ingestion of snapshots and chunks as a stream, and the newest row per source of one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from granary.operators import chunking, ingest, retrieval


def read_snapshots(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files that arrive under path, so many at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def newest(snapshots: DataFrame, source: str, at: str, key: str) -> DataFrame:
    """The newest row of each source seen so far; its state is one row per source."""
    return retrieval.latest(snapshots, source, at, key)


def chunk_into(documents: DataFrame, key: list[str], out: str, checkpoint: str, target: int = 600, overlap: int = 50) -> StreamingQuery:
    """Chunks of documents (key, content) under `out`, each key and content once, until all that is there is read.

    What was seen is kept as state, a key and a hash for each document, so no batch reads what is stored. A changed
    document has a new document_hash and its chunks are added. A micro-batch writes its own folder, so one that is run
    again after a failure replaces what it wrote.
    """
    named = [*key, "document_hash"]
    seen_once = documents.withColumn("document_hash", F.sha2(F.coalesce("content", F.lit("")), 256)).dropDuplicates(named)

    def add(batch: DataFrame, number: int) -> None:
        chunks = chunking.chunk(ingest.distinct_rows(batch.select(*named, "content"), named), named, target=target, overlap=overlap)
        chunks.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return seen_once.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
