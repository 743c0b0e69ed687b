"""The stored corpus: documents with their chunks, appended once for each key, and embeddings beside them.

A document and its chunks are one row, so an append is all or nothing: Spark's file commit makes all rows of a job
visible, or none. Embeddings are rows of their own, so filling them in later rewrites nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import chunking, ingest, retrieval
from granary.operators.normalize import document_id
from granary.session import folder
from granary.sources import embed

#: one document for each
UNIQUE = ("source_id", "normalized_content_hash", "chunk_target_tokens", "chunk_overlap_tokens")
DOCUMENT = (
    "document_id string, source_id string, rule_number string, title string, source_type string, source_url string, latest_effective_date date, retrieved_at timestamp, raw_content_hash string, "
    "normalized_content_hash string, parser_version string, chunk_target_tokens int, chunk_overlap_tokens int, "
    "chunks array<struct<chunk_id:string,section_path:string,subsection:string,chunk_index:int,content:string,token_count:int,content_hash:string>>"
)
EMBEDDING = "chunk_id string, embedding array<float>, embedding_model string"
#: a retrieved passage
PASSAGE = ("chunk_id", "document_id", "rule_number", "title", "source_type", "source_url", "retrieved_at", "section_path", "subsection", "content", "score")


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    root: str

    def _read(self, name: str, schema: str) -> DataFrame:
        """The rows there are; none if nothing was ever written."""
        return self.spark.read.schema(schema).parquet(folder(self.spark, f"{self.root}/{name}"))

    def documents(self) -> DataFrame:
        return self._read("documents", DOCUMENT)

    def chunks(self) -> DataFrame:
        """One row per chunk, with its document's columns and its embedding."""
        parts = self.documents().select("*", F.explode("chunks").alias("c")).select("*", "c.*").drop("c", "chunks")
        vectors = self._read("embeddings", EMBEDDING).groupBy("chunk_id").agg(F.min_by(F.struct("embedding", "embedding_model"), "embedding_model").alias("e"))
        return parts.join(vectors, "chunk_id", "left").select(*parts.columns, "e.embedding", "e.embedding_model")

    def newest_chunks(self) -> DataFrame:
        """Chunks of each source's newest document."""
        return retrieval.newest_only(self.chunks(), self.documents(), "document_id", "source_id", "retrieved_at")

    def add(self, normalized: DataFrame, target: int = 600, overlap: int = 50) -> int:
        """Documents that are new under their key, appended with their chunks; how many they are."""
        sections = normalized.select("source_id", "normalized_content_hash", F.posexplode("sections").alias("at", "s")).select("source_id", "normalized_content_hash", "at", "s.section_path", F.col("s.label").alias("subsection"), "s.content")
        day = F.col("latest_effective_date").cast("date")
        rows = normalized.withColumns({"chunk_target_tokens": F.lit(target), "chunk_overlap_tokens": F.lit(overlap), "latest_effective_date": day, "retrieved_at": F.col("retrieved_at").cast("timestamp")})
        rows = rows.withColumn("document_id", document_id(*map(F.col, UNIQUE)))
        fresh = ingest.new_documents(rows, self.documents(), list(UNIQUE)).drop("sections", "history", "audit", "excluded")
        own = ["source_id", "normalized_content_hash"]
        cut = chunking.chunk(sections, own, "at", target, overlap, carry=("section_path", "subsection"))
        named = cut.join(fresh.select(*own, "document_id"), own).withColumn("chunk_id", document_id(F.col("document_id"), F.col("chunk_index")))
        fields = ("chunk_id", "section_path", "subsection", "chunk_index", "content", "token_count", "content_hash")
        listed = named.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", F.struct(*fields).alias("c")))).alias("cs")).select("document_id", F.col("cs.c").alias("chunks"))
        columns = [part.split()[0] for part in DOCUMENT.split(", ")]
        out = fresh.join(listed, "document_id", "left").select(columns)
        before = self.documents().count()
        out.write.mode("append").parquet(f"{self.root}/documents")
        return self.documents().count() - before

    def embed(self, provider: embed.Provider, model: str | None = None) -> int:
        """Embeddings of chunks that have none, in order of their index; how many they are."""
        bare = self.chunks().filter("embedding is null").select("document_id", "chunk_index", "chunk_id", "content")
        rows = embed.embed(bare.sortWithinPartitions("document_id", "chunk_index"), "content", provider).select("chunk_id", "embedding", F.lit(model or provider.name).alias("embedding_model"))
        before = self._read("embeddings", EMBEDDING).count()
        rows.write.mode("append").parquet(f"{self.root}/embeddings")
        return self._read("embeddings", EMBEDDING).count() - before


def passages(ranked: DataFrame, chunks: DataFrame, query: str, key: str = "chunk_id") -> DataFrame:
    """Ranked chunks (query, key, score, rank) as passages, with query and rank."""
    return ranked.join(chunks.drop("score", "rank"), key).select(query, "rank", *PASSAGE)


def orphans(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks whose document isn't there."""
    return chunks.join(documents.select("document_id"), "document_id", "left_anti")


def without(chunks: DataFrame, removed: DataFrame) -> DataFrame:
    """Chunks left when the documents in removed (document_id) are deleted."""
    return chunks.join(removed.select("document_id").distinct(), "document_id", "left_anti")


def repeated(rows: DataFrame, unique: list[str]) -> DataFrame:
    """(unique, n): keys that come more than once."""
    return rows.groupBy(*unique).agg(F.count("*").alias("n")).filter("n > 1")
