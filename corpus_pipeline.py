"""A corpus through quality rules, near-duplicate removal, decontamination, redaction and packing.

Defined results of the stages: a null text has no words, which the quality rules reject; rows that repeat a doc_id and
its text are one document and go or stay together; the texts of one doc_id are judged each for itself, and of those in
one group one stays; documents without a doc_id count as the last ones of their group, each text for itself, and exact
copies among them leave one row, unless they have no word; of several texts of one doc_id in one group the one that
stays is the one whose hash is least; texts are read whole, however long; an empty table stays empty; other columns are
kept as they are, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import decontaminate, ngram_join, packing, pii, quality
from granary.llm.queries import tokenizer_path
from granary.llm.storage import cut, remove, shared_dir, volume
from granary.llm.storage import sized as in_parts
from granary.session import table

ORACLE_SQL = None


def sized(df: DataFrame, docs: DataFrame) -> DataFrame:
    """What is left of docs, in files of some thousands of documents or 16 MB of text."""
    return in_parts(df, *volume(docs), each_rows=8000)


#: near copies share four fifths of their five-word shingles; op6's own rule (three words, nine tenths) binds only op6
NEAR = ngram_join.Join(size=5, percent=80)
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
UNNAMED = 1 << 62  # documents without a doc_id are counted from here


def aside(docs: DataFrame) -> DataFrame:
    """docs with columns that documents don't have under names that no operator uses."""
    return docs.select(*(F.col(f"`{c}`").alias(c if c in COLUMNS else f"_own_{i}") for i, c in enumerate(docs.columns)))


def back(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, under their names, of what became of aside(docs)."""
    return found.select(*(F.col(c if c in COLUMNS else f"_own_{i}").alias(c) for i, c in enumerate(docs.columns)))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return sized(back(quality.judge(aside(docs)).filter("kept"), docs), docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five-word Jaccard of 0.8 or more) the document with the smallest doc_id."""
    held = aside(docs)
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    several = cut(held.filter("doc_id is not null").groupBy("doc_id").agg(F.min(text_hash).alias("low"), F.max(text_hash).alias("high")).filter("low <> high").select(F.col("doc_id").alias("_several")))
    if several.count() <= decontaminate.BROADCAST_ROWS:
        several = F.broadcast(several)
    of_text = F.lit(UNNAMED) + F.pmod(F.xxhash64("doc_id", text_hash), F.lit(UNNAMED))
    keyed = held.join(several, held["doc_id"] == several["_several"], "left").withColumn("_key", F.when(F.col("doc_id").isNotNull() & F.col("_several").isNull(), F.col("doc_id")).otherwise(of_text))
    linked = cut(ngram_join.join_components(keyed.select(F.col("_key").alias("doc_id"), "text"), NEAR).select(F.col("doc_id").alias("_key"), F.col("component_id").alias("_root")))
    # Roots are smallest keys; a text of a doc_id with several may come before one.
    texts = keyed.filter("_several is not null").select("_key", F.col("_several").alias("_id")).distinct()
    least = linked.join(texts, "_key").groupBy("_root").agg(F.min(F.struct("_id", "_key")).alias("_least"))
    moved = cut(least.filter("_least._id < _root").select("_root", F.col("_least._key").alias("_first")))
    if moved.count() <= decontaminate.BROADCAST_ROWS:  # else a large group would be dealt by its root
        moved = F.broadcast(moved)
    later = linked.join(moved, "_root", "left").filter(F.col("_key") != F.coalesce("_first", "_root")).select("_key").distinct()
    rest = keyed.join(later, "_key", "left_anti")
    exact = F.col("doc_id").isNull() & F.coalesce(F.col("text").rlike(r"[^ \t-\r]"), F.lit(False))
    own = F.struct(*held.columns)
    once = rest.filter(exact).groupBy("_key").agg(F.min_by(own, F.to_json(own)).alias("_row")).select("_row.*")
    return sized(back(rest.filter(~exact).select(*held.columns).union(once), docs), docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    keyed = aside(docs).withColumn("_key", F.xxhash64("doc_id", "text"))
    judged = decontaminate.decontaminate(keyed.select(F.col("_key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    hit = judged.filter("contaminated").select(F.col("doc_id").alias("_key"))
    return sized(back(keyed.join(hit, "_key", "left_anti"), docs), docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind, and n_chars of what is left."""
    held = aside(docs)
    found = pii.annotate(held, pii.fit(held)).withColumn("text", pii.redacted(F.col("text"), F.col("spans")))
    chars = F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return sized(back(found.withColumn("n_chars", chars), docs), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality_rules", keep_quality),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("benchmark_decontamination", keep_uncontaminated),
    ("pii", redact_personal_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's result is written to the shared folder, read again, and removed once used."""
    root, docs, used = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        if used:
            remove(spark, used)
        used = f"{root}/{name}"
        docs = spark.read.parquet(used)
    return docs
