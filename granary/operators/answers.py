"""Evidence answers and citation checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ABSTENTION = "No stored passage answers this question."
PREAMBLE = "These stored passages match the question best; read them in full where it matters.\n\n"
EXCERPT = 500


def grounded_answers(questions: DataFrame, passages: DataFrame, query: str, top_k: int = 5) -> DataFrame:
    """query, answer, abstained, n_citations, citations; passages (query, rank, key, content) at most top_k each."""
    held = passages.filter(F.col("rank") <= top_k).groupBy(query).agg(F.array_sort(F.collect_list(F.struct("rank", "key", "content"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] "), x["content"])), "\n\n")
    cited = F.transform("p", lambda x: F.struct(x["key"].alias("key"), F.substring(x["content"], 1, EXCERPT).alias("excerpt")))
    out = questions.select(query).join(held, query, "left")
    return out.select(
        query,
        F.when(F.col("p").isNull(), ABSTENTION).otherwise(F.concat(F.lit(PREAMBLE), text)).alias("answer"),
        F.col("p").isNull().alias("abstained"),
        F.coalesce(F.size("p"), F.lit(0)).alias("n_citations"),
        cited.alias("citations"),
    )


def check_citations(citations: DataFrame, passages: DataFrame, query: str, on: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """citations with valid: the first passage that agrees in `on`, null with null, holds the excerpt; its `carry` come as passage_*."""
    first = passages.withColumn("_n", F.row_number().over(Window.partitionBy(query, *on).orderBy("rank"))).filter("_n = 1")
    right = first.select(F.col(query).alias("_q"), *(F.col(c).alias(f"_{c}") for c in on), F.col("content").alias("_content"), *(F.col(c).alias(f"passage_{c}") for c in carry))
    match = F.col(query) == F.col("_q")
    for c in on:
        match = match & F.col(c).eqNullSafe(F.col(f"_{c}"))
    joined = citations.join(right, match, "left")
    return joined.withColumn("valid", F.coalesce(F.col("_content").contains(F.col("excerpt")), F.lit(False))).select(*citations.columns, "valid", *(f"passage_{c}" for c in carry))
