"""Retrieval evaluation: rows per case, and a summary per configuration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evaluation_rows(cases: DataFrame, retrieved: DataFrame, case: str | list[str], top_ks: list[int]) -> DataFrame:
    """case (one column or several), top_k, expected, got, recall, reciprocal_rank, passed; cases (case, expected array), retrieved (case, rank, key).

    A case is answerable if it expects something. Retrieval runs once, for the largest k. Passages without a key count
    for passed only: ranks close up over them. If cases have expected_subsections and retrieved has subsection, rows
    have got_subsections and subsection_recall too, null where no subsection is expected.
    """
    names = [case] if isinstance(case, str) else case
    parted = "expected_subsections" in cases.columns and "subsection" in retrieved.columns
    hits = retrieved.groupBy(*names).agg(F.array_sort(F.collect_list(F.struct("rank", "key", *["subsection"][:parted]))).alias("got"))
    rows = cases.join(hits, names, "left").withColumn("top_k", F.explode(F.array(*map(F.lit, top_ks))))
    got = F.filter(F.coalesce("got", F.array().cast(hits.schema["got"].dataType)), lambda x: x["rank"] <= F.col("top_k"))
    rows = rows.withColumn("passages", got).withColumn("got", F.filter(F.transform("passages", lambda x: x["key"]), lambda x: x.isNotNull()))
    answerable = F.size("expected") > 0
    parts = []
    if parted:
        rows = rows.withColumn("got_subsections", F.filter(F.transform("passages", lambda x: x["subsection"]), lambda x: x.isNotNull() & (x != "")))
        share = F.size(F.array_intersect("got_subsections", "expected_subsections")) / F.size("expected_subsections")
        parts = ["expected_subsections", "got_subsections", F.when(answerable & (F.size("expected_subsections") > 0), share).alias("subsection_recall")]
    first = F.array_min(F.filter(F.transform("got", lambda k, i: F.when(F.array_contains("expected", k), i + 1)), lambda x: x.isNotNull()))
    return rows.select(
        *names,
        "top_k",
        "expected",
        "got",
        F.when(answerable, F.size(F.array_intersect("got", "expected")) / F.size("expected")).alias("recall"),
        F.when(answerable, F.coalesce(1 / first, F.lit(0.0))).alias("reciprocal_rank"),
        ((F.size("passages") == 0) == ~answerable).alias("passed"),
        *parts,
    )


def evaluation_grid(cases: DataFrame, rankings: dict[str, DataFrame], case: str, top_ks: list[int]) -> DataFrame:
    """evaluation_rows of every mode, size and case, with mode and configuration; rankings: mode -> (case, rank, key, ...).

    A ranking holds a mode's passages for the largest k; its first k are the passages for k.
    """
    modes = F.explode(F.array(*map(F.lit, rankings)))
    retrieved = reduce(DataFrame.unionByName, (r.withColumn("mode", F.lit(mode)) for mode, r in rankings.items()))
    rows = evaluation_rows(cases.withColumn("mode", modes), retrieved, ["mode", case], top_ks)
    return rows.withColumn("configuration", F.concat(F.col("mode"), F.lit("-top-"), F.col("top_k").cast("string")))


def evaluation_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Means over answerable cases, and of passed over all; subsection_recall (null if there is none) if rows have it."""
    parts = [F.round(F.avg("subsection_recall"), 6).alias("subsection_recall")] if "subsection_recall" in rows.columns else []
    return rows.groupBy(*by).agg(
        F.count("recall").alias("answerable"),
        F.round(F.coalesce(F.avg("recall"), F.lit(0.0)), 6).alias("recall"),
        F.round(F.coalesce(F.avg(F.when(F.col("recall").isNotNull(), F.col("reciprocal_rank"))), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.avg(F.col("passed").cast("double")), 6).alias("abstention_accuracy"),
        *parts,
    )
