"""Sections of guidance pages from their elements, and the audit of any sections against their source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INTRODUCTION, LEVELS = "Introduction", 4


def locator(selector: Column) -> Column:
    """Where an element stands, and the hash of its text."""
    where = F.concat(selector, F.lit(" > :nth-child("), (F.col("element_index") + 1).cast("string"), F.lit(")"))
    return F.struct("element_index", where.alias("selector"), F.sha2("text", 256).alias("source_text_hash"))


def guidance_sections(elements: DataFrame, key: str, title: str | None = None) -> DataFrame:
    """One section for each heading, and one for text before the first; elements (key, element_index, tag, text).

    key, section, label, heading, display_label, heading_source, section_path, section_type, content, locators. title
    names a column of elements that begins each path, body (if there) the selector of locators; rows with an error are
    left out. A heading of level n is put on the stack of headings after its first n - 1. The stack's size after
    heading i is the least of i and of level j + i - j over the headings j up to i, and what stands at depth d is the
    last heading that left a stack of size d, so four running values stand for the stack.
    """
    if "error" in elements.columns:
        elements = elements.filter("error is null")
    order = Window.partitionBy(key).orderBy("element_index").rowsBetween(Window.unboundedPreceding, 0)
    level = F.when(F.col("tag").rlike(f"^h[1-{LEVELS}]$"), F.substring("tag", 2, 1).cast("int"))
    held = elements.filter(F.col("text") != "").withColumn("level", level).withColumn("section", F.count("level").over(order))
    size = F.col("section") + F.least(F.lit(0), F.min(F.when(F.col("level").isNotNull(), F.col("level") - F.col("section"))).over(order))
    held = held.withColumn("depth", F.when(F.col("level").isNotNull(), size))
    at = {d: F.last(F.when(F.col("depth") == d, F.col("text")), ignorenulls=True).over(order) for d in range(1, LEVELS + 1)}
    held = held.withColumn("stack", F.when(F.col("depth").isNotNull(), F.array(*(F.when(F.col("depth") >= d, text) for d, text in at.items()))))
    selector = F.coalesce("body", F.lit("main")) if "body" in elements.columns else F.lit("main")
    is_body = F.col("level").isNull()
    grouped = held.groupBy(key, "section").agg(
        F.max(F.when(~is_body, F.col("text"))).alias("heading"),
        F.max("stack").alias("stack"),
        F.array_sort(F.collect_list(F.when(is_body, F.struct("element_index", "text")))).alias("bodies"),
        F.array_sort(F.collect_list(locator(selector))).alias("locators"),
        *([F.max(title).alias("_title")] if title else []),
    )
    text = F.array_join(F.transform("bodies", lambda b: b["text"]), "\n\n")
    path = F.concat_ws(" > ", *(["_title"] if title else []), F.array_compact(F.coalesce("stack", F.array().cast("array<string>"))))
    return grouped.select(
        key,
        F.col("section").cast("int").alias("section"),
        F.lit(None).cast("string").alias("label"),
        "heading",
        F.coalesce("heading", F.lit(INTRODUCTION)).alias("display_label"),
        F.when(F.col("heading").isNull(), "synthetic").otherwise("official").alias("heading_source"),
        F.coalesce(F.nullif(path, F.lit("")), F.lit(INTRODUCTION)).alias("section_path"),
        F.lit("guidance").alias("section_type"),
        F.when(F.size("bodies") > 0, text).otherwise(F.coalesce("heading", F.lit(""))).alias("content"),
        "locators",
    )


def audit(source: DataFrame, places: DataFrame, key: str) -> DataFrame:
    """(key, source_chars, covered_chars, ratio, exact, missing, extra): source (key, element_index, chars) against places (key, element_index).

    exact: each element of the source stands in exactly one place, and nothing else does.
    """
    used = places.groupBy(key, "element_index").agg(F.count("*").alias("times"))
    both = source.join(used, [key, "element_index"], "full").withColumn("times", F.coalesce("times", F.lit(0)))
    total, got = F.coalesce(F.sum("chars"), F.lit(0)), F.coalesce(F.sum(F.col("chars") * F.col("times")), F.lit(0))
    listed = lambda test: F.sort_array(F.collect_list(F.when(test, F.col("element_index"))))
    return both.groupBy(key).agg(
        total.alias("source_chars"),
        got.alias("covered_chars"),
        F.coalesce(F.try_divide(got, total), F.lit(0.0)).alias("ratio"),
        F.bool_and((F.col("times") == 1) & F.col("chars").isNotNull()).alias("exact"),
        listed(F.col("times") == 0).alias("missing"),
        listed(F.col("chars").isNull()).alias("extra"),
    )


def guidance_audit(elements: DataFrame, sections: DataFrame, key: str) -> DataFrame:
    """The audit of guidance sections; elements without text or with an error are no source."""
    if "error" in elements.columns:
        elements = elements.filter("error is null")
    source = elements.filter(F.col("text") != "").select(key, "element_index", F.length("text").alias("chars"))
    return audit(source, sections.select(key, F.explode("locators.element_index").alias("element_index")), key)
