"""Labelled rule sections from the direct children of a rule's body, with running counts in place of a loop.

An element opens a section `(a)`, a child `(1)` of the last such section, or, after the marker of supplementary
material, a section `.01`; any other element belongs to what is open. Running counts of those openings number the
sections, so assembly is one sort by (key, element_index) and one aggregation.

Faults are data: `faults` names the documents that can't be assembled, and `rule_sections` leaves them out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.operators.sections import audit

# How labels and the marker are written.
MARKER = r"(?U)\bSupplementary Material\s*:\s*-+"
TOP = r"(?sU)^\(([a-z])\)\s+(.+)$"
NUMBERED = r"(?sU)^\((\d+)\)\s+(.+)$"
SUPPLEMENTARY = r"(?sU)^\.(\d{2})\s+(.+)$"
INLINE_CHARS, CONTEXT_CHARS = 80, 200
MAIN, LETTERED, EXTRA = 0, 1, 2


def footnote() -> Column:
    return (F.col("tag") == "table") & F.array_contains("classes", "footnote")


def _text_elements(elements: DataFrame) -> DataFrame:
    return elements.filter(F.col("text") != "").withColumn("footnote", F.coalesce(footnote(), F.lit(False)))


def inline(value: Column) -> Column:
    """Whether the words after a label are text rather than a heading."""
    return (F.length(value) > INLINE_CHARS) | value.rlike("[.;:?!]")


def _numbered(elements: DataFrame, key: str) -> DataFrame:
    """Elements of rule text with kind, part (number of the section) and child (number within it)."""
    order = Window.partitionBy(key).orderBy("element_index").rowsBetween(Window.unboundedPreceding, 0)
    text = F.col("text")
    held = _text_elements(elements).filter(~F.col("footnote")).withColumn("marker", text.rlike(MARKER))
    held = held.withColumn("extra", F.max("marker").over(order)).filter(~F.col("marker"))
    held = held.withColumn("opens_top", ~F.col("extra") & text.rlike(TOP)).withColumn("opens_extra", F.col("extra") & text.rlike(SUPPLEMENTARY))
    held = held.withColumn("top", F.sum(F.col("opens_top").cast("int")).over(order)).withColumn("add", F.sum(F.col("opens_extra").cast("int")).over(order))
    held = held.withColumn("opens_child", ~F.col("extra") & (F.col("top") > 0) & text.rlike(NUMBERED))
    within = Window.partitionBy(key, "extra", "top").orderBy("element_index").rowsBetween(Window.unboundedPreceding, 0)
    return held.select(
        key,
        "element_index",
        "text",
        "opens_top",
        "opens_child",
        "opens_extra",
        F.when(F.col("extra"), EXTRA).when(F.col("top") > 0, LETTERED).otherwise(MAIN).alias("kind"),
        F.when(F.col("extra"), F.col("add")).otherwise(F.col("top")).alias("part"),
        F.when(F.col("extra"), 0).otherwise(F.sum(F.col("opens_child").cast("int")).over(within)).alias("child"),
    )


def faults(elements: DataFrame, key: str) -> DataFrame:
    """(key, error): documents with supplementary text before its first section, or without rule text."""
    by = _numbered(elements, key).groupBy(key).agg(F.bool_or((F.col("kind") == EXTRA) & (F.col("part") == 0)).alias("orphan"), F.bool_or(F.col("kind") != EXTRA).alias("text"))
    every = elements.select(key).distinct().join(by, key, "left")
    error = F.when(F.col("orphan"), "supplementary content before a section").when(~F.coalesce("text", F.lit(False)), "rule text is empty")
    return every.select(key, error.alias("error")).filter(F.col("error").isNotNull())


def rule_sections(elements: DataFrame, key: str, number: str | None = None, selector: str = "#block-body .field--name-body") -> DataFrame:
    """One row per section in reading order; elements (key, element_index, tag, classes, text), number names a column of theirs.

    key, section, label, heading, display_label, heading_source, section_path, section_type, content, locators.
    A child's content starts with that of its parent where the parent has no heading and at most 200 characters.
    """
    held = _numbered(elements, key)
    text = F.col("text")
    word = lambda pattern, i: F.regexp_extract("text", pattern, i)
    rest = F.when(F.col("opens_top"), word(TOP, 2)).when(F.col("opens_child"), word(NUMBERED, 2)).when(F.col("opens_extra"), word(SUPPLEMENTARY, 2))
    held = held.withColumn("rest", rest)
    cut = F.instr("rest", ". ")
    after = F.trim(F.regexp_replace(F.expr("substring(rest, instr(rest, '. ') + 2)"), r"(?U)\s+", " "))
    heading = F.when(F.col("opens_extra"), F.when(cut > 0, F.expr("substring(rest, 1, instr(rest, '. ') - 1)")).otherwise(F.col("rest"))).when(F.col("rest").isNotNull() & ~inline(F.col("rest")), F.col("rest"))
    body = F.when(F.col("rest").isNull(), text).when(F.col("opens_extra"), F.when((cut > 0) & (after != ""), after)).when(inline(F.col("rest")), F.col("rest"))
    label = F.when(F.col("opens_extra"), F.concat(F.lit("."), word(SUPPLEMENTARY, 1))).when(F.col("opens_top"), F.concat(F.lit("("), word(TOP, 1), F.lit(")"))).when(F.col("opens_child"), F.concat(F.lit("("), word(NUMBERED, 1), F.lit(")")))
    held = held.withColumn("heading", heading).withColumn("body", body).withColumn("label", label)
    bodies = F.array_sort(F.collect_list(F.when(F.col("body").isNotNull(), F.struct("element_index", "body"))))
    where = F.concat(F.lit(f"{selector} > :nth-child("), (F.col("element_index") + 1).cast("string"), F.lit(")"))
    places = F.array_sort(F.collect_list(F.struct("element_index", where.alias("selector"), F.sha2("text", 256).alias("source_text_hash"))))
    groups = held.groupBy(key, "kind", "part", "child").agg(F.max("label").alias("own"), F.max("heading").alias("heading"), bodies.alias("bodies"), places.alias("locators"))
    groups = groups.withColumn("content", F.array_join(F.transform("bodies", lambda b: b["body"]), "\n\n"))

    family = Window.partitionBy(key, "kind", "part").orderBy("child")
    is_child = F.col("child") > 0
    for name in ("own", "heading", "content"):
        groups = groups.withColumn(f"p_{name}", F.first(name).over(family))
    context = F.when(is_child & F.col("p_heading").isNull() & F.length("p_content").between(1, CONTEXT_CHARS), F.col("p_content"))
    content = F.when(context.isNotNull(), F.concat_ws("\n\n", context, F.nullif("content", F.lit("")))).otherwise(F.col("content"))
    if number is None:
        groups = groups.withColumn("_number", F.lit("").cast("string"))
    else:
        groups = groups.join(elements.groupBy(key).agg(F.max(number).alias("_number")), key)
    titled = F.concat_ws(" ", "own", "heading")
    parent = F.when(is_child, F.concat_ws(" ", "p_own", "p_heading"))
    path = F.concat_ws(" > ", F.nullif("_number", F.lit("")), F.when(F.col("kind") == EXTRA, "Supplementary Material"), parent, F.nullif(titled, F.lit("")))
    main = F.col("kind") == MAIN
    good = groups.join(faults(elements, key), key, "left_anti")
    return good.select(
        key,
        F.row_number().over(Window.partitionBy(key).orderBy("kind", "part", "child")).alias("section"),
        F.when(is_child, F.concat("p_own", "own")).otherwise(F.col("own")).alias("label"),
        "heading",
        F.when(main, "Main rule text").otherwise(titled).alias("display_label"),
        F.when(main, "synthetic").otherwise("official").alias("heading_source"),
        path.alias("section_path"),
        F.when(F.col("kind") == EXTRA, "supplementary").otherwise("rule_text").alias("section_type"),
        content.alias("content"),
        "locators",
    )


def history(elements: DataFrame, key: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, element_index, source_text, notices, *carry): the last footnote table of each document."""
    notes = _text_elements(elements).filter("footnote")
    last = notes.groupBy(key).agg(F.max(F.struct("element_index", F.col("text").alias("source_text"), F.col("refs").alias("notices"), *carry)).alias("h"))
    return last.select(key, "h.*")


def rule_audit(elements: DataFrame, sections: DataFrame, key: str) -> DataFrame:
    """The audit of what sections and history hold of the elements' text, marker aside."""
    source = _text_elements(elements).filter(F.col("footnote") | ~F.col("text").rlike(MARKER)).select(key, "element_index", F.length("text").alias("chars"))
    places = sections.select(key, F.explode("locators.element_index").alias("element_index")).unionByName(history(elements, key).select(key, "element_index"))
    return audit(source, places, key)


def excluded(elements: DataFrame, key: str) -> DataFrame:
    """(key, element_index, text, reason): text that is no part of a section on purpose."""
    marker = _text_elements(elements).filter(~F.col("footnote") & F.col("text").rlike(MARKER))
    return marker.select(key, "element_index", "text", F.lit("marker of supplementary material").alias("reason"))


def content_hash(documents: DataFrame, sections: DataFrame, key: str) -> DataFrame:
    """(key, normalized_hash): sha256 of the canonical JSON (keys in order, no spaces) of what a document says.

    documents: key, rule_number, title, source_type, source_url, latest_effective_date (text), history. Markup, paths,
    locators, display labels and times of retrieval leave it as it is. Control characters below U+0020 that JSON has no
    short escape for are written with upper-case hex digits.
    """
    said = F.struct("section", "content", "heading", "label", "section_type")
    rows = sections.groupBy(key).agg(F.array_sort(F.collect_list(said)).alias("s"))
    listed = F.transform("s", lambda x: F.struct(*(x[c].alias(c) for c in ("content", "heading", "label", "section_type"))))
    payload = F.struct("history", "latest_effective_date", "rule_number", listed.alias("sections"), "source_type", "source_url", "title")
    return documents.join(rows, key).select(key, F.sha2(F.to_json(payload, {"ignoreNullFields": "false"}), 256).alias("normalized_hash"))
