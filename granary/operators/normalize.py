"""Snapshots of pages to normalized documents: one row per document, faults as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import effective_date, effective_evidence, unreadable_date
from granary.operators import rules, sections
from granary.sources import html

SCHEMA_VERSION, RULE_PARSER, GUIDANCE_PARSER = 1, "granary-rule-1", "granary-guidance-1"
RULE_BODY, GUIDANCE_BODIES = "#block-body .field--name-body", ("#block-body", "main")
KEY = "source_id"
LOCATOR = "struct<element_index:int,selector:string,source_text_hash:string>"
#: what a document keeps of its source and snapshot
CARRIED = ("source_id", "rule_number", "title", "source_type", "source_url", "raw_snapshot_file", "retrieved_at", "raw_content_hash")


def _snapshots(snapshots: DataFrame, kind: str) -> DataFrame:
    raw = F.col("content").cast("binary")
    held = snapshots.filter(F.col("source_type") == kind)
    return held.select(KEY, "rule_number", "title", "source_type", F.col("url").alias("source_url"), F.col("html_file").alias("raw_snapshot_file"), "retrieved_at", F.sha2(raw, 256).alias("raw_content_hash"), F.decode(raw, "UTF-8").alias("html"))


def _listed(found: DataFrame, *columns: str) -> DataFrame:
    """Sections of each document in order, as an array of structs."""
    rows = F.array_sort(F.collect_list(F.struct("section", *columns)))
    return found.groupBy(KEY).agg(F.transform(rows, lambda s: F.struct(*(s[c].alias(c) for c in columns))).alias("sections"))


SECTION = ("label", "heading", "display_label", "heading_source", "section_path", "section_type", "content", "locators")


def _documents(pages: DataFrame, found: DataFrame, audits: DataFrame, past: DataFrame, parser: str, skipped: DataFrame) -> DataFrame:
    """Documents with audit, history, date, hash and error."""
    audit = audits.select(KEY, F.struct("source_chars", "covered_chars", "ratio", "exact").alias("audit"), "missing", "extra")
    date = F.col("history.source_text")
    joined = pages.select(*CARRIED).join(_listed(found, *SECTION), KEY, "left").join(audit, KEY, "left").join(past, KEY, "left").join(skipped, KEY, "left")
    day = effective_date(date).cast("string")
    evidence = F.when(day.isNotNull(), F.struct(day.alias("date"), effective_evidence(date).alias("source_text"), F.lit("explicit").alias("confidence")))
    out = joined.withColumns({"latest_effective_date": day, "effective_date_evidence": evidence, "schema_version": F.lit(SCHEMA_VERSION), "parser_version": F.lit(parser)})
    named = F.concat(F.lit("audit failed: missing "), F.to_json("missing"), F.lit(", extra "), F.to_json("extra"))
    fault = F.coalesce(F.when(F.coalesce(unreadable_date(date), F.lit(False)), "unreadable effective date"), F.when(~F.coalesce("audit.exact", F.lit(False)), named))
    hashed = rules.content_hash(out.withColumn("history", date), found, KEY).withColumnRenamed("normalized_hash", "normalized_content_hash")
    return out.withColumn("fault", fault).join(hashed, KEY, "left").drop("missing", "extra")


def _empty(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


def normalized_rules(snapshots: DataFrame, selector: str = RULE_BODY) -> tuple[DataFrame, DataFrame]:
    """(documents, faults) of rule snapshots; see normalized."""
    pages = _snapshots(snapshots, "rule")
    read = html.rule_elements(pages, KEY, selector=selector)
    numbered = read.join(pages.select(KEY, "rule_number"), KEY)
    good = numbered.filter("error is null")
    found = rules.rule_sections(good, KEY, "rule_number", selector)
    where = sections.locator(F.lit(selector))
    past = rules.history(good.withColumn("place", where), KEY, carry=("place",))
    past = past.select(KEY, F.struct("source_text", "notices", F.col("place").alias("locator")).alias("history"))
    left = rules.excluded(good, KEY).withColumn("place", where)
    left = left.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("element_index", "text", "reason", "place"))).alias("x")).select(KEY, F.transform("x", lambda e: F.struct(e["text"].alias("text"), e["reason"].alias("reason"), e["place"].alias("locator"))).alias("excluded"))
    documents = _documents(pages, found, rules.rule_audit(good, found, KEY), past, RULE_PARSER, left)
    errors = read.filter("error is not null").select(KEY, "error").unionByName(rules.faults(good, KEY))
    return _split(documents, errors)


def normalized_guidance(snapshots: DataFrame, bodies: tuple[str, ...] = GUIDANCE_BODIES) -> tuple[DataFrame, DataFrame]:
    """(documents, faults) of guidance snapshots; see normalized."""
    pages = _snapshots(snapshots, "guidance")
    read = html.elements(pages, KEY, body=bodies)
    titled = read.join(pages.select(KEY, "title"), KEY)
    found = sections.guidance_sections(titled, KEY, "title")
    none = _empty(snapshots, f"{KEY} string, history struct<source_text:string,notices:array<string>,locator:{LOCATOR}>")
    left = _empty(snapshots, f"{KEY} string, excluded array<struct<text:string,reason:string,locator:{LOCATOR}>>")
    documents = _documents(pages, found, sections.guidance_audit(read, found, KEY), none, GUIDANCE_PARSER, left)
    return _split(documents, read.filter("error is not null").select(KEY, "error"))


def _split(documents: DataFrame, errors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A document without a fault, and one row of (source_id, error) for each of the others."""
    told = documents.join(errors.groupBy(KEY).agg(F.min("error").alias("_error")), KEY, "left").withColumn("error", F.coalesce("_error", "fault"))
    columns = [*CARRIED, "schema_version", "parser_version", "latest_effective_date", "effective_date_evidence", "normalized_content_hash", "sections", "history", "audit", "excluded"]
    return told.filter("error is null").select(columns), told.filter("error is not null").select(KEY, "error")


def normalized(snapshots: DataFrame, selector: str = RULE_BODY, bodies: tuple[str, ...] = GUIDANCE_BODIES) -> tuple[DataFrame, DataFrame]:
    """(documents, faults) of snapshots (source_id, rule_number, title, source_type, url, html_file, retrieved_at, content).

    A snapshot becomes a document or a row (source_id, error): pages without their body or text, supplementary text
    before its first section, an unreadable effective date, an audit that is not exact, an unknown source type.
    """
    both = [normalized_rules(snapshots, selector), normalized_guidance(snapshots, bodies)]
    documents = both[0][0].unionByName(both[1][0])
    odd = snapshots.filter(~F.coalesce(F.col("source_type").isin("rule", "guidance"), F.lit(False))).select(KEY, F.lit("unknown source type").alias("error"))
    return documents, both[0][1].unionByName(both[1][1]).unionByName(odd)


def document_id(*parts: Column) -> Column:
    """An identifier from what makes a row unique, the same in every run."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)
