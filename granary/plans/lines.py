"""Queries over documents as a corpus of snapshots, and over their sentences as elements of rules and guidance pages.

Elements of HTML need Python; sentences of `documents` are rows that SQL can make too, so what follows the parser
(assembly, heading paths, audits, histories, canonical hashes) is held against SQL here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as fn
from granary.operators import chunking, retrieval, rules, sections
from granary.session import table

TARGET, OVERLAP = 100, 10


# --- documents as snapshots: one source for each pair of source and language, the larger doc_id is the newer one


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rule = F.coalesce(F.col("lang") == "en", F.lit(False))
    return docs.select(
        F.col("doc_id").alias("document_id"),
        F.concat_ws("-", "source", "lang").alias("source_id"),
        F.when(rule, F.lpad(F.regexp_replace("source", "[^0-9]", ""), 4, "2")).alias("rule_number"),
        F.col("source").alias("title"),
        F.when(rule, "rule").otherwise("guidance").alias("source_type"),
        F.concat(F.lit("https://host.example/"), F.col("doc_id").cast("string")).alias("source_url"),
        F.timestamp_seconds(F.col("doc_id") * 60).alias("retrieved_at"),
        F.concat_ws(" > ", "source", "lang").alias("section_path"),
        F.col("lang").alias("subsection"),
        F.col("text").alias("content"),
    )


def newest_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each source's newest document; a document's first chunk has the embedding of its number."""
    every = _snapshots(spark, sf_dir)
    kept = retrieval.newest_only(every, every, "document_id", "source_id", "retrieved_at")
    cut = chunking.chunk(kept.select("document_id", "content"), ["document_id"], target=TARGET, overlap=OVERLAP)
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("document_id"), F.lit(0).alias("chunk_index"), "embedding")
    named = cut.join(kept.drop("content"), "document_id").join(vectors, ["document_id", "chunk_index"], "left")
    return named.withColumn("chunk_id", F.col("document_id") * 1_000_000 + F.col("chunk_index"))


NEWEST = rf"""snap as (
  select doc_id as document_id, concat_ws('-', source, lang) as source_id, case when lang = 'en' then right('2222' || regexp_replace(source, '[^0-9]', '', 'g'), 4) end as rule_number, source as title,
    case when lang = 'en' then 'rule' else 'guidance' end as source_type, 'https://host.example/' || doc_id as source_url, to_timestamp(doc_id * 60) as retrieved_at,
    concat_ws(' > ', source, lang) as section_path, lang as subsection, text from documents
), kept as (select distinct on (source_id) * from snap order by source_id, retrieved_at desc, document_id desc),
ntok as (select *, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') as t from kept),
nwin as (select *, unnest(range(0, case when len(t) = 0 then 0 else 1 + greatest(0, ceil((len(t) - {TARGET}) / {TARGET - OVERLAP}::double))::bigint end)) as i from ntok),
nchunk as (select document_id * 1000000 + i as chunk_id, i as chunk_index, * exclude (t, i, text), array_to_string(t[i * {TARGET - OVERLAP} + 1:i * {TARGET - OVERLAP} + {TARGET}], ' ') as content from nwin)"""
NEWEST_KEYWORD = "npost as (select chunk_id, term, count(*) as tf from (select chunk_id, unnest(regexp_extract_all(lower(section_path || ' ' || content), '[a-z0-9]+')) as term from nchunk) group by all), nsum as (select item_id, chunk_id, sum(tf) as n from asked join npost using (term) group by all), nkw as (select item_id, chunk_id, n, row_number() over (partition by item_id order by n desc, chunk_id)::int as rank from nsum qualify rank <= 15)"
NEWEST_VECTOR = "nvec as (select q.vec_id as item_id, chunk_id, list_cosine_similarity(q.embedding::double[], v.embedding::double[]) as score, row_number() over (partition by q.vec_id order by list_cosine_similarity(q.embedding::double[], v.embedding::double[]) desc, chunk_id)::int as rank from embeddings q join benchmark b on b.item_id = q.vec_id, nchunk join embeddings v on v.vec_id = document_id where chunk_index = 0 qualify rank <= 15)"


# --- sentences as elements


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, element_index, t): sentences, white space collapsed."""
    pieces = F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\. ", -1)).alias("element_index", "t")
    return table(spark, sf_dir, "documents").select("doc_id", pieces).withColumn("t", F.trim(F.regexp_replace("t", r"[ \t\n\x0B\f\r]+", " ")))


def _cycle(step: int, of: int) -> Column:
    return (F.col("doc_id") * 7 + F.col("element_index") * step) % of


def _rule_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences in turn as lettered, numbered and supplementary openings, the marker, footnotes and plain text."""
    k, t = _cycle(3, 17), F.col("t")
    day = F.date_add(F.lit("2000-01-01").cast("date"), (F.col("doc_id") % 9000).cast("int"))
    dated = F.when(F.col("doc_id") % 10 == 3, "eff. Sept. 5, 2011").otherwise(F.date_format(day, "'eff. 'MMM'. 'd', 'yyyy"))
    forms = [(0, F.concat(F.lit("(a) "), F.substring(t, 1, 40))), (1, F.concat(F.lit("(b) "), t)), (2, F.concat(F.lit("(1) "), t)), (3, F.concat(F.lit("(12) "), F.substring(t, 1, 30))), (4, F.concat(F.lit(".01 Note. "), t))]
    forms += [(5, F.concat(F.lit(".02 "), F.substring(t, 1, 30))), (7, F.concat(F.lit("Amended by notice; "), dated, F.lit(". See "), t)), (9, F.concat(F.lit(".03 After. "), t))]
    marker = (k == 6) & ((F.col("doc_id") + F.col("element_index")) % 3 == 0)
    text = F.coalesce(F.when(marker, "More Supplementary Material: ---"), *(F.when(k == i, x) for i, x in forms), t)
    foot = k == 7
    return _sentences(spark, sf_dir).select("doc_id", F.col("element_index"), F.when(foot, "table").otherwise("p").alias("tag"), F.when(foot, F.array(F.lit("footnote"))).otherwise(F.array().cast("array<string>")).alias("classes"), text.alias("text"), F.array().cast("array<string>").alias("refs"))


def _shown(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "section", "label", "heading", "display_label", "heading_source", "section_path", "section_type", F.sha2("content", 256).alias("content_sha256"), F.sha2(F.to_json(F.transform("locators", lambda x: F.struct(x["element_index"].alias("i"), x["source_text_hash"].alias("h")))), 256).alias("places_sha256"))


def _audited(audit: DataFrame) -> DataFrame:
    listed = lambda c: F.array_join(F.col(c).cast("array<string>"), ";").alias(c)
    return audit.select("doc_id", "source_chars", "covered_chars", F.round("ratio", 6).alias("ratio"), "exact", listed("missing"), listed("extra"))


def line_rule_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(rules.rule_sections(_rule_lines(spark, sf_dir), "doc_id"))


def line_rule_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.faults(_rule_lines(spark, sf_dir), "doc_id")


def line_rule_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _rule_lines(spark, sf_dir)
    return _audited(rules.rule_audit(held, rules.rule_sections(held, "doc_id"), "doc_id"))


def line_rule_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last footnote of each document, its date, the sentence that has it, and whether it can't be read."""
    text = F.col("source_text")
    past = rules.history(_rule_lines(spark, sf_dir), "doc_id")
    return past.select("doc_id", "element_index", fn.effective_date(text).cast("string").alias("effective"), F.sha2(fn.effective_evidence(text), 256).alias("evidence_sha256"), fn.unreadable_date(text).alias("unreadable"))


def line_rule_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _rule_lines(spark, sf_dir)
    past = rules.history(held, "doc_id").select("doc_id", F.col("source_text").alias("history"), fn.effective_date(F.col("source_text")).cast("string").alias("latest_effective_date"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("rule_number"), F.col("source").alias("title"), F.lit("rule").alias("source_type"), F.concat(F.lit("https://host.example/"), F.col("doc_id").cast("string")).alias("source_url"))
    return rules.content_hash(docs.join(past, "doc_id", "left"), rules.rule_sections(held, "doc_id"), "doc_id")


def _guidance_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences in turn as headings of four levels, items and paragraphs."""
    k = _cycle(5, 13)
    tag = F.element_at(F.array(*map(F.lit, ("h1", "h2", "h3", "h4", "li", "li", *["p"] * 7))), (k + 1).cast("int"))
    text = F.when(tag.startswith("h"), F.substring("t", 1, 40)).otherwise(F.col("t"))
    titles = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"))
    return _sentences(spark, sf_dir).select("doc_id", "element_index", tag.alias("tag"), text.alias("text")).join(titles, "doc_id")


def line_guidance_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(sections.guidance_sections(_guidance_lines(spark, sf_dir), "doc_id", "title"))


def line_guidance_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _guidance_lines(spark, sf_dir)
    return _audited(sections.guidance_audit(held, sections.guidance_sections(held, "doc_id"), "doc_id"))


QUERIES = (line_rule_sections, line_rule_faults, line_rule_audit, line_rule_history, line_rule_hash, line_guidance_sections, line_guidance_audit)

_SENTENCES = r"sent as (select doc_id, idx, trim(regexp_replace(piece, '[ \t\n\x0B\f\r]+', ' ', 'g')) as t from (select doc_id, unnest(range(len(p))) as idx, unnest(p) as piece from (select doc_id, string_split(coalesce(text, ''), '. ') as p from documents)))"
_RULE = (
    _SENTENCES
    + r""", el as (
  select doc_id, idx, k = 7 as foot, case when k = 6 and (doc_id + idx) % 3 = 0 then 'More Supplementary Material: ---' else case k when 0 then '(a) ' || substr(t, 1, 40) when 1 then '(b) ' || t when 2 then '(1) ' || t when 3 then '(12) ' || substr(t, 1, 30)
    when 4 then '.01 Note. ' || t when 5 then '.02 ' || substr(t, 1, 30) when 7 then 'Amended by notice; ' || dated || '. See ' || t when 9 then '.03 After. ' || t else t end end as t
  from (select *, (doc_id * 7 + idx * 3) % 17 as k, case when doc_id % 10 = 3 then 'eff. Sept. 5, 2011' else strftime(date '2000-01-01' + (doc_id % 9000)::int, 'eff. %b. %-d, %Y') end as dated from sent)
), mk as (select *, regexp_matches(t, '\bSupplementary Material\s*:\s*-+') as mark from el where t <> '' and not foot),
lat as (select *, bool_or(mark) over (partition by doc_id order by idx rows unbounded preceding) as sup from mk),
op as (select *, not sup and regexp_full_match(t, '\([a-z]\)\s+.+') as top, sup and regexp_full_match(t, '\.\d{2}\s+.+') as ext from lat where not mark),
ids as (select *, sum(top::int) over w as tid, sum(ext::int) over w as sid from op window w as (partition by doc_id order by idx rows unbounded preceding)),
nums as (select *, not sup and tid > 0 and regexp_full_match(t, '\(\d+\)\s+.+') as num from ids),
placed as (
  select *, case when sup then 2 when tid > 0 then 1 else 0 end as kind, case when sup then sid else tid end as part,
    case when sup then 0 else sum(num::int) over (partition by doc_id, sup, tid order by idx rows unbounded preceding) end as child,
    case when top then regexp_extract(t, '^\([a-z]\)\s+(.+)$', 1) when num then regexp_extract(t, '^\(\d+\)\s+(.+)$', 1) when ext then regexp_extract(t, '^\.\d{2}\s+(.+)$', 1) end as rest,
    case when top then substr(t, 1, 3) when num then regexp_extract(t, '^(\(\d+\))', 1) when ext then substr(t, 1, 3) end as own
  from nums
), bad as (
  select d.doc_id, case when bool_or(kind = 2 and part = 0) then 'supplementary content before a section' when not coalesce(bool_or(kind <> 2), false) then 'rule text is empty' end as error
  from (select distinct doc_id from el) d left join placed using (doc_id) group by d.doc_id
), cut as (
  select *, rest is not null and not ext and (length(rest) > 80 or regexp_matches(rest, '[.;:?!]')) as inl, instr(rest, '. ') as dot from placed
), said as (
  select *, case when ext then case when dot > 0 then substr(rest, 1, dot - 1) else rest end when rest is not null and not inl then rest end as heading,
    case when rest is null then t when ext then case when dot > 0 then nullif(trim(regexp_replace(substr(rest, dot + 2), '\s+', ' ', 'g')), '') end when inl then rest end as body
  from cut
), grp as (
  select doc_id, kind, part, child, max(own) as own, max(heading) as heading, coalesce(string_agg(body, chr(10) || chr(10) order by idx) filter (where body is not null), '') as content,
    list(idx order by idx) as places, '[' || string_agg('{"i":' || idx || ',"h":"' || sha256(t) || '"}', ',' order by idx) || ']' as listed
  from said join bad using (doc_id) where error is null group by all
), fam as (
  select g.*, p.own as p_own, p.heading as p_heading, case when g.child > 0 and p.heading is null and length(p.content) between 1 and 200 then p.content end as lead
  from grp g left join grp p on p.doc_id = g.doc_id and p.kind = g.kind and p.part = g.part and p.child = 0
), sec as (
  select doc_id, row_number() over (partition by doc_id order by kind, part, child)::int as section, case when child > 0 then p_own || own else own end as label, heading,
    case when kind = 0 then 'Main rule text' else concat_ws(' ', own, heading) end as display_label, case when kind = 0 then 'synthetic' else 'official' end as heading_source,
    concat_ws(' > ', case when kind = 2 then 'Supplementary Material' end, case when child > 0 then concat_ws(' ', p_own, p_heading) end, nullif(concat_ws(' ', own, heading), '')) as section_path,
    case when kind = 2 then 'supplementary' else 'rule_text' end as section_type, case when lead is not null then concat_ws(chr(10) || chr(10), lead, nullif(content, '')) else content end as content, places, listed
  from fam
), past as (select doc_id, idx, t from el where foot and t <> '' qualify row_number() over (partition by doc_id order by idx desc) = 1),
seen as (select doc_id, idx, t, regexp_extract(t, '\beff\.\s+([A-Z][a-z]+)\.?\s+(\d{1,2}),\s+(\d{4})', ['m', 'd', 'y']) as x from past),
dated as (select doc_id, idx, t, coalesce(try_strptime(x.m || ' ' || x.d || ' ' || x.y, '%b %d %Y'), try_strptime(x.m || ' ' || x.d || ' ' || x.y, '%B %d %Y'))::date::varchar as effective from seen)"""
)
_AUDIT = """select doc_id, sum(coalesce(length(t), 0))::bigint as source_chars, sum(coalesce(length(t), 0) * coalesce(times, 0))::bigint as covered_chars, round(coalesce(sum(coalesce(length(t), 0) * coalesce(times, 0)) / nullif(sum(length(t)), 0)::double, 0), 6) as ratio,
  bool_and(coalesce(times, 0) = 1 and t is not null) as exact, coalesce(string_agg(idx::varchar, ';' order by idx) filter (where times is null), '') as missing, coalesce(string_agg(idx::varchar, ';' order by idx) filter (where t is null), '') as extra
from src full join used using (doc_id, idx) group by doc_id"""
_SECTION = "doc_id, section, label, heading, display_label, heading_source, section_path, section_type, sha256(content) as content_sha256, sha256(listed) as places_sha256"
_GUIDANCE = (
    _SENTENCES
    + r""", tagged as (select doc_id, idx, t, ['h1', 'h2', 'h3', 'h4', 'li', 'li', 'p', 'p', 'p', 'p', 'p', 'p', 'p'][((doc_id * 7 + idx * 5) % 13 + 1)::int] as tag from sent),
el as (select doc_id, idx, tag, case when tag like 'h%' then substr(t, 1, 40) else t end as t from tagged),
num as (select *, case when tag like 'h%' then substr(tag, 2, 1)::int end as level, count(level) over (partition by doc_id order by idx rows unbounded preceding) as section from el where t <> ''),
heads as (select doc_id, section, level, t from num where level is not null),
stacks as (select doc_id, section, list([struct_pack(l := level, t := t)]) over (partition by doc_id order by section rows unbounded preceding) as hs from heads),
paths as (select doc_id, section, array_to_string(list_transform(list_reduce(hs, lambda acc, h: acc[1:h[1].l - 1] || h), lambda x: x.t), ' > ') as path from stacks),
grp as (
  select doc_id, section, max(t) filter (where level is not null) as heading, string_agg(t, chr(10) || chr(10) order by idx) filter (where level is null) as body, list(idx order by idx) as places,
    '[' || string_agg('{"i":' || idx || ',"h":"' || sha256(t) || '"}', ',' order by idx) || ']' as listed
  from num group by all
), sec as (
  select g.doc_id, g.section::int as section, null::varchar as label, heading, coalesce(heading, 'Introduction') as display_label, case when heading is null then 'synthetic' else 'official' end as heading_source,
    concat_ws(' > ', d.source, path) as section_path, 'guidance' as section_type, coalesce(body, heading, '') as content, places, listed
  from grp g join documents d using (doc_id) left join paths using (doc_id, section)
)"""
)
ORACLES = {
    "line_rule_sections": f"with {_RULE} select {_SECTION} from sec",
    "line_rule_faults": f"with {_RULE} select doc_id, error from bad where error is not null",
    "line_rule_audit": f"with {_RULE}, src as (select doc_id, idx, t from el where t <> '' and (foot or not regexp_matches(t, '\\bSupplementary Material\\s*:\\s*-+'))), used as (select doc_id, idx, count(*) as times from (select doc_id, unnest(places) as idx from sec union all select doc_id, idx from past) group by all) {_AUDIT}",
    "line_rule_hash": f"""with {_RULE}, js as (select doc_id, string_agg('{{"content":' || to_json(content)::varchar || ',"heading":' || coalesce(to_json(heading)::varchar, 'null') || ',"label":' || coalesce(to_json(label)::varchar, 'null') || ',"section_type":"' || section_type || '"}}', ',' order by section) as s from sec group by doc_id)
select d.doc_id, sha256('{{"history":' || coalesce(to_json(h.t)::varchar, 'null') || ',"latest_effective_date":' || coalesce('"' || effective || '"', 'null') || ',"rule_number":"' || d.doc_id || '","sections":[' || s || '],"source_type":"rule","source_url":"https://host.example/' || d.doc_id || '","title":' || coalesce(to_json(d.source)::varchar, 'null') || '}}') as normalized_hash
from documents d join js using (doc_id) left join dated h using (doc_id)""",
    "line_guidance_sections": f"with {_GUIDANCE} select {_SECTION} from sec",
    "line_guidance_audit": f"with {_GUIDANCE}, src as (select doc_id, idx, t from el where t <> ''), used as (select doc_id, idx, count(*) as times from (select doc_id, unnest(places) as idx from sec) group by all) {_AUDIT}",
}
#: the sentence of a date: from the last full stop with a space before it to the first one after it
ORACLES["line_rule_history"] = f"""with {_RULE}, parts as (select *, regexp_extract(t, '\\beff\\.\\s+[A-Z][a-z]{{2,8}}\\.?\\s+\\d{{1,2}},\\s+\\d{{4}}', 0) as found from dated),
sides as (select *, split_part(t, found, 1) as before, substr(t, instr(t, found) + length(found)) as after from parts)
select doc_id, idx as element_index, effective, sha256(string_split(before, '. ')[-1] || found || string_split(after, '. ')[1] || case when contains(after, '. ') then '.' else '' end) as evidence_sha256, effective is null as unreadable from sides"""
