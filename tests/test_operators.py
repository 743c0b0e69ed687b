import random

import pytest
from pyspark.sql import functions as F

from granary.functions import text as fn
from granary.operators import answers, chunking, ingest, retrieval, sections
from granary.sources import html, manifest


def test_fusion_orders_ties_by_first_seen(spark):
    a = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "q string, k string, rank int")
    b = spark.createDataFrame([("q", "b", 1), ("q", "c", 2)], "q string, k string, rank int")
    got = [r.k for r in retrieval.fuse([a, b], "q", "k").orderBy("rank").collect()]
    assert got == ["b", "a", "c"]
    with pytest.raises(ValueError, match="rrf_k must be positive"):
        retrieval.fuse([a], "q", "k", rrf_k=0)


def test_chunks_overlap_and_stay_small(spark):
    rows = [(1, 0, " ".join(map(str, range(25)))), (1, 1, "short one"), (1, 2, "")]
    got = chunking.chunk(spark.createDataFrame(rows, "d int, s int, content string"), ["d"], "s", 10, 2).orderBy("chunk_index").collect()
    assert [r.token_count for r in got] == [10, 10, 9, 2]
    assert [r.chunk_index for r in got] == [0, 1, 2, 3]
    assert got[0].content.split()[-2:] == got[1].content.split()[:2]
    with pytest.raises(ValueError):
        chunking.chunk(spark.createDataFrame(rows, "d int, s int, content string"), ["d"], "s", 10, 10)


def test_manifest_errors_and_order(spark):
    row = lambda i, s, n, t, u: (i, s, n, "t", t, u)
    rows = [
        row(0, "org-rule-1", "2090", "rule", "https://www.a.org/x"), row(1, "org-g", None, "guidance", "https://www.a.org/y"), row(2, "org-r", None, "rule", "https://www.a.org/z"),
        row(3, "org-h", None, "guidance", "https://evil.org/"), row(4, "org-p", None, "guidance", "http://www.a.org/"), row(5, "org-q", None, "guidance", "https://www.a.org/?q=1"), row(6, "org-n", "209", "rule", "https://www.a.org/"),
    ]
    df = spark.createDataFrame(rows, "ordinal int, source_id string, rule_number string, title string, source_type string, url string")
    errors = [r.error for r in manifest.validate(df, ["www.A.org"]).orderBy("ordinal").collect()]
    assert errors == [None, None, "rule number is missing", "host is not allowed", "url is not https", "url has a query or fragment", "bad rule number"]
    assert [r.source_id for r in manifest.select(df, ["org-g", "org-rule-1"]).collect()] == ["org-rule-1", "org-g"]
    with pytest.raises(ValueError, match="nope"):
        manifest.select(df, ["nope"])


def test_return_to_older_content_is_saved(spark):
    df = spark.createDataFrame([("s", i, c) for i, c in enumerate("AABA")], "s string, i int, c string")
    got = [r.status for r in ingest.changed_snapshots(df, "s", ["i"], F.col("c")).orderBy("i").collect()]
    assert got == ["saved", "unchanged", "saved", "saved"]


def test_citations_match_null_with_null(spark):
    passages = spark.createDataFrame([("q", 1, None, "hello world"), ("q", 2, None, "other")], "q string, rank int, label string, content string")
    cited = spark.createDataFrame([("q", None, "hello"), ("q", None, "other"), ("q", "x", "hello")], "q string, label string, excerpt string")
    assert sorted((r.excerpt, r.label or "", r.valid) for r in answers.check_citations(cited, passages, "q", ["label"]).collect()) == [("hello", "", True), ("hello", "x", False), ("other", "", False)]


def test_guidance_sections(spark):
    page = "<main>lost<p>before</p><h1>Top</h1><p>a<b>b</b></p><h2>Sub</h2><ul><li>one</li><li>two</li></ul><h1>Empty</h1></main><footer><p>no</p></footer>"
    df = html.elements(spark.createDataFrame([(1, page), (2, "<p>no body</p>"), (3, None)], "id int, html string"), "id")
    found = sections.guidance_sections(df, "id")
    got = {r.section: (r.section_path, r.content) for r in found.collect()}
    assert got == {0: ("Introduction", "before"), 1: ("Top", "a b"), 2: ("Top > Sub", "one\n\ntwo"), 3: ("Empty", "Empty")}
    assert {r.id: r.error for r in df.filter("error is not null").collect()} == {2: "no body was found", 3: "no body was found"}
    titled = sections.guidance_sections(df.withColumn("t", F.lit("Page")), "id", "t").orderBy("section").collect()
    assert [(r.section_path, r.heading, r.heading_source, r.display_label) for r in titled[:2]] == [("Page", None, "synthetic", "Introduction"), ("Page > Top", "Top", "official", "Top")]
    assert [(x.element_index, x.selector) for x in titled[2].locators] == [(3, "main > :nth-child(4)"), (4, "main > :nth-child(5)"), (5, "main > :nth-child(6)")]
    checked = sections.guidance_audit(df, found, "id").collect()
    assert [(r.id, r.exact, r.ratio) for r in checked] == [(1, True, 1.0)]
    lost = sections.guidance_audit(df, found.filter("section <> 2"), "id").first()
    assert (lost.exact, lost.missing, lost.extra) == (False, [3, 4, 5], [])


def test_heading_paths_equal_a_stack(spark):
    rng = random.Random(3)
    docs = [[rng.choice(["h1", "h2", "h3", "h4", "p"]) for _ in range(rng.randrange(1, 25))] for _ in range(200)]
    rows = [(d, i, tag, f"{tag}-{i}") for d, tags in enumerate(docs) for i, tag in enumerate(tags)]
    got = {}
    for r in sections.guidance_sections(spark.createDataFrame(rows, "d int, element_index int, tag string, text string"), "d").collect():
        got[r.d, r.section] = r.section_path
    for d, tags in enumerate(docs):
        stack, n = [], 0
        for i, tag in enumerate(tags):
            if tag != "p":
                stack, n = stack[: int(tag[1]) - 1] + [f"{tag}-{i}"], n + 1
                assert got[d, n] == " > ".join(stack)


def test_scope_gate(spark):
    asked = ["Is it legal advice?", "should I\never buy", "Latest SEC rule", "What is suitability?"]
    got = [r[0] for r in spark.createDataFrame([(i, a) for i, a in enumerate(asked)], "i int, a string").orderBy("i").select(fn.out_of_scope(F.col("a"))).collect()]
    assert got == [True, False, True, False]
