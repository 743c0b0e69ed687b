"""Searches that keep a task's best, against plain loops."""

import re
from collections import Counter

import pyarrow as pa
import pytest

from granary.operators import retrieval

TEXTS = [(i, None if i % 11 == 10 else f"w{i % 7} w{i % 3}, Common w{i % 3} the-customers {'x ' * (i % 5)}") for i in range(60)]
ASKED = [("a", "w1 w2 common"), ("b", "customer"), ("c", "zzz"), ("d", "xx w3 w3")]


def counts(texts, words=lambda t: re.findall("[a-z0-9]+", (t or "").lower())):
    out = {}
    for k, t in texts:
        out.setdefault(k, Counter()).update(words(t))
    return out


def best(texts, k):
    rows = []
    for q, t in ASKED:
        terms = {x for x in re.findall("[a-z0-9]+", t) if len(x) > 2}
        scored = sorted((-sum(c[x] for x in terms), d) for d, c in counts(texts).items())
        rows += [(q, d, i + 1, round(-n * 0.1, 6)) for i, (n, d) in enumerate(scored[:k]) if n]
    return sorted(rows)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("again", [[], [(3, "customers common"), (3, "common"), (10, "common common common common common common")]])
def test_keyword_search_deals_out_no_matches(spark, again):
    chunks = spark.createDataFrame(TEXTS + again, "d int, content string")
    asked = spark.createDataFrame(ASKED, "q string, question string")
    found = retrieval.keyword_search(asked, "q", "question", chunks, "d", "content", k=5)
    assert sorted((r.q, r.d, r["rank"], round(r.score, 6)) for r in found.collect()) == best(TEXTS + again, 5)
    assert "MapInArrow" in plan(found)
    if not again:
        assert "Generate" not in plan(found) and plan(found).split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1  # the one of the best rows


def test_best_of_many_batches(monkeypatch):
    monkeypatch.setattr(retrieval, "CELLS", 16)
    tile = pa.table({"q": ["a", "a", "b", "c"], "term": ["x", "y", "y", "z"]})
    words = [["x"] * (i % 4) + ["y"] * (i % 3) for i in range(200)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, i + 25)), pa.array(words[i : i + 25], pa.list_(pa.string()))], ["c", "words"]) for i in range(175, -1, -25)]
    got = [(r["q"], r["c"], r["v"]) for b in retrieval.matched_by(tile, 7)(iter(batches)) for r in b.to_pylist()]
    want = []
    for q, terms in (("a", "xy"), ("b", "y")):
        scored = sorted((-sum(w.count(t) for t in terms), i) for i, w in enumerate(words))
        want += [(q, i, float(-n)) for n, i in scored[:7]]
    assert got == want


def test_containing_looks_at_every_document_once(spark):
    texts = [(1, "s", "so One two, three four."), (2, "s", "one two, three Four"), (3, "t", "three two One"), (4, "t", None), (5, None, "xOne two, three fourx and One two, three four"), (5, "u", "two One two, three four"), (6, "u", "")]
    items = [(1, "One two, three four"), (2, "two"), (3, "ne tw"), (4, ""), (5, None), (6, "two absent four"), (7, "One two, three four"), (8, "--")]
    docs = spark.createDataFrame(texts, "d int, source string, text string")
    asked = spark.createDataFrame(items, "i int, asked string")
    found = retrieval.containing(asked, "i", "asked", docs, "d", "text", ("source",))
    want = [(i, d, s or "") for i, a in items for d, s, t in texts if a is not None and t is not None and a in t]
    assert sorted((r.i, r.d, r.source or "") for r in found.collect()) == sorted(want)
    assert "Join" not in plan(found) and "Exchange" not in plan(found)


def test_each_retriever_runs_once_in_an_evaluation(spark):
    from granary.plans import catalogue

    rows = catalogue.eval_summary(spark, "/root/testdata/sf0.001")
    rows.collect()
    assert plan(rows).split("== Initial Plan ==")[0].count("MapInArrow ") == 3  # words, vectors, contained items


@pytest.mark.parametrize("name", ["rule_faults", "section_audit", "html_elements", "hashed_embeddings", "rule_audit"])
def test_texts_go_to_python_in_small_batches(spark, name):
    from granary.plans import catalogue

    at = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(at, "64m")
    catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert spark.conf.get(at) == str(1 << 20)


def test_rows_of_few_pages_come_back_together(monkeypatch):
    import pandas as pd

    from granary.sources import html

    monkeypatch.setattr(html, "FRAME_CHARS", 10)
    batch = pd.DataFrame({"k": range(7), "h": ["xxxx"] * 6 + [None]})
    frames = list(html._frames(iter([batch, batch[:0]]), lambda k, h: [(k, 0)], ["k", "element_index"]))
    assert [list(f["k"]) for f in frames] == [[0, 1, 2], [3, 4, 5], [6]]


@pytest.mark.parametrize("name", ["grounded_answer", "prompts"])
def test_texts_of_the_best_are_not_dealt_out(spark, name):
    from granary.plans import catalogue

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin [doc_id" in plan(catalogue.QUERIES[name](spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["hybrid_rrf", "stemmed_topk", "eval_rows", "eval_report"])
def test_no_query_explodes_documents(spark, name):
    from granary.plans import catalogue

    assert "explode(regexp_extract_all" not in plan(catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")) and not [k for k in catalogue._stored if k[1] == "postings"]


def test_postings_are_counted_by_row(spark):
    chunks = spark.createDataFrame(TEXTS, "d int, content string")
    assert "Aggregate" not in plan(retrieval.postings(chunks, "d", "content"))
    more = spark.createDataFrame([*TEXTS, (3, "w3 common"), (None, "w1"), (None, "w1 w2")], "d int, content string")
    got = {(r.d, r.term): r.tf for r in retrieval.postings(more, "d", "content").collect()}
    assert got == {(d, t): n for d, c in counts([*TEXTS, (3, "w3 common"), (None, "w1"), (None, "w1 w2")]).items() for t, n in c.items()}
