import json

import pytest
from pyspark.sql import functions as F

from granary.operators import answers, service
from granary.sources import embed, snapshots

URL = "https://host.example/a"


def payload(**change):
    cited = {"rule_number": None, "subsection": "(a)", "source_url": URL, "supporting_excerpt": "two three"}
    return json.dumps({"answer": "so", "citations": [cited | change.pop("cited", {})], "abstained": False} | change)


@pytest.mark.parametrize(
    "text, error",
    [
        (payload(), None),
        (payload(cited={"supporting_excerpt": "three two"}), "a citation is not supported by evidence"),
        (payload(cited={"supporting_excerpt": "later only"}), "a citation is not supported by evidence"),
        (payload(cited={"source_url": "https://host.example/b"}), "a citation is not supported by evidence"),
        (payload(cited={"rule_number": 7}), "a citation is not supported by evidence"),
        (payload(cited={"supporting_excerpt": None}), "a citation is not supported by evidence"),
        (payload(citations=["x"]), "a citation is not supported by evidence"),
        (payload(citations=[]), "no citations"),
        (payload(citations="x"), "citations are not a list"),
        (payload(answer=1), "answer is missing"),
        (payload(citations=[], abstained=True), None),
        ("{", "not valid JSON"),
        ("[1]", "answer is missing"),
        (None, "not valid JSON"),
    ],
)
def test_payloads_are_judged(spark, text, error):
    shape = "q long, rank int, rule_number string, subsection string, source_url string, title string, content string"
    passages = spark.createDataFrame([(1, 1, None, "(a)", URL, "T", "one two three"), (1, 2, None, "(a)", URL, "U", "later only")], shape)
    got = service.judged_payloads(spark.createDataFrame([(1, text)], "q long, payload string"), passages, "q").collect()
    assert [r.payload_error for r in got] == [error]
    if text == payload():
        assert [c.asDict() for c in got[0].model_citations] == [{"rule_number": None, "subsection": "(a)", "source_url": URL, "title": "T", "supporting_excerpt": "two three"}]


def asked(spark, *rows):
    return spark.createDataFrame(rows, "q long, question string, retrieval_mode string, top_k int, embedding array<float>")


def test_requests_are_checked(spark):
    rows = asked(spark, (1, "ab", None, None, None), (2, "x" * 2001, None, None, None), (3, "abc", "other", 5, None), (4, "abc", "keyword", 21, None), (5, None, None, None, None), (6, "abc", None, None, None))
    got = {r.q: r for r in service.checked_requests(rows).collect()}
    assert [got[i].error is None for i in range(1, 7)] == [False] * 5 + [True]
    assert (got[6].retrieval_mode, got[6].top_k) == ("hybrid", 5)


def test_responses_follow_their_mode(spark):
    requests = asked(
        spark,
        (1, "margin account", "keyword", 1, None), (2, "margin account", "vector", 2, [1.0, 0.0]), (3, "margin account", "vector", 2, None),
        (4, "margin account", "hybrid", 3, None), (5, "which stock is best", "vector", 5, None), (6, "which stock is best", "hybrid", 5, [1.0, 0.0]), (7, "nothing alike", "keyword", 5, None),
    )
    chunks = spark.createDataFrame([(10, "margin margin account", [0.0, 1.0]), (11, "account", [1.0, 0.0]), (12, "other", None)], "key long, text string, embedding array<float>")
    held = service.dispatch(requests, "q")
    found = service.retrieve(held, chunks, "q", "key", "text")
    passages = found.join(chunks.select("key", F.col("text").alias("content")), "key")
    out = service.responses(held, passages, "q")
    got = {r.q: r for r in out.collect()}
    keys = {i: [c.key for c in r.citations] if r.citations is not None else [] for i, r in got.items()}
    assert keys == {1: [10], 2: [11, 10], 3: [], 4: [10, 11], 5: [], 6: [], 7: []}
    assert got[3].error and got[3].answer is None
    assert [got[i].abstained for i in (1, 2, 4, 5, 6, 7)] == [False, False, False, True, True, True]
    assert [got[i].retrieval_configuration for i in (1, 2, 4, 6)] == ["keyword-top-1", "vector-top-2", "hybrid-keyword-only-top-3", "hybrid-keyword-only-top-5"]
    judged = spark.createDataFrame([(1, "short", None, False, None), (2, "x", None, True, None), (4, "bad", None, False, "no citations"), (7, "late", None, False, None)], "q long, generated string, model_citations array<string>, model_abstained boolean, payload_error string")
    laid = {r.q: r for r in service.overlay(out, judged, "q").collect()}
    assert laid[1].answer == "short" and laid[1].generated
    assert laid[2].answer == answers.ABSTENTION and laid[2].abstained and laid[2].citations
    assert laid[4].answer == got[4].answer and not laid[4].generated
    assert laid[7].abstained and not laid[7].generated
    logged = {tuple(r.retrieved_keys) for r in service.log_rows(out).collect()}
    assert logged == {(10,), (11, 10), (10, 11), ()}


def test_embeddings_have_the_providers_dimension(spark):
    rows = spark.createDataFrame([(1, "a b a"), (2, None), (3, "")], "k long, text string")
    got = {r.k: r.embedding for r in embed.embed(rows, "text", embed.HashingProvider(16)).collect()}
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-6 and got[2] is None and got[3] == [0.0] * 16

    class Short(embed.HashingProvider):
        def __call__(self, texts, purpose):
            return [[0.0] for _ in texts]

    with pytest.raises(Exception, match="unexpected dimension"):
        embed.embed(rows, "text", Short(16)).collect()
    with pytest.raises(embed.EmbeddingError, match="no embedding provider"):
        embed.embed(rows, "text", None)


def test_report_and_snapshots_are_written(spark, tmp_path):
    rows = spark.createDataFrame([(1, 3, [4, 5], [], 0.5)], "item int, top_k int, expected array<int>, got array<int>, recall double")
    snapshots.write_report(rows, rows.select("top_k", "recall"), f"{tmp_path}/report")
    back = spark.read.option("header", True).csv(f"{tmp_path}/report/rows").first()
    assert (back.expected, back.got) == ("4;5", None)
    assert spark.read.json(f"{tmp_path}/report/summary").first().recall == 0.5
    saved = spark.sql("select s as source_id, status, timestamp'2024-01-02 03:04:05' as retrieved_at, sha2(s, 256) as content_sha256 from values ('a', 'saved'), ('b', 'unchanged') as t(s, status)")
    snapshots.write_snapshots(saved, f"{tmp_path}/raw")
    got = spark.read.parquet(f"{tmp_path}/raw").collect()
    assert [(r.source_id, r.file_stem) for r in got] == [("a", "20240102T030405Z-ca978112ca1b")]


def test_newest_metadata_is_the_last_name(spark):
    rows = spark.createDataFrame([("a", "1", 1), ("a", "3", 2), ("a", "2", 3)], "source_id string, file_name string, x int")
    assert [tuple(r) for r in snapshots.latest_metadata(rows).collect()] == [("a", "3", 2)]
