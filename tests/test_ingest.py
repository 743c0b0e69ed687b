"""From a manifest over snapshots and documents to a stored corpus and what is searched in it."""

import json

import pytest
from pyspark.sql import functions as F

from granary.operators import ann, ingest, normalize, retrieval, service, store
from granary.settings import Settings, SettingsError
from granary.sources import embed, fetch, manifest, snapshots

MANIFEST = """
version: 1
corpus_name: harbour
scope: harbour-only
allowed_hosts: [" Port.Example.org "]
sources:
  - {source_id: port-rule-1, rule_number: "7310", title: " Lamps ", source_type: rule, url: "https://port.example.org/a"}
  - {source_id: port-guide-1, title: Guide, source_type: guidance, url: "https://port.example.org/b"}
"""
RULE = "<div id='block-body'><div class='field--name-body'><p>(a) Lamps</p><p>(1) burn; all night.</p>{}</div></div>"
GUIDE = "<main><h1>Top</h1><p>one two three</p><h3>Deep</h3><li>four</li></main>"
SOURCE = "source_id string, rule_number string, title string, source_type string, url string, html_file string, retrieved_at string, content string"


def test_manifest_is_read(spark, tmp_path):
    path = tmp_path / "m.yaml"
    path.write_text(MANIFEST)
    m = manifest.read_manifest(spark, str(path), "harbour-only")
    assert (m.corpus_name, m.hosts) == ("harbour", ["port.example.org"])
    rows = m.sources.orderBy("ordinal").collect()
    assert [(r.source_id, r.rule_number, r.title) for r in rows] == [("port-rule-1", "7310", "Lamps"), ("port-guide-1", None, "Guide")]
    assert manifest.source(m.sources, "port-guide-1").first().title == "Guide"
    with pytest.raises(LookupError, match="port-x"):
        manifest.source(m.sources, "port-x")


@pytest.mark.parametrize(
    "old, new, message",
    [
        ("version: 1", "version: 2", "version must be 1"),
        ("corpus_name: harbour", "corpus_name: ' '", "missing or blank: corpus_name"),
        ("harbour-only", "all", "scope must be"),
        ('[" Port.Example.org "]', "[]", "allowed_hosts"),
        ('[" Port.Example.org "]', "[other.org]", "source 0: host is not allowed"),
        ("port-guide-1", "port-rule-1", "duplicate source id: port-rule-1"),
        ("https://port.example.org/b", "http://port.example.org/b", "source 1: url is not https"),
        ("https://port.example.org/b", "https://u:p@port.example.org/b", "source 1: url has credentials"),
        ('rule_number: "7310", ', "", "source 0: rule number is missing"),
        ("title: Guide", "title: [x]", "source 1: must be a mapping of texts"),
        ("sources:", "others:", "there are no sources"),
        ("version: 1", "{", "not valid YAML"),
    ],
)
def test_faulty_manifests(spark, tmp_path, old, new, message):
    path = tmp_path / "m.yaml"
    path.write_text(MANIFEST.replace(old, new))
    with pytest.raises(manifest.ManifestError, match=message):
        manifest.read_manifest(spark, str(path), "harbour-only")


def test_settings(tmp_path):
    assert (Settings().retrieval_mode, Settings().top_k, Settings().rrf_k) == ("hybrid", 5, 60)
    file = tmp_path / ".env"
    file.write_text("# note\nGRANARY_TOP_K=7\nGRANARY_GENERATION_PROVIDER='x'\nOTHER=1\n")
    s = Settings.read({"GRANARY_RRF_K": "10", "granary_top_k": "8", "GRANARY_REQUEST_TIMEOUT": ""}, str(file))
    assert (s.top_k, s.rrf_k, s.generation_provider, s.request_timeout) == (8, 10, "x", 30.0)
    assert not s.has_generation_credentials() and not s.has_embedding_credentials() and s.embedding_model_name() is None
    keyed = Settings(embedding_provider="v", embedding_model="m", embedding_key="k")
    assert keyed.has_embedding_credentials() and keyed.embedding_model_name() == "v/m"
    for bad in ({"GRANARY_TOP_K": "21"}, {"GRANARY_TOP_K": "x"}, {"GRANARY_RRF_K": "0"}, {"GRANARY_CHUNK_OVERLAP": "600"}, {"GRANARY_RETRIEVAL_MODE": "all"}):
        with pytest.raises(SettingsError):
            Settings.read(bad)


def getter(body):
    html = {"content-type": "text/html"}
    return lambda url: fetch.Response(200, url, html, body.encode() + b" " * 1000)


def test_fetched_snapshots_are_stored_once(spark, tmp_path):
    sources = spark.createDataFrame([("port-rule-1", "7310", "Lamps", "rule", "https://port.example.org/a")], "source_id string, rule_number string, title string, source_type string, url string")
    run = lambda body, at: fetch.fetch_all(sources, ["port.example.org"], getter(body), str(tmp_path), now=lambda: at)
    assert run("A", "2024-01-01T00:00:00") == {"saved": 1}
    assert run("A", "2024-01-02T00:00:00") == {"unchanged": 1}
    assert run("B", "2024-01-03T00:00:00") == {"saved": 1}
    assert run("A", "2024-01-04T00:00:00") == {"saved": 1}
    kept = snapshots.stored(spark, str(tmp_path)).orderBy("html_file").collect()
    assert [r.html_file[:16] for r in kept] == ["20240101T000000Z", "20240103T000000Z", "20240104T000000Z"]
    assert (kept[0].requested_url, kept[0].rule_number, kept[0].content_length_bytes, kept[0].fetcher_version) == ("https://port.example.org/a", "7310", 1001, fetch.AGENT_VERSION)
    assert snapshots.consistent(snapshots.stored(spark, str(tmp_path)), snapshots.stored(spark, str(tmp_path))).filter("error is not null").count() == 0
    summary = spark.read.json(f"{tmp_path}/_runs/*/fetch_summary")
    assert sorted((r.status, r.n) for r in summary.collect()) == [("saved", 1)] * 3 + [("unchanged", 1)]


def test_judged_responses_equal_checked_ones(spark):
    rows = [("https://A.org/x", "text/html", b"x" * 1000), ("http://a.org/x", "text/html", b"x" * 1000), ("https://b.org/", "text/html", b"x" * 1000), ("https://a.org/", "TEXT/html ; charset=x", b"x" * 999), ("https://a.org/", "application/pdf", b"x" * 2000), ("https://a.org/", None, None)]
    got = fetch.judged(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "source_id int, final_url string, content_type string, body binary"), ["a.org"]).orderBy("source_id").collect()
    for (url, kind, body), r in zip(rows, got):
        try:
            fetch.checked(fetch.Response(200, url, {"content-type": kind or ""}, body or b""), ["a.org"])
            assert (r.status, r.error) == ("saved", None)
        except ValueError as e:
            assert r.status == "failed" and r.error.split(":")[0] == str(e).split(":")[0]


def test_newest_metadata_files(spark, tmp_path):
    for name, text in (("1", json.dumps({"source_id": "a", "html_file": "1.html"})), ("2", json.dumps({"source_id": "a", "html_file": "2.html"})), ("3", "[1]"), ("4", "{"), ("5", json.dumps({"source_id": "b", "html_file": " "}))):
        (tmp_path / f"{name}.metadata.json").write_text(text)
    files = snapshots.read_metadata(spark, str(tmp_path))
    assert sorted((r.file_name[0], r.source_id) for r in files.collect()) == [("1", "a"), ("2", "a"), ("3", None), ("4", None), ("5", "b")]
    sources = spark.createDataFrame([("a",), ("b",), ("c",)], "source_id string")
    got = {r.source_id: (r.html_file, r.error) for r in snapshots.newest_snapshots(sources, files).collect()}
    assert got == {"a": ("2.html", None), "b": (" ", "metadata names no file"), "c": (None, "no snapshot")}


def test_cases_are_read(spark, tmp_path):
    case = {"id": "1", "question": "q", "expected_rule_numbers": ["1"], "expected_answerable": True, "category": "x"}
    (tmp_path / "c.jsonl").write_text(json.dumps(case) + "\n" + json.dumps(case | {"id": "2", "expected_subsections": ["(a)"]}))
    rows = snapshots.read_cases(spark, f"{tmp_path}/c.jsonl").orderBy("id").collect()
    assert [(r.id, r.expected_rule_numbers, r.expected_subsections) for r in rows] == [("1", ["1"], []), ("2", ["1"], ["(a)"])]


def snapshot_rows(spark):
    foot = "<table class='footnote'><tr><td>Adopted; eff. {} 3, 2015.</td></tr></table>"
    page = lambda i, kind, html, at="2024-01-01T00:00:00": (i, "7310" if kind == "rule" else None, "T " + i, kind, "https://port.example.org/" + i, i + ".html", at, html)
    rows = [
        page("good", "rule", RULE.format(foot.format("March"))), page("guide", "guidance", GUIDE), page("month", "rule", RULE.format(foot.format("Sept."))), page("notes", "rule", RULE.format(foot.format("March") * 2)),
        page("none", "rule", "<p>x</p>"), page("bare", "guidance", "<main><table></table></main>"), page("orphan", "rule", RULE.format("<p>Supplementary Material: --</p><p>x</p>")), page("odd", "note", GUIDE),
    ]
    return spark.createDataFrame(rows, SOURCE)


def test_snapshots_become_documents_or_faults(spark):
    documents, faults = normalize.normalized(snapshot_rows(spark))
    got, bad = {r.source_id: r for r in documents.collect()}, {r.source_id: r.error for r in faults.collect()}
    assert set(got) == {"good", "guide"}
    assert bad == {"month": "unreadable effective date", "notes": "audit failed: missing [2], extra []", "none": "expected one body, found 0", "bare": "the body is empty", "orphan": "supplementary content before a section", "odd": "unknown source type"}
    good = got["good"]
    assert (good.latest_effective_date, good.effective_date_evidence.source_text, good.history.locator.element_index, good.audit.exact) == ("2015-03-03", "Adopted; eff. March 3, 2015.", 2, True)
    assert [(s.label, s.section_path, s.content) for s in good.sections] == [("(a)", "7310 > (a) Lamps", ""), ("(a)(1)", "7310 > (a) Lamps > (1)", "burn; all night.")]
    assert [(s.section_path, s.content) for s in got["guide"].sections] == [("T guide > Top", "one two three"), ("T guide > Top > Deep", "four")]
    again, _ = normalize.normalized(snapshot_rows(spark).withColumn("content", F.replace("content", F.lit("<p>"), F.lit("<p id='z'>"))).withColumn("retrieved_at", F.lit("2025-05-05T00:00:00")))
    for r in again.collect():
        assert r.normalized_content_hash == got[r.source_id].normalized_content_hash and (r.source_id != "good" or r.raw_content_hash != good.raw_content_hash)


def test_ingesting_twice_changes_nothing(spark, tmp_path):
    held = store.Store(spark, str(tmp_path))
    documents, _ = normalize.normalized(snapshot_rows(spark))
    assert held.add(documents, 2, 0) == 2 and held.add(documents, 2, 0) == 0
    assert held.add(documents, 600, 50) == 2  # other chunks, other documents
    chunks = held.chunks()
    guide = chunks.filter("source_id = 'guide' and chunk_target_tokens = 2").orderBy("chunk_index").collect()
    assert [(c.chunk_index, c.section_path, c.content) for c in guide] == [(0, "T guide > Top", "one two"), (1, "T guide > Top", "three"), (2, "T guide > Top > Deep", "four")]
    assert store.repeated(chunks, ["document_id", "chunk_index"]).count() == store.repeated(held.documents(), list(store.UNIQUE)).count() == 0
    assert store.orphans(chunks, held.documents()).count() == 0
    assert store.without(chunks, held.documents().filter("source_id = 'guide'")).filter("source_id = 'guide'").count() == 0
    n = chunks.count()
    assert held.embed(embed.HashingProvider(8), "hashing/8") == n and held.embed(embed.HashingProvider(8)) == 0
    assert held.chunks().filter("embedding is null or embedding_model <> 'hashing/8'").count() == 0
    later = documents.filter("source_id = 'guide'").withColumn("retrieved_at", F.lit("2024-02-02T00:00:00")).withColumn("normalized_content_hash", F.sha2("normalized_content_hash", 256))
    assert held.add(later, 600, 50) == 1
    newest = held.newest_chunks()
    assert {r.retrieved_at.isoformat()[:10] for r in newest.filter("source_id = 'guide'").collect()} == {"2024-02-02"}
    asked = spark.createDataFrame([("q", "four lamps")], "q string, question string")
    found = store.passages(retrieval.keyword_search(asked, "q", "question", newest, "chunk_id", "content", section_path="section_path"), newest, "q")
    assert found.columns == ["q", "rank", *store.PASSAGE]
    assert {(r.section_path, round(r.score, 6)) for r in found.collect()} == {("T guide > Top > Deep", 0.1), ("7310 > (a) Lamps > (1)", 0.1)}


def test_english_search_over_paths(spark):
    chunks = spark.createDataFrame([(1, "Lamps > Burning", "the lamp burned"), (2, None, "lamps")], "c int, path string, content string")
    asked = spark.createDataFrame([("q", "burn a lamp"), ("one", "of"), ("two", "of it")], "q string, question string")
    got = {(r.q, r.c): round(r.score, 6) for r in retrieval.keyword_search(asked, "q", "question", chunks, "c", "content", section_path="path", english=True).collect()}
    assert got == {("q", 1): 0.4, ("q", 2): 0.1}
    places = {(r.c, r.stem): r.positions for r in retrieval.positions(chunks, "c", "content", "path").collect()}
    assert places == {(1, "lamp"): [1, 4], (1, "burn"): [2, 5], (2, "lamp"): [1]}
    plain = retrieval.keyword_search(asked, "q", "question", spark.createDataFrame([(1, "of it")], "c int, content string"), "c", "content")
    assert [(r.q, r.c) for r in plain.collect()] == [("one", 1)]  # a single word stands for itself


def test_stored_index(spark, tmp_path):
    chunks = spark.createDataFrame([(i, f"w{i % 7} w{i % 3} common") for i in range(40)], "c int, content string")
    asked = spark.createDataFrame([(q, f"w{q} common zzz") for q in range(5)], "q int, question string")
    retrieval.write_index(retrieval.postings(chunks, "c", "content"), f"{tmp_path}/index")
    stored = retrieval.search_index(retrieval.asked_terms(asked, "q", "question"), "q", retrieval.read_index(spark, f"{tmp_path}/index"), "c")
    direct = retrieval.keyword_search(asked, "q", "question", chunks, "c", "content")
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, direct.collect()))


def test_vectors_of_odd_shapes(spark, monkeypatch):
    vectors = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, 1.0]), (6, [1.0]), (7, [0.0, -1.0])]
    chunks = spark.createDataFrame(vectors, "c int, embedding array<float>")
    asked = spark.createDataFrame([("x", [3.0, 0.0]), ("zero", [0.0, 0.0]), ("none", None), ("short", [2.0])], "q string, embedding array<float>")
    for size in (retrieval.TILE_BYTES, 16):
        monkeypatch.setattr(retrieval, "TILE_BYTES", size)
        got = {(r.q, r.rank): (r.c, r.score) for r in retrieval.vector_search(asked, "q", chunks, "c", k=4).collect()}
        assert [got["x", i] for i in (1, 2, 4)] == [(1, 1.0), (2, 1.0), (7, 0.0)] and got["x", 3] == (5, pytest.approx(0.5**0.5))
        assert [got["zero", i] for i in (1, 2, 3, 4)] == [(1, None), (2, None), (3, None), (5, None)]
        assert got["short", 1] == (6, 1.0) and got["short", 2] == (1, None) and ("none", 1) not in got


def test_approximate_index(spark, tmp_path):
    rng = __import__("numpy").random.default_rng(0)
    centres = rng.normal(size=(10, 16))
    rows = [(i, (centres[i % 10] + 0.2 * rng.normal(size=16)).tolist()) for i in range(600)] + [(1000, None), (1001, [0.0] * 16)]
    chunks = spark.createDataFrame(rows, "c int, embedding array<double>")
    asked = chunks.filter("c % 20 = 0 and c < 600").withColumnRenamed("c", "q")
    cells = ann.fit(chunks)
    ann.write_index(chunks, "c", f"{tmp_path}/cells", cells)
    index = spark.read.parquet(f"{tmp_path}/cells")
    assert index.count() == 601  # every row with a vector
    exact = retrieval.vector_search(asked, "q", chunks, "c")
    whole = ann.search(asked, "q", index, "c", cells, probes=cells.n)
    plain = lambda df: sorted((r.q, r.c, r.rank) for r in df.select("q", "c", "rank").collect())
    assert plain(whole) == plain(exact)
    probes = ann.probes_for(0.93, asked, "q", exact, index, "c", cells)
    assert probes < cells.n and ann.recall(ann.search(asked, "q", index, "c", cells, probes=probes), exact, "q", "c").first().recall >= 0.9


def test_prompt_and_log(spark, tmp_path):
    asked = spark.createDataFrame([("Why?", [(1, "one")])], "question string, p array<struct<rank:int,content:string>>")
    text = asked.select(service.prompt(F.col("question"), F.col("p"))).first()[0]
    assert text.split("\n\n")[1:] == ["QUESTION Why?", 'PASSAGE {"rank":1,"content":"one"}']
    for _ in range(2):
        snapshots.append_log(spark.createDataFrame([("q", 5)], "question string, latency_ms int"), f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 2
    with pytest.raises(ValueError):
        service.latency_ms(2.0, 1.0, strict=True)
    assert service.latency_ms(1.0, 1.25) == 250 and service.latency_ms(2.0, 1.0) == 0


def test_documents_are_written_by_name(spark, tmp_path):
    documents, _ = normalize.normalized(snapshot_rows(spark))
    snapshots.write_documents(documents, str(tmp_path))
    rows = spark.read.json(str(tmp_path)).collect()
    assert {r.source_id: r.file_name[:17] for r in rows} == {"good": "20240101T000000Z-", "guide": "20240101T000000Z-"}
    assert ingest.violations(documents, {"hash": F.col("normalized_content_hash").rlike("^[a-f0-9]{64}$")}).first().n == 0
