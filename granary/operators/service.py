"""Questions as rows: request checks, retrieval by mode, responses, answers of a model, the query log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import out_of_scope
from granary.operators import answers, retrieval

MODES, DEFAULT_MODE, DEFAULT_K, MOST_K = ("vector", "keyword", "hybrid"), "hybrid", 5, 20
PROMPT_VERSION = "evidence-v1"
DISCLAIMER = "For information only; not legal, compliance or investment advice."
CITED_BY = ("rule_number", "subsection", "source_url")
ASKED = "Answer from these passages alone, as JSON: answer (string), citations (array of " + ", ".join(CITED_BY) + ", title, supporting_excerpt, each excerpt word for word from one passage), abstained (boolean)."


def checked_requests(requests: DataFrame) -> DataFrame:
    """requests (question, retrieval_mode, top_k) with defaults for null modes and sizes, and error, null where one is valid."""
    size = F.length(F.coalesce("question", F.lit("")))
    filled = requests.withColumn("retrieval_mode", F.coalesce("retrieval_mode", F.lit(DEFAULT_MODE))).withColumn("top_k", F.coalesce("top_k", F.lit(DEFAULT_K)))
    checks = [
        (~size.between(3, 2000), "question must have 3 to 2000 characters"),
        (~F.col("retrieval_mode").isin(*MODES), "unknown retrieval mode"),
        (~F.col("top_k").between(1, MOST_K), f"top_k must be from 1 to {MOST_K}"),
    ]
    return filled.withColumn("error", F.coalesce(*(F.when(bad, message) for bad, message in checks)))


def configuration(mode: Column, k: Column, embedded: Column) -> Column:
    """The label of what was done: hybrid retrieval without an embedding is keyword retrieval."""
    name = F.when((mode == "hybrid") & ~embedded, "hybrid-keyword-only").otherwise(mode)
    return F.concat(name, F.lit("-top-"), k.cast("string"))


def dispatch(requests: DataFrame, query: str) -> DataFrame:
    """Checked requests (with embedding, null without a provider) with gated, error and retrieval_configuration.

    Questions out of scope are gated before anything is retrieved, and so never miss an embedding.
    """
    held = checked_requests(requests).withColumn("gated", F.col("error").isNull() & out_of_scope(F.coalesce("question", F.lit(""))))
    held = held.withColumn("embedding", F.when(~F.col("gated"), F.col("embedding")))
    missing = (F.col("retrieval_mode") == "vector") & F.col("embedding").isNull() & ~F.col("gated")
    held = held.withColumn("error", F.coalesce("error", F.when(missing, "vector retrieval needs an embedding provider")))
    label = configuration(F.col("retrieval_mode"), F.col("top_k"), F.col("embedding").isNotNull())
    return held.withColumn("retrieval_configuration", label)


def retrieve(requests: DataFrame, chunks: DataFrame, query: str, key: str, text: str) -> DataFrame:
    """(query, key, score, rank) of dispatched requests over chunks (key, text, embedding), at most top_k each.

    Each retriever runs once for all questions; hybrid ones fuse the same number of candidates whatever their top_k.
    """
    live = requests.filter(F.col("error").isNull() & ~F.col("gated"))
    mode = live.select(query, "retrieval_mode", "top_k")
    lexical = live.filter("retrieval_mode <> 'vector'")
    dense = live.filter("retrieval_mode <> 'keyword' and embedding is not null")
    words = retrieval.keyword_search(lexical, query, "question", chunks, key, text, MOST_K)
    vectors = retrieval.vector_search(dense, query, chunks, key, k=MOST_K)
    of = lambda df, *names: df.join(mode.filter(F.col("retrieval_mode").isin(*names)).select(query), query, "left_semi")
    fused = retrieval.hybrid_search(of(words, "hybrid"), of(vectors, "hybrid"), query, key, MOST_K)
    columns = [query, key, "score", "rank"]
    ranked = of(words, "keyword").select(columns).unionByName(of(vectors, "vector").select(columns)).unionByName(fused.select(columns))
    return ranked.join(mode.select(query, "top_k"), query).filter(F.col("rank") <= F.col("top_k")).select(columns)


def responses(requests: DataFrame, passages: DataFrame, query: str) -> DataFrame:
    """One row per dispatched request: answer, abstained, citations, label and versions; no answer where it has an error."""
    given = answers.grounded_answers(requests.filter("error is null"), passages, query, MOST_K)
    out = requests.select(query, "question", "retrieval_mode", "top_k", "error", "retrieval_configuration").join(given, query, "left")
    return out.withColumns({"prompt_version": F.lit(PROMPT_VERSION), "disclaimer": F.lit(DISCLAIMER)})


def prompt(question: Column, passages: Column) -> Column:
    """What a model is asked; passages is array<struct<rank,content,...>> by rank, each with its other fields by name."""
    block = F.transform(passages, lambda p: F.concat(F.lit("PASSAGE "), F.to_json(p)))
    return F.concat_ws("\n\n", F.lit(ASKED), F.concat(F.lit("QUESTION "), question), F.array_join(block, "\n\n"))


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def judged_payloads(payloads: DataFrame, passages: DataFrame, query: str, on: tuple[str, ...] = CITED_BY) -> DataFrame:
    """(query, generated, model_citations, model_abstained, payload_error) of payloads (query, payload: a model's JSON).

    A payload counts if it has an answer and either abstains or cites, each citation agreeing in `on` (null with null)
    with a passage (query, rank, content, title, *on) whose first such one holds the excerpt. A missing title is the passage's.
    """
    v = payloads.select(query, F.try_parse_json("payload").alias("v"))
    cited, answer, flag = _field(F.col("v"), "citations"), _field(F.col("v"), "answer"), _field(F.col("v"), "abstained")
    read = v.select(
        query,
        F.col("v").isNotNull().alias("_json"),
        F.when(_kind(answer) == "STRING", F.try_variant_get("v", "$.answer", "string")).alias("generated"),
        F.coalesce(~F.to_json(flag).isin("false", "null", "0", "0.0", '""', "[]", "{}"), F.lit(False)).alias("model_abstained"),
        (_kind(cited).startswith("ARRAY") | cited.isNull()).alias("_listed"),
        F.coalesce(F.try_variant_get("v", "$.citations", "array<variant>"), F.array().cast("array<variant>")).alias("_cited"),
    )
    one = read.select(query, F.posexplode("_cited").alias("_at", "c"))
    text = lambda name: F.when(_kind(_field(F.col("c"), name)) == "STRING", F.try_variant_get("c", f"$.{name}", "string")).alias(name)
    plain = [_kind(_field(F.col("c"), name)).isin("STRING", "VOID") for name in on]
    sound = _kind(F.col("c")).startswith("OBJECT")
    for p in plain:
        sound = sound & p
    flat = one.select(query, "_at", *map(text, (*on, "title")), F.when(sound, F.try_variant_get("c", "$.supporting_excerpt", "string")).alias("excerpt"), (_kind(_field(F.col("c"), "supporting_excerpt")) == "STRING").alias("_text"))
    tried = answers.check_citations(flat, passages, query, list(on), carry=("title",))
    row = F.struct("_at", *on, F.coalesce("title", "passage_title").alias("title"), F.col("excerpt").alias("supporting_excerpt"))
    whole = tried.groupBy(query).agg(F.bool_and(F.col("valid") & F.col("_text")).alias("_valid"), F.array_sort(F.collect_list(row)).alias("_rows"))
    out = read.join(whole, query, "left")
    checks = [
        (~F.col("_json"), "not valid JSON"),
        (F.col("generated").isNull(), "answer is missing"),
        (~F.col("_listed"), "citations are not a list"),
        (~F.col("model_abstained") & F.col("_valid").isNull(), "no citations"),
        (~F.col("model_abstained") & ~F.col("_valid"), "a citation is not supported by evidence"),
    ]
    rows = F.transform("_rows", lambda c: F.struct(*(c[name].alias(name) for name in (*on, "title", "supporting_excerpt"))))
    return out.select(query, "generated", F.when(~F.col("model_abstained"), rows).alias("model_citations"), "model_abstained", F.coalesce(*(F.when(bad, m) for bad, m in checks)).alias("payload_error"))


def overlay(given: DataFrame, judged: DataFrame, query: str) -> DataFrame:
    """Responses with a model's answer where it has passages and its payload counts; else they stay as they are."""
    good = judged.filter("payload_error is null").drop("payload_error")
    joined = given.join(good, query, "left")
    use = F.col("model_abstained").isNotNull() & F.col("error").isNull() & ~F.col("abstained")
    return joined.select(
        *(c for c in given.columns if c not in ("answer", "abstained", "n_citations")),
        F.when(use & F.col("model_abstained"), answers.ABSTENTION).when(use, F.col("generated")).otherwise(F.col("answer")).alias("answer"),
        F.when(use, F.col("model_abstained")).otherwise(F.col("abstained")).alias("abstained"),
        F.when(use, F.coalesce(F.size("model_citations"), F.lit(0))).otherwise(F.col("n_citations")).alias("n_citations"),
        F.when(use, F.col("model_citations")).alias("model_citations"),
        use.alias("generated"),
    )


def latency_ms(began: float, ended: float, strict: bool = False) -> int:
    """Whole milliseconds between two readings of a clock, 0 if it ran backwards (an error if strict)."""
    if strict and ended < began:
        raise ValueError("the clock ran backwards")
    return max(0, int((ended - began) * 1000))


def log_rows(given: DataFrame, key: str = "key", latency: int | None = None) -> DataFrame:
    """What the query log keeps of responses without error: no passages, only their keys; latency is that of the batch."""
    keys = F.transform(F.coalesce("citations", F.array().cast(given.schema["citations"].dataType)), lambda c: c[key])
    config = F.struct(F.col("retrieval_mode").alias("mode"), "top_k", F.col("retrieval_configuration").alias("configuration"))
    return given.filter("error is null").select("question", "answer", "abstained", keys.alias("retrieved_keys"), config.alias("retrieval_configuration"), "prompt_version", *([F.lit(latency).alias("latency_ms")] if latency is not None else []))
