"""Personal data by weak supervision; DataFrame and SQL functions only.

Candidates are the base matches (email, ip, card, phone), base-shaped matches that fail their check, and matches of
wider patterns (keys, spelled-out mail addresses, local phone numbers, identity numbers). Regex, gazetteer, context
and shape labelers vote 1, 0 (abstain) or -1 on each. Expectation-maximisation over the counts of vote patterns, of
which there are at most 3 ** 5, estimates how reliable each labeler is, and so gives each candidate a soft label. The
final span classifier, naive Bayes over bounded features of the span and its surroundings, is trained on these labels.
Base matches are always kept; other candidates are added if the classifier takes them and they overlap no base match.

Defined results: null text is the empty text, which has no spans; rows are judged one by one, so repeated ones alike;
texts are read whole, and n matches in one text cost n ** 1.5 small steps; equal vote patterns share one soft label, and
a candidate of exactly even odds is not added; an empty table gives an empty result. Columns of docs are carried along;
new ones replace columns of the same names. Positions are code points, end exclusive.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.arrays import let, scan

# \\G lets a match begin where the last one ended; else it begins at the start of a run. So no run is read from each of
# its places. Loops are possessive where nothing that follows could take back a character; so no recursion.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: what a text must match to be searched at all: cheap, and true wherever a match that passes can be
NEEDED = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
# Wider patterns, gazetteers and context words of the labelers.
WIDER = {
    "key": r"(?<![A-Za-z0-9_/+=-])(?=[A-Za-z_/+=-]*+[0-9])(?=[0-9_/+=-]*+[A-Za-z])[A-Za-z0-9_/+=-]{16,}+",
    "spelled_email": r"(?i)(?<![\w.])[\w.]++\x20?[\[(]?\bat\b[\])]?\x20?[\w-]++\x20?[\[(]?\bdot\b[\])]?\x20?[a-z]{2,6}\b",
    "local_phone": r"(?<![0-9+-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.-][0-9]{4}(?![0-9])",
    "id_number": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
WIDER_NEEDED = {"key": r"[0-9]", "spelled_email": r"(?i)\bdot\b", "local_phone": r"[0-9]{3}[.-][0-9]{4}", "id_number": r"[0-9]-[0-9]{2}-[0-9]"}
KINDS = [*BASE, *WIDER]
GAZETTEER = r"^(?:AKIA|ASIA|ghp_|gho_|sk-|pk_|xox[abp]-|AIza|eyJ)|(?i:\.(?:com|net|org|edu|gov|io|de|fr|es|uk)$)|^\+(?:1|33|34|44|49)\b"
CONTEXT = r"(?i)\b(?:e-?mail|mail|contact|tel|phone|call|fax|mobile|card|visa|credit|account|key|token|secret|password|address|ssn|host|server|kontakt|telefon|courriel|correo|clave)\b"
OTHER_CONTEXT = r"(?i)\b(?:isbn|version|page|order|invoice|ref|doi|issue|chapter|figure|commit|hash|checksum|uuid|seite|página)\b"
LABELERS = ("regex", "gazetteer", "context", "shape", "length")
FEATURES = ("kind", "size", "digits", "letters", "variety", "before", "after")
ROUNDS, SETTLED, NEAR, BELIEF = 500, 1e-9, 40, 0.2
CHUNK = 4096
FOUND = "struct<start:int,end:int,text:string,left:string,right:string>"


def occurrences(text: Column, pattern: str) -> Column:
    """array<struct<start,end,text,left,right>> of the leftmost non-overlapping matches, with what stands beside them."""

    def items(gaps: Column, hits: Column) -> Column:
        later = lambda i: F.concat(F.coalesce(F.get(gaps, i + 1), F.lit("")), F.coalesce(F.get(hits, i + 1), F.lit("")))
        return F.transform(hits, lambda h, i: F.struct(F.get(gaps, i).alias("gap"), h.alias("hit"), F.substring(later(i), 1, 1).alias("right")))

    def step(state: Column, x: Column) -> tuple[Column, Column]:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        left = F.substring(F.concat(state["tail"], x["gap"]), -NEAR, NEAR)
        after = F.struct(end.alias("at"), F.substring(F.concat(state["tail"], x["gap"], x["hit"]), -NEAR, NEAR).alias("tail"))
        return after, F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("text"), left.alias("left"), x["right"].alias("right"))

    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = let(F.struct(gaps.alias("g"), hits.alias("h")), lambda x: items(x["g"], x["h"]))
    return scan(found, F.struct(F.lit(0).alias("at"), F.lit("").alias("tail")), step, FOUND)


def luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def passes(kind: str, hit: Column) -> Column:
    """The base kind's check of a match."""
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: F.coalesce(p.try_cast("long") <= 255, F.regexp_replace(p, "^0+", "") == ""))
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _candidates(text: Column) -> Column:
    """array<struct<kind,start,end,text,valid,left,right>>; valid: 1 a base match, -1 a failing one, 0 a wider one."""
    kinds = {**BASE, **WIDER}
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,text:string,valid:int,left:string,right:string>>")

    def described(kind: str):
        def one(x: Column) -> Column:
            valid = F.when(passes(kind, x["text"]), 1).otherwise(-1) if kind in BASE else F.lit(0)
            return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), valid.alias("valid"), x["left"].alias("left"), x["right"].alias("right"))

        return one

    needed = {**NEEDED, **WIDER_NEEDED}
    return F.concat(*(F.when(text.rlike(needed[k]), F.transform(occurrences(text, p), described(k))).otherwise(empty) for k, p in kinds.items()))


def votes(c: Column) -> dict[str, Column]:
    """-1, 0 or 1 of each labeler on a candidate."""
    text, left = c["text"], c["left"]
    kinds = sum((text.rlike(p).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9]")), F.lit(0))
    wider_only = c["valid"] == 0
    distinct = F.size(F.array_distinct(F.split(text, "")))
    return {
        "regex": c["valid"],
        "gazetteer": F.when(text.rlike(GAZETTEER), 1).otherwise(0),
        "context": F.when(left.rlike(CONTEXT), 1).when(left.rlike(OTHER_CONTEXT), -1).otherwise(0),
        "shape": F.when((distinct >= 8) & (kinds >= 2), 1).when(distinct <= 4, -1).otherwise(0),
        "length": F.when(F.length(text) > 64, -1).when(wider_only & F.length(text).between(9, 40), 1).otherwise(0),
    }


def features(c: Column) -> dict[str, Column]:
    """Bounded values that the classifier sees."""
    text = c["text"]
    share = lambda pattern: (F.length(F.regexp_replace(text, pattern, "")) * 4 / F.length(text)).cast("int").cast("string")
    beside = lambda x: F.when(F.length(x) == 0, "edge").when(x.rlike(r"^\s$"), "space").when(x.rlike("^[A-Za-z0-9]$"), "word").otherwise("mark")
    return {
        "kind": F.concat(c["kind"], c["valid"].cast("string")),
        "size": F.least(F.length(text) / 4, F.lit(20)).cast("int").cast("string"),
        "digits": share("[^0-9]"),
        "letters": share("[^A-Za-z]"),
        "variety": F.least(F.size(F.array_distinct(F.split(text, ""))), F.lit(24)).cast("string"),
        "before": beside(F.substring(c["left"], -1, 1)),
        "after": beside(c["right"]),
    }


@dataclass
class SpanModel:
    """reliability: labeler -> (P(vote | personal), P(vote | not)) for votes -1, 0, 1; weights: feature -> value -> log odds."""

    prior: float
    reliability: dict[str, tuple[list[float], list[float]]]
    weights: dict[str, dict[str, float]]


BEGIN = ([0.1, 0.3, 0.6], [0.5, 0.4, 0.1])  # labelers that are right more often than not


def estimate(counts: dict[tuple[int, ...], int]) -> tuple[float, dict[str, tuple[list[float], list[float]]]]:
    """Prior and reliabilities by expectation-maximisation, until they settle; counts: vote pattern -> candidates.

    The starting values count like a share BELIEF of the candidates throughout.
    """
    prior, reliability = 0.5, {k: BEGIN for k in LABELERS}
    n = sum(counts.values())
    if not n:
        return prior, reliability
    given = 1 + BELIEF * n
    for _ in range(ROUNDS):
        belief = {}
        for pattern in counts:
            odds = math.log(prior / (1 - prior)) + sum(math.log(reliability[k][0][v + 1] / reliability[k][1][v + 1]) for k, v in zip(LABELERS, pattern))
            belief[pattern] = 1 / (1 + math.exp(-odds))
        yes = sum(belief[x] * m for x, m in counts.items())
        before, prior = prior, (yes + given / 2) / (n + given)
        moved = abs(prior - before)
        for i, k in enumerate(LABELERS):
            sides = []
            for side, total in ((0, yes), (1, n - yes)):
                mass = [sum((belief[x] if side == 0 else 1 - belief[x]) * m for x, m in counts.items() if x[i] == v) for v in (-1, 0, 1)]
                sides.append([(mass[v] + given * BEGIN[side][v]) / (total + given) for v in range(3)])
            moved = max(moved, *(abs(p - q) for new, old in zip(sides, reliability[k]) for p, q in zip(new, old)))
            reliability[k] = (sides[0], sides[1])
        if moved < SETTLED:
            break
    return prior, reliability


def fit(docs: DataFrame) -> SpanModel:
    """Labelers' reliabilities and the classifier, from all candidates of all documents, in one pass.

    What reaches the driver are counts by vote pattern and feature value: 3 ** 5 patterns times some 80 values at most.
    """
    each = docs.select(F.explode(_candidates(F.coalesce("text", F.lit("")))).alias("c"))
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("feature"), v.alias("value")) for k, v in features(F.col("c")).items())))
    counted = each.select(*(v.cast("int").alias(k) for k, v in votes(F.col("c")).items()), pairs.alias("x")).groupBy(*LABELERS, "x.feature", "x.value").agg(F.count("*").alias("n"))
    rows = sorted((tuple(r[k] for k in LABELERS), r["feature"], r["value"], r["n"]) for r in counted.collect())
    patterns: dict[tuple[int, ...], int] = {}
    for pattern, feature, _, n in rows:
        if feature == FEATURES[0]:  # each candidate has one value of it
            patterns[pattern] = patterns.get(pattern, 0) + n
    prior, reliability = estimate(patterns)
    logs = {k: [math.log(a / b) for a, b in zip(*reliability[k])] for k in LABELERS}
    soft = {x: 1 / (1 + math.exp(-math.log(prior / (1 - prior)) - sum(logs[k][v + 1] for k, v in zip(LABELERS, x)))) for x in patterns}
    mass: dict[str, dict[str, list[float]]] = {k: {} for k in FEATURES}
    for pattern, feature, value, n in rows:
        m = mass[feature].setdefault(value, [0.0, 0.0])
        m[0], m[1] = m[0] + soft[pattern] * n, m[1] + (1 - soft[pattern]) * n
    weights: dict[str, dict[str, float]] = {}
    for feature, values in mass.items():
        yes, no = (sum(m[i] for m in values.values()) + len(values) for i in (0, 1))
        weights[feature] = {v: math.log((m[0] + 1) / yes / ((m[1] + 1) / no)) for v, m in sorted(values.items())}
    return SpanModel(prior, reliability, weights)


def score(model: SpanModel, c: Column) -> Column:
    """The classifier's log odds that a candidate is personal data."""
    total = F.lit(math.log(model.prior / (1 - model.prior)))
    for k, value in features(c).items():
        if table := model.weights[k]:
            log_odds = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
            total = total + F.coalesce(F.try_element_at(log_odds, value), F.lit(0.0))
    return total


def annotate(docs: DataFrame, model: SpanModel) -> DataFrame:
    """docs with base_spans and spans: array<struct<kind,start,end>>, by kind as in KINDS, then start."""
    docs = docs.select([c for c in docs.columns if c.lower() not in ("base_spans", "spans", "_candidates")])
    held = docs.withColumn("_candidates", _candidates(F.coalesce("text", F.lit(""))))
    short = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    with_base = held.withColumn("base_spans", F.transform(F.filter("_candidates", lambda c: c["valid"] == 1), short))
    taken = F.transform(F.filter("_candidates", lambda c: (c["valid"] == 0) & (score(model, c) > 0)), short)
    return with_base.withColumn("spans", F.concat("base_spans", clear_of(taken, F.col("base_spans")))).drop("_candidates")


def clear_of(spans: Column, base: Column) -> Column:
    """Those of spans (kind, start, end) that overlap none of base, by kind as in KINDS, then start."""
    kind = "struct<start:int,end:int,kind:string,base:boolean,free:boolean>"
    marked = lambda xs, is_base: F.transform(xs, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), F.lit(is_base).alias("base")))

    def with_free(x: Column, free: Column) -> Column:
        return F.struct(*(x[c].alias(c) for c in ("start", "end", "kind", "base")), free.alias("free"))

    # In order of starts: what ends after this start comes before, what starts before this end comes next.
    onward = scan(F.array_sort(F.concat(marked(base, True), marked(spans, False))), F.lit(0), lambda reach, x: (F.when(x["base"], F.greatest(reach, x["end"])).otherwise(reach), with_free(x, x["start"] >= reach)), kind)
    back = scan(F.reverse(onward), F.lit(2**31 - 1), lambda near, x: (F.when(x["base"], x["start"]).otherwise(near), with_free(x, x["free"] & (x["end"] <= near))), kind)
    rank = lambda x: F.array_position(F.array(*map(F.lit, KINDS)), x["kind"])
    left = F.array_sort(F.transform(F.filter(back, lambda x: ~x["base"] & x["free"]), lambda x: F.struct(rank(x).alias("rank"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    both = F.transform(left, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return F.when((F.size(spans) == 0) | (F.size(base) == 0), spans).otherwise(both)


def redacted(text: Column, spans: Column) -> Column:
    """text with each span replaced by its kind in brackets; of overlapping spans the later start goes into the earlier.

    The text is cut into chunks once; each stretch that stays is then read from its chunks, not from the text's begin.
    """
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        mark = F.when(s["start"] >= at, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")
        return F.greatest(at, s["end"]), F.struct(at.alias("start"), F.greatest(at, s["start"]).alias("end"), mark.alias("mark"))

    def stretch(chunks: Column, a: Column, b: Column) -> Column:
        def part(c: Column) -> Column:
            begin = F.greatest(a - c * CHUNK, F.lit(0))
            return F.substring(F.get(chunks, c), begin + 1, F.least(b - c * CHUNK, F.lit(CHUNK)) - begin)

        inside = F.sequence(F.floor(a / CHUNK).cast("int"), F.floor((b - 1) / CHUNK).cast("int"))
        return F.when(b > a, F.array_join(F.transform(inside, part), "")).otherwise("")

    rest = F.struct(F.array_max(F.transform(spans, lambda s: s["end"])).alias("start"), F.length(text).alias("end"), F.lit("").alias("mark"))
    pieces = F.concat(scan(ordered, F.lit(0), step, "struct<start:int,end:int,mark:string>"), F.array(rest))
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    whole = let(chunks, lambda c: F.array_join(F.transform(pieces, lambda p: F.concat(stretch(c, p["start"], p["end"]), p["mark"])), ""))
    return F.when(F.size(spans) == 0, text).otherwise(whole)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
