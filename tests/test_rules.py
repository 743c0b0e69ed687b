import hashlib
import json
import random
import re

from pyspark.sql import functions as F

from granary.functions import text as fn
from granary.operators import rules
from granary.sources import html

PAGE = """<header>skip me</header><div id="block-body"><div class="y field--name-body"><div>Boats keep a lamp lit at night.</div><hr><div>Small ones may use a lantern.</div>
<p>Supplementary Material: ------</p><p>.01 Lamps. A lamp burns oil or gas.</p><p>.02 Lanterns</p><p>They hang from the mast.</p>
<table class="wide footnote"><tr><td>Adopted; eff. March 3, 2015. Renumbered later; see <ref>15-07</ref> and <ref>16-20</ref></td></tr></table></div></div><footer>skip too</footer>"""
TEXTS = ["(a) Title", "(a) Text of it; more", "(b) " + "long " * 30, "(1) child heading", "(2) child text.", "plain words", "another. one", "Supplementary Material: --", ".01 Head. Body here", ".02 Only heading", "(12) x", "(aa) y", ""]


def cut_at(items, opening):
    """What comes before the first item that matches opening, and then one list from each such item on."""
    places = [n for n, (_, t) in enumerate(items) if re.fullmatch(opening, t)]
    return items[: places[0]] if places else items, [items[m:n] for m, n in zip(places, [*places[1:], len(items)])]


def opened(run, opening, wordy):
    """(label, heading, bodies) of a run by its opening; wordy says of the words after the label whether they are text."""
    label, rest = re.fullmatch(opening, run[0][1]).groups()
    more = [t for _, t in run[1:]]
    return (label, None, [rest, *more]) if wordy(rest) else (label, rest, more)


def model(texts):
    """Sections of one document, cut by cut: (label, heading, content, indexes), or None where it has a fault."""
    items = [(i, t) for i, t in enumerate(texts) if t]
    marks = [n for n, (_, t) in enumerate(items) if re.search(rules.MARKER[4:], t)]
    rule, extra = (items[: marks[0]], [x for n, x in enumerate(items) if n > marks[0] and n not in marks]) if marks else (items, [])
    stray, notes = cut_at(extra, r"\.\d\d\s+.+")
    if stray or not rule:
        return None
    at, join, wordy = lambda run: [i for i, _ in run], "\n\n".join, lambda v: len(v) > 80 or bool(set(v) & set(".;:?!"))
    intro, parts = cut_at(rule, r"\([a-z]\)\s+.+")
    out = [(None, None, join(t for _, t in intro), at(intro))] if intro else []
    for part in parts:
        own, children = cut_at(part, r"\(\d+\)\s+.+")
        label, heading, bodies = opened(own, r"(\([a-z]\))\s+(.+)", wordy)
        out.append((label, heading, join(bodies), at(own)))
        short = heading is None and 0 < len(join(bodies)) <= 200
        for child in children:
            number, name, texts = opened(child, r"(\(\d+\))\s+(.+)", wordy)
            out.append((label + number, name, join([join(bodies)] * short + texts), at(child)))
    for note in notes:
        label, rest, more = opened(note, r"(\.\d\d)\s+(.+)", lambda v: False)
        name, _, first = rest.partition(". ")
        out.append((label, name, join([first] * bool(first) + more), at(note)))
    return out


def test_sections_equal_a_loop(spark):
    rng = random.Random(5)
    docs = [[rng.choice(TEXTS) for _ in range(rng.randint(0, 9))] for _ in range(300)]
    rows = [(d, i, "p", [], t, []) for d, texts in enumerate(docs) for i, t in enumerate(texts)]
    elements = spark.createDataFrame(rows, "d int, element_index int, tag string, classes array<string>, text string, refs array<string>")
    got = {}
    sections = rules.rule_sections(elements, "d")
    for r in sections.orderBy("d", "section").collect():
        got.setdefault(r.d, []).append((r.label, r.heading, r.content, [x.element_index for x in r.locators]))
    want = {d: m for d, texts in enumerate(docs) if (m := model(texts)) is not None}
    assert got == want
    bad = {r.d for r in rules.faults(elements, "d").collect()}
    assert bad == {d for d, texts in enumerate(docs) if texts and model(texts) is None}
    audit = rules.rule_audit(elements, sections, "d").join(sections.select("d").distinct(), "d", "left_semi")
    assert all(r.exact and r.ratio == 1.0 and r.missing == [] for r in audit.collect())


def test_rule_page_from_html_to_hash(spark):
    pages = spark.createDataFrame([("r", PAGE), ("none", "<p>x</p>"), ("two", PAGE + PAGE), ("null", None)], "id string, html string")
    elements = html.rule_elements(pages, "id").withColumn("no", F.lit("7310")).cache()
    errors = {r.id: r.error for r in elements.filter("error is not null").collect()}
    assert errors == {"none": "expected one body, found 0", "two": "expected one body, found 2", "null": "expected one body, found 0"}
    good = elements.filter("error is null")
    sections = rules.rule_sections(good, "id", "no")
    a, b, c = sections.orderBy("section").collect()
    assert (a.label, a.section_path, a.content, a.display_label, a.section_type) == (None, "7310", "Boats keep a lamp lit at night.\n\nSmall ones may use a lantern.", "Main rule text", "rule_text")
    assert (b.label, b.section_path, b.content, b.section_type) == (".01", "7310 > Supplementary Material > .01 Lamps", "A lamp burns oil or gas.", "supplementary")
    assert (c.label, c.heading, c.section_path, c.content) == (".02", "Lanterns", "7310 > Supplementary Material > .02 Lanterns", "They hang from the mast.")
    assert a.locators[1].selector == "#block-body .field--name-body > :nth-child(3)"  # the rule between them counts
    assert b.locators[0].source_text_hash == hashlib.sha256(b".01 Lamps. A lamp burns oil or gas.").hexdigest()
    past = rules.history(good, "id")
    note = past.select("notices", fn.effective_date(F.col("source_text")).cast("string").alias("at"), fn.effective_evidence(F.col("source_text")).alias("why")).first()
    assert (note.notices, note.at, note.why) == (["15-07", "16-20"], "2015-03-03", "Adopted; eff. March 3, 2015.")
    assert rules.rule_audit(good, sections, "id").first().exact
    said = {"rule_number": "7310", "title": 'T "q"\té', "source_type": "rule", "source_url": "https://a.org", "latest_effective_date": None, "history": past.first().source_text}
    docs = spark.createDataFrame([("r", *said.values())], "id string, " + ", ".join(f"{k} string" for k in said))
    said["sections"] = [{"label": s.label, "heading": s.heading, "section_type": s.section_type, "content": s.content} for s in (a, b, c)]
    canonical = json.dumps(said, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    assert rules.content_hash(docs, sections, "id").first().normalized_hash == hashlib.sha256(canonical.encode()).hexdigest()


def test_second_footnote_fails_the_audit(spark):
    rows = [(1, 0, "p", [], "text", []), (1, 1, "table", ["footnote"], "first", []), (1, 2, "table", ["footnote"], "second", [])]
    elements = spark.createDataFrame(rows, "d int, element_index int, tag string, classes array<string>, text string, refs array<string>")
    r = rules.rule_audit(elements, rules.rule_sections(elements, "d"), "d").first()
    assert (r.exact, r.missing) == (False, [1])


def test_evidence_sentence(spark):
    texts = ["One. Two; eff. Dec. 31, 2009. Three. Four", "eff. May 1, 2020", "none"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    assert [r[0] for r in df.select(fn.effective_evidence(F.col("t"))).collect()] == ["Two; eff. Dec. 31, 2009.", "eff. May 1, 2020", None]
