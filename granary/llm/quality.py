"""Quality rules: exact repetition counts, then distribution divergence from language references.

Each document's histogram of character classes and its histogram of common words are compared with references of
each language by Jensen-Shannon distance (base 2, 0 to 1). References are summed over all documents whose language is
known, which pass the base rules and have few symbols. A document is judged by the nearest language, the one with the
least sum of both distances; texts under the length guards have histograms too noisy to judge and keep the base verdict.

Defined results: null text is the empty text (no words, base_failed); texts are read whole, however long; of languages
equally near the first in order judges; a distance that equals its limit passes; rows that repeat are judged alike, each
on its own; an empty table gives an empty result and no reference; where no language is known no document fails by
divergence. Columns other than text and lang are carried along, and new columns replace columns of the same names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm import tokens as tk
from granary.llm.storage import in_batches

# Very common words of four languages, most common first.
COMMON = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son aux ou".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si".split(),
}
RANKS = 3  # common words of a language in groups of ten


@dataclass(frozen=True)
class Rules:
    min_words: int = 20
    max_repeat_percent: int = 30
    repeat_window: int = 8
    judged_words: int = 40
    judged_chars: int = 120
    max_char_distance: float = 0.2
    max_word_distance: float = 0.4
    max_reference_symbol_percent: int = 1
    symbols: str = "#*$%&|<>"
    classes: int = field(default=9, init=False)


def _char_classes(rules: Rules) -> np.ndarray:
    c = np.full(256, 8, np.int64)  # continuation bytes and controls; not counted
    c[ord("a") : ord("z") + 1] = 0
    c[ord("A") : ord("Z") + 1] = 1
    c[ord("0") : ord("9") + 1] = 2
    c[[32, 9, 10, 11, 12, 13]] = 3
    c[[ord(x) for x in ".,;:?'\"()-"]] = 4
    c[[x for x in range(33, 127) if c[x] == 8]] = 5
    c[[ord(x) for x in rules.symbols]] = 6
    c[0xC0:] = 7
    return c


def _common() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the common words, sorted, and the bin of each; a word of two languages has a bin of its own."""
    bins: dict[str, int] = {}
    for k, words in enumerate(COMMON.values()):
        for i, w in enumerate(words):
            bins[w] = len(COMMON) * RANKS if w in bins else k * RANKS + i * RANKS // len(words)
    t = tk.texts_of(pa.array(list(bins)))
    h = tk.runs(t).hash
    order = np.argsort(h)
    return h[order], np.array(list(bins.values()))[order]


N_BINS = len(COMMON) * RANKS + 2  # and the words of two languages, and all others
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[ord("a") : ord("z") + 1] = NOT_LETTER[ord("A") : ord("Z") + 1] = NOT_LETTER[128:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def _measure(t: tk.Texts, rules: Rules) -> dict[str, np.ndarray]:
    """The counts of the contract, for all documents of t."""
    data, n = t.data, t.n
    sums = tk.prefix_sums(data)
    w = tk.runs(t, tk.BLANK, sums)
    per_doc = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[t.offsets])
    symbol = np.zeros(256, bool)
    symbol[[ord(x) for x in rules.symbols]] = True
    solid = ~tk.BLANK[data]
    lines = tk.runs(t, tk.NEWLINE, sums)
    solids = np.concatenate([[0], np.cumsum(solid, dtype=np.int64)])
    full = solids[lines.end] > solids[lines.start]
    ldoc, lhash = lines.doc[full], lines.hash[full]
    distinct = np.unique(np.rec.fromarrays([ldoc, lhash])).f0 if len(ldoc) else ldoc
    size = rules.repeat_window
    win = np.flatnonzero(tk.within(w.doc, size))
    repeat = np.zeros(n, np.int64)
    if len(win):
        h = tk.window_hash(w.hash, size)[win] ^ tk.mix(w.doc[win].astype(np.uint64) + np.uint64(1))
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(win), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        repeat = np.bincount(w.doc[tk.cover(win[twice], size, len(w.doc))], minlength=n)
    return {
        "n_words": np.diff(w.first),
        "word_chars": per_doc(solid & ((data & 0xC0) != 0x80)),
        "n_symbols": per_doc(symbol[data]),
        "n_dup_lines": np.bincount(ldoc, minlength=n) - np.bincount(distinct, minlength=n),
        "n_repeat_words": repeat,
    }


def _histograms(t: tk.Texts, rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """Per document: counts of character classes, counts of common words."""
    of = np.repeat(np.arange(t.n), np.diff(t.offsets))
    k = rules.classes
    chars = np.bincount(of * k + _char_classes(rules)[t.data], minlength=t.n * k).reshape(t.n, k)[:, :-1]
    w = tk.runs(tk.Texts(LOWER[t.data], t.offsets), NOT_LETTER)
    hashes, bins = _common()
    at = np.minimum(np.searchsorted(hashes, w.hash), len(hashes) - 1)
    b = np.where(hashes[at] == w.hash, bins[at], N_BINS - 1)
    return chars, np.bincount(w.doc * N_BINS + b, minlength=t.n * N_BINS).reshape(t.n, N_BINS)


def _base_failed(m: dict[str, np.ndarray], rules: Rules) -> np.ndarray:
    return (m["n_words"] < rules.min_words) | (100 * m["n_repeat_words"] > rules.max_repeat_percent * m["n_words"])


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts p to the distribution q; 1 for an empty row."""
    total = p.sum(1, keepdims=True)
    p = p / np.maximum(total, 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.where(total[:, 0] > 0, np.sqrt(np.clip((left + right) / 2, 0, 1)), 1.0)


def language_references(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per known language: lang, chars and words (summed histograms) of all its documents that pass the base rules."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in tk.pieces(batch, "text"):
                t = tk.texts_of(part.column(part.schema.get_field_index("text")))
                m = _measure(t, rules)
                chars, words = _histograms(t, rules)
                both = np.hstack([chars, words])
                good = ~_base_failed(m, rules) & (m["n_words"] >= rules.judged_words) & (100 * m["n_symbols"] <= rules.max_reference_symbol_percent * m["word_chars"])
                langs = part.column(part.schema.get_field_index("lang")).to_pylist()
                for lang in {x for x in langs if x is not None}:
                    row = both[good & np.array([x == lang for x in langs])].sum(0)
                    sums[lang] = sums.get(lang, 0) + row
        rows = [(lang, i, int(v)) for lang, x in sums.items() for i, v in enumerate(x)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.int64()))], ["lang", "bin", "n"])

    used = in_batches(docs).select("text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    return used.mapInArrow(add, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))


def nearest(chars: np.ndarray, words: np.ndarray, refs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Both distances of each document from its nearest reference; 0 if there is none."""
    if not refs:
        return np.zeros(len(chars)), np.zeros(len(chars))
    of_chars, of_words = np.array([js_distance(chars, c) for c, _ in refs]), np.array([js_distance(words, w) for _, w in refs])
    best = (of_chars + of_words).argmin(0), np.arange(len(chars))
    return of_chars[best], of_words[best]


def judge(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance."""
    # A few dozen numbers for each language, however large the corpus is.
    table: dict[str, np.ndarray] = {}
    for lang, b, n in language_references(docs, rules).collect():
        table.setdefault(lang, np.zeros(rules.classes - 1 + N_BINS))[b] = n
    refs = [(x[: rules.classes - 1] / x[: rules.classes - 1].sum(), x[rules.classes - 1 :] / x[rules.classes - 1 :].sum()) for _, x in sorted(table.items()) if x[: rules.classes - 1].sum() and x[rules.classes - 1 :].sum()]
    new = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()), ("kept", T.BooleanType()), ("char_distance", T.DoubleType()), ("word_distance", T.DoubleType())]
    names = {n for n, _ in new}
    docs = in_batches(docs.select([c for c in docs.columns if c.lower() not in names]))
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, k) for n, k in new]])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.pieces(batch, "text"):
                t = tk.texts_of(part.column(part.schema.get_field_index("text")))
                m = _measure(t, rules)
                chars, words = _histograms(t, rules)
                failed = _base_failed(m, rules)
                near_c, near_w = nearest(chars, words, refs)
                sure = (m["n_words"] >= rules.judged_words) & (m["word_chars"] >= rules.judged_chars)
                far = sure & ((near_c > rules.max_char_distance) | (near_w > rules.max_word_distance))
                cols = [*(m[n].astype(np.int64) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), failed, ~failed & ~far, near_c, near_w]
                yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, cols)], [*part.schema.names, *(n for n, _ in new)])

    return docs.mapInArrow(judged, schema)
