"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter n-gram's vector binds its letters' vectors, each permuted
(rotated) by its place, by multiplication. A text's vector bundles, that is sums, the vectors of all its n-grams, and a
language's prototype bundles those of its training texts. A text gets the language whose prototype has the largest
cosine with it.

Bundling is linear, so a prototype is the n-gram counts of its language times the n-gram vectors: only counts are
summed over the corpus, at most `SLOTS ** 3` for a language. Letters outside a-z share 21 slots by code point.

Defined results: null, empty and letterless texts are `und` with score 0, as are all texts if no language was learned;
a letter is what Unicode calls one, in any plane; texts are read whole, however long; equal cosines go to the first
language in order; repeated rows count as often as they occur; a null lang or doc_id is not learned from; an empty table
gives an empty result; other columns are carried along, and new columns replace columns of the same names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm import tokens as tk
from granary.llm.storage import in_batches

SLOTS, DIM, SEED = 48, 512, 7
NGRAMS = SLOTS**3
_cache: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """The slot of each code point: 0 not a letter, 1-26 a-z in either case, others from 27 on."""
    if "letters" not in _cache:
        points = np.zeros(0x110000, np.uint8)
        for p in range(len(points)):
            c = chr(p)
            if c.isalpha():
                low = c.lower()
                x = ord(low[0])
                points[p] = x - 96 if 97 <= x <= 122 else 27 + (x * 2654435761 >> 7) % (SLOTS - 27)
        _cache["letters"] = points
    return _cache["letters"]


def letter_vectors() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(SEED)).choice(np.array([-1, 1], np.int8), (SLOTS, DIM))


def ngram_vectors() -> np.ndarray:
    """The bound vector of each trigram, by number a * SLOTS**2 + b * SLOTS + c."""
    if "ngrams" not in _cache:
        v = letter_vectors()
        two, one = np.roll(v, 2, 1), np.roll(v, 1, 1)
        _cache["ngrams"] = (two[:, None, None] * one[None, :, None] * v[None, None]).reshape(NGRAMS, DIM)
    return _cache["ngrams"]


def _counts(texts: tk.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, trigram, count) of all trigrams with a letter in the middle, by document; which documents have letters."""
    raw = texts.data.tobytes().decode("utf-8", "replace")
    points = np.frombuffer(raw.encode("utf-32-le", "replace"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
    ends = lead[texts.offsets]
    slots = _letters()[points].astype(np.int64)
    doc = np.repeat(np.arange(texts.n), np.diff(ends))
    has = np.bincount(doc, slots > 0, texts.n) > 0
    before, after = np.zeros_like(slots), np.zeros_like(slots)
    if len(slots):
        before[1:] = np.where(doc[1:] == doc[:-1], slots[:-1], 0)
        after[:-1] = np.where(doc[1:] == doc[:-1], slots[1:], 0)
    inner = slots > 0
    key = np.sort((doc * NGRAMS + before * SLOTS**2 + slots * SLOTS + after)[inner])
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    key, n = key[first], np.diff(np.r_[first, len(key)])
    return key // NGRAMS, key % NGRAMS, n, has


def count_ngrams(docs: DataFrame) -> DataFrame:
    """(lang, ngram, n): how often each trigram occurs in the texts of each language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in tk.pieces(batch, "text"):
                langs = part.column(part.schema.get_field_index("lang")).to_pylist()
                names = sorted(set(langs))
                number = np.array([names.index(x) for x in langs])
                doc, gram, n, _ = _counts(tk.texts_of(part.column(part.schema.get_field_index("text"))))
                for k, lang in enumerate(names):
                    mine = number[doc] == k
                    if lang not in sums:
                        sums[lang] = np.zeros(NGRAMS, np.int64)
                    sums[lang] += np.bincount(gram[mine], n[mine], NGRAMS).astype(np.int64)
        for lang, x in sums.items():
            g = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int32)), pa.array(x[g])], ["lang", "ngram", "n"])

    used = in_batches(docs).select("text", "lang").filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    return used.mapInArrow(count, "lang string, ngram int, n long").groupBy("lang", "ngram").agg(F.sum("n").alias("n"))


def prototypes(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and their bundled vectors. What reaches the driver is at most SLOTS**3 counts for a language."""
    rows = count_ngrams(docs).toPandas()
    langs = sorted(rows["lang"].unique())
    out = np.zeros((len(langs), DIM))
    for k, lang in enumerate(langs):
        mine = rows[rows["lang"] == lang]
        g, n = mine["ngram"].to_numpy(), mine["n"].to_numpy(np.float64)
        for at in range(0, len(g), 4096):
            out[k] += n[at : at + 4096] @ ngram_vectors()[g[at : at + 4096]]
    return langs, out


def classify(docs: DataFrame, langs: list[str], vectors: np.ndarray) -> DataFrame:
    """docs with lang_pred and score, the cosine (0 if below)."""
    docs = in_batches(docs.select([c for c in docs.columns if c.lower() not in ("lang_pred", "score")]))
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = (vectors / np.maximum(norms, 1e-12)).astype(np.float32)
    names = np.array([*langs, "und"], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = ngram_vectors()
        for batch in batches:
            for part in tk.pieces(batch, "text", 1 << 18):
                texts = tk.texts_of(part.column(part.schema.get_field_index("text")))
                doc, gram, n, has = _counts(texts)
                bundle = np.zeros((texts.n, DIM), np.float32)
                edges = np.searchsorted(doc, np.arange(texts.n + 1))
                for i in range(texts.n):
                    for at in range(edges[i], edges[i + 1], 4096):
                        to = min(at + 4096, edges[i + 1])
                        bundle[i] += n[at:to].astype(np.float32) @ grams[gram[at:to]].astype(np.float32)
                size = np.linalg.norm(bundle, axis=1)
                cos = (bundle @ unit.T) / np.maximum(size, 1e-12)[:, None] if len(langs) else np.zeros((texts.n, 0))
                known = has & bool(len(langs))
                best = np.where(known, cos.argmax(1) if len(langs) else 0, len(langs))
                score = np.where(known, np.clip(cos.max(1) if len(langs) else 0, 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names[best].tolist(), pa.string()), pa.array(score.astype(np.float64))], [*part.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """docs with held_out, lang_pred and score; learned from the documents that are not held out."""
    split = docs.select([c for c in docs.columns if c.lower() != "held_out"]).withColumn("held_out", held_out(docs["doc_id"]))
    langs, vectors = prototypes(split.filter(~F.col("held_out") & F.col("doc_id").isNotNull()))
    return classify(split, langs, vectors)
