"""Keyword, vector and hybrid retrieval for batches of questions, and rank fusion."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions.stem import english_stem, stemmed
from granary.functions.text import search_terms, terms
from granary.session import in_batches

CANDIDATES, RRF_K = 15, 60
#: Numbers that a table of counts or scores in a task holds at once; terms and questions that one pass over chunks takes.
CELLS, TILE_TERMS, TILE_QUESTIONS = 1 << 20, 1 << 20, 1 << 14


def latest(documents: DataFrame, source: str, at: str, key: str) -> DataFrame:
    """The newest row of each source, the larger key first on ties; one aggregation, no window."""
    rest = [c for c in documents.columns if c not in (source, at, key)]
    newest = documents.groupBy(source).agg(F.max(F.struct(at, key, *rest)).alias("_n"))
    return newest.select(source, *(F.col(f"_n.{c}").alias(c) for c in (at, key, *rest)))


def newest_only(chunks: DataFrame, documents: DataFrame, document: str, source: str, at: str) -> DataFrame:
    """chunks of each source's newest document; documents (document, source, at)."""
    newest = latest(documents.select(source, at, document), source, at, document)
    return chunks.join(newest.select(document), document, "left_semi")


def parted(chunks: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """chunks whose key no other row has, and the others: None if there are none, as is usual."""
    again = chunks.groupBy(key).count().filter("count > 1").select(F.col(key).alias("_again"))
    n = again.count()
    if not n:
        return chunks, None
    same = F.col(key).eqNullSafe(F.col("_again"))
    again = F.broadcast(again) if n <= 1 << 20 else again
    return chunks.join(again, same, "left_anti"), chunks.join(again, same, "left_semi")


def postings(chunks: DataFrame, key: str, text: str | Column, only: DataFrame | None = None) -> DataFrame:
    """(key, term, tf) of each chunk's terms, of those in `only` (term) if given.

    Rows are counted one by one; only those that share a key are aggregated.
    """
    words = terms(F.col(text) if isinstance(text, str) else text)
    alone, others = parted(chunks, key)
    kind = chunks.schema[key].dataType.simpleString()
    out = in_batches(alone).select(F.col(key).alias("c"), words.alias("words")).mapInArrow(_counted, f"c {kind}, term string, tf bigint")
    out = out.withColumnRenamed("c", key)
    if others is not None:
        out = out.union(others.select(key, F.explode(words).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf")))
    return out if only is None else out.join(only, "term", "left_semi").select(key, "term", "tf")


def _places(lists: pa.ListArray) -> np.ndarray:
    """For each item of lists, the number of its list."""
    return np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: (c, term, tf) of rows (c, words)."""
    for batch in batches:
        words = batch.column(1).flatten().dictionary_encode()
        size = max(1, len(words.dictionary))
        pairs, tf = np.unique(_places(batch.column(1)) * size + words.indices.to_numpy(), return_counts=True)
        columns = [batch.column(0).take(pa.array(pairs // size)), words.dictionary.take(pa.array(pairs % size)), pa.array(tf, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["c", "term", "tf"])


def positions(chunks: DataFrame, key: str, text: str, section_path: str | None = None) -> DataFrame:
    """(key, stem, positions) of section path and text: English stems without stop words, places counted over all words."""
    whole = F.concat_ws(" ", F.coalesce(section_path, F.lit("")), text) if section_path else F.col(text)
    each = chunks.select(key, F.posexplode(terms(whole)).alias("at", "term"))
    stems = stemmed(each.select("term").distinct())
    return each.join(stems, "term").groupBy(key, "stem").agg(F.sort_array(F.collect_list(F.col("at") + 1)).alias("positions"))


def stemmed_postings(index: DataFrame, key: str) -> DataFrame:
    """(key, term, tf) with stems for terms and without stop words; each distinct term is stemmed once."""
    stems = stemmed(index.select("term").distinct())
    return index.join(stems, "term").groupBy(key, F.col("stem").alias("term")).agg(F.sum("tf").alias("tf"))


BUCKETS, BUCKET_TASKS = 64, 4


def write_index(index: DataFrame, path: str) -> None:
    """Postings (key, term, tf) stored by a hash of the term, in order of terms: a search reads the buckets it needs.

    A bucket is written by some tasks, each with a part of the chunks, so no task sorts all of a frequent term.
    """
    placed = index.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
    share = F.pmod(F.xxhash64(*(c for c in index.columns if c not in ("term", "tf"))), F.lit(BUCKET_TASKS))
    placed.repartition("bucket", share).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def asked_terms(questions: DataFrame, query: str, question: str, english: bool = False) -> DataFrame:
    """Distinct (query, term) of questions, stemmed like an English index if need be."""
    asked = questions.select(query, F.explode(search_terms(F.col(question))).alias("term"))
    if not english:
        return asked.distinct()
    return asked.join(stemmed(asked.select("term").distinct()), "term").select(query, F.col("stem").alias("term")).distinct()


def search_index(asked: DataFrame, query: str, index: DataFrame, key: str, k: int = CANDIDATES) -> DataFrame:
    """(query, key, score, rank): any asked term matches, each match scores 0.1. A stored index is read by bucket."""
    on = ["term"]
    if "bucket" in index.columns:
        asked, on = asked.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")), ["bucket", "term"]
    hits = index.join(asked, on).groupBy(query, key).agg(F.sum("tf").alias("n"))
    return top(hits.select(query, key, (F.col("n") * 0.1).alias("score")), query, key, k)


def stemmed_search(questions: DataFrame, query: str, question: str, index: DataFrame, key: str, k: int = CANDIDATES) -> DataFrame:
    """search_index over stemmed postings: a question's terms are stemmed alike, each stem counts once."""
    return search_index(asked_terms(questions, query, question, english=True), query, index, key, k)


def top(scored: DataFrame, query: str, key: str, k: int, best: str = "score") -> DataFrame:
    """The k best rows of each query with their rank, ties by key."""
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc_nulls_last(best), key))
    return scored.withColumn("rank", place).filter(F.col("rank") <= k)


def keyword_search(questions: DataFrame, query: str, question: str, chunks: DataFrame, key: str, text: str, k: int = CANDIDATES, section_path: str | None = None, english: bool = False) -> DataFrame:
    """(query, key, score, rank): any search term matches, each match scores 0.1.

    With section_path its words are searched too; with english both sides are stemmed and stop words left out. questions
    is the stated query set: its terms go to the tasks, in tiles, and each task counts them in its chunks and keeps the
    k best for each question, so neither postings nor matches are dealt out. Rows that share a key are searched by
    their postings.
    """
    asked = asked_terms(questions, query, question, english).select(F.col(query).alias("q"), "term")
    whole = F.concat_ws(" ", section_path, text) if section_path else F.col(text)
    kinds = asked.schema["q"].dataType.simpleString(), chunks.schema[key].dataType.simpleString()
    alone, others = parted(chunks, key)
    rows = in_batches(alone).select(F.col(key).alias("c"), terms(whole).alias("words"))
    n_terms, n_questions = asked.agg(F.count("*"), F.count_distinct("q")).first()
    parts = max(1, -(-n_terms // TILE_TERMS), -(-n_questions // TILE_QUESTIONS))
    out = []
    for i in range(parts):
        tile = (asked if parts == 1 else asked.filter(F.pmod(F.xxhash64("q"), F.lit(parts)) == i)).toArrow().sort_by("q")
        found = rows.mapInArrow(matched_by(tile, k, english), f"{query} {kinds[0]}, {key} {kinds[1]}, n double")
        out.append(found.select(query, key, (F.col("n") * 0.1).alias("score")))
    if others is not None:
        index = postings(others, key, whole)
        out.append(search_index(asked.withColumnRenamed("q", query), query, stemmed_postings(index, key) if english else index, key, k).select(query, key, "score"))
    return top(reduce(DataFrame.union, out), query, key, k)


class Asked:
    """Rows (q, term) sorted by q as lists of places in a vocabulary."""

    def __init__(self, pairs: pa.Table) -> None:
        coded = pairs.column("term").combine_chunks().dictionary_encode()
        runs = pairs.column("q").combine_chunks().dictionary_encode(null_encoding="encode")
        self.vocabulary, self.q = coded.dictionary, runs.dictionary
        self.at = coded.indices.to_numpy()
        self.starts = np.flatnonzero(np.diff(runs.indices.to_numpy(), prepend=-1))

    def tables(self, lists: pa.ListArray, english: bool = False) -> Iterator[tuple[int, np.ndarray]]:
        """Of some lists of words at a time the first one's number, and how often each has each term (terms by lists)."""
        words = lists.flatten()
        if english:
            words = words.dictionary_encode()
            stems = pc.index_in(pa.array([english_stem(w) for w in words.dictionary.to_pylist()], pa.string()), value_set=self.vocabulary)
            term = stems.take(words.indices)
        else:
            term = pc.index_in(words, value_set=self.vocabulary)
        known = term.is_valid().to_numpy(zero_copy_only=False)
        row, term = _places(lists)[known], term.drop_null().to_numpy()
        width = max(1, CELLS // (len(self.vocabulary) + len(self.at) + 1))
        for first in range(0, len(lists), width):
            n = min(width, len(lists) - first)
            a, b = np.searchsorted(row, (first, first + n))
            cells = term[a:b].astype(np.int64) * n + row[a:b] - first
            yield first, np.bincount(cells, minlength=len(self.vocabulary) * n).reshape(-1, n)

    def sums(self, table: np.ndarray) -> np.ndarray:
        """Questions by lists: the sum of a table over each question's terms."""
        return np.add.reduceat(table[self.at], self.starts, axis=0)


class Best:
    """The k best of many (question, key, value), ties by key; a few times k rows of each question are held."""

    def __init__(self, questions: int, k: int) -> None:
        self.k, self.held, self.rows, self.most = k, [], 0, max(CELLS // 8, 4 * questions * k)
        self.floor = np.full(questions, -np.inf)

    def add(self, value: np.ndarray, keys: pa.Array) -> None:
        """value: questions by keys, NaN for what is no match."""
        q, c = np.nonzero(value >= self.floor[:, None])
        if len(q):
            self.held.append(pa.table([pa.array(q), keys.take(pa.array(c)), pa.array(value[q, c])], ["q", "c", "v"]))
            self.rows += len(q)
            if self.rows > self.most:
                self.cut()

    def cut(self) -> pa.Table:
        """Rows (q: its number, c, v) of the k best of each question."""
        rows = pa.concat_tables(self.held).combine_chunks()
        order = pc.sort_indices(rows, sort_keys=[("q", "ascending"), ("v", "descending"), ("c", "ascending")], null_placement="at_start")
        rows = rows.take(order)
        q = rows.column("q").to_numpy()
        place = np.arange(len(q)) - np.searchsorted(q, q)
        rows = rows.filter(pa.array(place < self.k))
        last = place == self.k - 1
        self.floor[q[last]] = rows.column("v").to_numpy()[last[place < self.k]]
        self.held, self.rows = [rows], rows.num_rows
        return rows

    def result(self, q: pa.Array) -> Iterator[pa.RecordBatch]:
        """Those rows with the questions' names, the value -inf as null."""
        if self.held:
            rows = self.cut()
            v = rows.column("v").to_numpy()
            names = q.take(rows.column("q").combine_chunks())
            yield from pa.table([names, rows.column("c"), pa.array(v, mask=np.isneginf(v))], ["q", "c", "v"]).to_batches(1 << 16)


def matched_by(tile: pa.Table, k: int, english: bool = False):
    """For mapInArrow over (c, words): (q, c, n) of a task's k best chunks for each question of tile (q, term), ties by c."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not tile.num_rows:
            return
        asked = Asked(tile)
        best = Best(len(asked.q), k)
        for batch in batches:
            for first, table in asked.tables(batch.column(1), english):
                n = asked.sums(table).astype(float)
                best.add(np.where(n > 0, n, np.nan), batch.column(0).slice(first, n.shape[1]))
        yield from best.result(asked.q)

    return run


def containing(items: DataFrame, item: str, asked: str, documents: DataFrame, key: str, text: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(item, key, *carry) where a document's text contains an item's, letter by letter; items is the stated query set.

    A text that contains an item's has its inner terms (all but the first and the last), so one pass looks at those
    documents that have all of them. Items without inner terms are held against every document.
    """
    inner = F.array_distinct(F.slice(terms(F.col(asked)), 2, F.greatest(F.size(terms(F.col(asked))) - 2, F.lit(0))))
    told = items.filter(F.col(asked).isNotNull()).select(F.col(item).alias("q"), F.col(asked).cast("binary").alias("asked"), inner.alias("inner")).toArrow()
    rows = in_batches(documents).filter(F.col(text).isNotNull()).select(F.col(key).alias("c"), terms(F.col(text)).alias("words"), F.col(text).cast("binary").alias("text"), *carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, said = told.column("q").combine_chunks(), told.column("asked").to_pylist()
        lists = told.column("inner").combine_chunks()
        pairs = pa.table([pa.array(_places(lists)), lists.flatten()], ["q", "term"])
        short = np.flatnonzero(pc.list_value_length(lists).to_numpy() == 0)
        index = Asked(pairs) if pairs.num_rows else None
        wanted = np.diff([*index.starts, len(index.at)])[:, None] if index else None
        for batch in batches:
            tried = [(q, d) for q in short for d in range(batch.num_rows)]
            for first, table in index.tables(batch.column(1)) if index else ():
                q, d = np.nonzero(index.sums((table > 0).astype(np.int32)) == wanted)
                tried += zip(index.q.to_numpy()[q], d + first)
            found = [(q, d) for q, d in tried if said[q] in batch.column(2)[int(d)].as_py()]
            q, d = (pa.array([int(x[i]) for x in found], pa.int64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([names.take(q), *(batch.column(i).take(d) for i in (0, *range(3, batch.num_columns)))], [item, key, *carry])

    kinds = [items.schema[item].dataType, documents.schema[key].dataType, *(documents.schema[c].dataType for c in carry)]
    return rows.mapInArrow(run, ", ".join(f"{c} {t.simpleString()}" for c, t in zip((item, key, *carry), kinds)))


def vector_search(questions: DataFrame, query: str, chunks: DataFrame, key: str, vector: str = "embedding", k: int = CANDIDATES) -> DataFrame:
    """(query, key, score, rank) by cosine. questions (query, vector) is the stated query set, scored against all chunks.

    The questions' matrix goes to the tasks, in tiles of TILE_BYTES at most, and each task keeps its k best for each
    question of what matrix products give. Vectors of zeros or of another length score null, last.
    """
    asked = questions.select(F.col(query).alias("q"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("v").isNotNull())
    known = chunks.select(F.col(key).alias("c"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("v").isNotNull())
    kinds = asked.schema["q"].dataType.simpleString(), known.schema["c"].dataType.simpleString()
    count, widest = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    parts = max(1, -(-count * (widest or 1) * 8 // TILE_BYTES))
    out = []
    for i in range(parts):
        tile = (asked if parts == 1 else asked.filter(F.pmod(F.xxhash64("q"), F.lit(parts)) == i)).toArrow().sort_by("q")
        out.append(known.mapInArrow(scored_by(tile, k), f"{query} {kinds[0]}, {key} {kinds[1]}, score double"))
    return top(reduce(DataFrame.union, out), query, key, k)


TILE_BYTES = 32 << 20


def matrix(vectors: pa.ChunkedArray | pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of `width` numbers scaled to length 1, and which of them are such: the others are zeros."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    out, fits = np.zeros((len(vectors), width)), sizes == width
    if fits.any():
        out[fits] = pc.list_flatten(vectors.filter(pa.array(fits))).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, width)
    norm = np.sqrt((out * out).sum(1))
    good = fits & (norm > 0) & np.isfinite(norm)
    out[~good] = 0
    return out / np.where(good, norm, 1)[:, None], good


def scored_by(tile: pa.Table, k: int):
    """For mapInArrow: (q, c, score) of a task's k best chunks for each question of tile (q, v), ties by c."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        widths = sorted(set(pc.list_value_length(tile.column("v").combine_chunks()).to_pylist()))
        sides = []
        for width in widths:
            part = tile.filter(pc.equal(pc.list_value_length(tile.column("v").combine_chunks()), width))
            q = part.column("q").combine_chunks()
            sides.append((q, *matrix(part.column("v"), width), width, Best(len(q), k)))
        for batch in batches:
            for q, asked, fine, width, best in sides:
                step = max(1, CELLS // len(q))
                for first in range(0, batch.num_rows, step):
                    part = batch.slice(first, step)
                    known, good = matrix(part.column(1), width)
                    score = np.round(asked @ known.T, 12)
                    score[~fine], score[:, ~good] = -np.inf, -np.inf
                    best.add(score, part.column(0))
        for q, *_, best in sides:
            yield from best.result(q)

    return run


def fuse(rankings: list[DataFrame], query: str, key: str, limit: int | None = None, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of rankings (query, key, rank): score, rank; ties by the place where a key is first seen."""
    if rrf_k < 1:
        raise ValueError("rrf_k must be positive")
    lists = [r.select(query, key, F.lit(i).alias("_list"), F.col("rank").alias("_rank")) for i, r in enumerate(rankings)]
    merged = reduce(DataFrame.unionByName, lists).groupBy(query, key).agg(F.sum(1 / (rrf_k + F.col("_rank"))).alias("score"), F.min(F.struct("_list", "_rank")).alias("_seen"))
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc(F.round("score", 12)), "_seen"))
    out = merged.withColumn("rank", place).drop("_seen")
    return out if limit is None else out.filter(F.col("rank") <= limit)


def hybrid_search(keyword: DataFrame, vector: DataFrame | None, query: str, key: str, limit: int = 5, rrf_k: int = RRF_K) -> DataFrame:
    """Fusion of the candidates of both retrievers; without vectors the keyword list alone, scored the same way."""
    held = [x.filter(F.col("rank") <= CANDIDATES) for x in (keyword, vector) if x is not None]
    return fuse(held, query, key, limit, rrf_k)
