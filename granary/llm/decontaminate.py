"""Benchmark decontamination with a distributed positional inverted index; DataFrame and SQL functions only.

The index holds (term, doc_id, pos) postings of training tokens. Every window of a test item is looked up by its
rarest terms: the postings of the rarest one are joined with those of the second rarest, adjusted by their distance
in the window, and what is left is compared with the whole window, term by term at its offset. Only lists of terms
that are some window's rarest or second rarest are stored. Terms are counted over all documents.

Words: A-Z lower-cased, runs of characters other than ASCII that is no letter or digit. An item of fewer words than a
window is one window; an item or text without words matches nothing.

Defined results: null text has no words; null doc_id is kept as it is; a null item_id is an item like others, a null
among item_ids that comes first; repeated documents are judged alike; repeated items name an id once; texts and items
are read whole, however long; windows of equal rarity are looked up by the term that sorts first, which the result
doesn't show; an empty benchmark hits nothing; columns of documents other than doc_id and text are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.storage import cut, sized, tidy

WINDOW = 10
#: rows of a table that may be broadcast: some 50 bytes each
BROADCAST_ROWS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, in order."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(plain, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def _small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it has few rows; else Spark shuffles it."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _keyed(docs: DataFrame) -> DataFrame:
    """k stands for the row: doc_id may be null or come twice with different texts."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256)).alias("k"))


def test_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (win, item_id): each window of each item, as an array of words."""
    w = items.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    return w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, window))).alias("win")).distinct()


def postings(keyed: DataFrame, terms: DataFrame) -> DataFrame:
    """(k, term, pos): the places of terms in the training texts."""
    return keyed.select("k", F.posexplode(words(F.col("text"))).alias("pos", "term")).join(terms, "term", "left_semi")


def rarest_terms(keyed: DataFrame, windows: DataFrame) -> DataFrame:
    """(win, a, b): each window's rarest and second rarest (term, at); windows with a term that no text has are left out."""
    vocabulary = _small(windows.select(F.explode("win").alias("term")).distinct())
    counted = keyed.select(F.explode(words(F.col("text"))).alias("term")).join(vocabulary, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    place = windows.select("win").distinct().select("win", F.posexplode("win").alias("at", "term"))
    by_df = place.join(counted, "term").groupBy("win").agg(F.array_sort(F.collect_list(F.struct("df", "term", "at"))).alias("by_df")).filter(F.size("by_df") == F.size("win"))
    pair = by_df.select("win", F.col("by_df")[0].alias("a"), F.element_at("by_df", F.least(F.lit(2), F.size("by_df"))).alias("b"))
    return pair.select("win", F.col("a.term").alias("a_term"), F.col("b.term").alias("b_term"), F.col("a.at").alias("a_at"), (F.col("b.at") - F.col("a.at")).alias("gap"))


def stored_index(keyed: DataFrame, rare: DataFrame) -> DataFrame:
    """The postings of the terms that windows are looked up by, written to the shared folder."""
    return cut(postings(keyed, _small(rare.select(F.col("a_term").alias("term")).union(rare.select("b_term")).distinct())))


def candidates(index: DataFrame, rare: DataFrame) -> DataFrame:
    """(k, start, win): where both of a window's rarest terms stand at their distance."""
    pairs = _small(rare.select("a_term", "b_term", "gap").distinct())
    a = index.withColumnRenamed("term", "a_term").join(pairs, "a_term").withColumn("b_pos", F.col("pos") + F.col("gap"))
    b = index.select("k", F.col("term").alias("b_term"), F.col("pos").alias("b_pos"))
    both = a.join(b, ["k", "b_term", "b_pos"], "left_semi")
    return both.join(_small(rare), ["a_term", "b_term", "gap"]).select("k", (F.col("pos") - F.col("a_at")).alias("start"), "win").filter(F.col("start") >= 0)


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int, window: int = WINDOW, misses: int = 1) -> DataFrame:
    """Distinct (doc_id, item_id): texts that hold all words of a window but `misses`, each at most `slop` words off its place.

    Places count from an occurrence of one of the window's misses + 1 rarest words; at least two words must be there,
    or the only one. Of the misses + 2 rarest words two are in a match, so their lists are intersected at their distance
    within slop, and what is left is compared with the whole window in the text. Words that no text has are rarest.
    """
    keyed = _keyed(docs)
    windows = cut(test_windows(items, window))
    distinct = windows.select("win").distinct().withColumn("may_miss", F.least(F.lit(misses), F.greatest(F.size("win") - 2, F.lit(0))))
    vocabulary = _small(distinct.select(F.explode("win").alias("term")).distinct())
    counted = keyed.select(F.explode(words(F.col("text"))).alias("term")).join(vocabulary, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    placed = distinct.select("win", "may_miss", F.posexplode("win").alias("at", "term")).join(counted, "term", "left")
    ranked = placed.groupBy("win", "may_miss").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term", "at"))).alias("rare"))
    rare = F.slice("rare", 1, F.col("may_miss") + 2)
    first = ranked.select("win", "may_miss", rare.alias("rare"), F.posexplode(F.slice("rare", 1, F.col("may_miss") + 1)).alias("i", "a"))
    second = F.filter(F.transform("rare", lambda x, i: F.when(i != F.col("i"), x)), lambda x: x.isNotNull())
    pairs = first.select("win", "may_miss", "a", F.explode(F.when(F.size("win") > 1, second).otherwise(F.array("a"))).alias("b")).filter("a.df > 0 and b.df > 0")
    pairs = cut(pairs.select("win", "may_miss", F.col("a.term").alias("a_term"), F.col("b.term").alias("b_term"), F.col("a.at").alias("a_at"), (F.col("b.at") - F.col("a.at")).alias("gap")))
    index = stored_index(keyed, pairs)
    block = 2 * slop + 1
    a = index.withColumnRenamed("term", "a_term").join(_small(pairs), "a_term").withColumn("want", F.col("pos") + F.col("gap"))
    a = a.withColumn("cell", F.explode(F.array_distinct(F.array(F.floor((F.col("want") - slop) / block), F.floor((F.col("want") + slop) / block)))))
    b = index.select("k", F.col("term").alias("b_term"), F.col("pos").alias("b_pos")).withColumn("cell", F.floor(F.col("b_pos") / block))
    near = a.join(b, ["k", "b_term", "cell"]).filter(F.abs(F.col("b_pos") - F.col("want")) <= slop)
    found = near.select("k", (F.col("pos") - F.col("a_at")).alias("start"), "win", "may_miss").distinct().groupBy("k").agg(F.collect_list(F.struct("start", "win", "may_miss")).alias("found"))
    w = F.col("w")

    def holds(c: Column) -> Column:
        low = lambda j: F.greatest(c["start"] + j - slop, F.lit(0))
        there = F.transform(c["win"], lambda x, j: F.array_contains(F.slice(w, low(j) + 1, F.greatest(c["start"] + j + slop + 1 - low(j), F.lit(0))), x))
        return F.size(F.filter(there, lambda x: x)) >= F.size(c["win"]) - c["may_miss"]

    read = found.join(keyed, "k").withColumn("w", words(F.col("text")))
    hits = read.select("doc_id", F.explode(F.filter("found", holds)).alias("c")).select("doc_id", "c.win").distinct()
    return hits.join(windows, "win").select("doc_id", "item_id").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every row of docs as doc_id, n_words, n_hit, n_items, item_ids (sorted as strings), contaminated, hits (word places)."""
    keyed = _keyed(docs)
    windows = cut(test_windows(items, window))
    rare = cut(rarest_terms(keyed, windows))
    found = candidates(stored_index(keyed, rare), rare).distinct().groupBy("k").agg(F.collect_list(F.struct("start", "win")).alias("found"))
    w = F.col("w")
    exact = F.filter("found", lambda c: F.slice(w, c["start"] + 1, F.size(c["win"])) == c["win"])
    read = keyed.join(found, "k", "left").withColumn("w", words(F.col("text")))
    places = F.array_distinct(F.flatten(F.transform("exact", lambda c: F.sequence(c["start"], c["start"] + F.size(c["win"]) - 1))))
    judged = read.withColumn("exact", F.coalesce(exact, F.array().cast("array<struct<start:int,win:array<string>>>"))).select("k", "doc_id", F.size("w").cast("long").alias("n_words"), F.sort_array(places).alias("hits"), F.array_distinct(F.col("exact.win")).alias("wins"))
    judged = cut(judged)
    tidy(docs.sparkSession)
    named = judged.select("k", F.explode("wins").alias("win")).distinct().join(windows, "win").groupBy("k").agg(F.sort_array(F.collect_set(F.struct(F.col("item_id").cast("string").alias("item_id")))).alias("items"))
    out = sized(judged.join(named, "k", "left").withColumn("item_ids", F.col("items.item_id")), judged.count())
    return out.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        (F.size("hits") > 0).alias("contaminated"),
        "hits",
    )
