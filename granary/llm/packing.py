"""Packing token sequences by minimum bin slack.

Documents become token ids with an end id. A document longer than the window is cut into whole windows and a rest.
What is planned is only the multiset of lengths, at most `window` counts: the longest length left opens a window, a
subset-sum over a bitset of reachable fills (bounded multiplicities in binary parts) finds the multiset of remaining
lengths that comes closest to capacity, backtracking gives its counts, and the pattern is used as often as the counts
allow. Each use exhausts a length, so there are at most `window` patterns, each with at most about 90 distinct
lengths, however many documents there are. The r-th piece of a length takes the r-th slot of that length; ranks are
counted in salted parts of some RANKED pieces, as many as a length needs, so that a length which a third of all pieces
have is not ranked in one task. Whole windows need no plan and no rank: each is a sequence of its own, numbered after
the planned ones by its place in the stored pieces, with gaps.

Defined results: null and empty texts are the end id alone; equal rows are packed each for itself; texts are tokenized
whole, however long; of patterns that fill a window alike the one with fewer of the short lengths is used; a null doc_id
stays null; an empty table gives no piece; other columns are not carried.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm import tokens as tk
from granary.llm.storage import cut, in_batches, sized

WINDOW, END_ID, RANKED, CACHE, WORDS = 4096, 2, 100_000, 1_000_000, 4000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


# Bytes by kind: 0 white space, 1 letters (and the bytes of U+00C0 to U+00FF), 2 other ASCII.
KIND = np.full(256, 2, np.int8)
KIND[tk.BLANK] = 0
KIND[ord("a") : ord("z") + 1] = KIND[ord("A") : ord("Z") + 1] = KIND[128:] = 1
#: Bytes whose words are left whole: contractions, special tokens, and characters outside U+00C0 to U+00FF.
ODD = np.zeros(256, bool)
ODD[[ord("'"), ord("|")]] = True
ODD[0xC0:] = True
ODD[0xC3] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def parts(texts: tk.Texts) -> tk.Runs:
    """Parts of words that pre-tokens never span: letters or other ASCII, lower-cased for the hash; odd words whole."""
    data, offsets = texts.data, texts.offsets
    words = tk.runs(texts)
    odd = ODD[data]
    if len(data) > 1:  # the two signs among U+00C0 to U+00FF
        odd[:-1] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    seen = np.concatenate([[0], np.cumsum(odd)])
    is_odd = seen[words.end] > seen[words.start]
    kind = KIND[data]
    inside = np.zeros(len(data) + 1, np.int64)
    inside[words.start[is_odd]] += 1
    inside[words.end[is_odd]] -= 1
    kind[np.cumsum(inside)[:-1] > 0] = 1
    begin = np.zeros(len(data), bool)
    begin[words.start] = True
    begin[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
    finish = np.zeros(len(data) + 1, bool)
    finish[words.end] = True
    finish[1:-1] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
    start, end = np.flatnonzero(begin), np.flatnonzero(finish)
    hashed = np.where(np.cumsum(inside)[:-1] > 0, data, LOWER[data])
    first = np.searchsorted(start, offsets)
    return tk.Runs(np.repeat(np.arange(texts.n), np.diff(first)), start, end, tk.span_hash(tk.prefix_sums(hashed), start, end), first)


class WordEncoder:
    """Ids of texts by a tokenizer whose pre-tokens never span ASCII white space; each distinct part of a word is encoded once.

    What is remembered is bounded; beyond that it begins anew.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.hashes, self.starts, self.counts, self.ids = (np.zeros(0, x) for x in (np.uint64, np.int64, np.int64, np.uint32))

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        found: list[list[int]] = []
        for i in range(0, len(words), WORDS):  # an encoding takes much more room than its ids
            found += [x.ids for x in self.tokenizer.encode_batch_fast(words[i : i + WORDS], add_special_tokens=False)]
        counts = np.array([len(x) for x in found], np.int64)
        starts = len(self.ids) + np.cumsum(counts) - counts
        self.ids = np.concatenate([self.ids, np.array([t for x in found for t in x], np.uint32)])
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.starts, self.counts = (np.insert(a, at, b) for a, b in ((self.hashes, hashes), (self.starts, starts), (self.counts, counts)))

    def encode(self, texts: tk.Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each document has."""
        w = parts(texts)
        hashes, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        if len(self.hashes) + len(hashes) > CACHE:
            self.clear()
        if len(self.hashes):
            new = self.hashes[np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)] != hashes
        else:
            new = np.ones(len(hashes), bool)
        if new.any():
            raw = texts.data.tobytes()
            self._learn(hashes[new], [raw[w.start[i] : w.end[i]].decode("utf-8", "replace") for i in first[new]])
        entry = np.searchsorted(self.hashes, hashes)[inverse]
        counts = self.counts[entry]
        ends = np.concatenate([[0], np.cumsum(counts)])
        return self.ids[tk.ragged(self.starts[entry], counts)], np.diff(ends[w.first])


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This process's encoder; what it knows serves later tasks too."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def tokenize(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        for batch in batches:
            for part in tk.pieces(batch, "text"):
                ids, sizes = words.encode(tk.texts_of(part.column(1)))
                rows, at = [], 0
                end = np.array([end_id], np.uint32)
                for doc, n in zip(part.column(0).to_pylist(), sizes.tolist()):
                    whole = np.concatenate([ids[at : at + n], end]).astype("<u4")
                    at += n
                    rows += [(doc, s, min(window, n + 1 - s), zlib.crc32(whole[s : s + window]), n + 1) for s in range(0, n + 1, window)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return in_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths within counts whose sum comes closest to capacity, as length: count."""
    reach, full, steps = 1, (1 << (capacity + 1)) - 1, []
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        left, part = min(counts[length], capacity // length), 1
        while left and not reach >> capacity & 1:
            part = min(part, left)
            steps.append((length, part, reach))
            reach |= reach << (length * part) & full
            left -= part
            part *= 2
        if reach >> capacity & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, part, before in reversed(steps):
        if not before >> at & 1:
            at -= length * part
            used[length] = used.get(length, 0) + part
    return used


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """Patterns (length: count) and how many windows use each; together they hold every length as often as counts says."""
    left, out = {k: v for k, v in counts.items() if v}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        pattern = best_fill({k: v for k, v in left.items() if v}, window - longest)
        left[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(left[k] // n for k, n in pattern.items())
        for k, n in pattern.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        out.append((pattern, times))
    return out


def slots(patterns: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, count in a window, first window, offset), by length and rank."""
    rows, ranks, base = [], {}, 0
    for pattern, times in patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            n = pattern[length]
            rows.append((length, ranks.get(length, 0), n, base, offset))
            ranks[length] = ranks.get(length, 0) + n * times
            offset += n * length
        base += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """pieces (doc_id, start, length, ...) with sequence_id and offset; pieces are stored, and read more than once."""
    # What is ranked: at most `window` lengths, each in parts of some RANKED pieces.
    total = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    planned = {k: n for k, n in total.items() if k != window}
    patterns = plan(planned, window)
    n_planned = sum(times for _, times in patterns)
    whole = pieces.filter(F.col("length") == window).select("*", (F.monotonically_increasing_id() + n_planned).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    if not planned:
        return whole
    table = slots(patterns)
    parts = pieces.sparkSession.createDataFrame([(k, -(-n // RANKED)) for k, n in planned.items()], "length long, parts int")
    salted = pieces.join(F.broadcast(parts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("parts")).cast("int")).drop("parts")
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    # One row for a length and RANKED pieces: ranks before each part.
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = salted.withColumn("rn", F.row_number().over(order)).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("rn") - 1).select(*pieces.columns, "rank")
    key = table[:, 0] << 44 | table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            row = table[np.searchsorted(key, length << 44 | rank, "right") - 1] if len(length) else table[:0]
            nth = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(row[:, 3] + nth // row[:, 2]), pa.array(row[:, 4] + nth % row[:, 2] * length)], [*batch.schema.names[:-1], "sequence_id", "offset"])

    placed = sized(ranked, sum(planned.values())).mapInArrow(place, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long")
    return placed.union(whole)


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most `window` tokens."""
    return pack(cut(tokenize(docs, tokenizer, window, end_id)), window)
