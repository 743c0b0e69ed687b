"""Substring deduplication with longest-previous-factor arrays over suffix order.

A reference shard (`repeats`) sorts the suffixes of its segments, as far as one window; with documents in order of
doc_id, the previous and the next suffix in that order whose document is smaller give the longest earlier match of
each position. A window is a repeat if that match is a window long. Later copies go, the first stays.

Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns: see `repeats.mark_repeats`,
whose results these are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from granary.llm.repeats import Windows, mark_repeats
from granary.llm.tokens import ragged

WINDOW, ANCHOR = 50, 22


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the nearest earlier place with a smaller value, -1 if none: pointers are followed until all hold."""
    n = len(values)
    at = np.arange(-1, n - 1)
    open_ = np.flatnonzero(at >= 0)
    open_ = open_[values[at[open_]] >= values[open_]]
    while len(open_):
        back = at[open_]
        at[open_] = at[back]  # what lies between is not smaller than values[back], hence not than this one's
        left = at[open_]
        open_ = open_[(left >= 0) & (values[np.maximum(left, 0)] >= values[open_])]
    return at


def suffix_keys(code: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """The first `size` bytes of each suffix, as columns of 64-bit numbers in the order of the bytes."""
    letters = np.unique(code)
    bits = max(1, int(len(letters)).bit_length())
    per = min(64 // bits, size)
    number = np.zeros(256, np.uint64)
    number[letters] = np.arange(1, len(letters) + 1)
    # packed[i] has letters i to i + have - 1, doubled as often as they fit
    packed, have = number[np.concatenate([code, np.zeros(size + per, code.dtype)])], 1
    single = packed

    def wider(x: np.ndarray, n: int, y: np.ndarray, m: int) -> np.ndarray:
        y = np.concatenate([y[n:], np.zeros(n, np.uint64)])
        return x << np.uint64(bits * m) | y

    while have * 2 <= per:
        packed, have = wider(packed, have, packed, have), have * 2
    while have < per:
        packed, have = wider(packed, have, single, 1), have + 1
    columns, at = [], 0
    while at < size:
        n = min(per, size - at)
        columns.append(packed[starts + at] >> np.uint64(bits * (per - n)))
        at += n
    return np.array(columns)


def suffix_order(keys: np.ndarray) -> np.ndarray:
    """The suffixes' order by all columns; of each next column only what is still tied is sorted."""
    order = np.argsort(keys[0])
    low = keys[0][order]
    same = np.r_[False, low[1:] == low[:-1]] if len(order) else np.zeros(0, bool)
    for column in keys[1:]:
        tied = np.flatnonzero(same | np.r_[same[1:], False])
        if not len(tied):
            break
        group = np.cumsum(~same)[tied]
        inner = np.lexsort((column[order[tied]], group))
        order[tied] = order[tied][inner]
        value = column[order[tied]]
        same[tied] &= np.r_[False, value[1:] == value[:-1]]
    return order


def search(code: np.ndarray, first: np.ndarray, docs: np.ndarray, tag: np.ndarray, size: int) -> np.ndarray:
    """Suffixes of all segments are sorted together, so tags don't matter here."""
    counts = np.diff(first) - (size - 1)
    starts = ragged(first[:-1], counts)
    doc = np.repeat(docs, counts)
    keys = suffix_keys(code, starts, size)
    order = suffix_order(keys)
    keys, d = keys[:, order], doc[order]
    n = len(d)
    before = previous_smaller(d)
    after = n - 1 - previous_smaller(d[::-1])[::-1]
    place = np.arange(n)
    least = d.copy()
    for near, there in ((before, before >= 0), (after, after < n)):
        i, k = place[there], near[there]
        # the factor shared with the nearest suffix of a smaller document is a whole window
        whole = (keys[:, i] == keys[:, k]).all(0)
        least[i[whole]] = np.minimum(least[i[whole]], d[k[whole]])
    out = np.empty(n, np.int64)
    out[order] = least
    return out


def remove_repeated_bytes(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_items (bytes), n_removed, n_spans, kept of every document; see repeats.mark_repeats for the rules."""
    return mark_repeats(docs, Windows("byte", window, min(ANCHOR, window), search))
