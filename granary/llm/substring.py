"""Substring deduplication with suffix automata of reference shards.

The windows that documents may share are dealt to reference shards (`repeats`), since sending every shard's automaton
to every document would take work in the square of the corpus. A shard builds suffix automata of its segments, block
by block so that memory is bounded, in order of doc_id: a state then keeps the smallest doc_id in which its strings end.
The block's segments are streamed through its automaton; matching statistics of at least the window size name, through
the state that holds the window, the smallest document it starts in. Segments with like anchors are in one block; only
where those of one tag alone outgrow a block are they streamed through several automata.

Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns: see `repeats.mark_repeats`,
whose results these are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from granary.llm.repeats import NONE, Windows, mark_repeats

WINDOW, ANCHOR, BLOCK = 13, 6, 400_000


class SuffixAutomaton:
    """States of all substrings of the sequences added so far; owner: the first document each state was seen in."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        self.owner: list[int] = [NONE]

    def add(self, sequence: list[int], owner: int) -> None:
        """Sequences come in ascending order of owner."""
        nexts, link, length, owners = self.next, self.link, self.length, self.owner
        last = 0
        for c in sequence:
            q = nexts[last].get(c)
            if q is not None and length[q] == length[last] + 1:
                last = q
                continue
            if q is None:
                state = len(nexts)
                nexts.append({})
                link.append(0)
                length.append(length[last] + 1)
                owners.append(owner)
                p = last
                while p != -1 and c not in nexts[p]:
                    nexts[p][c] = state
                    p = link[p]
                last = state
                if p == -1:
                    continue
                q = nexts[p][c]
                if length[q] == length[p] + 1:
                    link[state] = q
                    continue
            else:
                p, state = last, -1
            clone = len(nexts)
            nexts.append(nexts[q].copy())
            link.append(link[q])
            length.append(length[p] + 1)
            owners.append(owners[q])
            link[q] = clone
            if state < 0:
                last = clone
            else:
                link[state] = clone
            while p != -1 and nexts[p].get(c) == q:
                nexts[p][c] = clone
                p = link[p]

    def first_owners(self, sequence: list[int], size: int) -> list[int]:
        """For each window of `size` items of sequence: the first document that holds it, or NONE."""
        nexts, link, length, owners = self.next, self.link, self.length, self.owner
        out, state, matched = [], 0, 0
        for i, c in enumerate(sequence, 1):
            q = nexts[state].get(c)
            while q is None and state:
                state = link[state]
                matched = length[state]
                q = nexts[state].get(c)
            if q is not None:
                state = q
                matched += 1
                while length[link[state]] >= size:
                    state = link[state]
                    matched = length[state]
            if i >= size:
                out.append(owners[state] if matched >= size else NONE)
        return out


def _blocks(tag: np.ndarray, sizes: np.ndarray) -> list[list[np.ndarray]]:
    """Segments in parts of whole tags, of about BLOCK items each; a larger tag is a part of several blocks."""
    order = np.argsort(tag, kind="stable")
    begin = np.flatnonzero(np.r_[True, tag[order][1:] != tag[order][:-1]]) if len(order) else []
    parts, held, filled = [], [], 0
    for group in np.split(order, begin[1:]) if len(order) else []:
        size = int(sizes[group].sum())
        if size > BLOCK:
            ends = np.cumsum(sizes[group]) // BLOCK
            parts.append([group[ends == k] for k in np.unique(ends)])
            continue
        if filled + size > BLOCK and held:
            parts.append([np.concatenate(held)])
            held, filled = [], 0
        held.append(group)
        filled += size
    return [*parts, [np.concatenate(held)]] if held else parts


def search(code: np.ndarray, first: np.ndarray, docs: np.ndarray, tag: np.ndarray, size: int) -> np.ndarray:
    """Segments come in ascending order of docs."""
    numbers = np.unique(code, return_inverse=True)[1].tolist()
    at, best = first.tolist(), np.full(len(code) - (size - 1) * len(docs), NONE, np.int64)
    windows = first - (size - 1) * np.arange(len(first))
    for part in _blocks(tag, np.diff(first)):
        streamed = np.sort(np.concatenate(part)).tolist()
        for block in part:
            automaton = SuffixAutomaton()
            for k in np.sort(block).tolist():
                automaton.add(numbers[at[k] : at[k + 1]], int(docs[k]))
            for k in streamed:
                mine = best[windows[k] : windows[k + 1]]
                np.minimum(mine, automaton.first_owners(numbers[at[k] : at[k + 1]], size), out=mine)
    return best


def remove_repeated_words(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_items (words), n_removed, n_spans, kept of every document; see repeats.mark_repeats for the rules."""
    return mark_repeats(docs, Windows("word", window, min(ANCHOR, window), search))
