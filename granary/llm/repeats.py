"""Which windows of a document also start in a document with a smaller doc_id; shared by the two substring operators.

A window is `size` consecutive items (words or bytes) of one document. Its anchor is the least hash of the runs of
`anchor` items in it. Equal windows have equal anchors, so all copies of a window can meet where their anchor is sent,
and neighbouring windows mostly share one: such a run of windows is a segment, sent as a whole. Steps:

1. Documents are dealt by a hash of doc_id and text into batches of bounded size, so rows that share a doc_id or have
   none don't meet in one batch. Each batch sends every distinct anchor once.
2. Where anchors meet, those of one document only are dropped; the rest are named to the batches that sent them.
3. Batches send the distinct segments of shared anchors, each with its smallest doc_id, to reference shards.
4. A shard is searched by the operator's own method, which says for each window of each segment the smallest doc_id
   seen. The answers go back to the batches, which mark their documents.

What a batch sends is distinct, so a passage which a third of all documents share arrives once from each batch. An
anchor with more than HOT segments (a very common phrase in many contexts) is not sent as segments but window by
window, each with its own hash for an anchor; so one phrase never fills a shard. Everything is keyed by content
hashes of 64 bits, nothing by the order of rows, so lost tasks can be run again in any order.

Segments go with 16 bits of their anchor. Segments that differ in them share no window, so a shard is searched part by
part, and its size doesn't multiply the work. Messages from batches to buckets never outnumber the distinct anchors of
the batches, however many buckets there are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import tokens as tk

U64 = np.uint64
BATCH_BYTES, BUCKET_BYTES, SHARD_BYTES = 8 << 20, 16 << 20, 2 << 20
HOT = 20_000
LONGEST = 256  # windows in a segment
NONE = np.iinfo(np.int64).max

#: (items of the segments one after another, first item of each and the end, doc_id of each, tag of each, window size) ->
#: for each window, in order, the smallest doc_id of a segment that holds it; segments of different tags share none
Search = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]


@dataclass(frozen=True)
class Windows:
    unit: str  # word or byte
    size: int
    anchor: int
    search: Search


@dataclass
class Items:
    """values: what is compared; code: what is sent; first: each document's first item; runs: the words, if words."""

    values: np.ndarray
    code: np.ndarray
    first: np.ndarray
    words: tk.Runs | None
    sums: np.ndarray


def items_of(texts: tk.Texts, unit: str) -> Items:
    if unit == "byte":
        return Items(tk.TABLE[texts.data], texts.data, texts.offsets, None, tk.prefix_sums(texts.data))
    w = tk.runs(texts)
    sums = np.zeros(len(w.hash) + 1, U64)
    np.cumsum(w.hash * tk.powers(len(w.hash) + 1)[0][: len(w.hash)], out=sums[1:])
    return Items(w.hash, w.hash, w.first, w, sums)


@dataclass
class Segments:
    """Windows first[i] to first[i] + count[i] - 1 share an anchor; doc: the document's number."""

    first: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    doc: np.ndarray

    def take(self, which: np.ndarray) -> Segments:
        return Segments(self.first[which], self.count[which], self.anchor[which], self.doc[which])


def segments_of(items: Items, kind: Windows) -> Segments:
    n, size, k = len(items.values), kind.size, kind.anchor
    total = n - size + 1
    if total <= 0:
        z = np.zeros(0, np.int64)
        return Segments(z, z, z.astype(U64), z)
    at = np.arange(n - k + 1)
    least = tk.sliding_min(tk.span_hash(items.sums, at, at + k), size - k + 1)
    doc = np.repeat(np.arange(len(items.first) - 1), np.diff(items.first))
    whole = doc[:total] == doc[size - 1 :]
    start = whole.copy()
    start[1:] &= (least[1:] != least[:-1]) | (doc[1:total] != doc[: total - 1]) | ~whole[:-1]
    first = np.flatnonzero(start)
    run = np.cumsum(start) - 1
    count = np.bincount(run[whole], minlength=len(first))
    if len(count) and count.max() > LONGEST:
        parts = -(-count // LONGEST)
        nth = tk.ragged(np.zeros(len(parts), np.int64), parts)
        first, count = np.repeat(first, parts) + nth * LONGEST, np.minimum(np.repeat(count, parts) - nth * LONGEST, LONGEST)
    return Segments(first, count, least[first], doc[first])


def content_hash(items: Items, s: Segments, size: int) -> np.ndarray:
    return tk.span_hash(items.sums, s.first, s.first + s.count + size - 1)


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts keys, and where each distinct key begins in it."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    return order, np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)


def _deal(key: np.ndarray, salt: int, n: int) -> np.ndarray:
    return (tk.mix(key ^ U64(salt)) % U64(n)).astype(np.int64)


def _blobs(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([x.tobytes() for x in arrays], pa.binary())


def _joined(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of the blobs, and how many each row has."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind), np.array([len(x) for x in rows], np.int64) // np.dtype(kind).itemsize


def _parts(table: pa.Table, kind: Windows):
    """Texts, items, segments and doc_ids of a batch, in parts."""
    for part in tk.pieces(table, "text"):
        texts = tk.texts_of(part.column("text"))
        items = items_of(texts, kind.unit)
        yield part, texts, items, segments_of(items, kind), part.column("doc_id").fill_null(NONE).to_numpy()


def _isin(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def _label(anchor: np.ndarray, n_buckets: int) -> np.ndarray:
    """An anchor's bucket and 40 bits of it. As a bucket's size is bounded, few anchors share a label; if so, more is searched."""
    return _deal(anchor, 1, n_buckets).astype(U64) << U64(40) | anchor & U64((1 << 40) - 1)


def _short(x: np.ndarray) -> bytes:
    """The low 40 bits of each value."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _long(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view("<u8").astype(U64)


def _labels(table: pa.Table, column: str) -> np.ndarray:
    """Sorted labels of all rows' anchors."""
    found = [_long(x) | U64(b) << U64(40) for b, x in zip(table.column("bucket").to_pylist(), table.column(column).to_pylist())]
    return np.sort(np.concatenate(found)) if found else np.zeros(0, U64)


def _single(items: Items, s: Segments, hot: np.ndarray, size: int, n_buckets: int) -> Segments:
    """s with the segments of hot anchors cut into single windows, which are their own anchors."""
    is_hot = _isin(hot, _label(s.anchor, n_buckets)) if len(hot) else np.zeros(len(s.anchor), bool)
    if not is_hot.any():
        return s
    h, rest = s.take(is_hot), s.take(~is_hot)
    first = tk.ragged(h.first, h.count)
    one = Segments(first, np.ones(len(first), np.int64), np.zeros(len(first), U64), np.repeat(h.doc, h.count))
    one.anchor = content_hash(items, one, size)
    return Segments(*(np.concatenate([getattr(rest, f), getattr(one, f)]) for f in ("first", "count", "anchor", "doc")))


def mark_repeats(docs: DataFrame, kind: Windows) -> DataFrame:
    """doc_id, n_items, n_removed, n_spans and kept (binary) of every row of docs.

    Items covered by a window that also starts in a document with a smaller doc_id are removed; windows are judged on
    the input. kept: bytes left, or words left with one space between them.

    Defined results: null and empty texts have no items; a null doc_id counts as larger than any other; rows of one
    doc_id, or of none, don't remove each other's windows, so repeated rows have like results; there are no other ties;
    texts are read whole, however long; an empty table gives an empty result; further columns aren't carried, whatever
    their names.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    volume = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_batches, n_buckets, n_shards = (max(1, -(-volume // x)) for x in (BATCH_BYTES, BUCKET_BYTES, SHARD_BYTES))
    dealt = docs.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_batches)).cast("int"))
    size = kind.size

    def anchors(table: pa.Table) -> pa.Table:
        batch = table.column("batch")[0].as_py()
        found = [(s.anchor, ids[s.doc]) for *_, s, ids in _parts(table, kind)]
        a, d = (np.concatenate(x) for x in zip(*found))
        order, begin = groups(a)
        if not len(begin):
            return pa.table([pa.array([], pa.int32()), pa.array([], pa.int32()), _blobs([]), _blobs([])], names=["bucket", "batch", "anchors", "info"])
        d, a = d[order], a[order][begin]
        many = np.minimum.reduceat(d, begin) != np.maximum.reduceat(d, begin)
        n = np.diff(np.r_[begin, len(d)])
        info = (np.floor(np.log2(n)).astype(np.uint8) | many.astype(np.uint8) << 7).astype(np.uint8)
        order, begin = groups(bucket := _deal(a, 1, n_buckets))
        cuts = begin[1:]
        return pa.table([pa.array(bucket[order][begin].astype(np.int32)), pa.array([batch] * len(begin), pa.int32()), pa.array([_short(x) for x in np.split(a[order], cuts)], pa.binary()), _blobs(np.split(info[order], cuts))], names=["bucket", "batch", "anchors", "info"])

    def shared(table: pa.Table) -> pa.Table:
        a = np.concatenate([_long(x) for x in table.column("anchors").to_pylist()])
        info, sizes = _joined(table.column("info"), np.uint8)
        order, begin = groups(a)
        group = np.zeros(len(a), np.int64)
        group[order] = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(a)]))
        senders = np.bincount(group)
        keep = (senders > 1) | (np.bincount(group, info >> 7) > 0)
        hot = np.bincount(group, np.exp2(info & 127)) > HOT
        cuts = np.cumsum(sizes)[:-1]
        rows = [(x[keep[g]], x[keep[g] & hot[g]]) for x, g in zip(np.split(a, cuts), np.split(group, cuts))]
        kept = (pa.array([_short(r[i]) for r in rows], pa.binary()) for i in (0, 1))
        return pa.table([table.column("bucket"), table.column("batch"), *kept], names=["bucket", "batch", "anchors", "hot"])

    def segments(table: pa.Table, named: pa.Table) -> pa.Table:
        names = ["shard", "batch", "segments", "docs", "counts", "tags", "code", "letters", "hot"]
        if not table.num_rows or not named.num_rows:
            return pa.table([pa.array([], pa.int32()), pa.array([], pa.int32()), *[_blobs([])] * 7], names=names)
        batch = table.column("batch")[0].as_py()
        wanted, hot = _labels(named, "anchors"), _labels(named, "hot")
        found: list[tuple] = []
        for _, _, items, s, ids in _parts(table, kind):
            s = _single(items, s.take(_isin(wanted, _label(s.anchor, n_buckets))), hot, size, n_buckets)
            found.append((content_hash(items, s, size), ids[s.doc], s.count, s.anchor, items.code[tk.ragged(s.first, s.count + size - 1)]))
        h, d, n, a, code = (np.concatenate(x) for x in zip(*found))
        at = np.concatenate([[0], np.cumsum(n + size - 1)])
        order, begin = groups(h)
        one = order[begin]
        least = np.minimum.reduceat(d[order], begin) if len(begin) else d
        h, n, shard, start, tag = h[one], n[one], _deal(a[one], 2, n_shards), at[one], (a[one] >> U64(48)).astype(np.uint16)
        order, begin = groups(shard)
        rows = []
        for x in np.split(order, begin[1:]) if len(begin) else []:
            codes, letters = code[tk.ragged(start[x], n[x] + size - 1)], np.zeros(0, U64)
            if kind.unit == "word":
                letters, codes = np.unique(codes, return_inverse=True)
                codes = codes.astype(np.uint16 if len(letters) < 1 << 16 else np.uint32)
            rows.append((shard[x[0]], h[x], least[x], n[x].astype(np.uint16), tag[x], codes, letters, np.zeros(0, U64)))
        if len(hot):
            rows.append((batch % n_shards, h[:0], least[:0], n[:0].astype(np.uint16), tag[:0], np.zeros(0, np.uint8), np.zeros(0, U64), hot))
        cols = list(zip(*rows)) if rows else [[]] * 8
        packed = [_blobs(list(c)) for c in cols[1:]]
        packed[4] = pa.array([pa.compress(c.tobytes(), "zstd", asbytes=True) if len(c) else b"" for c in cols[5]], pa.binary())
        return pa.table([pa.array(list(cols[0]), pa.int32()), pa.array([batch] * len(rows), pa.int32()), *packed], names=names)

    def searched(table: pa.Table) -> pa.Table:
        h, sizes = _joined(table.column("segments"), U64)
        d, _ = _joined(table.column("docs"), np.int64)
        n = _joined(table.column("counts"), np.uint16)[0].astype(np.int64)
        tag = _joined(table.column("tags"), np.uint16)[0]
        codes, letters = [], []
        for row_n, c, x in zip(np.split(n, np.cumsum(sizes)[:-1]), table.column("code").to_pylist(), table.column("letters").to_pylist()):
            letter = np.frombuffer(x, U64)
            width = np.dtype(np.uint8 if kind.unit == "byte" else np.uint16 if len(letter) < 1 << 16 else np.uint32)
            own = np.frombuffer(pa.decompress(c, int((row_n + size - 1).sum()) * width.itemsize, "zstd", asbytes=True) if c else b"", width)
            codes.append(own if kind.unit == "byte" else letter[own])
        code = np.concatenate(codes)
        at = np.concatenate([[0], np.cumsum(n + size - 1)])
        order, begin = groups(h)
        group = np.zeros(len(h), np.int64)
        group[order] = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(h)]))
        least = np.minimum.reduceat(d[order], begin) if len(begin) else d
        by_doc = np.argsort(least, kind="stable")
        one = order[begin][by_doc]
        place = np.zeros(len(begin), np.int64)
        place[by_doc] = np.arange(len(begin))
        windows = n[one]
        smallest = kind.search(code[tk.ragged(at[one], windows + size - 1)], np.concatenate([[0], np.cumsum(windows + size - 1)]), least[by_doc], tag[one], size)
        # runs of equal answers within a segment
        seg = np.repeat(np.arange(len(one)), windows)
        start = np.flatnonzero(np.r_[True, (seg[1:] != seg[:-1]) | (smallest[1:] != smallest[:-1])]) if len(seg) else seg
        length, value, owner = np.diff(np.r_[start, len(seg)]), smallest[start], seg[start]
        first, runs = np.searchsorted(owner, np.arange(len(one))), np.bincount(owner, minlength=len(one))
        rows = []
        for which in np.split(place[group], np.cumsum(sizes)[:-1]):
            flat = tk.ragged(first[which], runs[which])
            rows.append((runs[which].astype(np.uint16), length[flat].astype(np.uint16), value[flat]))
        cols = list(zip(*rows)) if rows else [[]] * 3
        return pa.table([table.column("batch"), table.column("segments"), *(_blobs(list(c)) for c in cols), table.column("hot")], names=["batch", "segments", "runs", "lengths", "values", "hot"])

    def marked(table: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[pa.Table] = []
        if answers.num_rows:
            h, hot = _joined(answers.column("segments"), U64)[0], np.sort(_joined(answers.column("hot"), U64)[0])
            runs = _joined(answers.column("runs"), np.uint16)[0].astype(np.int64)
            lengths = _joined(answers.column("lengths"), np.uint16)[0].astype(np.int64)
            values = _joined(answers.column("values"), np.int64)[0]
        else:
            h, hot, runs, lengths, values = (np.zeros(0, x) for x in (U64, U64, np.int64, np.int64, np.int64))
        run_at = np.concatenate([[0], np.cumsum(runs)])[:-1]
        order = np.argsort(h)
        known = h[order]
        for part, texts, items, s, ids in _parts(table, kind):
            s = _single(items, s, hot, size, n_buckets)
            mine = content_hash(items, s, size)
            s, mine = s.take(got := _isin(known, mine)), mine[got]
            row = order[np.searchsorted(known, mine)] if len(mine) else np.zeros(0, np.int64)
            flat = tk.ragged(run_at[row], runs[row])
            seen = np.repeat(values[flat], lengths[flat])
            windows = tk.ragged(s.first, s.count)
            hits = windows[seen < np.repeat(ids[s.doc], s.count)]
            n = len(items.values)
            gone = tk.cover(hits, size, n)
            out.append(_result(part, texts, items, gone))
        return pa.concat_tables(out)

    schema = "doc_id long, n_items long, n_removed long, n_spans long, kept binary"
    by_batch = dealt.groupBy("batch")
    sent = by_batch.applyInArrow(anchors, "bucket int, batch int, anchors binary, info binary")
    named = sent.groupBy("bucket").applyInArrow(shared, "bucket int, batch int, anchors binary, hot binary").filter(F.octet_length("anchors") > 0)
    refs = by_batch.cogroup(named.groupBy("batch")).applyInArrow(segments, "shard int, batch int, segments binary, docs binary, counts binary, tags binary, code binary, letters binary, hot binary")
    answers = refs.groupBy("shard").applyInArrow(searched, "batch int, segments binary, runs binary, lengths binary, values binary, hot binary")
    return by_batch.cogroup(answers.groupBy("batch")).applyInArrow(marked, schema)


def _result(part: pa.Table, texts: tk.Texts, items: Items, gone: np.ndarray) -> pa.Table:
    first = items.first
    count = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[first])
    opens = gone.copy()
    if len(gone):
        begins = np.zeros(len(gone) + 1, bool)
        begins[first] = True
        opens[1:] &= ~gone[:-1] | begins[1:-1]
    if items.words is None:
        keep, data = ~gone, texts.data
    else:
        w, left = items.words, ~gone
        start, end = w.start[left], w.end[left]
        edge = np.zeros(len(texts.data) + 1, np.int64)
        np.add.at(edge, start, 1)
        np.add.at(edge, end, -1)
        keep = np.cumsum(edge)[:-1] > 0
        # one separator after each word left but a document's last
        doc = w.doc[left]
        keep[end[:-1][doc[1:] == doc[:-1]]] = True
        data = np.where(tk.BLANK[texts.data], np.uint8(32), texts.data)
    ends = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])[texts.offsets].astype(np.int32)
    kept = pa.Array.from_buffers(pa.binary(), texts.n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data[keep].tobytes())])
    return pa.table([part.column("doc_id"), pa.array(np.diff(first).astype(np.int64)), pa.array(count(gone)), pa.array(count(opens)), kept], names=["doc_id", "n_items", "n_removed", "n_spans", "kept"])
