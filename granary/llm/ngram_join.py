"""N-gram Jaccard join with token-combination prefixes.

A document's set is that of its distinct word shingles. Documents with equal sets form a class; classes are joined.
All sets are put into one global order, rare shingles first, and of these the ones with fewer common words. Shingles
heavier than a share of the documents are the frequent class, of which there can be only a bounded number.

- Rare shingles are indexed singly, those in the prefix of n - ceil(t * n) + 1 shingles.
- Two similar sets that share no rare shingle there have all their rare shingles in their prefixes and none in common.
  With at most d = n * (1 - t) / t differences, r of them spent on rare shingles, some K frequent shingles stand next
  to each other in both sets within the first K * (d - r + 1) of the frequent ones. So the prefix is extended that far
  and the combinations of K neighbours are indexed.

Classes that share a key are paired with a few pivots of it, the one with the smallest doc_id first. What these links
leave apart is compared pairwise, in tiles of like sizes, unless size or parity bitmaps (a bound of the overlap that is
never too low) rule it out; pairs within a component found so far are not made. Every pair is verified on the whole sets.
Links are joined into components; copies are never expanded into pairs.

Defined results: null, empty and wordless texts have the empty set and link with nothing; a text with fewer words than
a shingle is one shingle; texts are read whole, however long; a null doc_id counts as the largest, and a component of
such rows alone has a null component_id; repeated rows are in one component; ties cannot arise, as components take the
smallest doc_id and pivots decide about work only; an empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import tokens as tk
from granary.llm.components import components
from granary.llm.storage import cut, in_batches, remove, stored, tidy

U64 = np.uint64
LAST = np.iinfo(np.int64).max
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
FLUSH = 2_000_000  # shingles counted together
MOST_HEAVY = 1_000_000
BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class Join:
    size: int = 3
    percent: int = 90
    combine: int = 2
    heavy_share: int = 10_000  # a shingle is frequent if it occurs once in so many documents or more
    common_share: int = 1000  # so is a word common
    block: int = 256
    pivots: int = 3

    def prefix(self, n: int) -> int:
        return n - -(-self.percent * n // 100) + 1

    def differences(self, n: int) -> int:
        return n * (100 - self.percent) // self.percent


def shingles(texts: tk.Texts, size: int, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all shingles by document, each document's first, and how many of a shingle's words are common."""
    w = tk.runs(tk.Texts(LOWER[texts.data], texts.offsets))
    h = tk.window_hash(w.hash, size)
    keep = tk.within(w.doc, size)
    counts = np.bincount(w.doc[: len(h)][keep], minlength=texts.n)
    ranks = np.zeros(len(h), np.int8)
    if common is not None and len(common):
        is_common = (common[np.minimum(np.searchsorted(common, w.hash), len(common) - 1)] == w.hash).astype(np.int8)
        for j in range(size):
            ranks += is_common[j : j + len(h)]
    out, ranks, words = h[keep], ranks[keep], np.diff(w.first)
    short = np.flatnonzero((words > 0) & (words < size))
    if len(short):
        at = np.concatenate([[0], np.cumsum(counts)])[short]
        own = []
        for i in short:
            x = np.array([words[i]], U64)
            for v in w.hash[w.first[i] : w.first[i + 1]]:
                x = tk.mix(x * U64(tk.BASE) + v)
            own.append(x[0])
        out, ranks = np.insert(out, at, np.array(own, U64)), np.insert(ranks, at, 0)
        counts[short] = 1
    return out, np.concatenate([[0], np.cumsum(counts)]), ranks


@dataclass(frozen=True)
class Heavy:
    """Sorted: the frequent shingles, about how often each occurs, and the common words."""

    tokens: np.ndarray
    counts: np.ndarray
    words: np.ndarray


def heavy_hitters(docs: DataFrame, how: Join) -> Heavy:
    """Frequent shingles and common words. There are at most heavy_share (common_share) times as many as a mean text has.

    Each task forwards what it sees twice or more, which can only understate a count; the order of shingles decides
    about work, never about results. So the least count that makes a shingle frequent is doubled until no more than
    MOST_HEAVY of either kind are left, which is what tasks are sent (16 bytes each).
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {0: [], 1: []}
        total = docs_seen = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, parts in held.items():
                x = np.sort(np.concatenate(parts))
                first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
                n = np.diff(np.r_[first, len(x)])
                many = n >= max(2, docs_seen // (4 * (how.common_share if kind else how.heavy_share)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(many.sum(), kind, np.int32)), pa.array(x[first][many].view(np.int64)), pa.array(n[many])], ["kind", "token", "n"])
                parts.clear()

        for batch in batches:
            for part in tk.pieces(batch, "text"):
                texts = tk.texts_of(part.column(0))
                h, _, _ = shingles(texts, how.size)
                held[0].append(h)
                held[1].append(tk.runs(tk.Texts(LOWER[texts.data], texts.offsets)).hash)
                total, docs_seen = total + len(h), docs_seen + texts.n
                if total >= FLUSH:
                    yield from flush()
                    total = docs_seen = 0
        if held[0]:
            yield from flush()

    n_docs = docs.count()
    least = F.when(F.col("kind") == 0, max(4, n_docs // how.heavy_share)).otherwise(max(4, n_docs // how.common_share))
    counted = cut(docs.select("text").mapInArrow(count, "kind int, token long, n long").groupBy("kind", "token").agg(F.sum("n").alias("n")).filter(F.col("n") >= least))
    # How many there are by the power of two of their count: some 128 rows.
    powers = counted.groupBy("kind", F.floor(F.log2("n")).cast("int").alias("power")).agg(F.count("*").alias("m")).collect()
    floor = {kind: next(p for p in range(65) if sum(r["m"] for r in powers if r["kind"] == kind and r["power"] >= p) <= MOST_HEAVY) for kind in (0, 1)}
    found = counted.filter(F.col("n") >= F.when(F.col("kind") == 0, 2 ** floor[0]).otherwise(2 ** floor[1])).toPandas()
    tokens, n, kind = found["token"].to_numpy(np.int64).view(U64), found["n"].to_numpy(np.int64), found["kind"].to_numpy()
    order = np.argsort(tokens[kind == 0])
    return Heavy(tokens[kind == 0][order], n[kind == 0][order], np.sort(tokens[kind == 1]))


def bitmap(tokens: np.ndarray) -> bytes:
    """Parities of the tokens by hash, in 512 to 16384 bits."""
    bits = min(16384, max(512, 1 << (max(len(tokens), 1) - 1).bit_length()))
    odd = np.bincount((tokens & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def signature(tokens: np.ndarray) -> int:
    """A set's number."""
    total = tk.mix(tokens ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64, keepdims=True) + np.array([len(tokens)], U64)
    return int(tk.mix(total).view(np.int64)[0])


def keys_of(tokens: np.ndarray, weight: np.ndarray, rank: np.ndarray, how: Join) -> np.ndarray:
    """What a set is indexed by; tokens are sorted, weight is 0 for the rare ones, of which those of low rank come first."""
    n = len(tokens)
    if not n:
        return tokens
    p = how.prefix(n)
    rare, frequent = tokens[weight == 0], np.flatnonzero(weight)
    rare = rare[np.argsort(rank[weight == 0], kind="stable")]
    if len(rare) >= p:
        return rare[:p]
    d, k = max(how.differences(n) - len(rare), 0), how.combine
    first = tokens[frequent[np.lexsort((tokens[frequent], weight[frequent]))][: k * (d + 1)]]
    return np.concatenate([rare, tk.window_hash(first, k) ^ U64(1)])


def index(docs: DataFrame, heavy: Heavy, how: Join) -> DataFrame:
    """doc_id, n, node (the set's signature), keys, bits of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = heavy.tokens, heavy.counts
        for batch in batches:
            for part in tk.pieces(batch, "text"):
                h, first, ranks = shingles(tk.texts_of(part.column(1)), how.size, heavy.words)
                n, node, keys, bits = [], [], [], []
                for a, b in zip(first[:-1], first[1:]):
                    x, where = np.unique(h[a:b], return_index=True)
                    if len(tokens):
                        at = np.minimum(np.searchsorted(tokens, x), len(tokens) - 1)
                        weight = np.where(tokens[at] == x, counts[at], 0)
                    else:
                        weight = np.zeros(len(x), np.int64)
                    n.append(len(x))
                    node.append(signature(x))
                    keys.append(keys_of(x, weight, ranks[a:b][where], how).view(np.int64))
                    bits.append(bitmap(x))
                offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), listed, pa.array(bits, pa.binary())], ["doc_id", "n", "node", "keys", "bits"])

    return docs.mapInArrow(run, "doc_id long, n long, node long, keys array<long>, bits binary")


def folded(blobs: list[bytes], bits: int) -> np.ndarray:
    """The bitmaps, halves laid over each other until they have `bits` bits."""
    out = np.zeros((len(blobs), bits // 64), U64)
    for i, b in enumerate(blobs):
        x = np.frombuffer(b, U64)
        while len(x) > bits // 64:
            half = len(x) // 2
            x = x[:half] ^ x[half:]
        out[i] = x
    return out


def may_link(n: np.ndarray, bits: list[bytes], narrow: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs (i, j) sizes and bitmaps don't rule out: each differing bit needs a token that only one set has."""
    keep = np.flatnonzero(100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))

    def bound(apart: np.ndarray, at: np.ndarray) -> np.ndarray:
        most = (n[i[at]] + n[j[at]] - apart) // 2
        return 100 * most >= percent * (n[i[at]] + n[j[at]] - most)

    keep = keep[bound(np.bitwise_count(narrow[i[keep]] ^ narrow[j[keep]]).sum(1).astype(np.int64), keep)]
    apart = np.zeros(len(keep), np.int64)
    for k, at in enumerate(keep):
        b = 8 * min(len(bits[i[at]]), len(bits[j[at]]))
        if b > 512:
            x = folded([bits[i[at]], bits[j[at]]], b)
            apart[k] = np.bitwise_count(x[0] ^ x[1]).sum()
    return keep[bound(apart, keep)]


def _sides(batch: pa.RecordBatch, names: tuple[str, ...]) -> list:
    return [batch.column(batch.schema.get_field_index(x)) for x in names]


def bounded(pairs: DataFrame, classes: DataFrame, how: Join) -> DataFrame:
    """Those of the pairs (a, b) of nodes that may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m, x, y = _sides(batch, ("a", "b", "n", "m", "x", "y"))
            sizes, bits = np.concatenate([n.to_numpy(), m.to_numpy()]), x.to_pylist() + y.to_pylist()
            i = np.arange(len(a))
            keep = pa.array(may_link(sizes, bits, folded(bits, 512), i, i + len(a), how.percent))
            yield pa.RecordBatch.from_arrays([a.take(keep), b.take(keep)], ["a", "b"])

    left = classes.select(F.col("node").alias("a"), "n", F.col("bits").alias("x"))
    right = classes.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, how: Join) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets are similar enough."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.pieces(batch, "text"):
                h, first, _ = shingles(tk.texts_of(part.column(part.schema.get_field_index("text"))), how.size)
                sets = [np.unique(h[a:b]) for a, b in zip(first[:-1], first[1:])]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([signature(x) for x in sets], pa.int64()), listed], ["node", "set"])

    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = cut(classes.select("node", F.col("doc").alias("doc_id")).join(nodes, "node", "left_semi"))
    named = _few(wanted.select("doc_id").distinct())
    # A doc_id may name several texts: only sets of wanted nodes go on, and once.
    sets = docs.join(named, "doc_id", "left_semi").mapInArrow(whole, "node long, set array<long>").groupBy("node").agg(F.first("set").alias("set"))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    common = both.select("a", "b", (F.size("x") + F.size("y")).alias("total"), F.size(F.array_intersect("x", "y")).alias("common"))
    return common.filter(100 * F.col("common") >= how.percent * (F.col("total") - F.col("common"))).select("a", "b")


def _few(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it has BROADCAST_ROWS rows of a few numbers at most; else Spark shuffles it."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def cells(classes: DataFrame, how: Join) -> DataFrame:
    """(node, cell): sets that may link lie in one cell of sizes or in neighbouring ones."""
    if how.percent >= 100:
        return classes.select("node", F.col("n").alias("cell"))
    width = math.log(100 / how.percent) * (1 + 1e-9)  # a little wide, so rounding parts no pair
    return classes.select("node", F.floor(F.log(F.col("n").cast("double")) / width).cast("long").alias("cell"))


def apart(shared: DataFrame, classes: DataFrame, roots: DataFrame, how: Join) -> DataFrame:
    """Pairs (a, b) of nodes that share a key, are in different components so far, and may link.

    A key's members meet in units of like size: each in its own cell and, as a visitor, in the next one. In a unit the
    component with most members is its core. Only pairs with a member outside the core are open, so the core is dealt
    over tiles and the others go to all of them: rows grow with core times others over `block`, not with their square.
    """
    rooted = shared.select("key", "node").join(roots.select("node", "root"), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    rooted = cut(rooted)
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
    mixed = _few(cut(mixed))
    held = rooted.join(mixed, "key").join(cells(classes, how), "node")
    visit = F.explode(F.array(F.struct(F.col("cell").alias("at"), F.lit(False).alias("visitor")), F.struct((F.col("cell") + 1).alias("at"), F.lit(True).alias("visitor"))))
    member = cut(held.select("key", "node", "root", visit.alias("v")).select(F.xxhash64("key", "v.at").alias("unit"), "node", "root", "v.visitor"))
    by_root = member.groupBy("unit", "root").agg(F.count("*").alias("size"), F.count_if(~F.col("visitor")).alias("own"))
    units = by_root.groupBy("unit").agg(F.max(F.struct("size", "root")).alias("core"), F.sum("size").alias("size"), F.sum("own").alias("own"), F.count("*").alias("roots")).filter("roots > 1 and own > 0")
    tiles = lambda n: F.greatest(F.lit(1), F.ceil(n / how.block)).cast("int")
    units = cut(units.select("unit", F.col("core.root").alias("core"), tiles(F.col("core.size")).alias("core_tiles"), tiles(F.col("size") - F.col("core.size")).alias("tiles")))
    units = _few(units)
    placed = member.join(units, "unit").withColumn("inner", F.col("root") == F.col("core"))
    # Tiles of a core part and a part of the others, and of two parts of the others. Within a tile members of unlike
    # sides are compared, and those of side 2, a part of the others by itself, among themselves.
    count = lambda n: F.sequence(F.lit(0), n - 1)
    own = F.pmod(F.xxhash64("node"), F.when(F.col("inner"), F.col("core_tiles")).otherwise(F.col("tiles"))).cast("int")
    placed = placed.withColumn("mine", own)
    mine = F.col("mine")
    tile = lambda kind, x, y, side: F.struct(F.xxhash64("unit", F.lit(kind), x, y).alias("tile"), side.cast("int").alias("side"))
    of_core = F.transform(count(F.col("tiles")), lambda o: tile("core", mine, o, F.lit(0)))
    with_core = F.transform(count(F.col("core_tiles")), lambda c: tile("core", c, mine, F.lit(1)))
    with_others = F.transform(count(F.col("tiles")), lambda o: tile("others", F.least(mine, o), F.greatest(mine, o), F.when(mine == o, 2).otherwise((mine > o).cast("int"))))
    spread = placed.select("node", "root", "visitor", F.explode(F.when(F.col("inner"), of_core).otherwise(F.concat(with_core, with_others))).alias("t"))
    dealt = spread.join(classes.select("node", "n", "bits"), "node").select("t.tile", "t.side", "node", "root", "n", "bits", "visitor").repartition("tile").sortWithinPartitions("tile")

    def pairs_of(table: pa.Table) -> pa.RecordBatch:
        tile, node, root, n = (table.column(x).to_numpy() for x in ("tile", "node", "root", "n"))
        visitor, side = table.column("visitor").to_numpy(), table.column("side").to_numpy()
        bits = table.column("bits").to_pylist()
        narrow = folded(bits, 512)
        last = np.searchsorted(tile, tile, "right")
        out = []
        at, ahead = 0, last - np.arange(len(tile)) - 1
        ends = np.cumsum(ahead)
        while at < len(tile):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 500_000, "right")))
            i = np.repeat(np.arange(at, to), ahead[at:to])
            j = tk.ragged(np.arange(at, to) + 1, ahead[at:to])
            open_ = (root[i] != root[j]) & ~(visitor[i] & visitor[j]) & ((side[i] != side[j]) | (side[i] == 2))
            i, j = i[open_], j[open_]
            keep = may_link(n, bits, narrow, i, j, how.percent)
            out.append(np.stack([np.minimum(node[i[keep]], node[j[keep]]), np.maximum(node[i[keep]], node[j[keep]])], 1))
            at = to
        x = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            tile = batch.column(0).to_numpy()
            cut_at = int(np.searchsorted(tile, tile[-1]))  # the last tile may go on
            if cut_at:
                yield pairs_of(pa.Table.from_batches([*held, batch.slice(0, cut_at)]))
                held = []
            held.append(batch.slice(cut_at))
        if held:
            yield pairs_of(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "a long, b long").distinct()


def join_components(docs: DataFrame, how: Join = Join()) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reached by links, itself included) of every row of docs."""
    docs = in_batches(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = cut(index(docs, heavy_hitters(docs, how), how))
    classes = cut(rows.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("bits").alias("bits")))
    # Dealt by key once: what is met and who meets it are read from the same exchange, as long as both want all columns.
    postings = classes.select("node", "doc", F.explode("keys").alias("key")).repartition("key")
    # The oldest document of a key is likely what others were made from; some more, by parts, bridge what it doesn't reach.
    part = F.when(F.lit(how.pivots > 1), F.pmod("node", F.lit(max(1, how.pivots - 1))) + 1)
    pivots = [F.min(F.when(F.lit(i == 0) | (part == i), F.struct("doc", "node"))).alias(f"p{i}") for i in range(how.pivots)]
    met = postings.groupBy("key").agg(*pivots, F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high").select("key", F.array_distinct(F.array_compact(F.array(*(F.col(f"p{i}.node") for i in range(how.pivots))))).alias("pivots"))
    shared, path = stored(postings.join(met, "key").select("key", "node", "doc", "pivots"))
    stars = shared.select(F.col("node").alias("a"), F.explode("pivots").alias("b")).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = cut(verified(cut(bounded(stars, classes, how)), classes, docs, how))
    # Pairs with a pivot have been tried; others are left where a key has two more classes.
    rest = shared.filter(~F.array_contains("pivots", F.col("node")))
    tidy(docs.sparkSession)
    more = cut(apart(rest, classes, cut(components(links)), how))
    remove(docs.sparkSession, path)
    links = links.union(verified(more, classes, docs, how))
    roots = cut(components(links))
    tidy(docs.sparkSession)
    least = classes.join(roots, "node", "left").select("node", "doc", F.coalesce("root", "node").alias("root"))
    named = least.join(least.groupBy("root").agg(F.min("doc").alias("component")), "root").select("node", "component")
    # Sets of one class may be a third of all rows; the join's other side has one row a class, so such a part can be split.
    out = rows.select("doc_id", "n", "node").join(named, "node", "left")
    component = F.coalesce("component", "doc_id")
    return out.select(*(F.when(c != LAST, c).alias(name) if name != "n_shingles" else c.alias(name) for name, c in (("doc_id", F.col("doc_id")), ("n_shingles", F.col("n")), ("component_id", component))))
