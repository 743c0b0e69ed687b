"""Chat formatting of reply trees.

Messages point to the message they reply to. Root-to-leaf paths come from iterative self-joins that double their
reach: after round i each message knows the ancestor 2**i replies above it, the score and number of the messages
between, so a thread of n replies takes log2(n) joins. Branches of a root are ranked by mean score, then length, then
id, and each chosen path becomes one conversation.

Template: `### role: text</turn>` and a line break for each turn. In roles and texts & # < and, in roles, : and line
breaks are written as &a; &h; &l; &c; &n; so no text can hold a control string, and reading is exact. The loss mask
lists the code point ranges of assistant texts in the formatted string.

Defined results: null role and text are empty; a message without an id is none; a parent that doesn't exist makes its
reply a root; messages that reply in a circle, or below one, belong to no path; of rows with one id the least by
parent, tree, role, text and score counts, nulls first (the linear form numbers rows by turn, role and text, nulls first,
so there repeated rows are turns of their own); branches that tie in score and length go by id; rows of null conv_id are
one conversation; texts are kept whole; an empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.arrays import scan
from granary.llm.storage import cut

# Escapes; & is written first and read last.
TEXT_ESCAPES = (("&", "&a;"), ("#", "&h;"), ("<", "&l;"))
ROLE_ESCAPES = (*TEXT_ESCAPES, (":", "&c;"), ("\n", "&n;"))
OPEN, BETWEEN, CLOSE = "### ", ": ", "</turn>\n"
LEARNED = "assistant"


def linear_tree(conversations: DataFrame) -> DataFrame:
    """(id, parent, tree, role, text, score): each turn replies to the one before it."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    name = lambda n: F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), n.cast("string"))
    numbered = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").withColumn("n", place)
    return numbered.select(name(F.col("n")).alias("id"), F.when(F.col("n") > 1, name(F.col("n") - 1)).alias("parent"), F.col("conv_id").alias("tree"), "role", "text", F.lit(1.0).alias("score"))


MESSAGE = ("parent", "tree", "role", "text", "score")


def one_per_id(messages: DataFrame) -> DataFrame:
    """(id, parent, tree, role, text, score): of rows with one id the least, whatever their order."""
    least = messages.filter(F.col("id").isNotNull()).groupBy("id").agg(F.min(F.struct(*MESSAGE)).alias("m"))
    return least.select("id", *(F.col(f"m.{c}").alias(c) for c in MESSAGE))


def chosen_paths(messages: DataFrame, keep: int = 1) -> DataFrame:
    """(leaf, id, place) of each message on one of the `keep` best paths of its root; place counts from the root, from 0.

    messages (id, parent, tree, role, text, score) have one row for each id; see one_per_id.
    """
    nodes = cut(messages.select("id", "parent", "score"))
    known = nodes.select(F.col("id").alias("parent"))
    tied = nodes.join(known.withColumn("there", F.lit(True)), "parent", "left").select("id", F.when(F.col("there"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("size"), F.coalesce("score", F.lit(0.0)).cast("double").alias("total"), F.col("id").alias("top"))
    # Messages that have reached a root are set aside; only the others are joined again.
    reach, jumps = cut(tied), []
    done, going = reach.filter(F.col("up").isNull()), reach.filter(F.col("up").isNotNull())
    limit = nodes.count()
    while going.limit(1).count() and 2 ** len(jumps) <= 2 * limit:  # beyond that only circles are left
        jumps.append(going.select(F.col("id").alias("from"), "up"))
        above = done.unionByName(going).select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("size").alias("more"), F.col("total").alias("plus"), F.col("top").alias("root"))
        joined = going.join(above, "up")
        reach = cut(joined.select("id", F.col("next").alias("up"), (F.col("size") + F.col("more")).alias("size"), (F.col("total") + F.col("plus")).alias("total"), F.col("root").alias("top")))
        done, going = done.unionByName(reach.filter(F.col("up").isNull())), reach.filter(F.col("up").isNotNull())
    reach = done
    leaves = reach.join(nodes.select(F.col("parent").alias("id")), "id", "left_anti")
    rank = F.row_number().over(Window.partitionBy("top").orderBy(F.desc(F.col("total") / F.col("size")), F.desc("size"), "id"))
    chosen = leaves.withColumn("rank", rank).filter(F.col("rank") <= keep).select(F.col("id").alias("leaf"), "id", (F.col("size") - 1).alias("place"))
    # After each step the paths hold all messages up to twice as far above their leaves.
    paths = cut(chosen)
    for i, jump in enumerate(jumps):
        step = paths.filter(F.col("place") >= 2**i).join(jump.withColumnRenamed("from", "id"), "id").select("leaf", F.col("up").alias("id"), (F.col("place") - 2**i).alias("place"))
        paths = paths.union(cut(step))
    return paths


def escaped(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for plain, code in pairs:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: str, pairs: tuple[tuple[str, str], ...]) -> str:
    for plain, code in reversed(pairs):
        text = text.replace(code, plain)
    return text


def format_paths(messages: DataFrame, paths: DataFrame) -> DataFrame:
    """(tree, leaf, formatted, loss): loss is array<struct<start,end>> of assistant texts in formatted, in code points."""
    turns = paths.join(messages.select("id", "tree", "role", "text"), "id")
    role = escaped(F.coalesce("role", F.lit("")), ROLE_ESCAPES)
    text = escaped(F.coalesce("text", F.lit("")), TEXT_ESCAPES)
    lines = turns.select("leaf", "tree", F.struct("place", F.concat(F.lit(OPEN), role, F.lit(BETWEEN)).alias("head"), text.alias("body"), (F.coalesce("role", F.lit("")) == LEARNED).alias("learned")).alias("turn"))
    held = lines.groupBy("leaf").agg(F.first("tree").alias("tree"), F.array_sort(F.collect_list("turn")).alias("turns"))

    def place(at: Column, t: Column) -> tuple[Column, Column]:
        start = at + F.length(t["head"])
        end = start + F.length(t["body"])
        return end + len(CLOSE), F.struct(start.alias("start"), end.alias("end"), t["learned"].alias("learned"))

    spans = F.filter(scan(F.col("turns"), F.lit(0), place, "struct<start:int,end:int,learned:boolean>"), lambda s: s["learned"])
    return held.select(
        "tree",
        "leaf",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("loss"),
    )


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    out = []
    for turn in formatted.split(CLOSE)[:-1]:
        role, _, text = turn.removeprefix(OPEN).partition(BETWEEN)
        out.append((unescaped(role, ROLE_ESCAPES), unescaped(text, TEXT_ESCAPES)))
    return out


def read_back(formatted: DataFrame) -> DataFrame:
    """(tree, leaf, turns, learned, formatted_chars): what the formatted strings and their loss masks hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, masks = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("formatted", "loss"))
            turns = [[{"role": r, "text": x} for r, x in parse(t)] for t in texts]
            learned = ["".join(unescaped(t[m["start"] : m["end"]], TEXT_ESCAPES) for m in mask) for t, mask in zip(texts, masks)]
            kinds = (pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])), pa.string(), pa.int64())
            own = [pa.array(x, k) for x, k in zip((turns, learned, [len(t) for t in texts]), kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("tree", "leaf")), *own], ["tree", "leaf", "turns", "learned", "formatted_chars"])

    tree = formatted.schema["tree"].dataType.simpleString()
    return formatted.select("tree", "leaf", "formatted", "loss").mapInArrow(run, f"tree {tree}, leaf string, turns array<struct<role:string,text:string>>, learned string, formatted_chars long")


def format_trees(messages: DataFrame, keep: int = 1) -> DataFrame:
    """(tree, leaf, formatted, loss) of the `keep` best paths of each root; messages may repeat ids."""
    held = cut(one_per_id(messages))
    return format_paths(held, chosen_paths(held, keep))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) as (tree, leaf, formatted, loss)."""
    messages = cut(linear_tree(conversations))  # numbered, so ids don't repeat
    return format_paths(messages, chosen_paths(messages))
