"""Folds over arrays that stay cheap when a row has very many items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def scan(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """array<kind> of what step(state, item) -> (next state, emitted) emits, item by item.

    A plain fold that appends to one array copies that array for every item. Here items are taken in blocks of about
    the square root of their number, so n items cost n ** 1.5 copied references, not n ** 2. Null gives no items.
    """
    none = F.array().cast(f"array<{kind}>")

    def one(acc: Column, x: Column) -> Column:
        state, emitted = step(acc["state"], x)
        return F.struct(state.alias("state"), F.concat(acc["out"], F.array(emitted)).alias("out"))

    def over(xs: Column) -> Column:
        n = F.size(xs)
        each = F.greatest(F.lit(64), F.ceil(F.sqrt(n.cast("double"))).cast("int"))

        def block(acc: Column, b: Column) -> Column:
            done = F.aggregate(F.slice(xs, b * each + 1, each), F.struct(acc["state"].alias("state"), none.alias("out")), one)
            return let(done, lambda d: F.struct(d["state"].alias("state"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

        begin = F.struct(start.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        blocks = F.sequence(F.lit(0), F.floor((n - 1) / each).cast("int"))
        return F.when(n > 0, F.flatten(F.aggregate(blocks, begin, block, lambda acc: acc["out"]))).otherwise(none)

    return let(items, over)
