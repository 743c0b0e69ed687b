"""Section-first chunking with overlapping token windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import tokens


def chunk(sections: DataFrame, key: list[str], order: str | None = None, target: int = 600, overlap: int = 50, carry: tuple[str, ...] = ()) -> DataFrame:
    """key, carry, chunk_index, content, token_count, content_hash; sections (key, order, content) of at most target tokens stay whole."""
    if target < 1 or not 0 <= overlap < target:
        raise ValueError("chunk size must be positive and larger than the overlap")
    step = target - overlap
    t = F.col("_t")
    windows = F.when(F.size(t) == 0, 0).otherwise(1 + F.greatest(F.lit(0), F.ceil((F.size(t) - target) / step)))
    starts = F.when(windows > 0, F.sequence(F.lit(0), (windows - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    rows = sections.select(*key, *carry, *([order] if order else []), tokens(F.col("content")).alias("_t"))
    cut = rows.select(*key, *carry, *([order] if order else []), F.posexplode(F.transform(starts, lambda i: F.slice(t, i * step + 1, target))).alias("_w", "_p"))
    index = F.row_number().over(Window.partitionBy(*key).orderBy(order, "_w")) - 1 if order else F.col("_w")
    content = F.array_join("_p", " ")
    return cut.select(*key, *carry, index.cast("int").alias("chunk_index"), content.alias("content"), F.size("_p").alias("token_count"), F.sha2(content, 256).alias("content_hash"))
