"""An approximate vector index: cells around centres, of which a search reads the nearest few."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.retrieval import CANDIDATES, matrix, top

#: rows that centres are fitted on, at most; every row is indexed
SAMPLE, ROUNDS, SEED = 50_000, 12, 11


@dataclass(frozen=True)
class Cells:
    """Unit vectors of the cells' centres."""

    centres: np.ndarray

    @property
    def n(self) -> int:
        return len(self.centres)


def fit(chunks: DataFrame, vector: str = "embedding", cells: int | None = None) -> Cells:
    """Centres by spherical k-means on the SAMPLE rows whose hash is least; about the square root of all rows if not given."""
    held = chunks.filter(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))
    total, width = held.agg(F.count("*"), F.max(F.size("v"))).first()
    if not total:
        return Cells(np.zeros((1, 1)))
    sample = held.withColumn("h", F.xxhash64("v")).orderBy("h").limit(SAMPLE).select("v").toArrow()
    x, good = matrix(sample.column("v"), width)
    x = x[good]
    n = min(cells or max(1, int(total**0.5)), max(1, len(x)))
    rng = np.random.default_rng(SEED)
    centres = x[rng.choice(len(x), n, replace=False)] if len(x) else np.zeros((1, width))
    for _ in range(ROUNDS if len(x) else 0):
        near = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    return Cells(centres)


def nearest_cells(df: DataFrame, key: str, vector: str, cells: Cells, count: int) -> DataFrame:
    """(key, cell, place, v): the `count` nearest cells of each row from place 1 on, v its vector at length 1 (zeros if it can't be)."""
    kind = df.schema[key].dataType.simpleString()
    centres = cells.centres

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _ = matrix(batch.column(1), centres.shape[1])
            near = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :count]
            row = np.repeat(np.arange(len(x)), near.shape[1])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32) * x.shape[1]), pa.array(x[row].ravel()))
            place = np.tile(np.arange(1, near.shape[1] + 1, dtype=np.int32), len(x))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(near.ravel().astype(np.int32)), pa.array(place), flat], [key, "cell", "place", "v"])

    return df.filter(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, f"{key} {kind}, cell int, place int, v array<double>")


def write_index(chunks: DataFrame, key: str, path: str, cells: Cells, vector: str = "embedding") -> None:
    """Every row with a vector, stored by its nearest cell."""
    nearest_cells(chunks, key, vector, cells, 1).drop("place").repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(path)


def search(questions: DataFrame, query: str, index: DataFrame, key: str, cells: Cells, vector: str = "embedding", k: int = CANDIDATES, probes: int = 8) -> DataFrame:
    """(query, key, score, rank) among the rows of each question's `probes` nearest cells; with all cells the search is exact."""
    asked = nearest_cells(questions, query, vector, cells, min(probes, cells.n)).select(query, "cell", F.col("v").alias("_asked"))
    dot = F.aggregate(F.zip_with("_asked", "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return top(index.join(asked, "cell").select(query, key, F.round(dot, 12).alias("score")), query, key, k)


def probes_for(share: float, questions: DataFrame, query: str, exact: DataFrame, index: DataFrame, key: str, cells: Cells, vector: str = "embedding") -> int:
    """How many cells a search must read to find `share` of the exact search's rows, measured on these questions."""
    order = nearest_cells(questions, query, vector, cells, cells.n).select(query, "cell", "place")
    needed = exact.select(query, key).join(index.select(key, "cell"), key).join(order, [query, "cell"]).agg(F.percentile("place", F.lit(share))).first()[0]
    return min(cells.n, int(-(-(needed or 1) // 1)))


def recall(found: DataFrame, exact: DataFrame, query: str, key: str) -> DataFrame:
    """(n, recall): the share of the exact search's rows that were found."""
    both = exact.join(found.select(query, key).withColumn("_got", F.lit(1)), [query, key], "left")
    return both.agg(F.count("*").alias("n"), F.avg(F.coalesce("_got", F.lit(0)).cast("double")).alias("recall"))
