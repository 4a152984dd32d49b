"""Approximate dense search over a stored inverted-file index: k-means cells, codes of residuals, exact re-ranking.

A bounded sample gives the cells and the code books; every row is then coded and written twice under its cell, as a
short code and as a whole vector. A query looks at the codes of its nearest cells only (other cells' files are not
opened) and fetches the whole vectors of the best candidates, so the last ranking is exact among them.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .vector import BLOCK_QUERIES, distance

#: Queries whose distance tables stand in a task's memory at a time, and rows that meet them.
SLICE, ROWS = 256, 2_048
CODES = 256


def means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's algorithm on a sample; a centre without rows stays where it is."""
    at = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = nearest(x, at)
        counts = np.bincount(own, minlength=len(at))
        sums = np.zeros_like(at)
        np.add.at(sums, own, x)
        at[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return at


def gaps(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] + (at**2).sum(axis=1)[None, :] - 2 * x @ at.T, 0)


def nearest(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.concatenate([gaps(x[i : i + ROWS], at).argmin(axis=1) for i in range(0, len(x), ROWS)] or [np.zeros(0, int)])


@dataclass
class Model:
    """cells (cells, dims) and books (parts, codes, dims / parts)."""

    cells: np.ndarray
    books: np.ndarray

    def residuals(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        parts, _, width = self.books.shape
        return (x - self.cells[own]).reshape(len(x), parts, width)

    def code(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        rest = self.residuals(x, own)
        return np.stack([nearest(rest[:, p], book) for p, book in enumerate(self.books)], axis=1).astype(np.uint8)


def fit(sample: np.ndarray, cells: int, parts: int, rounds: int, seed: int) -> Model:
    rng = np.random.default_rng(seed)
    model = Model(means(sample, cells, rounds, rng), np.zeros((parts, 1, sample.shape[1] // parts)))
    rest = model.residuals(sample, nearest(sample, model.cells))
    size = min(CODES, len(sample))
    model.books = np.stack([means(rest[:, p], size, rounds, rng) for p in range(parts)])
    return model


def build(corpus: DataFrame, path: str, cells: int = 64, parts: int = 16, sample: int = 20_000, rounds: int = 8, seed: int = 1,
          row_id: str = "id", vector: str = "vector") -> None:
    """Writes the index of (id, vector) under ``path``: model, codes and vectors, the last two in a folder a cell.

    The model is fitted in one task on the ``sample`` rows of smallest hash; all rows are coded and stored. A cell that
    holds a large share of the rows is split over tasks by id. Null vectors are left out; all others need one length, a
    multiple of ``parts``. Rows that repeat an id are stored each. An empty table gives an index that finds nothing."""
    rows = corpus.select(F.col(row_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).filter("vector is not null")
    some = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample)

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [pdf for pdf in batches if len(pdf)]
        if held:
            model = fit(np.stack(pd.concat(held).sort_values("id")["vector"].to_numpy()), cells, parts, rounds, seed)
            yield pd.DataFrame({"model": [pickle.dumps((model.cells, model.books))]})

    some.repartition(1).mapInPandas(learn, "model binary").write.mode("overwrite").parquet(f"{path}/model")
    model = _model(corpus.sparkSession, path)

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf) and model is not None:
                x = np.stack(pdf["vector"].to_numpy())
                own = nearest(x, model.cells)
                yield pdf.assign(cell=own.astype(np.int32), code=[c.tobytes() for c in model.code(x, own)])

    every = rows.mapInPandas(coded, "id long, vector array<double>, cell int, code binary")
    placed = every.repartitionByRange("cell", F.xxhash64("id")).sortWithinPartitions("cell", "id")
    placed.select("cell", "id", "vector", "code").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")


def _model(spark: SparkSession, path: str) -> Model | None:
    found = spark.read.schema("model binary").parquet(f"{path}/model").first()
    return Model(*pickle.loads(found.model)) if found is not None else None


ROW = "id long, vector array<double>, code binary, cell int"


def candidates(spark: SparkSession, path: str, asked: list, probe: int, shortlist: int) -> DataFrame:
    """(qid, id, cell, near): by their codes the best ``shortlist`` rows of each query in its ``probe`` nearest cells."""
    model = _model(spark, path)
    stored = spark.read.schema(ROW).parquet(f"{path}/rows").select("cell", "id", "code")
    ids, matrix = np.array([r.qid for r in asked], dtype=np.int64), np.array([r.qv for r in asked], dtype=float)
    order = np.argsort(gaps(matrix, model.cells), axis=1, kind="stable")[:, :probe]
    by_cell = {int(c): np.flatnonzero((order == c).any(axis=1)) for c in np.unique(order)}
    parts, _, width = model.books.shape

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for cell, rows in pdf.groupby("cell", sort=True):
                codes = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(-1, parts)
                own = rows["id"].to_numpy()
                for at in range(0, len(by_cell[cell]), SLICE):
                    mine = by_cell[cell][at : at + SLICE]
                    rest = (matrix[mine] - model.cells[cell]).reshape(len(mine), parts, width)
                    near = sum(gaps(rest[:, p], book)[:, codes[:, p]] for p, book in enumerate(model.books))
                    best = np.lexsort((np.broadcast_to(own, near.shape), near), axis=-1)[:, :shortlist]
                    flat = {"qid": np.repeat(ids[mine], best.shape[1]), "id": own[best].ravel()}
                    yield pd.DataFrame({**flat, "cell": np.int32(cell), "near": np.take_along_axis(near, best, axis=1).ravel()})

    found = stored.filter(F.col("cell").isin(list(by_cell))).mapInPandas(look, "qid long, id long, cell int, near double")
    first = Window.partitionBy("qid").orderBy("near", "id")
    return found.withColumn("place_", F.row_number().over(first)).filter(F.col("place_") <= shortlist).drop("place_")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, probe: int = 36, shortlist: int = 200) -> DataFrame:
    """(qid, id, distance, rank): the ``k`` nearest of (qid, vector) by exact distance among each query's shortlist, ties
    in order of id. With all cells probed and a shortlist of all rows it is exact. Queries travel BLOCK_QUERIES at a
    time; queries without a vector find nothing."""
    q = queries.select(F.col("qid").cast("long").alias("qid"), F.col("vector").alias("qv")).filter("qv is not null")
    blocks, out = max(1, -(-q.count() // BLOCK_QUERIES)), None
    empty = spark.createDataFrame([], "qid long, id long, distance double, rank int")
    if _model(spark, path) is None:
        return empty
    rows = spark.read.schema(ROW).parquet(f"{path}/rows").select("cell", "id", F.col("vector").alias("v"))
    for block in range(blocks):
        part = q if blocks == 1 else q.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block)
        asked = part.collect()
        if asked:
            pairs = candidates(spark, path, asked, probe, shortlist).select("qid", "id", "cell").distinct()
            met = pairs.join(part, "qid").join(rows, ["cell", "id"])
            out_ = met.select("qid", "id", distance(F.col("v"), F.col("qv")).alias("distance"))
            out = out_ if out is None else out.unionByName(out_)
    if out is None:
        return empty
    best = Window.partitionBy("qid").orderBy(F.round("distance", 6), "id")
    return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
