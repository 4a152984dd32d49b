"""Dense retrieval: exact top-k, random-projection candidates and a stand-in embedding."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bm25 import Best, counted

#: Query vectors that travel to the tasks at once, and rows that meet them at a time (160 MB of distances).
BLOCK_QUERIES, BLOCK_ROWS = 10_000, 1_024


def distance(a, b):
    """Squared Euclidean distance of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("qid").orderBy(F.round("distance", 6), "id")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def top_k(corpus: DataFrame, queries: DataFrame, k: int, corpus_id: str = "id", query_id: str = "qid", vector: str = "vector") -> DataFrame:
    """(qid, id, distance, rank): the nearest by squared distance, ties in order of id. Rows and queries
    without a vector are near nothing.

    A stated set of queries is held against every row, block by block: up to BLOCK_QUERIES of them travel to
    the tasks as one matrix, a larger set takes a pass for each block. A task reads BLOCK_ROWS rows at a time
    and keeps the k best of each query, so k rows a query and task are exchanged."""
    q = queries.select(F.col(query_id).cast("long").alias("qid"), F.col(vector).alias("qv")).filter("qv is not null")
    c = corpus.select(F.col(corpus_id).cast("long").alias("id"), F.col(vector).alias("v")).filter("v is not null")
    blocks = max(1, -(-q.count() // BLOCK_QUERIES))
    found = None
    for block in range(blocks):
        asked = (q if blocks == 1 else q.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block)).collect()
        part = _block(c, asked, k)
        found = part if found is None else found.unionByName(part)
    return _ranked(found, k)


def _block(c: DataFrame, asked: list, k: int) -> DataFrame:
    """(qid, id, distance): each task's k best rows for each of the collected queries."""
    ids = np.array([r.qid for r in asked], dtype=np.int64)
    matrix = np.array([r.qv for r in asked], dtype=float).reshape(len(asked), len(asked[0].qv) if asked else 0)
    squares = (matrix**2).sum(axis=1)[:, None]

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best_d, best_id = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), dtype=np.int64)
        for pdf in batches:
            for at in range(0, len(pdf) if len(ids) else 0, BLOCK_ROWS):
                rows, own = np.stack(pdf["v"].to_numpy()[at : at + BLOCK_ROWS]).astype(float), pdf["id"].to_numpy()[at : at + BLOCK_ROWS]
                d = np.maximum((rows**2).sum(axis=1)[None, :] + squares - 2 * matrix @ rows.T, 0)
                d = np.concatenate([best_d, d], axis=1)
                every = np.concatenate([best_id, np.broadcast_to(own, (len(ids), len(own)))], axis=1)
                order = np.lexsort((every, np.round(d, 6)), axis=-1)[:, :k]
                best_d, best_id = np.take_along_axis(d, order, axis=1), np.take_along_axis(every, order, axis=1)
        yield pd.DataFrame({"qid": np.repeat(ids, best_id.shape[1]), "id": best_id.ravel(), "distance": best_d.ravel()})

    return c.mapInPandas(blocks, "qid long, id long, distance double")


def write_store(df: DataFrame, path: str, row_id: str = "id", vector: str = "vector") -> None:
    """Drop and recreate the stored vectors (id, vector), so that queries read them and embed nothing anew."""
    df.select(F.col(row_id).alias("id"), F.col(vector).alias("vector")).write.mode("overwrite").parquet(path)


def read_store(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def signatures(x: np.ndarray, planes: np.ndarray, tables: int) -> np.ndarray:
    """(tables, rows): the signs of random projections as numbers, for each of several tables."""
    signs = (x @ planes > 0).reshape(len(x), tables, planes.shape[1] // tables)
    return (signs @ (1 << np.arange(signs.shape[2]))).T.copy()


def approximate_top_k(corpus: DataFrame, queries: DataFrame, k: int, dims: int, probe: bool = False, bits: int = 8, tables: int = 8, seed: int = 1) -> DataFrame:
    """Like top_k() on (id, vector) and (qid, vector), among rows that share a bucket with the query in one of the tables;
    with ``probe`` also rows whose bucket differs from the query's in one sign. As in top_k() the queries travel, block by
    block, and a task gives out its k best rows of each; pairs and vectors are not exchanged."""
    planes = np.random.default_rng(seed).standard_normal((dims, tables * bits))
    q = queries.select(F.col("qid").cast("long").alias("qid"), F.col("vector").alias("qv")).filter("qv is not null")
    c = corpus.select(F.col("id").cast("long").alias("id"), F.col("vector").alias("v")).filter("v is not null")
    blocks = max(1, -(-q.count() // BLOCK_QUERIES))
    found = None
    for block in range(blocks):
        asked = (q if blocks == 1 else q.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block)).collect()
        ids = np.array([r.qid for r in asked], dtype=np.int64)
        matrix = np.array([r.qv for r in asked], dtype=float).reshape(len(asked), dims)

        def near(batches: Iterator[pd.DataFrame], ids=ids, matrix=matrix) -> Iterator[pd.DataFrame]:
            best, squares, own = Best(ids, k), (matrix**2).sum(axis=1)[None, :], signatures(matrix, planes, tables)
            for pdf in batches:
                for at in range(0, len(pdf) if len(ids) else 0, BLOCK_ROWS):
                    rows = np.stack(pdf["v"].to_numpy()[at : at + BLOCK_ROWS]).astype(float)
                    held = np.zeros((len(rows), len(ids)), dtype=bool)
                    for mine, theirs in zip(signatures(rows, planes, tables), own):
                        differ = mine[:, None] ^ theirs[None, :]
                        held |= (differ & (differ - 1) if probe else differ) == 0
                    d = np.maximum((rows**2).sum(axis=1)[:, None] + squares - 2 * rows @ matrix.T, 0)
                    best.add(pdf["id"].to_numpy()[at : at + BLOCK_ROWS], -d, held)
            yield pd.DataFrame({"qid": ids[best.question], "id": best.id, "distance": -best.score})

        part = c.mapInPandas(near, "qid long, id long, distance double")
        found = part if found is None else found.unionByName(part)
    return _ranked(found, k)


def hashed_embedding(df: DataFrame, row_id: str, text: str, dims: int = 256) -> DataFrame:
    """(id, vector): a unit-length count vector of hashed tokens, a stand-in for a sentence embedding."""
    return embedded(counted(df, row_id, text), dims)


def embedded(documents: DataFrame, dims: int = 256) -> DataFrame:
    """hashed_embedding() of counted documents (id, terms, tfs), each in the task that reads it."""

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                lists = part.column("terms")
                row = np.repeat(np.arange(part.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                coded = pc.dictionary_encode(lists.flatten())
                places = np.array([int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dims for w in coded.dictionary.to_pylist()], dtype=np.int64)
                cell = row * dims + places[coded.indices.to_numpy(zero_copy_only=False)] if len(row) else row
                tf = part.column("tfs").flatten().to_numpy(zero_copy_only=False)
                out = np.bincount(cell, tf, part.num_rows * dims).reshape(-1, dims)
                norms = np.linalg.norm(out, axis=1, keepdims=True)
                ends = pa.array(np.arange(part.num_rows + 1) * dims, pa.int32())
                vectors = pa.ListArray.from_arrays(ends, pa.array((out / np.where(norms > 0, norms, 1)).ravel()))
                yield pa.RecordBatch.from_arrays([part.column("id"), vectors], ["id", "vector"])

    kind = documents.schema["id"].dataType.simpleString()
    return documents.select("id", "terms", "tfs").mapInArrow(embed, f"id {kind}, vector array<double>")
