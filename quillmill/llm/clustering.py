"""Centroid clustering: exact k-means over integer vectors with Shallot bounds.

Each row carries its centroid, the second-nearest one it remembers, an upper bound of the distance to the first
and a lower bound of the distance to all others. A round moves the bounds by how far the centroids went. Only a row
whose bounds overlap is searched: from the closer of its two centroids along that centroid's neighbours in order of
distance, as far as a ball that shrinks with each better second centroid. Survivors are compared by exact integer
squares, so equal distances go to the smaller number and no rounding changes a result.

A round is one pass over one table: tasks read rows with their bounds, write them with new ones, and add one row of
exact sums for each centroid and task to the same table. Spark adds those up (k x dims numbers); no row travels,
whatever the sizes of the clusters. The table before is removed once the next stands, so two of them are kept at most.

Rows: a vector that is null, of another length, or with a null or non-finite component is left out. Integers beyond
+-2^27 count as +-2^27, which keeps each squared distance within a long. Rows that repeat an id are vectors of their
own; a null id counts as an empty word in the seed hash. Fewer rows than k give as many centroids as rows, an empty
table gives no rows. Columns other than id and vector are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Largest integer component: (2 * 2^27)^2 * 64 components stay within 2^63.
LARGEST = 1 << 27
#: Relative slack of the floating-point bounds; the bounds only decide what is compared, never the result.
SLACK = 1e-9
LONG_MAX = (1 << 63) - 1


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(values.astype(np.float64) * scale), -LARGEST, LARGEST).astype(np.int64)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x to the same rows of c."""
    gap = x - c
    return np.einsum("ij,ij->i", gap, gap)


class Centroids:
    """Centroids with what a search needs: each one's neighbours in order of distance, half the gap to the nearest,
    and how far each one moved since the last round."""

    def __init__(self, at: np.ndarray, before: np.ndarray | None = None) -> None:
        self.at, k = at, len(at)
        gaps = np.sqrt(np.stack([squares(at, np.broadcast_to(c, at.shape)) for c in at]).astype(np.float64))
        order = np.argsort(gaps, axis=1, kind="stable")
        self.order = order[order != np.arange(k)[:, None]].reshape(k, k - 1)
        self.gaps = np.take_along_axis(gaps, self.order, axis=1)
        self.half = self.gaps[:, 0] / 2 if k > 1 else np.full(k, np.inf)
        self.moved = np.zeros(k) if before is None else np.sqrt(squares(at, before).astype(np.float64))
        far = np.argsort(-self.moved, kind="stable")
        self.moved_others = np.where(np.arange(k) == far[0], self.moved[far[1]] if k > 1 else 0.0, self.moved[far[0]])

    def first(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Nearest and second-nearest centroid of rows that have no bounds yet."""
        far = np.stack([squares(x, np.broadcast_to(c, x.shape)) for c in self.at], axis=1)
        rows, a = np.arange(len(x)), far.argmin(axis=1)
        nearest = far[rows, a].copy()
        far[rows, a] = LONG_MAX
        b = far.argmin(axis=1)
        second = np.sqrt(far[rows, b].astype(np.float64)) if len(self.at) > 1 else np.full(len(x), np.inf)
        return a, b, np.sqrt(nearest.astype(np.float64)) * (1 + SLACK), second * (1 - SLACK)

    def again(self, x: np.ndarray, a: np.ndarray, b: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, ...]:
        """The same from the last round's centroids and bounds."""
        upper = upper + self.moved[a] * (1 + SLACK)
        lower = lower - self.moved_others[a] * (1 + SLACK)
        a, b = a.copy(), b.copy()
        open_ = np.flatnonzero(upper >= np.maximum(lower, self.half[a] * (1 - SLACK)))
        if not len(open_):
            return a, b, upper, lower
        nearest = squares(x[open_], self.at[a[open_]])
        upper[open_] = np.sqrt(nearest.astype(np.float64)) * (1 + SLACK)
        still = upper[open_] >= np.maximum(lower[open_], self.half[a[open_]] * (1 - SLACK))
        open_, nearest = open_[still], nearest[still]
        if len(open_):
            a[open_], b[open_], upper[open_], lower[open_] = self.search(x[open_], a[open_], b[open_], nearest)
        return a, b, upper, lower

    def search(self, x: np.ndarray, a: np.ndarray, b: np.ndarray, nearest: np.ndarray) -> tuple[np.ndarray, ...]:
        second = squares(x, self.at[b])
        swap = (second < nearest) | ((second == nearest) & (b < a))
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        nearest, second = np.where(swap, second, nearest), np.where(swap, nearest, second)
        start, other = a.copy(), b.copy()
        reach, live = np.sqrt(nearest.astype(np.float64)), np.arange(len(x))
        for step in range(self.order.shape[1]):
            # No centroid farther from the start than this can be nearer than the second one found so far.
            ball = reach[live] + np.sqrt(second[live].astype(np.float64))
            live = live[self.gaps[start[live], step] * (1 - SLACK) <= ball * (1 + SLACK)]
            if not len(live):
                break
            seen = self.order[start[live], step]
            rows = live[seen != other[live]]
            seen = self.order[start[rows], step]
            far = squares(x[rows], self.at[seen])
            best = (far < nearest[rows]) | ((far == nearest[rows]) & (seen < a[rows]))
            next_ = ~best & ((far < second[rows]) | ((far == second[rows]) & (seen < b[rows])))
            won, came = rows[best], rows[next_]
            b[won], second[won] = a[won], nearest[won]
            a[won], nearest[won] = seen[best], far[best]
            b[came], second[came] = seen[next_], far[next_]
        return a, b, np.sqrt(nearest.astype(np.float64)) * (1 + SLACK), np.sqrt(second.astype(np.float64)) * (1 - SLACK)


#: A row of a vector has no count; a row of sums has a count and no vector.
STATE = "vector_ array<int>, a_ int, b_ int, upper_ double, lower_ double, distance_ long, count_ long, sums_ array<long>"


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel(), kind))


def pass_over(state: DataFrame, centroids: Centroids, dims: int, scale: int | None) -> DataFrame:
    """One round over all rows. scale: the input's components are numbers to be scaled, and no bounds stand yet."""
    id_type = state.schema["id_"].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(centroids.at), np.int64), np.zeros((len(centroids.at), dims), np.int64)
        kind = None
        for batch in batches:
            kind = batch.column("id_").type
            if not batch.num_rows:
                continue
            flat = batch.column("vector_").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            if scale is None:
                x = flat.astype(np.int64)
                old = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("a_", "b_", "upper_", "lower_")]
                a, b, upper, lower = centroids.again(x, *old)
            else:
                x = integers(flat, scale)
                a, b, upper, lower = centroids.first(x)
            for c in np.unique(a):
                mine = x[a == c]
                counts[c] += len(mine)
                sums[c] += mine.sum(axis=0)
            n = len(x)
            columns = [batch.column("id_"), lists(x.astype(np.int32), pa.int32()), pa.array(a, pa.int32()), pa.array(b, pa.int32())]
            columns += [pa.array(upper), pa.array(lower), pa.array(squares(x, centroids.at[a]))]
            columns += [pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names)
        full = np.flatnonzero(counts)
        if kind is not None and len(full):
            n = len(full)
            columns = [pa.nulls(n, kind), pa.nulls(n, pa.list_(pa.int32())), pa.array(full, pa.int32()), pa.nulls(n, pa.int32())]
            columns += [pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts[full]), lists(sums[full], pa.int64())], names)

    schema = f"id_ {id_type.simpleString()}, {STATE}"
    names = ["id_", *(x.split()[0] for x in STATE.split(", "))]
    return state.mapInArrow(work, schema)


def moved(state: DataFrame, at: np.ndarray) -> np.ndarray:
    """The centroids after a round: exact floors of the means; those without rows stay. Reads the rows of sums."""
    each = state.where("count_ is not null").select("a_", F.posexplode(F.concat("sums_", F.array("count_"))).alias("i", "x"))
    out, total = at.copy(), {}
    for r in each.groupBy("a_", "i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():
        total.setdefault(r["a_"], {})[r["i"]] = int(r["x"])
    for c, sums in total.items():
        out[c] = [sums[i] // sums[at.shape[1]] for i in range(at.shape[1])]
    return out


def usable(vector: Column, dims: int) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dims) & fine, F.lit(False))


def cluster(vectors: DataFrame, row_id: str = "vec_id", vector: str = "embedding", k: int = 40, dims: int = 64,
            scale: int = 256, rounds: int = 5, seed: int = 2) -> tuple[DataFrame, np.ndarray]:
    """Rows (id, cluster int, distance long) of all usable vectors after ``rounds`` rounds, and the k centroids."""
    rows = vectors.where(usable(F.col(vector), dims)).select(F.col(row_id).alias("id_"), F.col(vector).alias("vector_"))
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id_").cast("string"), F.lit(""))), 256)
    chosen = rows.orderBy(named, "vector_").limit(k).collect()
    result = [F.col("id_").alias(row_id), F.col("a_").alias("cluster"), F.col("distance_").alias("distance")]
    if not chosen:
        return rows.select("id_", F.lit(0).alias("a_"), F.lit(0).cast("long").alias("distance_")).select(*result), np.zeros((0, dims), np.int64)
    at = integers(np.array([r["vector_"] for r in chosen]), scale)
    spark, state, before, last = vectors.sparkSession, rows, None, None
    for turn in range(rounds + 1):
        done = pass_over(state.where("count_ is null") if turn else state, Centroids(at, before), dims, None if turn else scale)
        path = common.new_path(spark, f"clusters-{turn}")
        state, before = common.materialise(done, "clusters", path), at
        if last:
            common.remove(spark, last)
        last = path
        if turn < rounds:
            at = moved(state, at)
    return state.where("count_ is null").select(*result), at


def described(assigned: DataFrame, centroids: np.ndarray, row_id: str = "vec_id") -> DataFrame:
    """The assignment with the inertia of each row's cluster and of all, and a digest of its centroid. What is
    joined has a row for each centroid."""
    spark = assigned.sparkSession
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    within = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum_")).collect()
    sums = {r["cluster"]: int(r["sum_"]) for r in within}
    total = min(sum(sums.values()), LONG_MAX)
    known = [(i, min(sums.get(i, 0), LONG_MAX), total, x) for i, x in digests]
    table = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster").select(row_id, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
