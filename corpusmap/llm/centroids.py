"""Centroid clusters, each vector's nearest centroid found by the threshold algorithm.

Every dimension has a list of the centroids sorted by their value. For a vector the lists are walked outward from its own
value, one centroid a step in each dimension; a centroid met for the first time gets its exact distance. The centroids not
met yet differ by at least the frontier's difference in every dimension, so once the sum of the squared frontier
differences strictly exceeds the best exact distance, no other centroid is nearer or ties. All vectors of a batch
walk together, and those that have stopped leave it.

All arithmetic is on integers, so that the results are exact whatever the order of the rows. The tasks send one sum per
centroid and dimension; equal vectors, however many, stay where they are.

Defined cases: a vector is kept if it has exactly ``dims`` components, none null, NaN or infinite; others give no row. Repeated
rows count each. A null id counts as empty text in the order of the first centroids, and rows of one id go by their vectors.
With fewer vectors than centroids there are as many centroids as vectors; empty tables give no rows. Components of 2^21 and
more (2^27 in integers) raise an error, as their distances might not fit 64 bits. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmap.scratch import Tables

CENTROIDS, ROUNDS, DIMS, SCALE, SEED = 16, 3, 64, 64, 1
# Components beyond this, as integers, could overflow a distance.
LARGEST = 1 << 27
# Vectors that walk together.
BATCH = 4096


def whole_vectors(df: DataFrame, id_col: str, vec_col: str, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """``(vec_id, vec)`` of the vectors to keep, as integers."""
    vec = F.transform(F.col(vec_col), lambda x: x.cast("double"))

    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))

    rows = df.select(F.col(id_col).alias("vec_id"), vec.alias("vec"))
    rows = rows.filter((F.size("vec") == dims) & F.forall("vec", finite))
    fits = F.forall("vec", lambda x: F.abs(F.floor(x * scale)) < LARGEST)
    checked = F.when(fits, F.transform("vec", lambda x: F.floor(x * scale).cast("bigint")))
    return rows.select("vec_id", F.coalesce(checked, F.raise_error(F.lit("a component is too large"))).alias("vec"))


def first_centroids(rows: DataFrame, centroids: int, seed: int) -> np.ndarray:
    """The vectors whose ids have the smallest hashes, in their order: at most ``centroids`` rows."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    chosen = rows.orderBy(F.sha2(name, 256), "vec").limit(centroids).select("vec").collect()
    return np.array([r["vec"] for r in chosen], np.int64)


class SortedLists:
    """For each dimension the centroids in order of their value, and a walk outward from a vector's value."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids
        self.order = np.argsort(centroids, axis=0, kind="stable").T
        self.values = np.sort(centroids, axis=0).T

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each vector's nearest centroid, the smaller of equal ones, and the squared distance."""
        n, (dims, k) = len(vectors), self.values.shape
        best = np.full(n, np.iinfo(np.int64).max)
        number = np.full(n, k)
        # Next places to the left and right of the vector's own value, in each dimension.
        right = np.empty((n, dims), np.int64)
        for d in range(dims):
            right[:, d] = np.searchsorted(self.values[d], vectors[:, d])
        left = right - 1
        walking, met = np.arange(n), np.zeros((n, k), bool)
        dim = np.arange(dims)
        while len(walking):
            own = vectors[walking]
            low, high = left[walking], right[walking]
            below = np.where(low >= 0, own - self.values[dim, np.maximum(low, 0)], np.iinfo(np.int64).max)
            above = np.where(high < k, self.values[dim, np.minimum(high, k - 1)] - own, np.iinfo(np.int64).max)
            go_left = below <= above
            frontier = np.where(go_left, below, above)
            seen = self.order[dim, np.where(go_left, low, high)]
            left[walking] -= go_left
            right[walking] += ~go_left
            new = np.zeros((len(walking), k), bool)
            np.put_along_axis(new, seen, True, axis=1)
            new &= ~met[walking]
            met[walking] |= new
            row, centroid = np.nonzero(new)
            apart = own[row] - self.centroids[centroid]
            exact = np.einsum("ij,ij->i", apart, apart)
            # Rows come in order and centroids rise within a row, so that the first least one is the smaller number.
            order = np.lexsort((centroid, exact, row))
            first = order[np.unique(row[order], return_index=True)[1]]
            at = walking[row[first]]
            better = (exact[first] < best[at]) | ((exact[first] == best[at]) & (centroid[first] < number[at]))
            best[at[better]], number[at[better]] = exact[first][better], centroid[first][better]
            bound = np.einsum("ij,ij->i", frontier, frontier)
            walking = walking[(bound <= best[walking]) & ~met[walking].all(axis=1)]
        return number, best


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _assigned(centroids: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lists = SortedLists(centroids)
    for batch in batches:
        for a in range(0, batch.num_rows, BATCH):
            part = batch.slice(a, BATCH)
            number, best = lists.nearest(_vectors(part.column(1), centroids.shape[1]))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(number.astype(np.int32)), pa.array(best)], names=["vec_id", "cluster", "distance"]
            )


def _sums(centroids: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per centroid and dimension the sum of the task's vectors; dimension -1 holds their number."""
    lists, (k, dims) = SortedLists(centroids), centroids.shape
    sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
    for batch in batches:
        for a in range(0, batch.num_rows, BATCH):
            vectors = _vectors(batch.column(0).slice(a, BATCH), dims)
            number = lists.nearest(vectors)[0]
            np.add.at(sums, number, vectors)
            counts += np.bincount(number, minlength=k)
    some = np.flatnonzero(counts)
    made = np.column_stack([counts, sums])[some]
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(some, dims + 1).astype(np.int32)),
         pa.array(np.tile(np.arange(-1, dims), len(some)).astype(np.int32)), pa.array(made.ravel())],
        names=["cluster", "dim", "total"],
    )


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of the exact means; empty ones stay."""
    sums = rows.select("vec").mapInArrow(partial(_sums, centroids), "cluster int, dim int, total bigint")
    totals = sums.groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    found = {(r["cluster"], r["dim"]): int(r["total"]) for r in totals}
    after = centroids.copy()
    for (cluster, dim), total in found.items():
        if dim >= 0:
            after[cluster, dim] = total // found[cluster, -1]
    return after


def cluster_vectors(
    df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", centroids: int = CENTROIDS, rounds: int = ROUNDS,
    dims: int = DIMS, scale: int = SCALE, seed: int = SEED,
) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of every kept vector."""
    tables = Tables(df.sparkSession, "centroids")
    rows = tables.save(whole_vectors(df, id_col, vec_col, dims, scale), "vectors")
    at = first_centroids(rows, centroids, seed)
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, cluster int, distance bigint"
    if not len(at):
        at = np.zeros((1, dims), np.int64)
    for _ in range(rounds):
        at = moved(rows, at)
    found = tables.save(rows.mapInArrow(partial(_assigned, at), schema), "assigned")
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at.tolist()]
    names = df.sparkSession.createDataFrame(list(enumerate(digests)), "cluster int, centroid_sha256 string")
    per = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    # One row per centroid.
    facts = per.crossJoin(per.agg(F.sum("cluster_inertia").alias("inertia"))).join(names, "cluster")
    return found.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
