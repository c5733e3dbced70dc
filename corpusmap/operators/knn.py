"""Exact nearest neighbours by metric cells, for points in the plane and for long vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmap.functions.arrow import matrix, values
from corpusmap.functions.vectors import normalize
from corpusmap.operators import cells as C
from corpusmap.operators.cells import chunks, distances
from corpusmap.operators.copies import collapse
from corpusmap.operators.rank import top_per_group
from corpusmap.operators.simjoin import arrow_id_type
from corpusmap.scratch import Tables

# Distances between long vectors come from a matrix product; they are compared at nine decimals.
DECIMALS = 9


def top_kernel(k: int, query_type: pa.DataType, id_type: pa.DataType, unit: bool = False):
    """The ``k`` nearest candidates of each query of a block, ties by id; of unit vectors by their rounded cosine."""

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            asked, named = values(left.column("id")), values(right.column("id"))
            order = named.argsort(kind="stable")
            named = named[order]
            va, vb = matrix(left.column("vec")), matrix(right.column("vec"))[order]
            for part in chunks(len(va), len(vb)):
                if unit:
                    dist = np.sqrt(np.maximum(2.0 - 2.0 * np.round(va[part] @ vb.T, DECIMALS), 0.0))
                else:
                    dist = distances(va[part], vb)
                    if va.shape[1] > 4:
                        dist = np.round(dist, DECIMALS)
                if dist.shape[1] > k:
                    kth = np.partition(dist, k - 1, axis=1)[:, k - 1]
                    i, j = np.nonzero(dist <= kth[:, None])
                else:
                    i, j = (ix.ravel() for ix in np.indices(dist.shape))
                d = dist[i, j]
                by = np.lexsort((j, d, i))
                i, j, d = i[by], j[by], d[by]
                keep = np.arange(len(i)) - np.searchsorted(i, i) < k
                found.append((asked[i[keep] + part.start], named[j[keep]], d[keep]))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [[], [], []]
        return pa.table(
            {
                "id": pa.array(columns[0], type=query_type),
                "neighbor": pa.array(columns[1], type=id_type),
                "dist": pa.array(columns[2], type=pa.float64()),
            }
        )

    return kernel


def nearest(
    queries: DataFrame | None, corpus: DataFrame, k: int, tables: Tables, unit: bool = False
) -> DataFrame:
    """The ``k`` nearest corpus rows ``(id, vec)`` of every query row: ``(id, neighbor, dist)``.

    With ``unit`` the vectors have length one and are ranked by rounded cosine, of which ``dist`` is a function.
    Without ``queries`` the corpus is joined to itself, each row being its own first neighbour. Round one
    looks into the query's own cell; its k-th distance then says which other cells round two must visit.
    """
    cells = C.build_cells(corpus, tables)
    n_cells = len(cells.counts)
    asked = cells.homes if queries is None else tables.save(C.assign_cells(queries, cells.pivots), "asked")
    asked_counts = cells.counts if queries is None else C.cell_counts(asked, n_cells)
    query_kind = asked.schema["id"].dataType.simpleString()
    kernel = top_kernel(k, arrow_id_type(asked), arrow_id_type(corpus), unit)
    schema = f"id {query_kind}, neighbor {cells.id_type}, dist double"

    def round_of(rows: DataFrame, counts: np.ndarray) -> DataFrame:
        mine, theirs = C.n_blocks(counts), C.n_blocks(cells.counts)
        left = C.spread(rows, "queries", C.cross_fan(mine, theirs))
        right = C.spread(cells.homes, "candidates", C.cross_fan(theirs, mine))
        partial = C.compare(left, right, kernel, schema)
        return _best(partial, k)

    near = tables.save(round_of(asked, asked_counts), "near")
    if n_cells == 1:
        return near
    radius = F.max("dist")
    if unit:
        # Cosines that round to the same number as the k-th lie within this distance.
        radius = F.sqrt(radius * radius + F.lit(4.0 * 10.0**-DECIMALS))
    reach = near.groupBy("id").agg(F.when(F.count("*") >= k, radius).alias("radius"))
    searching = asked.join(reach, "id", "left")
    guest_cells = C.Cells(cells.homes, cells.pivots, cells.counts, cells.radii, query_kind)
    guests = tables.save(C.visits(guest_cells, searching, None, k=k), "guests")
    far = round_of(guests, C.cell_counts(guests, n_cells))
    return _best(near.unionByName(far), k)


def _best(found: DataFrame, k: int) -> DataFrame:
    return top_per_group(found, "id", [F.asc("dist"), F.asc("neighbor")], k, "r").drop("r")


def knn(points: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest others of every ``(id, vec)``: ``(id, neighbor, dist, rank)``, ties by id.

    Equal vectors form one location. Locations are joined; of each only its first k + 1 ids can be anyone's
    neighbours, and every id of a location has the same neighbours but for itself.
    """
    tables = Tables(points.sparkSession, "knn")
    groups = collapse(points.select("id", F.col("vec").cast("array<double>").alias("vec")), ["vec"], tables)
    places = groups.reps.select(F.col("rep").alias("id"), "vec")
    found = nearest(None, places, k + 1, tables)
    if not groups.has_copies:
        others = found.filter(F.col("id") != F.col("neighbor"))
        return tables.save(top_per_group(others, "id", [F.asc("dist"), F.asc("neighbor")], k), "knn")
    first_ids = top_per_group(groups.members, "rep", [F.asc("id")], k + 1, "r").select(
        F.col("rep").alias("neighbor"), F.col("id").alias("other")
    )
    listed = found.join(first_ids, "neighbor").select("id", F.col("other").alias("neighbor"), "dist")
    lists = _best(listed, k + 1).groupBy(F.col("id").alias("rep")).agg(
        F.sort_array(F.collect_list(F.struct("dist", "neighbor"))).alias("near")
    )
    others = F.slice(F.filter("near", lambda x: x["neighbor"] != F.col("id")), 1, k)
    ranked = groups.members.join(lists, "rep").select("id", F.posexplode(others).alias("pos", "n"))
    result = ranked.select("id", F.col("n.neighbor").alias("neighbor"), F.col("n.dist").alias("dist"),
                           (F.col("pos") + 1).alias("rank"))
    return tables.save(result, "knn")


def knn_join(points: DataFrame, k: int = 10) -> DataFrame:
    """Nearest neighbours of points ``(id, x, y)``."""
    return knn(points.select("id", F.array(F.col("x").cast("double"), F.col("y").cast("double")).alias("vec")), k)


def lifted(col, slot: int):
    """A unit vector with two more coordinates, where a zero vector gets a one in the given slot.

    Then all vectors have unit length, and a zero vector has cosine 0 with every vector of the other side.
    """
    unit = normalize(col)
    zero = F.when(F.exists(unit, lambda x: x != 0), F.lit(0.0)).otherwise(F.lit(1.0))
    extra = [F.lit(0.0), F.lit(0.0)]
    extra[slot] = zero
    return F.concat(unit, F.array(*extra))


def nearest_unit_vectors(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Exact cosine top-k of a large set of queries: ``(query_id, id, similarity)``."""
    tables = Tables(vectors.sparkSession, "nearest")
    corpus = vectors.select("id", lifted(F.col("embedding"), 0).alias("vec"))
    groups = collapse(corpus, ["vec"], tables)
    asked = queries.select(F.col("query_id").alias("id"), lifted(F.col("embedding"), 1).alias("vec"))
    found = nearest(asked, groups.reps.select(F.col("rep").alias("id"), "vec"), k, tables, unit=True)
    first_ids = top_per_group(groups.members, "rep", [F.asc("id")], k, "r").select(
        F.col("rep").alias("neighbor"), F.col("id").alias("other")
    )
    score = F.round(F.lit(1.0) - F.col("dist") * F.col("dist") / 2.0, DECIMALS)
    return found.join(first_ids, "neighbor").select(
        F.col("id").alias("query_id"), F.col("other").alias("id"), score.alias("similarity")
    )
