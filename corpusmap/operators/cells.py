"""Metric cells: the shared plan of exact distance joins.

Vectors are assigned to the nearest of a bounded number of pivots. A pair within distance ``r`` lies in one
cell, or straddles the plane between two pivots; the triangle inequality then tells which vectors must also
visit another cell. Cells of any size are cut into blocks of bounded size, and each task compares one block
of queries with one block of candidates, so that a crowded cell becomes many equal tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmap.functions.arrow import matrix
from corpusmap.scratch import Tables

# Rows a task compares at once, on either side.
BLOCK = 2048
# Pivots are driver-side: at most this many, and at most this many numbers in all.
MAX_PIVOTS = 16_384
MAX_PIVOT_VALUES = 1 << 20
CELL_ROWS = 512
# Working memory of a distance matrix, in numbers.
CHUNK_VALUES = 4 << 20
# Slack of bounds and comparisons against rounding.
EPS = 1e-9


@dataclass
class Cells:
    """Vectors ``(id, vec, cell, gap)`` written with their home cell, and the pivots' driver-side summary."""

    homes: DataFrame
    pivots: np.ndarray
    counts: np.ndarray
    radii: np.ndarray
    id_type: str


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairwise Euclidean distances; few dimensions are subtracted, many go through a matrix product."""
    if a.shape[1] <= 4:
        return np.sqrt(sum((a[:, i, None] - b[None, :, i]) ** 2 for i in range(a.shape[1])))
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0.0))


def chunks(n: int, width: int) -> Iterator[slice]:
    """Row ranges whose distance rows fit the working memory."""
    step = max(1, CHUNK_VALUES // max(width, 1))
    return (slice(i, min(i + step, n)) for i in range(0, n, step))


def _assigner(pivots: np.ndarray):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = matrix(batch.column("vec"))
            cell = np.zeros(len(vec), dtype=np.int32)
            gap = np.zeros(len(vec))
            for part in chunks(len(vec), len(pivots)):
                dist = distances(vec[part], pivots)
                cell[part] = dist.argmin(1)
                gap[part] = dist.min(1)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "vec", "h")), pa.array(cell), pa.array(gap)],
                names=["id", "vec", "h", "cell", "gap"],
            )

    return assign


def assign_cells(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Vectors with their nearest pivot, the distance to it, and a hash of the id."""
    id_type = df.schema["id"].dataType.simpleString()
    rows = df.select("id", F.col("vec").cast("array<double>").alias("vec"), F.xxhash64("id").alias("h"))
    return rows.mapInArrow(
        _assigner(pivots), f"id {id_type}, vec array<double>, h bigint, cell int, gap double"
    )


def cell_counts(df: DataFrame, n_cells: int) -> np.ndarray:
    """Rows per cell; one row per pivot reaches the driver."""
    counts = np.zeros(n_cells, dtype=np.int64)
    for row in df.groupBy("cell").agg(F.count("*").alias("n")).collect():
        counts[row["cell"]] = row["n"]
    return counts


def build_cells(df: DataFrame, tables: Tables, name: str = "homes", cell_rows: int = CELL_ROWS) -> Cells:
    """Choose pivots among the vectors ``(id, vec)`` and assign every vector to the nearest one."""
    shape = df.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d")).first()
    n, d = shape["n"], shape["d"] or 1
    wanted = int(min(max(1, n // cell_rows), MAX_PIVOTS, max(1, MAX_PIVOT_VALUES // d)))
    # A hash-ordered top-n is a repeatable sample; its size is bounded above.
    sample = df.orderBy(F.md5(F.col("id").cast("string")), "id").limit(wanted).select("vec").toArrow()
    pivots = matrix(sample.column("vec")) if n else np.zeros((1, d))
    homes = tables.save(assign_cells(df, pivots), name)
    counts = np.zeros(len(pivots), dtype=np.int64)
    radii = np.zeros(len(pivots))
    # One row per pivot reaches the driver.
    for row in homes.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("r")).collect():
        counts[row["cell"]], radii[row["cell"]] = row["n"], row["r"]
    return Cells(homes, pivots, counts, radii, df.schema["id"].dataType.simpleString())


def plane_gaps(dist: np.ndarray, home: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Lower bounds on the distance from each vector to every cell, by the plane between two pivots."""
    rows = np.arange(len(dist))
    between = distances(pivots[home], pivots)
    apart = between > 0
    gaps = (dist**2 - dist[rows, home][:, None] ** 2) / (2.0 * np.where(apart, between, 1.0))
    return np.where(apart, gaps, 0.0)


def _reach_for(dist: np.ndarray, radii: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """A distance within which each vector surely has ``k`` others, from whole cells."""
    outer = np.where(counts[None, :] > 0, dist + radii[None, :], np.inf)
    order = outer.argsort(1)
    enough = counts[order].cumsum(1) >= k
    first = enough.argmax(1)
    rows = np.arange(len(dist))
    return np.where(enough.any(1), outer[rows, order[rows, first]], np.inf)


def visits(cells: Cells, rows: DataFrame, radius: float | None, earlier_only: bool = False, k: int = 1) -> DataFrame:
    """Copies ``(cell, id, vec, h)`` of the vectors for the foreign cells that their search ball may reach.

    The radius is a constant or the column ``radius``; where that is null it follows from the sizes of the
    cells. With ``earlier_only`` a vector visits only cells numbered below its own, so that of two cells
    one alone sees a straddling pair.
    """
    pivots, counts, radii = cells.pivots, cells.counts, cells.radii
    carried = ("id", "vec", "h")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = matrix(batch.column("vec"))
            home = batch.column("cell").to_numpy()
            if radius is not None:
                reach = np.full(len(vec), radius)
            else:
                reach = batch.column("radius").to_numpy(zero_copy_only=False).astype(float)
            for part in chunks(len(vec), 4 * len(pivots)):
                dist = distances(vec[part], pivots)
                near = reach[part].copy()
                unknown = np.isnan(near)
                if unknown.any():
                    near[unknown] = _reach_for(dist[unknown], radii, counts, k)
                bound = np.maximum(plane_gaps(dist, home[part], pivots), dist - radii[None, :])
                hit = (bound <= near[:, None] + EPS) & (counts[None, :] > 0)
                hit[np.arange(len(dist)), home[part]] = False
                if earlier_only:
                    hit &= np.arange(len(pivots))[None, :] < home[part][:, None]
                row, cell = np.nonzero(hit)
                for i in range(0, len(row), BLOCK):
                    taken = pa.array(row[i : i + BLOCK] + part.start)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell[i : i + BLOCK].astype(np.int32)), *(batch.column(c).take(taken) for c in carried)],
                        names=["cell", *carried],
                    )

    columns = ["id", "vec", "h", "cell", *(["radius"] if radius is None else [])]
    return rows.select(*columns).mapInArrow(expand, f"cell int, id {cells.id_type}, vec array<double>, h bigint")


def n_blocks(counts: np.ndarray) -> np.ndarray:
    """Blocks needed per cell."""
    return np.maximum(1, -(-counts // BLOCK)).astype(np.int64)


def spread(df: DataFrame, side: str, fan: Callable, carried: tuple[str, ...] = ()) -> DataFrame:
    """Copy each row to the block pairs it takes part in: ``(cell, qb, cb, id, vec, <carried>)``.

    ``fan`` maps cells and id hashes to the row's own block and the range of opposite blocks.
    """
    kept = ("id", "vec", *carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, low, high = fan(batch.column("cell").to_numpy(), batch.column("h").to_numpy())
            width = high - low
            ends = width.cumsum()
            total = int(ends[-1]) if len(ends) else 0
            for start in range(0, total, BLOCK):
                flat = np.arange(start, min(start + BLOCK, total))
                row = np.searchsorted(ends, flat, side="right")
                other = low[row] + flat - (ends[row] - width[row])
                qb, cb = (own[row], other) if side == "queries" else (other, own[row])
                taken = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("cell").take(taken),
                        pa.array(qb.astype(np.int32)),
                        pa.array(cb.astype(np.int32)),
                        *(batch.column(c).take(taken) for c in kept),
                    ],
                    names=["cell", "qb", "cb", *kept],
                )

    types = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in kept)
    return df.select("cell", "h", *kept).mapInArrow(run, f"cell int, qb int, cb int, {types}")


def cross_fan(own_blocks: np.ndarray, other_blocks: np.ndarray) -> Callable:
    """Every own block meets every opposite block of the cell."""

    def fan(cell: np.ndarray, h: np.ndarray):
        return h % own_blocks[cell], np.zeros(len(cell), dtype=np.int64), other_blocks[cell]

    return fan


def compare(queries: DataFrame, candidates: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    """Run ``kernel`` on every (cell, query block, candidate block); each side holds about a block at most."""
    keys = ("cell", "qb", "cb")
    candidates = candidates.toDF(*candidates.columns)
    return queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(kernel, schema)
