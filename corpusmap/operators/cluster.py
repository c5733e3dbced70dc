"""Clusters of points in the plane."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmap.operators.graph import connected_components
from corpusmap.operators.knn import knn_join
from corpusmap.operators.rank import with_position
from corpusmap.scratch import Tables

BOXES = 8
_NEIGHBOURHOOD = [(dx, dy) for dx in range(-2, 3) for dy in range(-2, 3)]


def nn_label(points: DataFrame, k: int = 10) -> DataFrame:
    """Each point labelled by its nearest other point: ``(id, label)``."""
    return knn_join(points, k).filter(F.col("rank") == 1).select("id", F.col("neighbor").alias("label"))


def knn_components(points: DataFrame, k: int = 10) -> DataFrame:
    """Clusters ``(id, label)``: points linked through nearest neighbours."""
    nearest = nn_label(points, k)
    edges = nearest.select(F.col("id").alias("src"), F.col("label").alias("dst"))
    return connected_components(points, edges).withColumnRenamed("component", "label")


def cluster_numbers(labels: DataFrame) -> DataFrame:
    """Labels as numbers from 0 in label order, null as -1: ``(id, cluster)``."""
    numbers = with_position(labels.filter("label IS NOT NULL").select("label").distinct(), "label", name="cluster")
    return labels.join(numbers, "label", "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def _near(a: str, b: str, eps: float) -> Column:
    dx, dy = F.col(f"{a}x") - F.col(f"{b}x"), F.col(f"{a}y") - F.col(f"{b}y")
    return F.sqrt(dx * dx + dy * dy) <= eps


def _offsets(pairs: list[tuple[int, int]]) -> Column:
    return F.inline(F.array(*[F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x, y in pairs]))


def dbscan(points: DataFrame, eps: float, min_pts: int = 5) -> DataFrame:
    """Fixed-radius density clusters ``(id, label)``; the label is the smallest core id, null for noise.

    The plane is cut into squares whose diagonal is ``eps``. A square with ``min_pts`` points holds core
    points only, which all belong together; so points of a crowded square are never paired with each other.
    Only points of sparse squares, fewer than ``min_pts`` each, count their neighbours. Squares are linked
    through the bounding boxes of at most 64 parts each; points are compared only for links that boxes leave
    open. A border point takes the smallest label within reach. A point counts among its own neighbours.
    """
    if eps <= 0:
        raise ValueError("eps must be positive")
    tables = Tables(points.sparkSession, "dbscan")
    side = eps / math.sqrt(2.0) * (1.0 - 1e-9)
    placed = points.select(
        "id",
        F.col("x").cast("double").alias("x"),
        F.col("y").cast("double").alias("y"),
        F.floor(F.col("x") / side).alias("cx"),
        F.floor(F.col("y") / side).alias("cy"),
    )
    placed = tables.save(placed, "points")
    squares = placed.groupBy("cx", "cy").agg(F.count("*").alias("n"))
    sized = placed.join(squares, ["cx", "cy"])
    sparse = sized.filter(F.col("n") < min_pts)
    around = [o for o in _NEIGHBOURHOOD if o != (0, 0)]
    counted = (
        _reach(sparse, placed, around, eps)
        .groupBy("aid")
        .agg(F.count("*").alias("near"))
        .withColumnRenamed("aid", "id")
    )
    is_core = (F.col("n") >= min_pts) | (F.col("n") + F.coalesce("near", F.lit(0)) >= min_pts)
    flagged = tables.save(
        sized.join(counted, "id", "left").select("id", "x", "y", "cx", "cy", is_core.alias("core")), "flagged"
    )
    core = flagged.filter("core").drop("core")
    # A square is named by its smallest core id, so the smallest name of a component is its label.
    names = tables.save(core.groupBy("cx", "cy").agg(F.min("id").alias("square")), "squares")
    links = _square_links(core, eps, side, tables)
    ends = links.join(names.withColumnRenamed("square", "src"), ["cx", "cy"]).join(
        names.select(F.col("cx").alias("ox"), F.col("cy").alias("oy"), F.col("square").alias("dst")), ["ox", "oy"]
    )
    joined = connected_components(names.select(F.col("square").alias("id")), ends.select("src", "dst"))
    squares = tables.save(
        names.join(joined.select(F.col("id").alias("square"), F.col("component").alias("label")), "square")
        .select("cx", "cy", "label"), "labels",
    )
    labelled = core.join(squares, ["cx", "cy"])
    other = flagged.filter("NOT core")
    # Fewer than min_pts such points per square look around.
    border = (
        _reach(other, labelled, _NEIGHBOURHOOD, eps, "label").groupBy("aid").agg(F.min("label").alias("label"))
    )
    rest = other.join(border.withColumnRenamed("aid", "id"), "id", "left").select("id", "label")
    return labelled.select("id", "label").unionByName(rest)


def _reach(asking: DataFrame, points: DataFrame, offsets, eps: float, *carried: str) -> DataFrame:
    """Points within reach of the asking ones, by an equi-join on squares: ``(aid, <carried>)``."""
    a = asking.select(
        F.col("id").alias("aid"), F.col("x").alias("ax"), F.col("y").alias("ay"), "cx", "cy", _offsets(offsets)
    ).select("aid", "ax", "ay", (F.col("cx") + F.col("dx")).alias("tx"), (F.col("cy") + F.col("dy")).alias("ty"))
    b = points.select(
        F.col("x").alias("bx"), F.col("y").alias("by"), F.col("cx").alias("tx"), F.col("cy").alias("ty"), *carried
    )
    return a.join(b, ["tx", "ty"]).filter(_near("a", "b", eps)).select("aid", *carried)


def _square_links(core: DataFrame, eps: float, side: float, tables: Tables) -> DataFrame:
    """Pairs of squares ``(cx, cy, ox, oy)`` that hold core points within reach of each other."""
    step = side / BOXES
    boxed = core.select(
        "x", "y", "cx", "cy", F.floor(F.col("x") / step).alias("bx"), F.floor(F.col("y") / step).alias("by")
    )
    boxes = tables.save(
        boxed.groupBy("cx", "cy", "bx", "by").agg(
            F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
        ),
        "boxes",
    )
    later = [o for o in _NEIGHBOURHOOD if o > (0, 0)]
    a = boxes.select("*", _offsets(later)).select(
        "cx", "cy", "bx", "by", "x0", "x1", "y0", "y1",
        (F.col("cx") + F.col("dx")).alias("ox"), (F.col("cy") + F.col("dy")).alias("oy"),
    )
    b = boxes.select(
        F.col("cx").alias("ox"), F.col("cy").alias("oy"), F.col("bx").alias("obx"), F.col("by").alias("oby"),
        F.col("x0").alias("u0"), F.col("x1").alias("u1"), F.col("y0").alias("v0"), F.col("y1").alias("v1"),
    )
    zero = F.lit(0.0)
    gap_x = F.greatest(F.col("u0") - F.col("x1"), F.col("x0") - F.col("u1"), zero)
    gap_y = F.greatest(F.col("v0") - F.col("y1"), F.col("y0") - F.col("v1"), zero)
    far_x = F.greatest(F.col("u1") - F.col("x0"), F.col("x1") - F.col("u0"))
    far_y = F.greatest(F.col("v1") - F.col("y0"), F.col("y1") - F.col("v0"))
    pairs = (
        a.join(b, ["ox", "oy"])
        .withColumn("near", F.sqrt(gap_x * gap_x + gap_y * gap_y))
        .filter(F.col("near") <= eps * (1 + 1e-9))
        .withColumn("sure", F.sqrt(far_x * far_x + far_y * far_y) <= eps)
        .select("cx", "cy", "ox", "oy", "bx", "by", "obx", "oby", "sure")
    )
    pairs = tables.save(pairs, "boxpairs")
    keys = ["cx", "cy", "ox", "oy"]
    linked = pairs.filter("sure").select(*keys).distinct()
    open_pairs = pairs.filter("NOT sure").join(linked, keys, "left_anti")
    spots = boxed.distinct()
    left = spots.select("cx", "cy", "bx", "by", F.col("x").alias("px"), F.col("y").alias("py"))
    right = spots.select(
        F.col("cx").alias("ox"), F.col("cy").alias("oy"), F.col("bx").alias("obx"), F.col("by").alias("oby"),
        F.col("x").alias("qx"), F.col("y").alias("qy"),
    )
    met = open_pairs.join(left, ["cx", "cy", "bx", "by"]).join(right, ["ox", "oy", "obx", "oby"])
    return linked.unionByName(met.filter(_near("p", "q", eps)).select(*keys).distinct())


def hdbscan(points: DataFrame, min_cluster_size: int = 5, min_samples: int | None = None) -> DataFrame:
    """Density clusters ``(id, cluster)`` of points ``(id, x, y)``, noise -1; see ``operators.hierarchy``."""
    from corpusmap.operators.hierarchy import hierarchical_labels

    return cluster_numbers(hierarchical_labels(points, min_cluster_size, min_samples))
