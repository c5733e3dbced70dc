"""Report tables: plot points, facets, hulls and communities."""

from __future__ import annotations

from functools import reduce

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmap.functions.records import first_engine
from corpusmap.functions.text import TOKEN_BUDGET, CHARS_PER_TOKEN, truncate_tokens, year_of
from corpusmap.operators.rank import largest_groups, sample_per_group, top_per_group

HULL_SALTS = 64


def plot_points(clusters: DataFrame) -> DataFrame:
    """Ten display columns per record, with defaults for metadata a record lacks."""

    def meta(key: str, default: str):
        return F.coalesce(F.try_element_at("metadata", F.lit(key)), F.lit(default))

    return clusters.select(
        "idx",
        "cluster_name",
        meta("title", "No Title").alias("title"),
        meta("url", "No URL").alias("url"),
        meta("description", "No Description").alias("description"),
        meta("author", "No Authors").alias("authors"),
        meta("keywords", "No Keywords").alias("keywords"),
        meta("origin", "No Origin").alias("origin"),
        year_of(meta("date_creation", "No Date")).alias("date_creation"),
        first_engine(F.try_element_at("metadata", F.lit("software_engines"))).alias("software_engine"),
    )


def title_search(points: DataFrame, text: str) -> DataFrame:
    """Points whose title contains a text, whatever the case."""
    return points.filter(F.contains(F.lower("title"), F.lower(F.lit(text))))


def facet_counts(points: DataFrame) -> DataFrame:
    """Points per year, engine and origin, in one pass: ``(facet, value, n)``."""
    facets = F.array(
        *[
            F.struct(F.lit(facet).alias("facet"), F.col(col).alias("value"))
            for facet, col in (("date", "date_creation"), ("software", "software_engine"), ("origin", "origin"))
        ]
    )
    return points.select(F.inline(facets)).groupBy("facet", "value").agg(F.count("*").alias("n"))


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise from the leftmost one."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def chain(ordered):
        corners: list = []
        for p in ordered:
            while len(corners) > 1:
                (ax, ay), (bx, by) = corners[-2], corners[-1]
                if (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax) > 0:
                    break
                corners.pop()
            corners.append(tuple(p))
        return corners[:-1]

    return np.array(chain(points) + chain(points[::-1]))


def cluster_hulls(points: DataFrame, key: str = "cluster") -> DataFrame:
    """Hull corners ``(cluster, corner, x, y)`` of each group of points.

    Each partition first reduces its points to partial hulls, then each group's hulls are merged in salted
    parts, so that the last step sees corners only.
    """
    kind = points.schema[key].dataType.simpleString()

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for value, part in frame.groupby(key, sort=False):
                hull = convex_hull(part[["x", "y"]].to_numpy())
                yield pd.DataFrame({key: value, "x": hull[:, 0], "y": hull[:, 1]})

    def merge(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        hull = convex_hull(frame[["x", "y"]].to_numpy())
        return pd.DataFrame({key: keys[0], "corner": range(len(hull)), "x": hull[:, 0], "y": hull[:, 1]})

    corners = points.select(key, "x", "y").mapInPandas(partial, f"{key} {kind}, x double, y double")
    salted = corners.withColumn("salt", F.pmod(F.xxhash64("x", "y"), F.lit(HULL_SALTS)).cast("int"))
    schema = f"{key} {kind}, corner int, x double, y double"
    merged = salted.groupBy(key, "salt").applyInPandas(merge, schema)
    return merged.groupBy(key).applyInPandas(merge, schema)


def cluster_titles(members: DataFrame, key: str = "cluster") -> DataFrame:
    """All titles of each group as rows ``(cluster, id, title)``, to be read in id order; nothing is cut or gathered."""
    return members.select(key, "id", F.coalesce(F.col("title"), F.lit("Unknown Title")).alias("title"))


def row_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """``(stage, n_rows)``: how many rows each named table holds."""
    counts = [df.agg(F.lit(name).alias("stage"), F.count("*").alias("n_rows")) for name, df in stages.items()]
    return reduce(DataFrame.unionByName, counts)


def joined_titles(members: DataFrame, key: str = "cluster", budget: int = TOKEN_BUDGET) -> DataFrame:
    """Titles per group joined with ", " in id order, up to a token budget: ``(cluster, titles)``.

    A title takes at least its separator, so the budget bounds how many titles of a crowded group matter;
    the rest never reach the task that joins them.
    """
    chars = CHARS_PER_TOKEN * budget
    titled = members.select(
        key, "id", F.substring(F.coalesce(F.col("title"), F.lit("Unknown Title")), 1, chars).alias("title")
    )
    kept = top_per_group(titled, key, [F.asc("id")], chars // 2 + 1, "nth")
    before = Window.partitionBy(key).orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("title") + 2).over(before), F.lit(0))
    fitting = kept.withColumn("start", start).filter(F.col("start") < chars + 2)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("nth", "title"))), lambda x: x["title"])
    return fitting.groupBy(key).agg(truncate_tokens(F.array_join(listed, ", "), budget).alias("titles"))


def sample_titles(communities: DataFrame, nodes: DataFrame, n: int = 10, top: int = 5, seed: int = 0) -> DataFrame:
    """Up to ``n`` random titles of each of the largest communities: ``(rank, label, id, line)``."""
    titled = _largest_members(communities, nodes, top)
    drawn = sample_per_group(titled, "label", n, seed)
    return drawn.select("rank", "label", "id", F.concat(F.lit("- "), _title()).alias("line"))


def community_report(communities: DataFrame, nodes: DataFrame, top: int = 5) -> DataFrame:
    """Report lines ``(rank, line_no, id, line)`` of the largest communities: a head, then one line per record.

    Lines stay rows, so a community of any size is written by many tasks.
    """
    largest = largest_groups(communities, "label", top)
    head = largest.select(
        "rank", F.lit(0).alias("line_no"), F.lit("").alias("id"),
        F.concat(F.lit("Cluster "), F.col("rank"), F.lit(" (Size: "), F.col("size"), F.lit(")")).alias("line"),
    )
    foot = largest.select("rank", F.lit(2).alias("line_no"), F.lit("").alias("id"), F.lit("").alias("line"))
    body = _largest_members(communities, nodes, top).select(
        "rank", F.lit(1).alias("line_no"), F.col("id").cast("string").alias("id"),
        F.concat(F.coalesce(F.col("id").cast("string"), F.lit("No ID")), F.lit(" - "), _title()).alias("line"),
    )
    return head.unionByName(body).unionByName(foot)


def _title():
    return F.coalesce("title", F.lit("No Title"))


def _largest_members(communities: DataFrame, nodes: DataFrame, top: int) -> DataFrame:
    # ``top`` rows at most.
    largest = F.broadcast(largest_groups(communities, "label", top).select("label", "rank"))
    return communities.join(largest, "label").join(nodes.select("id", "title"), "id", "left")
