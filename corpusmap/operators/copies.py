"""Equal vectors as one: a crowd of copies is compared once, and its pairs are spelled out only on request."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmap.operators.cells import BLOCK
from corpusmap.scratch import Tables


@dataclass
class Groups:
    """``members(id, rep)`` and ``reps(rep, n_copies, <payload>)``; ``rep`` is the smallest id of its copies."""

    members: DataFrame
    reps: DataFrame
    has_copies: bool


def collapse(df: DataFrame, payload: list[str], tables: Tables) -> Groups:
    """Group the rows ``(id, <payload>)`` by equal payload; copies are reduced before the shuffle.

    Ids find their representatives by a digest of 128 bits, so that payloads are shuffled once. Only where a digest is that of
    several payloads, as where null elements move, the payloads themselves are joined.
    """
    grouped = df.groupBy(*payload).agg(F.min("id").alias("rep"), F.count("*").alias("n_copies"))
    reps, total = tables.save_measured(grouped, "reps", n=F.coalesce(F.sum("n_copies"), F.lit(0)), m=F.count("*"))
    # The shuffle files of the payloads, which the table replaces.
    tables.release()
    if total["n"] == total["m"]:
        return Groups(reps.select(F.col("rep").alias("id"), "rep"), reps, False)
    digest = [F.xxhash64(F.lit(k), *payload).alias(f"digest{k}") for k in range(2)]
    keys = [f"digest{k}" for k in range(2)]
    marked = reps.select("rep", *digest)
    if marked.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        members = df.select("id", *digest).join(marked, keys).select("id", "rep")
    else:
        same = reduce(Column.__and__, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in payload])
        members = df.alias("a").join(reps.select("rep", *payload).alias("b"), same).select("a.id", "b.rep")
    return Groups(tables.save(members, "members"), reps, True)


def blocked_pairs(rows: DataFrame, group: str, count: str) -> DataFrame:
    """Pairs ``(src, dst)``, ``src < dst``, of the ids of each group, in tasks of bounded size.

    A group of n rows is cut into n / BLOCK blocks, and every pair of blocks is a join key of its own.
    """
    blocked = rows.withColumn("n", F.ceil(F.col(count) / BLOCK).cast("int")).withColumn(
        "b", F.pmod(F.xxhash64("id"), F.col("n")).cast("int")
    )
    left = blocked.select(
        F.col(group).alias("g"), F.col("id").alias("l"), F.col("b").alias("lb"),
        F.explode(F.sequence(F.col("b"), F.col("n") - 1)).alias("rb"),
    )
    right = blocked.select(
        F.col(group).alias("g"), F.col("id").alias("r"), F.explode(F.sequence(F.lit(0), F.col("b"))).alias("lb"),
        F.col("b").alias("rb"),
    )
    met = left.join(right, ["g", "lb", "rb"]).filter((F.col("lb") < F.col("rb")) | (F.col("l") < F.col("r")))
    return met.select("g", F.least("l", "r").alias("src"), F.greatest("l", "r").alias("dst"))


def expand_edges(edges: DataFrame, groups: Groups) -> DataFrame:
    """Edges between representatives as edges between all their copies, and the edges among copies.

    The output is as large as the graph itself; counts, components and communities need only the groups.
    """
    if not groups.has_copies:
        return edges
    a = groups.members.select(F.col("rep").alias("src"), F.col("id").alias("a"))
    b = groups.members.select(F.col("rep").alias("dst"), F.col("id").alias("b"))
    between = (
        edges.join(a, "src")
        .join(b, "dst")
        .select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "weight")
    )
    crowds = groups.reps.filter("n_copies > 1 AND self_weight IS NOT NULL").select("rep", "n_copies", "self_weight")
    pairs = blocked_pairs(groups.members.join(crowds, "rep").select("id", "rep", "n_copies"), "rep", "n_copies")
    within = pairs.join(crowds.select(F.col("rep").alias("g"), "self_weight"), "g").select(
        "src", "dst", F.col("self_weight").alias("weight")
    )
    return between.unionByName(within)


def count_edges(edges: DataFrame, groups: Groups) -> DataFrame:
    """Nodes and edges of the expanded graph ``(n_nodes, n_edges)``, without expanding it."""
    size = groups.reps.select("rep", "n_copies")
    between = (
        edges.join(size.select(F.col("rep").alias("src"), F.col("n_copies").alias("ns")), "src")
        .join(size.select(F.col("rep").alias("dst"), F.col("n_copies").alias("nd")), "dst")
        .select(F.lit(0).cast("bigint").alias("nodes"), (F.col("ns") * F.col("nd")).alias("edges"))
    )
    crowd = F.col("n_copies") * (F.col("n_copies") - 1) / 2
    within = groups.reps.select(
        F.col("n_copies").alias("nodes"),
        F.when(F.col("self_weight").isNotNull(), crowd.cast("bigint")).otherwise(0).alias("edges"),
    )
    return between.unionByName(within).agg(F.sum("nodes").alias("n_nodes"), F.sum("edges").alias("n_edges"))
