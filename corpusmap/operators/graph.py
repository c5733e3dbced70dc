"""Similarity graphs, connected components and communities."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmap.functions.arrow import values
from corpusmap.operators.simjoin import SimilarBlocks, SimilarVectors, arrow_id_type, similar_vectors
from corpusmap.scratch import Tables

# Rounds of label propagation that must suffice; they grow slowly with the graph.
UNSETTLED = 1_000
# Links a task holds before it contracts them.
CONTRACT_ROWS = 1 << 20


def similarity_graph(vectors: DataFrame, threshold: float = 0.9, method: str = "exact") -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)``: every record with its other columns, and the edges above the threshold."""
    similar = similar_vectors(vectors, threshold, method=method)
    return vectors.drop("embedding"), similar.full_edges()


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, component)``, the component being the smallest id in it.

    Each task first contracts the links of its partition to stars. Alternating large-star and small-star
    rounds then link each node's neighbours to the smallest of them, until a round changes nothing. Minima are
    reduced map-side, no neighbourhood is ever gathered, and the rounds grow with the logarithm of the graph,
    whatever its diameter.
    """
    tables = Tables(edges.sparkSession, "components")
    links = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    current, state = tables.save_measured(_contract(links.filter(F.col("u") != F.col("v"))), "round0", **_checksum())
    i, settled = 0, not state["n"]
    # Every round that changes the links lowers some node's smallest neighbour, so the rounds come to an end.
    while not settled:
        i += 1
        # Saved between the steps: each joins its input with an aggregate of the same input.
        large = tables.save(_large_star(current), f"large{i}")
        small = tables.save(_small_star(large), f"small{i}")
        before = state
        current, state = tables.save_measured(_contract(small), f"round{i}", **_checksum())
        settled = state == before
        for name in (f"round{i - 1}", f"large{i}", f"small{i}"):
            tables.drop(name)
    roots = current.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return nodes.select("id").join(roots, "id", "left").select(
        "id", F.coalesce("component", "id").alias("component")
    )


def local_stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a partition as stars: every node with the smallest node it is connected to."""
    names, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(names))
    while True:
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            break
        low = np.minimum(ra, rb)
        np.minimum.at(root, ra, low)
        np.minimum.at(root, rb, low)
        while (root[root] != root).any():
            root = root[root]
    tied = np.nonzero(root != np.arange(len(names)))[0]
    return names[tied], names[root[tied]]


def _contract(links: DataFrame) -> DataFrame:
    """The same connections with fewer links, by contraction within each partition."""
    kind = links.schema["u"].dataType.simpleString()
    id_type = arrow_id_type(links, "u")

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            held.append((values(batch.column("u")), values(batch.column("v"))))
            size += batch.num_rows
            if size > CONTRACT_ROWS:
                held = [local_stars(*(np.concatenate(c) for c in zip(*held)))]
                size = len(held[0][0]) // 2
        if held:
            u, v = local_stars(*(np.concatenate(c) for c in zip(*held)))
            yield pa.RecordBatch.from_arrays([pa.array(u, id_type), pa.array(v, id_type)], names=["u", "v"])

    return links.mapInArrow(contract, f"u {kind}, v {kind}")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select("v", "u"))
    lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(lowest, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    lowest = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.filter(F.col("u") != F.col("v")).union(lowest.select("u", F.col("m").alias("v"))).distinct()


def _checksum() -> dict[str, Column]:
    return {"n": F.count("*"), "bits": F.bit_xor(F.xxhash64("u", "v"))}


def label_propagation(
    nodes: DataFrame, edges: DataFrame, max_iter: int | None = None, seed: int = 0, synchronous: bool = False
) -> DataFrame:
    """Communities ``(id, label)``: every node takes the label most frequent among its neighbours.

    Ties go to the smallest label. In every round a seeded bit of its id colours each node anew, and one
    colour moves after the other, so that no two neighbours swap labels for ever; ``synchronous`` moves all
    nodes at once. An optional node column ``votes`` is the number of equal records a node stands for. Rounds end when no
    label changes, or after ``max_iter`` if that is given; labels that never settle are an error.
    """
    tables = Tables(edges.sparkSession, "propagation")
    # Found and written once; turned round where they are read.
    both = both_ways(tables.save(edges.select("src", "dst"), "edges"))
    votes = F.col("votes") if "votes" in nodes.columns else F.lit(1)
    start = nodes.select("id", F.col("id").alias("label"), votes.cast("bigint").alias("votes"))
    labels = tables.save(start.withColumn("changed", F.lit(False)), "round0")
    changes = {"n": F.count_if("changed")}
    i = 0
    while max_iter is None or i < max_iter:
        i += 1
        if i > UNSETTLED:
            raise RuntimeError(f"labels still change after {UNSETTLED} rounds")
        moved = labels.withColumn("changed", F.lit(False))
        for turn in (None,) if synchronous else (0, 1):
            mine = F.lit(True) if turn is None else _colour(seed, i) == turn
            moved = _move(moved, both, mine)
            if turn == 0:
                moved = tables.save(moved, f"half{i}")
        labels, seen = tables.save_measured(moved, f"round{i}", **changes)
        tables.drop(f"round{i - 1}")
        if not seen["n"]:
            break
        tables.drop(f"half{i}")
        tables.release()
    return labels.select("id", "label")


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges ``(src, dst, ...)`` in both directions, from one reading of them."""
    others = [c for c in edges.columns if c not in ("src", "dst")]
    turns = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.select(F.explode(turns).alias("turn"), *others).select("turn.src", "turn.dst", *others)


def _colour(seed: int, i: int) -> Column:
    digest = F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}:{i}")))
    return (F.substring(digest, 1, 1) < "8").cast("int")


def _move(labels: DataFrame, both: DataFrame, mine: Column) -> DataFrame:
    heard = both.join(labels.select(F.col("id").alias("dst"), "label", "votes"), "dst").select(
        F.col("src").alias("id"), "label", "votes"
    )
    # The copies a node stands for vote for its own label.
    own = labels.filter("votes > 1").select("id", "label", (F.col("votes") - 1).alias("votes"))
    tally = heard.union(own).groupBy("id", "label").agg(F.sum("votes").alias("n"))
    best = tally.groupBy("id").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("best"))
    new = F.when(mine, F.coalesce("best", "label")).otherwise(F.col("label"))
    return labels.join(best, "id", "left").select(
        "id", new.alias("label"), "votes", (F.col("changed") | (new != F.col("label"))).alias("changed")
    )


def communities(similar: SimilarVectors | SimilarBlocks, max_iter: int | None = None, seed: int = 0) -> DataFrame:
    """Communities ``(id, label)`` of a similarity graph, found among its distinct vectors."""
    nodes = similar.groups.reps.select(F.col("rep").alias("id"), F.col("n_copies").alias("votes"))
    found = label_propagation(nodes, similar.pairs(), max_iter, seed)
    return similar.groups.members.join(found.withColumnRenamed("id", "rep"), "rep").select("id", "label")


def components_of(similar: SimilarVectors | SimilarBlocks) -> DataFrame:
    """Components ``(id, component)`` of a similarity graph, found among its distinct vectors."""
    nodes = similar.groups.reps.select(F.col("rep").alias("id"))
    found = connected_components(nodes, similar.links())
    return similar.groups.members.join(found.withColumnRenamed("id", "rep"), "rep").select("id", "component")


def with_all_nodes(
    similar: SimilarVectors | SimilarBlocks, ids: DataFrame
) -> SimilarVectors | SimilarBlocks:
    """Add records without a vector as isolated nodes."""
    groups = similar.groups
    lone = ids.select("id").join(groups.members, "id", "left_anti")
    members = groups.members.unionByName(lone.select("id", F.col("id").alias("rep")))
    reps = groups.reps.select("rep", "n_copies", "self_weight").unionByName(
        lone.select(F.col("id").alias("rep"), F.lit(1).cast("bigint").alias("n_copies"),
                    F.lit(None).cast("double").alias("self_weight"))
    )
    return replace(similar, groups=replace(groups, members=members, reps=reps))
