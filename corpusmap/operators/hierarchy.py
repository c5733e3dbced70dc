"""Density clusters of varying density, from a spanning tree of mutual reachability.

The spanning tree is exact: in every round each component finds its lightest edge to another one, through metric
cells. So is the hierarchy over it, which has a level for every edge weight: the tree is halved at median weights,
what the lighter half connects being vertices of the heavier one, until the parts are small enough for a task to merge
them in order. Equal points are one location with a mass.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmap.functions.arrow import matrix
from corpusmap.operators import cells as C
from corpusmap.operators.cells import BLOCK, EPS, chunks, distances, plane_gaps
from corpusmap.operators.copies import collapse
from corpusmap.operators.graph import connected_components
from corpusmap.operators.knn import knn
from corpusmap.operators.rank import with_position
from corpusmap.scratch import Tables

# Edges of a spanning tree that one task merges.
PROBLEM = 100_000


def hierarchical_labels(
    points: DataFrame, min_cluster_size: int = 5, min_samples: int | None = None
) -> DataFrame:
    """``(id, label)`` of points ``(id, x, y)``; the label is null for noise."""
    if min_cluster_size < 2:
        raise ValueError("min_cluster_size must be at least 2")
    samples = min_samples or min_cluster_size
    tables = Tables(points.sparkSession, "hierarchy")
    vec = F.array(F.col("x").cast("double"), F.col("y").cast("double"))
    named = with_position(points.select("id", vec.alias("vec")), "id", name="idx")
    named = tables.save(named, "points")
    indexed = named.select(F.col("idx").alias("id"), "vec")
    core = knn(indexed, samples).filter(F.col("rank") == samples).select("id", F.col("dist").alias("core"))
    groups = collapse(indexed, ["vec"], tables)
    # Without enough others a point has no core distance and stays noise.
    locations = tables.save(
        groups.reps.select(F.col("rep").alias("id"), "vec", F.col("n_copies").alias("mass")).join(core, "id"), "places"
    )
    if locations.count() < 2:
        return named.select("id", F.lit(None).cast("bigint").alias("label"))
    tree = spanning_tree(locations, tables)
    chosen = _extract(locations, tree, min_cluster_size, tables)
    by_place = groups.members.withColumnRenamed("id", "idx").join(chosen.withColumnRenamed("id", "rep"), "rep")
    return named.join(by_place.select("idx", "label"), "idx", "left").select("id", "label")


def spanning_tree(locations: DataFrame, tables: Tables) -> DataFrame:
    """Minimum spanning tree ``(a, b, w)`` of locations ``(id, vec, core)`` under mutual reachability."""
    cells = C.build_cells(locations.select("id", "vec"), tables, "cells")
    state = cells.homes.join(locations.select("id", "core"), "id").withColumn("comp", F.col("id"))
    state = tables.save(state.select("id", "vec", "h", "cell", "core", "comp"), "state0")
    parts: list[DataFrame] = []
    # Every round at least halves the parts.
    for i in count(1):
        picks = tables.save(_lightest_edges(state, cells, tables, i), f"picks{i}")
        if picks.isEmpty():
            break
        parts.append(picks.select("a", "b", "w"))
        comps = state.select(F.col("comp").alias("id")).distinct()
        links = picks.select(F.col("comp").alias("src"), F.col("other").alias("dst"))
        merged = connected_components(comps, links).select(F.col("id").alias("comp"), F.col("component").alias("to"))
        state = tables.save(
            state.join(merged, "comp").select("id", "vec", "h", "cell", "core", F.col("to").alias("comp")), f"state{i}"
        )
        tables.drop(f"state{i - 1}")
    tree = parts[0]
    for part in parts[1:]:
        tree = tree.unionByName(part)
    # Both ends of an edge may have picked it.
    return tables.save(tree.distinct(), "tree")


def _lightest_edges(state: DataFrame, cells: C.Cells, tables: Tables, i: int) -> DataFrame:
    """The lightest edge of each component to another: ``(comp, other, w, a, b)``, ties by ids."""
    n_cells = len(cells.counts)
    # Per cell: the only component in it, or -1 when there are several, and the largest core distance.
    only, widest = np.full(n_cells, -1, dtype=np.int64), np.zeros(n_cells)
    summary = state.groupBy("cell").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("core").alias("core")
    )
    for row in summary.collect():
        only[row["cell"]] = row["lo"] if row["lo"] == row["hi"] else -1
        widest[row["cell"]] = row["core"]
    if (only >= 0).all() and len(set(only[cells.counts > 0])) == 1:
        return state.select("comp", F.col("comp").alias("other"), F.col("core").alias("w"),
                            F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    pivots, counts, radii = cells.pivots, cells.counts, cells.radii

    def foreign(comp: np.ndarray) -> np.ndarray:
        return (counts > 0)[None, :] & (only[None, :] != comp[:, None])

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec, core, comp = matrix(batch.column("vec")), batch.column("core").to_numpy(), batch.column("comp").to_numpy()
            best = np.full(len(vec), np.inf)
            for part in chunks(len(vec), 3 * n_cells):
                far = distances(vec[part], pivots) + radii[None, :]
                far = np.maximum(far, np.maximum(core[part][:, None], widest[None, :]))
                best[part] = np.where(foreign(comp[part]), far, np.inf).min(1)
            names, where = np.unique(comp, return_inverse=True)
            least = np.full(len(names), np.inf)
            np.minimum.at(least, where, best)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(least)], names=["comp", "reach"])

    reach = state.select("vec", "core", "comp").mapInArrow(bound, "comp bigint, reach double")
    reach = reach.groupBy("comp").agg(F.min("reach").alias("reach"))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = ("id", "vec", "h", "core", "comp")
        for batch in batches:
            vec, core, comp = matrix(batch.column("vec")), batch.column("core").to_numpy(), batch.column("comp").to_numpy()
            home, limit = batch.column("cell").to_numpy(), batch.column("reach").to_numpy()
            for part in chunks(len(vec), 4 * n_cells):
                dist = distances(vec[part], pivots)
                near = np.maximum(plane_gaps(dist, home[part], pivots), dist - radii[None, :])
                near = np.maximum(near, core[part][:, None])
                row, cell = np.nonzero(foreign(comp[part]) & (near <= limit[part][:, None] + EPS))
                for k in range(0, len(row), BLOCK):
                    taken = pa.array(row[k : k + BLOCK] + part.start)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell[k : k + BLOCK].astype(np.int32)), *(batch.column(c).take(taken) for c in carried)],
                        names=["cell", *carried],
                    )

    schema = "cell int, id bigint, vec array<double>, h bigint, core double, comp bigint"
    guests = tables.save(state.join(reach, "comp").mapInArrow(visit, schema), f"guests{i}")
    mine, theirs = C.n_blocks(C.cell_counts(guests, n_cells)), C.n_blocks(counts)
    queries = C.spread(guests, "queries", C.cross_fan(mine, theirs), ("core", "comp"))
    hosts = C.spread(state, "candidates", C.cross_fan(theirs, mine), ("core", "comp"))
    found = C.compare(queries, hosts, _foreign_kernel, "comp bigint, other bigint, w double, a bigint, b bigint")
    best = found.groupBy("comp").agg(F.min(F.struct("w", "a", "b", "other")).alias("e"))
    tables.drop(f"guests{i - 1}")
    return best.select("comp", "e.other", "e.w", "e.a", "e.b")


def _foreign_kernel(left: pa.Table, right: pa.Table) -> pa.Table:
    """Per component of the left block, its lightest edge into other components of the right block."""
    names = ("comp", "other", "w", "a", "b")
    if not left.num_rows or not right.num_rows:
        return pa.table({c: pa.array([], pa.float64() if c == "w" else pa.int64()) for c in names})
    one, two = ({c: t.column(c).to_numpy() for c in ("id", "core", "comp")} for t in (left, right))
    va, vb = matrix(left.column("vec")), matrix(right.column("vec"))
    found = []
    for part in chunks(len(va), 3 * len(vb)):
        w = np.maximum(distances(va[part], vb), np.maximum(one["core"][part][:, None], two["core"][None, :]))
        w[one["comp"][part][:, None] == two["comp"][None, :]] = np.inf
        least = w.min(1)
        i, j = np.nonzero((w == least[:, None]) & np.isfinite(least)[:, None])
        ids, others = one["id"][part][i], two["id"][j]
        found.append((one["comp"][part][i], two["comp"][j], w[i, j], np.minimum(ids, others), np.maximum(ids, others)))
    comp, other, w, a, b = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((b, a, w, comp))
    first = order[np.unique(comp[order], return_index=True)[1]]
    return pa.table(dict(zip(names, (comp[first], other[first], w[first], a[first], b[first]))))


def _halved(edges: DataFrame, vertices: DataFrame, n: int, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Problems ``(problem, a, b, w, eid)`` and ``(problem, v, mass)`` of at most ``PROBLEM`` edges, or of one weight.

    A larger problem is cut at its median weight. What its lighter edges connect becomes a problem of its own and one
    vertex of the rest, so that each edge is in one problem, and all of a round's problems are cut at once. The vertex
    that stands for a problem has its number. Vertices from ``n`` on stand for problems.
    """
    for i in count():
        sizes = edges.groupBy("problem").agg(F.count("*").alias("m"), F.min("w").alias("low"), F.max("w").alias("high"))
        large = tables.save(sizes.filter((F.col("m") > PROBLEM) & (F.col("low") < F.col("high"))), f"large{i}")
        if large.isEmpty():
            return edges, vertices
        inside = edges.join(large, "problem")
        middle = inside.groupBy("problem").agg(
            F.percentile_approx("w", 0.5).alias("w"), F.max("high").alias("high"),
            F.max(F.when(F.col("w") < F.col("high"), F.col("w"))).alias("below"))
        pivots = tables.save(middle.select("problem", F.least("w", "below").alias("pivot")), f"pivots{i}")
        light = tables.save(inside.join(pivots, "problem").filter(F.col("w") <= F.col("pivot")).select(edges.columns), f"light{i}")
        ends = light.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        links = light.select(F.col("a").alias("src"), F.col("b").alias("dst"))
        # Numbers of this round follow all earlier ones.
        named = connected_components(ends, links).select(F.col("id").alias("v"), (F.col("component") + n * 2**i).alias("to"))
        named = tables.save(named, f"named{i}")
        moved = vertices.join(named, "v", "left")
        inner = moved.filter(F.col("to").isNotNull())
        rest = moved.filter(F.col("to").isNull()).select("problem", "v", "mass")
        outer = inner.groupBy("problem", "to").agg(F.sum("mass").alias("mass"))
        vertices = tables.save(
            rest.unionByName(inner.select(F.col("to").alias("problem"), "v", "mass"))
            .unionByName(outer.select("problem", F.col("to").alias("v"), "mass")), f"vertices{i}")
        lower = light.join(named.withColumnRenamed("v", "a"), "a").select(F.col("to").alias("problem"), "a", "b", "w", "eid")
        upper = edges.join(light.select("eid"), "eid", "left_anti")
        for end in ("a", "b"):
            upper = upper.join(named.withColumnRenamed("v", end), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        edges = tables.save(lower.unionByName(upper.select(lower.columns)), f"edges{i}")


MERGES = "problem bigint, item bigint, is_node boolean, w double, size bigint, parent bigint"


def _merge_kernel(edges: pa.Table, vertices: pa.Table) -> pa.Table:
    """The merges of one problem, edges of one weight at once: every vertex and merge with the merge above it."""
    a, b, w, eid = (edges.column(c).to_numpy() for c in ("a", "b", "w", "eid"))
    names, mass = vertices.column("v").to_numpy(), vertices.column("mass").to_numpy()
    order = np.argsort(names)
    names, size = names[order], mass[order].tolist()
    a, b = np.searchsorted(names, a).tolist(), np.searchsorted(names, b).tolist()
    root = list(range(len(names)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    # For each set its items without a parent yet.
    tops: list[list[int]] = [[k] for k in range(len(names))]
    items, weights, sizes = names.tolist(), [None] * len(names), list(size)
    parents: list[int | None] = [None] * len(names)
    rank = np.lexsort((eid, w)).tolist()
    k = 0
    while k < len(rank):
        weight, touched = w[rank[k]], {}
        while k < len(rank) and w[rank[k]] == weight:
            e = rank[k]
            x, y = find(a[e]), find(b[e])
            if len(tops[x]) < len(tops[y]):
                x, y = y, x
            root[y] = x
            tops[x] += tops[y]
            tops[y] = []
            size[x] += size[y]
            touched.pop(y, None)
            touched.setdefault(x, int(eid[e]))
            k += 1
        for x, first in touched.items():
            for t in tops[x]:
                parents[t] = -2 - first
            tops[x] = [len(items)]
            items.append(-2 - first)
            weights.append(float(weight))
            sizes.append(size[x])
            parents.append(None)
    problem = (edges if edges.num_rows else vertices).column("problem")[0].as_py()
    return pa.table({
        "problem": pa.array([problem] * len(items), pa.int64()), "item": pa.array(items, pa.int64()),
        "is_node": pa.array([i < -1 for i in items]), "w": pa.array(weights, pa.float64()),
        "size": pa.array(sizes, pa.int64()), "parent": pa.array(parents, pa.int64()),
    })


def merge_tree(locations: DataFrame, tree: DataFrame, tables: Tables) -> DataFrame:
    """``(item, is_node, w, size, parent)``: every merge of a spanning tree, each location, and the merge above it.

    Locations ``(id, mass, core)`` keep their ids, with their core distance as the weight; merges have negative numbers.
    """
    n = (locations.agg(F.max("id").alias("n")).first()["n"] or 0) + 1
    edges = tables.save(
        tree.select(F.lit(-1).cast("bigint").alias("problem"), "a", "b", "w", F.monotonically_increasing_id().alias("eid")), "edges")
    vertices = locations.select(F.lit(-1).cast("bigint").alias("problem"), F.col("id").alias("v"), "mass")
    edges, vertices = _halved(edges, vertices, n, tables)
    equal = edges.groupBy("problem").agg(F.count("*").alias("m"), F.min("eid").alias("eid"), F.min("w").alias("w"))
    equal = tables.save(equal.filter(F.col("m") > PROBLEM), "equal")
    small_edges = edges.join(equal.select("problem"), "problem", "left_anti")
    small_vertices = vertices.join(equal.select("problem"), "problem", "left_anti")
    merges = small_edges.groupBy("problem").cogroup(small_vertices.groupBy("problem")).applyInArrow(_merge_kernel, MERGES)
    # A large problem of one weight is one merge of all its vertices.
    node = (-2 - F.col("eid")).alias("parent")
    wide = vertices.join(equal, "problem").select(
        "problem", F.col("v").alias("item"), F.lit(False).alias("is_node"), F.lit(None).cast("double").alias("w"),
        F.col("mass").alias("size"), node)
    tops = wide.groupBy("problem", F.col("parent").alias("item")).agg(F.sum("size").alias("size")).join(
        equal.select("problem", "w"), "problem")
    tops = tops.select("problem", "item", F.lit(True).alias("is_node"), "w", "size", F.lit(None).cast("bigint").alias("parent"))
    merges = tables.save(merges.unionByName(wide).unionByName(tops), "merges")
    # The last merge of a problem goes on where the vertex that stands for it does.
    stands = merges.filter(~F.col("is_node") & (F.col("item") >= n)).select(F.col("item").alias("problem"), F.col("parent").alias("above"))
    nodes = merges.filter("is_node").join(stands, "problem", "left").withColumn(
        "parent", F.when(F.col("parent").isNull(), F.col("above")).otherwise(F.col("parent")))
    leaves = merges.filter(~F.col("is_node") & (F.col("item") < n)).drop("w").join(
        locations.select(F.col("id").alias("item"), F.col("core").alias("w")), "item")
    columns = ["item", "is_node", "w", "size", "parent"]
    return tables.save(nodes.select(columns).unionByName(leaves.select(columns)), "merge_tree")


def _ends(links: DataFrame, tables: Tables, name: str) -> DataFrame:
    """``(item, up)`` with every ``up`` replaced by the end of its chain, doubling the stride until nothing moves."""
    links, seen = tables.save_measured(links, f"{name}0", n=F.count("*"))
    for i in count(1):
        ends = links.select(F.col("item").alias("up"), F.col("up").alias("further"))
        moved = links.join(ends, "up").select("item", F.col("further").alias("up"), (F.col("further") != F.col("up")).alias("moved"))
        links, seen = tables.save_measured(moved, f"{name}{i}", n=F.count_if(F.col("moved")))
        links = links.drop("moved")
        if not seen["n"]:
            return links


def _extract(locations: DataFrame, tree: DataFrame, smallest: int, tables: Tables) -> DataFrame:
    """``(id, label)`` of the locations in the most stable clusters.

    A cluster follows its component from merge to merge down the tree, losing parts below the smallest size, until it splits
    in two or more parts of that size. Its stability is the mass times the span of inverse distance over which it stays.
    """
    items = merge_tree(locations, tree, tables)
    large = items.filter(F.col("size") >= smallest)
    forks = large.groupBy("parent").agg(F.count("*").alias("parts"))
    heights = items.filter("is_node").select(F.col("item").alias("parent"), F.col("w").alias("top"))
    large = large.join(forks, "parent", "left").join(heights, "parent", "left")
    born = F.col("parent").isNull() | (F.col("parts") > 1)
    links = large.select("item", "parent", "w", "size", "top", F.when(born, F.col("item")).otherwise(F.col("parent")).alias("up"))
    links = tables.save(links, "large_items")
    owners = _ends(links.select("item", "up"), tables, "owners")

    def inverse(c: str) -> Column:
        return 1.0 / F.greatest(F.col(c), F.lit(1e-12))

    span = inverse("w") - F.coalesce(inverse("top"), F.lit(0.0))
    stable = links.drop("up").join(owners, "item").groupBy(F.col("up").alias("cluster")).agg(
        F.sum(F.col("size") * span).alias("stability"))
    above = owners.select(F.col("item").alias("parent"), F.col("up").alias("owner"))
    clusters = links.filter("item = up").join(above, "parent", "left").select(F.col("item").alias("cluster"), F.col("owner").alias("parent"))
    clusters = tables.save(clusters.join(stable, "cluster"), "clusters")
    chosen = _chosen(clusters, tables)
    # A location is part of the lowest large item above it, past the small ones.
    small = items.filter(F.col("size") < smallest)
    lowest = _ends(
        small.select("item", F.coalesce("parent", "item").alias("up"))
        .unionByName(links.select("item", F.col("item").alias("up"))), tables, "lowest")
    placed = lowest.filter("item >= 0").join(owners.select(F.col("item").alias("up"), F.col("up").alias("cluster")), "up")
    return placed.join(chosen, "cluster").select(F.col("item").alias("id"), "label")


def _best_kernel(clusters: pa.Table) -> pa.Table:
    """Clusters with the outermost selected one above them or themselves; the whole set is never selected."""
    names, parents, stability = (clusters.column(c).to_pylist() for c in ("cluster", "parent", "stability"))
    at = {c: k for k, c in enumerate(names)}
    above = [None if p is None else at[p] for p in parents]
    below, left = [0.0] * len(names), [0] * len(names)
    for p in above:
        if p is not None:
            left[p] += 1
    ready = sorted((k for k in range(len(names)) if not left[k]), key=names.__getitem__)
    done = []
    while ready:
        k = ready.pop()
        done.append(k)
        if above[k] is not None:
            below[above[k]] += max(stability[k], below[k])
            left[above[k]] -= 1
            if not left[above[k]]:
                ready.append(above[k])
    label: list[int | None] = [None] * len(names)
    for k in reversed(done):
        p = above[k]
        if p is not None:
            own = names[k] if stability[k] >= below[k] else None
            label[k] = own if label[p] is None else label[p]
    return pa.table({"cluster": pa.array(names, pa.int64()), "label": pa.array(label, pa.int64())})


def _chosen(clusters: DataFrame, tables: Tables) -> DataFrame:
    """``(cluster, label)``: for each cluster the outermost one above it, or itself, that is more stable than what lies below.

    Up to ``PROBLEM`` clusters are one task; more are taken in rounds from the leaves up.
    """
    if clusters.count() <= PROBLEM:
        one = clusters.withColumn("all", F.lit(0)).groupBy("all")
        return tables.save(one.applyInArrow(lambda t: _best_kernel(t), "cluster bigint, label bigint").filter("label IS NOT NULL"), "chosen")
    left = tables.save(clusters.withColumn("below", F.lit(0.0)), "left0")
    done: list[DataFrame] = []
    for i in count(1):
        inner = left.select(F.col("parent").alias("cluster")).distinct()
        leaves = tables.save(left.join(inner, "cluster", "left_anti"), f"leaves{i}")
        own = F.col("parent").isNotNull() & (F.col("stability") >= F.col("below"))
        done.append(leaves.select("cluster", "parent", own.alias("selected")))
        sums = leaves.groupBy(F.col("parent").alias("cluster")).agg(F.sum(F.greatest("stability", "below")).alias("more"))
        left = left.join(inner, "cluster", "left_semi").join(sums, "cluster", "left").withColumn(
            "below", F.col("below") + F.coalesce("more", F.lit(0.0))).drop("more")
        left = tables.save(left, f"left{i}")
        if left.isEmpty():
            break
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    # The outermost selected one: doubling steps keep the highest met so far.
    state = tables.save(found.select(
        "cluster", F.col("parent").alias("up"), F.when(F.col("selected"), F.col("cluster")).alias("label")), "outer0")
    for i in count(1):
        ahead = state.select(F.col("cluster").alias("up"), F.col("up").alias("further"), F.col("label").alias("higher"))
        state, seen = tables.save_measured(
            state.join(ahead, "up", "left").select(
                "cluster", F.col("further").alias("up"), F.coalesce("higher", "label").alias("label")),
            f"outer{i}", n=F.count("up"))
        if not seen["n"]:
            return state.filter("label IS NOT NULL").select("cluster", "label")
