"""Joins and searches against brute force, with blocks and cells of a few rows."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmap.operators import graph, knn, lsh, search, simjoin
from corpusmap.plans import queries


@pytest.fixture(scope="module")
def cloud():
    """Clustered vectors with a crowd of equal ones that holds a third of all rows, and a zero vector."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((6, 12))
    near = centres[rng.integers(0, 6, 119)] + 0.25 * rng.standard_normal((119, 12))
    crowd = np.tile(centres[0] + 0.1, (60, 1))
    return np.concatenate([near, crowd, np.zeros((1, 12))])


@pytest.fixture
def vectors(spark, cloud):
    rows = [(f"{i:04d}", [float(x) for x in v]) for i, v in enumerate(cloud)]
    return spark.createDataFrame(rows, "id string, embedding array<double>").repartition(3)


def cosines(cloud):
    norm = np.linalg.norm(cloud, axis=1, keepdims=True)
    unit = cloud / np.where(norm > 0, norm, 1.0)
    return unit @ unit.T


def pairs_above(cloud, t):
    i, j = np.nonzero(np.triu(cosines(cloud) > t, 1))
    return {(f"{a:04d}", f"{b:04d}") for a, b in zip(i, j)}


@pytest.mark.parametrize("threshold", [0.3, 0.9])
def test_exact_join_equals_brute_force(vectors, cloud, small_cells, threshold):
    similar = simjoin.similar_vectors(vectors, threshold)
    edges = [(r.src, r.dst) for r in similar.full_edges().collect()]
    want = pairs_above(cloud, threshold)
    assert len(edges) == len(set(edges)) and set(edges) == want
    counts = similar.counts().first()
    assert (counts.n_nodes, counts.n_edges) == (len(cloud), len(want))


def test_lsh_join_finds_most_pairs_and_no_wrong_ones(vectors, cloud, small_cells):
    got = {(r.src, r.dst) for r in simjoin.similarity_join(vectors, 0.9, method="lsh").collect()}
    want = pairs_above(cloud, 0.9)
    assert got <= want and len(got) >= 0.9 * len(want)


def test_lsh_join_copies_few_bands_at_once_and_finds_the_same(vectors, cloud, small_cells, monkeypatch):
    """One band at a time, cells in blocks: the same pairs, each once, with their cosines, and no more copies than vectors."""
    at_once = simjoin.similarity_join(vectors, 0.9, method="lsh").collect()
    sims = cosines(cloud)
    assert len(at_once) == len({(r.src, r.dst) for r in at_once})
    assert all(abs(r.weight - sims[int(r.src), int(r.dst)]) < 1e-9 for r in at_once)
    placed = []
    cells = lsh.hash_cells

    def counted(df, dim, bits, bands, seed=0, some=None):
        placed.append(len(some or ()))
        return cells(df, dim, bits, bands, seed, some)

    monkeypatch.setattr(lsh, "hash_cells", counted)
    monkeypatch.setattr(lsh, "COPIED", 1)
    monkeypatch.setattr(lsh, "plan_bands", lambda *_: (4, 6))
    monkeypatch.setattr(lsh.C, "BLOCK", 8)
    split = {(r.src, r.dst) for r in simjoin.similarity_join(vectors, 0.9, method="lsh").collect()}
    assert placed == [0] + [1] * 6
    monkeypatch.setattr(lsh, "COPIED", 1 << 30)
    monkeypatch.setattr(lsh.C, "BLOCK", 2048)
    assert split == {(r.src, r.dst) for r in simjoin.similarity_join(vectors, 0.9, method="lsh").collect()}


@pytest.mark.parametrize("threshold", [0.4, 0.8])
def test_sparse_join_equals_brute_force(spark, small_cells, threshold):
    rng = np.random.default_rng(2)
    dense = np.where(rng.random((90, 40)) < 0.15, rng.random((90, 40)), 0.0)
    dense[30:60] = dense[0]
    dense[61] = dense[60] * 0.999 + 0.001 * dense[62]
    norm = np.linalg.norm(dense, axis=1, keepdims=True)
    unit = dense / np.where(norm > 0, norm, 1.0)
    rows = [(f"{i:03d}", [int(k) for k in np.nonzero(v)[0]], [float(x) for x in v[v > 0]]) for i, v in enumerate(unit)]
    df = spark.createDataFrame(rows, "id string, indices array<int>, weights array<double>")
    got = {(r.src, r.dst): r.weight for r in simjoin.sparse_similarity_join(df, threshold).collect()}
    sims = unit @ unit.T
    i, j = np.nonzero(np.triu(sims > threshold, 1))
    assert set(got) == {(f"{a:03d}", f"{b:03d}") for a, b in zip(i, j)}
    assert all(abs(w - sims[int(a), int(b)]) < 1e-9 for (a, b), w in got.items())


@pytest.mark.parametrize("dims", [2, 12])
def test_nearest_neighbours_equal_brute_force(spark, cloud, small_cells, dims):
    data = cloud[:, :dims]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    points = spark.createDataFrame(rows, "id bigint, vec array<double>")
    got = {}
    for r in knn.knn(points, 7).collect():
        got.setdefault(r.id, {})[r.rank] = (r.neighbor, r.dist)
    dist = np.sqrt(((data[:, None] - data[None]) ** 2).sum(-1))
    for i in range(len(data)):
        others = [j for j in range(len(data)) if j != i]
        order = sorted(others, key=lambda j: (round(dist[i, j], 9), j))[:7]
        assert [round(got[i][r][1], 6) for r in range(1, 8)] == [round(dist[i, j], 6) for j in order]
        if dims == 12:
            assert [got[i][r][0] for r in range(1, 8)] == order


def test_search_scan_and_cells_agree(vectors, cloud, small_cells, monkeypatch):
    queries = vectors.withColumnRenamed("id", "query_id")
    scan = {(r.query_id, r.rank): r.id for r in search.search(queries, vectors, 5).collect()}
    monkeypatch.setattr(search, "QUERY_BYTES", 0)
    cells = {(r.query_id, r.rank): r.id for r in search.search(queries, vectors, 5).collect()}
    assert scan == cells and len(scan) == 5 * len(cloud)
    sims = np.round(cosines(cloud), 9)
    for i in range(len(cloud)):
        order = sorted(range(len(cloud)), key=lambda j: (-sims[i, j], j))[:5]
        assert [scan[f"{i:04d}", r] for r in range(1, 6)] == [f"{j:04d}" for j in order]


def test_lsh_search_finds_most_close_vectors(vectors, cloud, small_cells):
    queries = vectors.withColumnRenamed("id", "query_id")
    got = {(r.query_id, r.rank): r for r in search.search(queries, vectors, 3, "lsh").collect()}
    sims = np.round(cosines(cloud), 9)
    assert all(abs(r.similarity - sims[int(q), int(r.id)]) < 1e-6 for (q, _), r in got.items())
    third = {q: r.similarity for (q, place), r in got.items() if place == 3}
    near = sum(abs(third.get(f"{i:04d}", -2.0) - np.sort(sims[i])[-3]) < 1e-6 for i in range(len(cloud) - 1))
    assert near >= 0.9 * (len(cloud) - 1)


def test_communities_partition_the_records(vectors, cloud):
    similar = simjoin.similar_vectors(vectors, 0.9)
    labels = {r.id: r.label for r in graph.communities(similar).collect()}
    parts = {r.id: r.component for r in graph.components_of(similar).collect()}
    assert len(labels) == len(parts) == len(cloud)
    # No community crosses a component, and copies stay together.
    assert len({(labels[i], parts[i]) for i in labels}) == len(set(labels.values()))
    assert len({labels[f"{i:04d}"] for i in range(119, 179)}) == 1


def test_components_do_not_depend_on_names(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)]
    rng = np.random.default_rng(0)
    ids = sorted({x for link in links for x in link} | {500})
    names = dict(zip(ids, (int(x) for x in rng.permutation(len(ids)))))
    nodes = spark.createDataFrame([(names[i],) for i in ids], "id bigint")
    edges = spark.createDataFrame([(names[a], names[b]) for a, b in links], "src bigint, dst bigint")
    got = {r.id: r.component for r in graph.connected_components(nodes, edges).collect()}
    for group in (range(61), [100 + i for i in range(40)], [500]):
        members = [names[i] for i in group]
        assert {got[m] for m in members} == {min(members)}


def test_joins_plan_no_cross_products(vectors):
    rows = vectors.select("id", F.expr("array(1, 2)").alias("indices"), F.expr("array(0.6D, 0.8D)").alias("weights"))
    postings = simjoin._prefix_postings(rows, 0.5)
    plan = simjoin._candidates(postings, 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_near_ties_rank_alike_on_both_search_paths(spark, small_cells, monkeypatch):
    """Forty vectors whose cosines round to the same number are told apart by id, on either path."""
    rows = [(f"{i:03d}", [1.0, 1e-6 * ((i * 7) % 40), 0.0, 0.0, 0.0]) for i in range(40)]
    vectors = spark.createDataFrame(rows, "id string, embedding array<double>").repartition(3)
    queries = vectors.filter("id < '004'").withColumnRenamed("id", "query_id")

    def found():
        return {(r.query_id, r.rank): r.id for r in search.search(queries, vectors, 5).collect()}

    scan = found()
    monkeypatch.setattr(search, "QUERY_BYTES", 0)
    assert found() == scan
    sims = np.round(cosines(np.array([v for _, v in rows])), 9)
    for q in range(4):
        order = sorted(range(40), key=lambda j: (-sims[q, j], j))[:5]
        assert [scan[f"{q:03d}", r] for r in range(1, 6)] == [f"{j:03d}" for j in order]


def test_a_null_vector_stays_a_member_beside_copies(spark):
    from corpusmap.operators.copies import collapse
    from corpusmap.scratch import Tables

    rows = spark.createDataFrame([("a", [1.0]), ("b", [1.0]), ("c", None)], "id string, vec array<double>")
    groups = collapse(rows, ["vec"], Tables(spark, "test"))
    assert {(r.id, r.rep) for r in groups.members.collect()} == {("a", "a"), ("b", "a"), ("c", "c")}


def test_copies_find_their_representative_without_shuffling_payloads_again(spark, monkeypatch):
    from corpusmap.operators.copies import collapse
    from corpusmap.scratch import Tables

    nan, plans = float("nan"), []
    save = Tables.save

    def watched(tables, df, name):
        if name == "members":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return save(tables, df, name)

    monkeypatch.setattr(Tables, "save", watched)
    rows = [("a", [0.0, nan]), ("b", [-0.0, nan]), ("c", [1.0, 2.0]), ("d", [2.0, 1.0]), ("e", None), ("f", [1.0, 2.0]), ("g", [])]
    once = {"a": "a", "b": "a", "c": "c", "d": "d", "e": "e", "f": "c", "g": "g"}
    frame = spark.createDataFrame(rows[:4] + rows[5:], "id string, vec array<double>").repartition(3)
    found = collapse(frame, ["vec"], Tables(spark, "test"))
    assert {r.id: r.rep for r in found.members.collect()} == {k: v for k, v in once.items() if k != "e"}
    joined = [line for line in plans[0].splitlines() if "Join" in line]
    assert len(joined) == 1 and "digest0" in joined[0] and "vec" not in joined[0]
    # Null elements leave no trace in a digest: these rows share one and are told apart all the same.
    rows += [("h", [None, 1.0]), ("i", [1.0, None]), ("j", [1.0]), ("k", [None, 1.0])]
    found = collapse(spark.createDataFrame(rows, "id string, vec array<double>").repartition(3), ["vec"], Tables(spark, "test"))
    assert {r.id: r.rep for r in found.members.collect()} == once | {"h": "h", "i": "i", "j": "j", "k": "h"}


def test_a_long_path_is_one_component_and_unsettled_labels_raise(spark, monkeypatch):
    nodes = spark.range(401).withColumnRenamed("id", "id")
    edges = nodes.filter("id > 0").select((F.col("id") - 1).alias("src"), F.col("id").alias("dst")).repartition(7)
    assert graph.connected_components(nodes, edges).select("component").distinct().count() == 1
    monkeypatch.setattr(graph, "UNSETTLED", 1)
    with pytest.raises(RuntimeError, match="still change"):
        graph.label_propagation(nodes, edges)


def test_sparse_search_skips_blocks_and_loses_nothing(spark, monkeypatch):
    """Many small blocks, ties, equal documents, queries without known terms, and more hits asked for than are similar."""
    from corpusmap.operators import postings

    monkeypatch.setattr(postings, "BLOCK_DOCS", 8)
    rng = np.random.default_rng(12)
    m = np.where(rng.random((200, 40)) < 0.1, rng.random((200, 40)), 0.0)
    m[:, 0] = np.where(np.arange(200) % 3 == 0, 0.5, m[:, 0])
    m[150:] = m[100]
    m[7] = 0.0
    m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    asked = np.vstack([m[:6], np.zeros((1, 40)), np.eye(40)[39:]])

    def rows(matrix, name):
        listed = [(f"{i:03d}", np.flatnonzero(v).tolist(), v[v > 0].tolist()) for i, v in enumerate(matrix)]
        return spark.createDataFrame(listed, f"{name} string, indices array<int>, weights array<double>")

    for k in (3, 40):
        got = {(r.query_id, r.rank): (r.id, r.similarity) for r in postings.sparse_search(rows(asked, "query_id"), rows(m, "id"), k).collect()}
        assert len(got) == len(asked) * k
        sims = np.round(asked @ m.T, 9)
        for q in range(len(asked)):
            order = np.lexsort((np.arange(200), -sims[q]))[:k]
            assert [got[f"{q:03d}", r + 1][0] for r in range(k)] == [f"{i:03d}" for i in order]
    assert postings.sparse_search(rows(asked, "query_id"), rows(m, "id").limit(0), 3).collect() == []


def test_many_queries_are_compared_a_bounded_number_at_a_time():
    rng = np.random.default_rng(12)
    q, unit = rng.standard_normal((12_000, 8)), rng.standard_normal((10_000, 8))
    tracemalloc.start()
    found = search.best_in(q, np.arange(len(unit)), unit, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12_000 * 10_000 * 8 / 2
    some = rng.choice(len(q), 20)
    want = np.argsort(-np.round(q[some] @ unit.T, 9), axis=1, kind="stable")[:, :10]
    assert (found[1].reshape(-1, 10)[some] == want).all()


def test_vectors_that_visit_many_cells_are_compared_in_blocks(spark, vectors, cloud, small_cells, monkeypatch):
    monkeypatch.setattr(simjoin, "COUNTED", 2)
    monkeypatch.setattr(simjoin, "FEW_VISITS", 1)
    unit = vectors.filter("id < '0119'").select("id", simjoin.normalize(F.col("embedding")).alias("vec"))
    cells = simjoin.C.build_cells(unit, simjoin.Tables(spark, "visits"), cell_rows=6)
    assert simjoin._many_visits(cells, 0.01) and not simjoin._many_visits(cells, 0.999)
    monkeypatch.setattr(simjoin, "_many_visits", lambda cells, threshold: True)
    monkeypatch.setattr(simjoin.B, "BLOCK_ROWS", 16)
    odd = spark.createDataFrame([("x1", None), ("x2", []), ("x3", [0.0])], vectors.schema)
    similar = simjoin.similar_vectors(vectors.unionByName(odd), 0.3)
    assert isinstance(similar, simjoin.SimilarBlocks)
    edges = [(r.src, r.dst) for r in similar.full_edges().collect()]
    want = pairs_above(cloud, 0.3)
    assert len(edges) == len(set(edges)) and set(edges) == want
    weights = {(r.src, r.dst): r.weight for r in similar.full_edges().collect()}
    assert all(abs(w - cosines(cloud)[int(a), int(b)]) < 1e-9 for (a, b), w in weights.items())
    counts = similar.counts().first()
    assert (counts.n_nodes, counts.n_edges) == (len(cloud) + 3, len(want))
    isolated = simjoin.similar_vectors(vectors, 0.999)
    assert {(r.src, r.dst) for r in isolated.full_edges().collect()} == pairs_above(cloud, 0.999)


def test_cosine_topk_asks_with_every_vector(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.standard_normal((130, 8)))]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    asked = queries.cosine_topk(spark, str(tmp_path)).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in asked} == {str(i): 10 for i in range(130)}
