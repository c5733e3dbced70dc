"""Sparse joins in blocks against all pairs, with crowds of copies and empty rows."""

import numpy as np
import pytest

from corpusmap.operators import blocks, graph, reduce, simjoin
from corpusmap.scratch import Tables


@pytest.fixture
def made(spark, monkeypatch):
    """Rows that share widespread terms, so that nearly all pairs meet under some posted term."""
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 16)
    monkeypatch.setattr(blocks, "PART", 8)
    monkeypatch.setattr(blocks, "COPIES", 4)
    rng = np.random.default_rng(3)
    m = np.where(rng.random((150, 30)) < 0.5, rng.random((150, 30)), 0.0)
    m[90:130] = m[89]
    m[130:135] = m[3]
    m[140] = 0.0
    m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    rows = [(f"{i:03d}", np.flatnonzero(v).tolist(), v[v > 0].tolist()) for i, v in enumerate(m)]
    return m, spark.createDataFrame(rows, "id string, indices array<int>, weights array<double>").repartition(5)


@pytest.mark.parametrize("threshold", [0.7, 0.9])
def test_blocks_find_all_pairs_and_write_none(made, threshold):
    m, rows = made
    similar = simjoin.similar_sparse(rows, threshold)
    assert isinstance(similar, simjoin.SimilarBlocks)
    i, j = np.nonzero(np.triu(m @ m.T > threshold, 1))
    truth = {(f"{a:03d}", f"{b:03d}"): float(m[a] @ m[b]) for a, b in zip(i, j)}
    got = similar.full_edges().collect()
    assert len(got) == len(truth) and {(r.src, r.dst) for r in got} == set(truth)
    assert all(abs(r.weight - truth[r.src, r.dst]) < 1e-12 for r in got)
    assert tuple(similar.counts().first()) == (150, len(truth))
    # Components need no table of edges, and the plan shuffles no pairs.
    parts = {r.id: r.component for r in graph.components_of(similar).collect()}
    assert not similar.kept
    assert "Exchange" not in similar._compared("stars")._jdf.queryExecution().optimizedPlan().toString()
    root = {f"{k:03d}": f"{k:03d}" for k in range(150)}
    for _ in range(150):
        for a, b in truth:
            root[a] = root[b] = min(root[a], root[b])
    assert parts == root
    reps = {r.rep for r in similar.groups.reps.collect()}
    assert {(r.src, r.dst) for r in similar.edges.collect()} == {p for p in truth if set(p) <= reps}


@pytest.mark.parametrize("wide", [False, True])
def test_connected_rows_are_not_multiplied_out_again(monkeypatch, wide):
    """Three crowds over three blocks: their links connect what all pairs connect, and few pairs are multiplied out for that."""
    rng = np.random.default_rng(5)
    monkeypatch.setattr(blocks, "PART", 64)
    monkeypatch.setattr(blocks, "WIDE", 1 if wide else blocks.WIDE)
    centre = rng.random((3, 40)) * (rng.random((3, 40)) < 0.4)
    of = rng.integers(0, 3, 600)
    m = centre[of] + 0.05 * rng.random((600, 40)) * (rng.random((600, 40)) < 0.3)
    m /= np.linalg.norm(m, axis=1, keepdims=True)

    def rows(low):
        part = m[low : low + 200]
        start = np.concatenate([[0], (part > 0).sum(1).cumsum()])
        terms = np.nonzero(part)[1].astype(np.int64)
        lead = np.ones(200, dtype=bool)
        lead[:3] = False
        return blocks.Rows(None, np.arange(201), lead, start, terms, part[part > 0])

    asked = []
    dots = blocks._dots
    monkeypatch.setattr(blocks, "_dots", lambda *x: asked.append(len(x[-1])) or dots(*x))
    forest, found = blocks.Forest(), [rows(0), rows(200), rows(400)]
    for r in range(3):
        for k in range(r + 1):
            at, to = forest.place(k, 200), forest.place(r, 200)
            for i, j in blocks._linked(found[k], found[r], k == r, 0.9, forest, at, to):
                assert (np.einsum("ij,ij->i", m[200 * k + i], m[200 * r + j]) > 0.9).all()
    led = np.arange(600) % 200 > 2
    similar = (m @ m.T > 0.9) & led[:, None] & led[None, :]
    assert sum(asked) < similar.sum() / 2 / 10
    root = np.arange(600)
    for _ in range(600):
        lowest = np.where(similar, root[None, :], 600).min(1)
        new = np.where(led, np.minimum(root, lowest), root)
        if (new == root).all():
            break
        root = new
    assert (forest.root == root).all()


def test_rounds_on_edges_find_and_write_them_once(made, monkeypatch):
    """Label propagation, communities and the spring layout compare the blocks once, and keep each edge in one direction."""
    m, rows = made
    similar = simjoin.similar_sparse(rows, 0.9)
    found = {}
    save = Tables.save

    def watched(tables, df, name):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") <= 1
        kept = save(tables, df, name)
        if "MapInArrow" in plan:
            found[name] = found.get(name, 0) + kept.count()
        return kept

    n = similar.full_edges().count()
    nodes = rows.select("id")
    monkeypatch.setattr(Tables, "save", watched)
    labels = graph.label_propagation(nodes, similar.full_edges(), 2, synchronous=True).collect()
    assert len(labels) == 150 and found == {"edges": n}
    found.clear()
    assert len(graph.communities(similar).collect()) == 150
    assert not similar.kept and list(found) == ["edges"]
    found.clear()

    def stop(start, both, *_):
        assert both.count() == 2 * n
        raise InterruptedError

    monkeypatch.setattr(reduce, "run_epochs", stop)
    with pytest.raises(InterruptedError):
        reduce.spring_layout(nodes, similar.full_edges())
    assert found == {"edges": n}


def _languages(n, seed=6):
    """Rows of two vocabularies that share few terms, a third of them near one of two centres, and some of both vocabularies."""
    rng = np.random.default_rng(seed)
    m = np.zeros((n, 80))
    of = rng.integers(0, 2, n)
    centre = rng.random((2, 40))
    for i in range(n):
        near = i % 3 == 0
        v = centre[of[i]] + 0.1 * rng.random(40) if near else np.where(rng.random(40) < 0.2, rng.random(40), 0.0)
        m[i, 40 * of[i] : 40 * of[i] + 40] = v
        if i % 20 == 0:
            m[i, 40 - 40 * of[i] : 80 - 40 * of[i]] += 0.5 * centre[1 - of[i]]
    m[:, 39] = 0.1
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _sparse(spark, m):
    rows = [(f"{i:03d}", np.flatnonzero(v).tolist(), v[v > 0].tolist()) for i, v in enumerate(m)]
    return spark.createDataFrame(rows, "id string, indices array<int>, weights array<double>").repartition(3)


def test_clusters_of_terms_and_hubs_change_no_result(spark, monkeypatch):
    """Two clusters of terms are found; rows connected through hubs are not compared; edges, counts and components are those of all pairs."""
    for name, value in {"BLOCK_ROWS": 64, "PART": 16, "HUBS": 40, "CHOICES": (16, 32, 64), "GROUPS": 32, "CROSSED": 0.5, "CENTRES": 3}.items():
        monkeypatch.setattr(blocks, name, value)
    m, threshold = _languages(300), 0.6
    similar = simjoin.similar_sparse(_sparse(spark, m), threshold)
    assert isinstance(similar, simjoin.SimilarBlocks) and similar.plan.n == 2
    assert 20 <= len(similar.plan.hubs) < 120
    i, j = np.nonzero(np.triu(m @ m.T > threshold, 1))
    truth = {(f"{a:03d}", f"{b:03d}") for a, b in zip(i, j)}
    got = similar.full_edges().collect()
    assert len(got) == len(truth) and {(r.src, r.dst) for r in got} == truth
    assert tuple(similar.counts().first()) == (300, len(truth))
    root = np.arange(300)
    for _ in range(300):
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
    assert {r.id: r.component for r in graph.components_of(similar).collect()} == {f"{k:03d}": f"{v:03d}" for k, v in enumerate(root)}


def test_rows_of_other_terms_are_not_bounded_pair_by_pair(monkeypatch):
    """Rows of two vocabularies meet by their lengths in the clusters alone, and rows connected to hubs are not multiplied out."""
    monkeypatch.setattr(blocks, "PART", 64)
    m = _languages(400)
    size = (m > 0).sum(1)
    rows = blocks.Rows(None, np.arange(401), np.ones(400, dtype=bool), np.concatenate([[0], size.cumsum()]), np.nonzero(m)[1], m[m > 0])
    monkeypatch.setattr(blocks, "CROSSED", 0.5)
    monkeypatch.setattr(blocks, "LEAST", 0.2)
    plan = blocks._clusters(rows, 0.6)
    assert plan.n == 2 and (plan.cluster[:39] == plan.cluster[0]).all() and (plan.cluster[40:] == plan.cluster[40]).all()
    order = blocks.Rows(None, rows.copies, rows.lead, rows.start, rows.terms, rows.weights, plan).order()
    m = m[order]
    rows = blocks.Rows(
        None, rows.copies, rows.lead, np.concatenate([[0], size[order].cumsum()]), np.nonzero(m)[1], m[m > 0], plan)
    met = []
    lengths = blocks.Rows.lengths
    monkeypatch.setattr(blocks.Rows, "lengths", lambda self, c, low, high, n: met.append((c, high - low)) or lengths(self, c, low, high, n))
    forest = blocks.Forest()
    at = forest.place(0, 400)
    for _ in blocks._linked(rows, rows, True, 0.6, forest, at, at):
        pass
    assert {c for c, _ in met} >= {0, 1}
    hubs = forest.root
    plan.root = hubs
    hub, merged = blocks._to_hubs(rows, rows, 0.6)
    assert (hub == hubs).all() and not len(merged)
    asked = []
    monkeypatch.setattr(blocks, "_dots", lambda *x: asked.append(len(x[-1])) or np.zeros(len(x[-1])))
    again = blocks.Forest(hubs)
    at = again.place(0, 400, hub)
    apart = hubs[:, None] != hubs[None, :]
    for _ in blocks._linked(rows, rows, True, 0.6, again, at, at):
        pass
    assert sum(asked) <= (np.triu(apart, 1)).sum()
