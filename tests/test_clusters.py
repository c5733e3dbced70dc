import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmap.operators import cells, cluster, hierarchy, label, rank, reduce, report
from corpusmap.scratch import Tables


def frame(spark, points):
    rows = [(f"{i:04d}", float(x), float(y)) for i, (x, y) in enumerate(points)]
    return spark.createDataFrame(rows, "id string, x double, y double")


@pytest.fixture(scope="module")
def blobs():
    """Three blobs, a crowd of equal points that holds a third of all, and noise."""
    rng = np.random.default_rng(1)
    return np.concatenate(
        [
            rng.normal((0, 0), 0.1, (40, 2)),
            rng.normal((3, 0), 0.2, (50, 2)),
            np.tile([[1.5, 1.5]], (60, 1)),
            rng.uniform(-2, 6, (20, 2)),
        ]
    )


def brute_dbscan(points, eps, min_pts):
    near = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1)) <= eps
    core = near.sum(1) >= min_pts
    labels = np.full(len(points), -1)
    for i in np.nonzero(core)[0]:
        if labels[i] < 0:
            stack = [i]
            while stack:
                j = stack.pop()
                if labels[j] < 0:
                    labels[j] = i
                    stack.extend(k for k in np.nonzero(near[j] & core)[0] if labels[k] < 0)
    for i in np.nonzero(~core)[0]:
        reach = [labels[k] for k in np.nonzero(near[i] & core)[0]]
        labels[i] = min(reach, default=-1)
    return labels


@pytest.mark.parametrize("eps", [0.08, 0.3])
def test_dbscan_equals_brute_force(spark, blobs, eps):
    want = brute_dbscan(blobs, eps, 5)
    got = {r.id: r.label for r in cluster.dbscan(frame(spark, blobs), eps, 5).collect()}
    assert [got[f"{i:04d}"] for i in range(len(blobs))] == [None if w < 0 else f"{w:04d}" for w in want]


def test_spanning_tree_has_the_least_weight(spark, small_cells):
    rng = np.random.default_rng(3)
    points, core = rng.random((80, 2)), 0.02 * (np.arange(80) % 3)
    rows = [(i, [float(x), float(y)], float(core[i])) for i, (x, y) in enumerate(points)]
    places = spark.createDataFrame(rows, "id bigint, vec array<double>, core double")
    tree = hierarchy.spanning_tree(places, Tables(spark, "test")).collect()
    reach = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    reach = np.maximum(reach, np.maximum(core[:, None], core[None, :]))
    inside, best, total = {0}, reach[0].copy(), 0.0
    while len(inside) < 80:
        best[list(inside)] = np.inf
        j = int(best.argmin())
        total += best[j]
        inside.add(j)
        best = np.minimum(best, reach[j])
    assert len(tree) == 79 and abs(sum(r.w for r in tree) - total) < 1e-9


def test_hdbscan_finds_the_blobs(spark, blobs):
    got = {r.id: r.cluster for r in cluster.hdbscan(frame(spark, blobs)).collect()}
    found = np.array([got[f"{i:04d}"] for i in range(len(blobs))])
    assert len(found) == len(blobs)
    main = [np.unique(found[s], return_counts=True) for s in (slice(0, 40), slice(40, 90), slice(90, 150))]
    names = [values[counts.argmax()] for values, counts in main]
    assert len(set(names)) == 3 and -1 not in names
    assert all(counts.max() >= 0.9 * counts.sum() for _, counts in main)
    sizes = np.unique(found[found >= 0], return_counts=True)[1]
    assert (sizes >= 5).all()


def test_hulls_of_partitions_merge(spark, blobs):
    points = frame(spark, blobs).withColumn("cluster", F.lit(1)).repartition(4)
    got = {(r.x, r.y) for r in report.cluster_hulls(points).collect()}
    assert got == {tuple(p) for p in report.convex_hull(blobs)}


def test_names_are_unique_short_and_free_of_banned_words(spark):
    titles = ["lipid bilayer dynamics", "lipid bilayer", "lipid bilayer", "protein folding cluster", "of the", "x1"]
    rows = [(str(i), i if i < 5 else -1, t) for i, t in enumerate(titles)]
    members = spark.createDataFrame(rows, "id string, cluster bigint, title string")
    names = {r.cluster: r.cluster_name for r in label.name_clusters(members).collect()}
    assert len(names) == 6 and len(set(names.values())) == 6 and names[-1] == "Others"
    for cluster_id, name in names.items():
        words = name.lower().split()
        assert len(words) <= 3 and not set(words) & set(label.BANNED_WORDS)


def test_titles_are_cut_at_the_budget(spark):
    rows = [(f"{i:03d}", 1, "abc" if i else None) for i in range(50)]
    members = spark.createDataFrame(rows, "id string, cluster int, title string")
    titles = report.joined_titles(members, budget=10).first().titles
    assert titles == ", ".join(["Unknown Title"] + ["abc"] * 49)[:40]


def test_samples_are_seeded(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("id"), (F.col("id") % 2).alias("g"))
    drawn = [{r.id for r in rank.sample_per_group(df, "g", 10, seed).collect()} for seed in (1, 1, 2)]
    assert len(drawn[0]) == 20 and drawn[0] == drawn[1] != drawn[2]


def test_positions_are_dense(spark):
    df = spark.range(1000).select(F.md5(F.col("id").cast("string")).alias("k")).repartition(5)
    rows = sorted((r.position, r.k) for r in rank.with_position(df, "k").collect())
    assert [p for p, _ in rows] == list(range(1000)) and [k for _, k in rows] == sorted(k for _, k in rows)


def trust(high, low, k=10):
    """Share of neighbours in the plane that are neighbours in space."""
    def near(m):
        d = ((m[:, None] - m[None]) ** 2).sum(-1)
        np.fill_diagonal(d, np.inf)
        return d.argsort(1)[:, :k]

    return np.mean([len(set(a) & set(b)) / k for a, b in zip(near(high), near(low))])


def test_projections_keep_neighbours(spark):
    rng = np.random.default_rng(4)
    data = rng.standard_normal((150, 5)) @ rng.standard_normal((5, 20)) + 0.1 * rng.standard_normal((150, 20))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "id bigint, embedding array<double>")
    kept = {}
    for method, epochs in (("pca", None), ("umap", 10), ("tsne", 20)):
        got = {r.id: (r.x, r.y) for r in reduce.reduce2d(df, method, epochs=epochs).collect()}
        assert len(got) == 150
        kept[method] = trust(data, np.array([got[i] for i in range(150)]))
    assert kept["umap"] >= kept["pca"] and kept["tsne"] >= kept["pca"]


def test_spring_pulls_neighbours_together(spark):
    nodes = spark.range(30).select(F.col("id"))
    edges = spark.createDataFrame([(i, j) for g in (0, 15) for i in range(g, g + 15) for j in range(i + 1, g + 15)],
                                  "src bigint, dst bigint")
    got = {r.id: np.array([r.x, r.y]) for r in reduce.spring_layout(nodes, edges, iterations=10).collect()}
    inside = np.mean([np.linalg.norm(got[i] - got[j]) for i in range(15) for j in range(i)])
    across = np.mean([np.linalg.norm(got[i] - got[j]) for i in range(15) for j in range(15, 30)])
    assert len(got) == 30 and inside < across
    assert max(abs(v).max() for v in got.values()) <= 1.0 + 1e-9


def test_unknown_choices_are_errors(spark):
    from corpusmap.plans.catalogue import check_choices

    check_choices("hashing", "basic", "umap", "knn")
    for wrong in (("x", "basic", "umap", "knn"), ("BERT", "x", "umap", "knn"), ("BERT", "basic", "x", "knn"),
                  ("BERT", "basic", "umap", "x")):
        with pytest.raises(ValueError):
            check_choices(*wrong)
    assert cells.n_blocks(np.array([0, 1, cells.BLOCK + 1])).tolist() == [1, 1, 2]


def brute_hierarchy(points, smallest, samples):
    """Labels by the definition: components below every distance, from the whole set down."""
    n = len(points)
    far = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    core = np.sort(far, axis=1)[:, samples]
    reach = np.maximum(far, np.maximum(core[:, None], core[None, :]))

    def parts(members, below):
        """Components of members under edges lighter than ``below``, and a member alone only below its core distance."""
        left, out = set(members), []
        while left:
            stack = [left.pop()]
            got = set(stack)
            while stack:
                i = stack.pop()
                near = {j for j in left if reach[i, j] < below}
                left -= near
                got |= near
                stack += near
            out.append(sorted(got))
        return out

    def joined_at(members):
        """The distance at which the members become one component."""
        if len(members) == 1:
            return core[members[0]]
        inside, best, top = {members[0]}, reach[members[0]].copy(), 0.0
        while len(inside) < len(members):
            j = min((m for m in members if m not in inside), key=lambda m: best[m])
            top = max(top, best[j])
            inside.add(j)
            best = np.minimum(best, reach[j])
        return top

    def inverse(w):
        return 1 / max(w, 1e-12)

    def grow(members, birth):
        """A cluster's stability and the best labels inside: ``(value, {point: label})``, and whether it is worth itself."""
        stable, at, last = 0.0, members, birth
        while True:
            w = joined_at(at)
            stable += len(at) * (inverse(w) - last)
            last = inverse(w)
            large = [p for p in parts(at, w) if len(p) >= smallest]
            if len(large) != 1 or len(large[0]) == len(at):
                break
            at = large[0]
        if len(large) < 2:
            return stable, {i: members[0] for i in members}
        below = [grow(p, last) for p in large]
        total = sum(b[0] for b in below)
        if stable >= total and birth > 0:
            return stable, {i: members[0] for i in members}
        return total, {i: c for b in below for i, c in b[1].items()}

    found = grow(list(range(n)), 0.0)[1]
    labels = np.full(n, -1)
    # The whole set is never a cluster.
    if len(set(found.values())) > 1 or len(found) < n:
        for i, c in found.items():
            labels[i] = c
    return labels


def same_partition(a, b):
    return ((a < 0) == (b < 0)).all() and len(set(zip(a.tolist(), b.tolist()))) == len(set(a.tolist())) == len(set(b.tolist()))


@pytest.mark.parametrize("problem", [100_000, 7])
def test_hierarchy_equals_the_definition(spark, monkeypatch, problem):
    """Blobs in blobs, copies, ties on a grid and noise; in one task, and halved down to seven edges."""
    monkeypatch.setattr(hierarchy, "PROBLEM", problem)
    rng = np.random.default_rng(11)
    points = np.concatenate([
        rng.normal((0, 0), 0.05, (40, 2)), rng.normal((0.5, 0), 0.02, (25, 2)), rng.normal((4, 1), 0.3, (40, 2)),
        np.tile([[2.0, 2.0]], (9, 1)), np.stack(np.meshgrid(np.arange(5), np.arange(5)), -1).reshape(-1, 2) * 0.125 + 8,
        rng.uniform(-2, 9, (25, 2))])
    got = {r.id: r.cluster for r in cluster.hdbscan(frame(spark, points)).collect()}
    found = np.array([got[f"{i:04d}"] for i in range(len(points))])
    assert same_partition(found, brute_hierarchy(points, 5, 5))
    assert len(set(found.tolist())) > 4


@pytest.mark.parametrize("problem", [100_000, 40])
def test_nested_chains_are_followed_to_the_end(spark, monkeypatch, problem):
    """Groups ever farther from the ones before: the hierarchy is a chain of some seventy splits."""
    monkeypatch.setattr(hierarchy, "PROBLEM", problem)
    at, points = 0.0, []
    for k in range(72):
        at += 1.06**k
        points += [(at + 0.001 * 1.05**k * j * (1 + j / 100), 0.0) for j in range(3)]
    points = np.array(points)
    got = {r.id: r.cluster for r in cluster.hdbscan(frame(spark, points), min_cluster_size=3, min_samples=2).collect()}
    found = np.array([got[f"{i:04d}"] for i in range(len(points))])
    assert same_partition(found, brute_hierarchy(points, 3, 2))
