"""Cosine joins in blocks: every pair of blocks is compared in one task, and no pair of rows is written or shuffled.

A block is one row of a saved table: some thousand rows, packed. Blocks meet in a cross product, each two of them once,
which needs no shuffle, so that disk grows with the rows and not with the pairs; time grows with the square of the rows.
Two rows are first bounded: terms are put into groups, the most widespread each in its own, and by Cauchy and Schwarz the
products of the rows' lengths within each group sum to at least their cosine. Only what exceeds the threshold is multiplied out.
Terms that stand in the same rows, as those of one language, form a cluster, fitted on some rows (``Plan``). Each cluster has groups of
its own, a block is sorted by the cluster in which its rows are longest, and rows of different clusters are bounded by their
lengths within the clusters alone. The fit decides how much is multiplied out and not what is found.
Blocks of dense rows, which all hold the same terms, are multiplied as matrices. Where only the connections are asked for, a task
multiplies out no pair of rows that the pairs it has found connect already, or that are connected through some rows, the hubs, with
which all rows are compared when they are packed.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import combinations_with_replacement, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmap.operators.copies import Groups
from corpusmap.scratch import Tables

# Rows and entries of a block, and rows and numbers of one that are spelled out at once.
BLOCK_ROWS, BLOCK_ENTRIES, PART, SPELLED = 2048, 1 << 19, 256, 1 << 23
# Groups of the terms of a cluster, of which a quarter have a widespread term each: without a fit, and those that a fit chooses from.
GROUPS, CHOICES = 1024, (128, 256, 512, 1024, 2048)
# Nanoseconds that a bound takes, one of its groups, and an entry that is multiplied out; classes of rows by powers of two of their entries,
# and rows of a class that a choice is made on at least.
BOUND_NS, GROUP_NS, ENTRY_NS, CLASSES, CHOSEN_ON = 1.5, 0.009, 18.0, 16, 8
# Rows that are hubs, at least and about, entries that they have at most, rows that clusters are fitted on, clusters to begin with, rounds
# of the fit, and terms whose cluster is kept.
HUBS, HUB_ENTRIES, FITTED, CENTRES, FITS, MAPPED = 2048, 1 << 21, 1024, 16, 8, 1 << 18
# Cosine of the means of two clusters that are one, share of the rows that a cluster has at least, and share of the pairs of rows of
# different clusters that the lengths within the clusters may leave.
ALIKE, LEAST, CROSSED = 0.3, 1 / 64, 0.1
# The bound is found in single precision.
SLACK = 1e-4
# Copies that share a row, and pairs written at once.
COPIES, OUT = 64, 100_000
# Blocks that a task of the cross product holds of a side, and blocks that it keeps unpacked.
HELD, UNPACKED = (4, 4), 5
# Terms up to which a row is spelled out over all of them, and entries of pairs multiplied at once.
WIDE, ENTRIES = 1 << 14, 1 << 16
# Lengths within groups that are kept of an unpacked block.
KEPT = 2 << 20
# What a block holds besides its ids.
RAW = ("copies", "lead", "size", "terms", "weights", "hub")


@dataclass
class Plan:
    """The cluster of each term and its rank there, how many groups tell rows of two classes apart at the least cost, and the hubs
    with the first hub that each is connected to."""

    cluster: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int8))
    rank: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    n: int = 1
    groups: np.ndarray | None = None
    hubs: pa.Array | None = None
    root: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def __post_init__(self) -> None:
        if self.groups is None:
            self.groups = np.full((self.n, CLASSES, CLASSES), GROUPS)

    def placed(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cluster of each term, and its rank there."""
        if not len(self.cluster):
            return np.zeros(len(terms), np.int64), terms
        at = np.minimum(terms, len(self.cluster) - 1)
        known = terms < len(self.cluster)
        return np.where(known, self.cluster[at], 0), np.where(known, self.rank[at], terms)


@dataclass
class Rows:
    """A block, unpacked: ``ids`` of all copies, of which row ``i`` has those from ``copies[i]`` to ``copies[i + 1]``.

    ``hub`` is the first hub that a row is connected to, or -1.
    """

    ids: pa.Array | None
    copies: np.ndarray
    lead: np.ndarray
    start: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    plan: Plan = field(default_factory=Plan)
    hub: np.ndarray | None = None

    def __post_init__(self) -> None:
        self._lengths: dict[tuple[int, int, int, int], np.ndarray] = {}

    def __len__(self) -> int:
        return len(self.lead)

    @cached_property
    def placed(self) -> tuple[np.ndarray, np.ndarray]:
        cluster, rank = self.plan.placed(self.terms)
        return cluster.astype(np.int8), rank.astype(np.int32)

    @cached_property
    def norms(self) -> np.ndarray:
        """The length of each row within each cluster."""
        row = np.repeat(np.arange(len(self)), np.diff(self.start))
        squares = np.bincount(row * self.plan.n + self.placed[0], self.weights**2, minlength=len(self) * self.plan.n)
        return np.sqrt(squares).reshape(len(self), self.plan.n).astype(np.float32)

    def order(self) -> np.ndarray:
        """The rows by cluster, and from few entries to many."""
        return np.lexsort((np.diff(self.start), self.norms.argmax(1)))

    def parts(self, size: int) -> list[tuple[int, int, int, int]]:
        """Parts of so many rows ``(cluster, low, high, class)``; the rows of each are of one cluster if the block is sorted."""
        home = self.norms.argmax(1)
        cuts = np.concatenate([[0], np.nonzero(np.diff(home))[0] + 1, [len(self)]])
        if (np.diff(home) < 0).any():
            home, cuts = np.zeros(len(self), np.int64), np.array([0, len(self)])
        cuts = [k for a, b in zip(cuts[:-1], cuts[1:]) for k in range(a, b, size)] + [len(self)]
        mean = [(self.start[b] - self.start[a]) / (b - a) for a, b in zip(cuts[:-1], cuts[1:])]
        return [(int(home[a]), a, b, min(int(np.log2(max(m, 1))), CLASSES - 1)) for a, b, m in zip(cuts[:-1], cuts[1:], mean)]

    def lengths(self, c: int, low: int, high: int, groups: int) -> np.ndarray:
        """The lengths of some rows within the groups of a cluster, and within the other clusters, or within groups of all (``c`` -1)."""
        key = c, low, high, groups
        if key in self._lengths:
            self._lengths[key] = self._lengths.pop(key)
        else:
            entries, own = slice(self.start[low], self.start[high]), groups // 4
            cluster, rank = (x[entries] for x in self.placed) if c >= 0 else (c, self.terms[entries])
            width = groups + (self.plan.n if c >= 0 and self.plan.n > 1 else 0)
            column = np.where(rank < own, rank, own + rank % (groups - own))
            if c >= 0:
                column = np.where(cluster == c, column, groups + cluster.astype(np.int32))
            place = np.repeat(np.arange(0, (high - low) * width, width), np.diff(self.start[low : high + 1])) + column
            found = np.zeros((high - low) * width, np.float32)
            np.add.at(found, place, (self.weights[entries] ** 2).astype(np.float32))
            self._lengths[key] = np.sqrt(found, out=found).reshape(-1, width)
            while len(self._lengths) > 1 and sum(x.size for x in self._lengths.values()) > KEPT:
                del self._lengths[next(iter(self._lengths))]
        return self._lengths[key]


def planned(reps: DataFrame, threshold: float) -> tuple[Plan, Rows]:
    """Clusters of terms and hubs, from rows ``(rep, indices, weights)`` chosen by a hash, and the hubs' rows."""
    some = F.pmod(F.xxhash64("rep"), F.lit(max(1, reps.count() // HUBS))) == 0
    held = reps.filter(some).select("rep", "indices", "weights").toArrow().combine_chunks()
    size = np.asarray(_flat(held, "indices").value_lengths()).astype(np.int64)
    n = int(np.searchsorted(size.cumsum(), HUB_ENTRIES, side="right"))
    held, start = held.slice(0, n), np.concatenate([[0], size[:n].cumsum()])
    terms = _flat(held, "indices").flatten().to_numpy().astype(np.int64)
    weights = _flat(held, "weights").flatten().to_numpy().astype(np.float64)
    rows = Rows(_flat(held, "rep"), np.arange(n + 1), np.ones(n, dtype=bool), start, terms, weights)
    plan = _clusters(rows, threshold)
    rows.plan, forest = plan, Forest()
    at = forest.place(0, n)
    rows = _taken(rows, rows.order())
    for _ in _linked(rows, rows, True, threshold, forest, at, at):
        pass
    plan.hubs, plan.root, plan.groups = rows.ids, forest.root, _chosen(rows, forest.root, threshold)
    rows._lengths.clear()
    return plan, rows


def _chosen(rows: Rows, root: np.ndarray, threshold: float) -> np.ndarray:
    """For rows of each two classes the groups at which bounds, and the products of pairs that they leave in vain, cost least."""
    home, size = rows.norms.argmax(1), np.diff(rows.start)
    of = np.minimum(np.log2(np.maximum(size, 1)).astype(int), CLASSES - 1)
    cost = np.full((len(CHOICES), rows.plan.n, CLASSES, CLASSES), np.inf)
    cost[CHOICES.index(GROUPS)] = 0.0
    for h, (k, groups) in product(range(rows.plan.n), enumerate(CHOICES)):
        low, high = np.searchsorted(home, [h, h + 1])
        x = rows.lengths(h, low, high, groups)
        members = [np.nonzero(of[low:high] == c)[0] for c in range(CLASSES)]
        for c, d in combinations_with_replacement(range(CLASSES), 2):
            a, b = members[c], members[d]
            if min(len(a), len(b)) >= CHOSEN_ON:
                left = (x[a] @ x[b].T > threshold - SLACK) & (root[low + a][:, None] != root[None, low + b])
                entries = (size[low + a].mean() + size[low + b].mean()) / 2
                cost[k, h, c, d] = cost[k, h, d, c] = BOUND_NS + GROUP_NS * groups + left.mean() * ENTRY_NS * entries
        rows._lengths.clear()
    return np.array(CHOICES)[cost.argmin(0)]


def _flat(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name).combine_chunks()
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def _taken(rows: Rows, order: np.ndarray) -> Rows:
    """Rows without copies in another order."""
    size = np.diff(rows.start)[order]
    start = np.concatenate([[0], size.cumsum()])
    entry = np.arange(start[-1]) + np.repeat(rows.start[order] - start[:-1], size)
    ids = rows.ids.take(pa.array(order))
    return Rows(ids, rows.copies, rows.lead, start, rows.terms[entry], rows.weights[entry], rows.plan)


def _clusters(rows: Rows, threshold: float) -> Plan:
    """Clusters of the terms of some rows by spherical k-means, if the lengths within clusters tell rows apart; else one."""
    n = len(rows)
    if n < 2:
        return Plan()
    width = min(int(rows.terms.max(initial=0)) + 1, WIDE)

    def spread(low: int, high: int) -> np.ndarray:
        out = np.zeros((high - low, width), np.float32)
        entries = slice(rows.start[low], rows.start[high])
        row = np.repeat(np.arange(high - low), np.diff(rows.start[low : high + 1]))
        np.add.at(out, (row, rows.terms[entries] % width), np.abs(np.nan_to_num(rows.weights[entries])))
        return out

    fitted = spread(0, min(n, FITTED))
    # Each centre begins as the row farthest from the earlier ones, of the quarter with most entries, which hold most of a cluster's terms.
    long = fitted[np.argsort(-np.diff(rows.start)[: len(fitted)], kind="stable")[: -(-len(fitted) // 4)]]
    centre = [long[0]]
    near = long @ centre[0]
    for _ in range(CENTRES - 1):
        centre.append(long[near.argmin()])
        near = np.maximum(near, long @ centre[-1])
    centre = np.array(centre)
    for _ in range(FITS):
        of = (fitted @ centre.T).argmax(1)
        sums = np.array([fitted[of == c].sum(0) if (of == c).any() else centre[c] for c in range(CENTRES)])
        centre = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    # Those of few rows, which may mix the terms of others, are left before like ones become one.
    centre = centre[np.bincount((fitted @ centre.T).argmax(1), minlength=CENTRES) >= LEAST * len(fitted)]
    label, alike = np.arange(len(centre)), centre @ centre.T > ALIKE
    for i, j in zip(*np.nonzero(alike)):
        label[label == label[j]] = label[i]
    parts = [slice(low, min(low + PART, n)) for low in range(0, n, PART)]
    of = np.concatenate([label[(spread(p.start, p.stop) @ centre.T).argmax(1)] for p in parts])
    counts = np.bincount(of, minlength=len(centre))
    kept = [c for c in np.argsort(-counts, kind="stable") if counts[c] >= max(LEAST * n, 1)]
    if len(kept) < 2:
        return Plan()
    row = np.repeat(np.arange(n), np.diff(rows.start))
    mapped = min(int(rows.terms.max()) + 1, MAPPED)
    mass = np.zeros((len(kept), mapped))
    for k, c in enumerate(kept):
        use = (of[row] == c) & (rows.terms < mapped)
        mass[k] = np.bincount(rows.terms[use], rows.weights[use] ** 2, minlength=mapped) / counts[c]
    cluster = mass.argmax(0)
    rank = np.zeros(mapped, np.int32)
    for k in range(len(kept)):
        own = np.nonzero(cluster == k)[0]
        rank[own] = np.arange(len(own))
    plan = Plan(cluster.astype(np.int8), rank, len(kept))
    tried = Rows(None, rows.copies, rows.lead, rows.start, rows.terms, rows.weights, plan).norms[:FITTED]
    home = tried.argmax(1)
    crossed = home[:, None] != home[None, :]
    left = (tried @ tried.T > threshold - SLACK) & crossed
    return plan if left.sum() <= CROSSED * crossed.sum() else Plan()


def pack(groups: Groups, tables: Tables, threshold: float, sparse: bool) -> tuple[DataFrame, int, Plan]:
    """The representatives ``(rep, indices, weights)`` and their copies as a saved table of blocks, and how many there are.

    Sparse rows have a plan: they are sorted by clusters within the blocks, and connected to hubs.
    """
    reps = groups.reps.filter(F.size("indices") > 0)
    plan, hubs = planned(reps, threshold) if sparse else (Plan(), None)
    rows = reps.select(F.array("rep").alias("ids"), F.lit(True).alias("lead"), "indices", "weights")
    if groups.has_copies:
        crowds = reps.filter("n_copies > 1")
        part = F.pmod(F.xxhash64("id"), F.ceil(F.col("n_copies") / COPIES)).alias("part")
        copies = groups.members.filter("id <> rep").join(crowds.select("rep", "n_copies"), "rep").select("rep", "id", part)
        copies = copies.groupBy("rep", "part").agg(F.collect_list("id").alias("ids")).join(crowds, "rep")
        rows = rows.unionByName(copies.select("ids", F.lit(False).alias("lead"), "indices", "weights"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, entries, n = [], 0, 0
        for batch in batches:
            size = np.asarray(batch.column("indices").value_lengths()).astype(np.int64)
            begin = 0
            while begin < batch.num_rows:
                room = max(1, int(np.searchsorted(size[begin:].cumsum(), BLOCK_ENTRIES - entries, side="right")))
                end = min(begin + room, begin + BLOCK_ROWS - sum(h.num_rows for h in held), batch.num_rows)
                held.append(batch.slice(begin, end - begin))
                entries += int(size[begin:end].sum())
                begin = end
                if sum(h.num_rows for h in held) >= BLOCK_ROWS or begin < batch.num_rows:
                    yield packed(held, n)
                    held, entries, n = [], 0, n + 1
        if held:
            yield packed(held, n)
        # What the next task of this worker does not need.
        del held
        hubs is not None and hubs._lengths.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()

    def unpacked(table: pa.Table) -> Rows:
        size = np.asarray(_flat(table, "indices").value_lengths())
        return Rows(
            None, np.arange(len(size) + 1), table.column("lead").to_numpy(), np.concatenate([[0], size.cumsum(dtype=np.int64)]),
            _flat(table, "indices").flatten().to_numpy().astype(np.int64), _flat(table, "weights").flatten().to_numpy(), plan)

    def packed(held: list[pa.RecordBatch], n: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        hub = merged = np.zeros(0)
        if hubs is not None:
            table = table.take(pa.array(unpacked(table).order()))
            hub, merged = _to_hubs(unpacked(table), hubs, threshold)
        lists = {c: _flat(table, c) for c in ("ids", "indices", "weights")}
        raw = [
            np.asarray(lists["ids"].value_lengths()).astype("<i4"), table.column("lead").to_numpy().astype("u1"),
            np.asarray(lists["indices"].value_lengths()).astype("<i4"),
            lists["indices"].flatten().to_numpy().astype("<i4"), lists["weights"].flatten().to_numpy().astype("<f8"),
            hub.astype("<i4"), merged.astype("<i4"),
        ]
        ids = lists["ids"].flatten()
        return pa.RecordBatch.from_arrays(
            [pa.array([n], pa.int64()), pa.ListArray.from_arrays([0, len(ids)], ids), *(pa.array([x.tobytes()], pa.binary()) for x in raw)],
            names=["n", "ids", "copies", "lead", "size", "terms", "weights", "hub", "merged"],
        )

    kind = groups.reps.schema["rep"].dataType.simpleString()
    schema = f"n bigint, ids array<{kind}>, " + ", ".join(f"{c} binary" for c in (*RAW, "merged"))
    found = rows.mapInArrow(run, schema).withColumn("block", F.spark_partition_id() * F.lit(1 << 20) + F.col("n")).drop("n")
    saved, seen = tables.save_measured(found, "blocks", n=F.count("*"))
    if hubs is not None:
        # What the hubs are connected to through other rows: as many numbers as there are hubs for a block, if any.
        forest = Forest(plan.root)
        for row in saved.filter(F.length("merged") > 0).select("merged").distinct().toLocalIterator():
            forest.join(*np.frombuffer(row["merged"], "<i4").astype(np.int64).reshape(2, -1))
        plan.root = forest.root
    return saved.drop("merged"), seen["n"], plan


def _to_hubs(rows: Rows, hubs: Rows, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The first hub that each row is connected to, or -1, and pairs of hubs that the rows connect."""
    forest = Forest(hubs.plan.root)
    at = forest.place(0, len(rows))
    for _ in _linked(rows, hubs, False, threshold, forest, at, 0):
        pass
    own, known = forest.root[at:], forest.root[:at]
    changed = np.nonzero(known != hubs.plan.root)[0]
    return np.where(own < at, own, -1), np.concatenate([changed, known[changed]])


def _unpacked(batch: pa.RecordBatch, side: str, i: int, plan: Plan | None = None) -> Rows:
    def raw(name: str, kind: str) -> np.ndarray:
        return np.frombuffer(batch.column(f"{side}_{name}")[i].as_py(), kind)

    def ends(name: str) -> np.ndarray:
        return np.concatenate([[0], raw(name, "<i4").cumsum(dtype=np.int64)])

    ids = batch.column(f"{side}_ids")[i].values
    return Rows(
        ids, ends("copies"), raw("lead", "u1") > 0, ends("size"), raw("terms", "<i4").astype(np.int64), raw("weights", "<f8"),
        plan or Plan(), raw("hub", "<i4").astype(np.int64))


def _dense(rows: Rows) -> np.ndarray | None:
    """The rows as a matrix, if each holds the terms from 0 on to the same last one."""
    width = rows.start[1] if len(rows) else 0
    if not width or (np.diff(rows.start) != width).any():
        return None
    if (rows.terms.reshape(-1, width) != np.arange(width)).any():
        return None
    return rows.weights.reshape(-1, width)


def _similar(a: Rows, b: Rows, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows above the threshold, with their cosines; a block against itself gives each pair once."""
    x, y = _dense(a), _dense(b)
    if x is not None and y is not None and x.shape[1] == y.shape[1]:
        for low in range(0, len(b), PART):
            cosines = x @ y[low : low + PART].T
            above = cosines > threshold
            if same:
                above &= np.arange(len(a))[:, None] < np.arange(low, low + cosines.shape[1])[None, :]
            i, j = np.nonzero(above)
            yield i, j + low, cosines[i, j]
        return
    start, columns, weights, column, width = _aligned(a, b)
    spelled = Spelled(b, column, width)
    for low, high, i, j, _ in _likely(a, b, same, threshold, width):
        # In the order of the spelled-out rows, which are read one by one.
        order = np.argsort(j, kind="stable")
        i, j = i[order], j[order]
        cosines = _dots(start, columns, weights, spelled.rows(low, high), i, j - low)
        above = cosines > threshold
        yield i[above], j[above], cosines[above]


def _aligned(a: Rows, b: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Row starts, columns and weights of what ``a`` holds of the columns of ``b``, the columns of ``b``, and how many there are."""
    width = int(max(a.terms.max(initial=0), b.terms.max(initial=0))) + 1
    if width <= WIDE:
        return a.start, a.terms, a.weights, b.terms, width
    known, column = np.unique(b.terms, return_inverse=True)
    at = np.minimum(np.searchsorted(known, a.terms), len(known) - 1)
    shared = known[at] == a.terms
    return np.concatenate([[0], shared.cumsum()])[a.start], at[shared], a.weights[shared], column, len(known)


def _likely(a: Rows, b: Rows, same: bool, threshold: float, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For the rows of ``b`` from one place to another the pairs with rows of ``a`` whose bounds exceed the threshold, and the bounds."""
    size = int(np.clip(SPELLED // max(width, 1), 16, PART))
    parts = a.parts(size)
    for d, low, high, kind in b.parts(size):
        found = []
        for c, at, end, other in parts:
            if same and at >= high:
                continue
            if c == d:
                groups = int(a.plan.groups[c, other, kind])
                bound = a.lengths(c, at, end, groups) @ b.lengths(d, low, high, groups).T
            elif a.norms[at:end].max(0) @ b.norms[low:high].max(0) <= threshold - SLACK:
                continue
            else:
                bound = a.norms[at:end] @ b.norms[low:high].T
                maybe = bound > threshold - SLACK
                x, y = np.nonzero(maybe.any(1))[0], np.nonzero(maybe.any(0))[0]
                if len(x):
                    # The rows that the clusters do not tell apart.
                    finer = a.lengths(-1, at, end, GROUPS)[x] @ b.lengths(-1, low, high, GROUPS)[y].T
                    bound[np.ix_(x, y)] = np.minimum(bound[np.ix_(x, y)], finer)
            flat = np.flatnonzero(bound > threshold - SLACK)
            i, j = np.divmod(flat, high - low)
            i, j, w = i + at, j + low, bound.ravel()[flat]
            if same:
                once = i < j
                i, j, w = i[once], j[once], w[once]
            found.append((i, j, w))
        i, j, w = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if len(i):
            yield low, high, i, j, w


class Spelled:
    """Rows over all columns, a part at a time in one matrix."""

    def __init__(self, b: Rows, column: np.ndarray, width: int) -> None:
        self.b, self.column, self.width, self.whole, self.last = b, column, width, None, None

    def rows(self, low: int, high: int) -> np.ndarray:
        """The rows from ``low`` to ``high``; those spelled out before are gone."""
        if self.whole is None or len(self.whole) < high - low:
            self.whole, self.last = np.zeros((high - low, self.width)), None
        if self.last is not None:
            self.whole[self.last] = 0.0
        entries = slice(self.b.start[low], self.b.start[high])
        self.last = np.repeat(np.arange(high - low), np.diff(self.b.start[low : high + 1])), self.column[entries]
        self.whole[self.last] = self.b.weights[entries]
        return self.whole


class Forest:
    """What the pairs that a task has found connect: hubs and rows of its blocks, with the first of them they are connected to."""

    def __init__(self, hubs: np.ndarray | None = None) -> None:
        self.root, self.first = np.zeros(0, dtype=np.int64) if hubs is None else hubs.copy(), {}

    def place(self, block: int, n: int, hub: np.ndarray | None = None) -> int:
        if block not in self.first:
            self.first[block] = len(self.root)
            own = np.arange(len(self.root), len(self.root) + n)
            if hub is not None and len(hub):
                own = np.where(hub < 0, own, self.root[hub])
            self.root = np.concatenate([self.root, own])
        return self.first[block]

    def join(self, u: np.ndarray, v: np.ndarray) -> None:
        while True:
            ru, rv = self.root[u], self.root[v]
            if (ru == rv).all():
                return
            low = np.minimum(ru, rv)
            np.minimum.at(self.root, ru, low)
            np.minimum.at(self.root, rv, low)
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]


def _linked(
    a: Rows, b: Rows, same: bool, threshold: float, forest: Forest, at: int, to: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """So many pairs of leading rows above the threshold that they and earlier ones connect what all connect.

    ``at`` and ``to`` are the places of the blocks in the forest. Of the pairs not connected yet, the likeliest of each
    row and of each two connected parts is multiplied out first, then the next two, and so on.
    """
    x, y = _dense(a), _dense(b)
    if x is not None and y is not None and x.shape[1] == y.shape[1]:
        for i, j, _ in _similar(a, b, same, threshold):
            led = a.lead[i] & b.lead[j]
            forest.join(at + i[led], to + j[led])
            yield i[led], j[led]
        return
    start, columns, weights, column, width = _aligned(a, b)
    spelled = Spelled(b, column, width)
    for low, high, i, j, bound in _likely(a, b, same, threshold, width):
        left = (forest.root[at + i] != forest.root[to + j]) & a.lead[i] & b.lead[j]
        if not left.any():
            continue
        i, j, bound, whole = i[left], j[left] - low, bound[left], spelled.rows(low, high)
        order = np.argsort(-bound, kind="stable")
        i, j, tried = i[order], j[order], 1
        while len(i):
            pair = forest.root[at + i] * len(forest.root) + forest.root[to + low + j]
            now = (_rank(i) < tried) & (_rank(pair) < tried)
            # In the order of the spelled-out rows, which are read one by one.
            order = np.argsort(j[now], kind="stable")
            x, y = i[now][order], j[now][order]
            above = _dots(start, columns, weights, whole, x, y) > threshold
            x, y = x[above], y[above] + low
            forest.join(at + x, to + y)
            yield x, y
            left = ~now & (forest.root[at + i] != forest.root[to + low + j])
            i, j, tried = i[left], j[left], tried * 2


def _rank(keys: np.ndarray) -> np.ndarray:
    """How many equal keys stand before each."""
    order = np.argsort(keys, kind="stable")
    rank = np.empty(len(keys), dtype=np.int64)
    rank[order] = np.arange(len(keys)) - np.searchsorted(keys[order], keys[order])
    return rank


def _dots(
    start: np.ndarray, columns: np.ndarray, weights: np.ndarray, whole: np.ndarray, i: np.ndarray, j: np.ndarray
) -> np.ndarray:
    """Inner products of sparse rows with rows that are spelled out, a bounded number of entries at a time."""
    size, width, flat = np.diff(start)[i], whole.shape[1], whole.ravel()
    cuts = np.unique((size.cumsum() - size) // ENTRIES, return_index=True)[1]
    found = [np.zeros(0)]
    for k, end in zip(cuts, [*cuts[1:], len(i)]):
        n = size[k:end]
        first = n.cumsum() - n
        entry = np.arange(n.sum())
        entry += np.repeat(start[i[k:end]] - first, n)
        place = columns.take(entry)
        place += np.repeat(j[k:end] * width, n)
        products = flat.take(place)
        products *= weights.take(entry)
        if n.all():
            found.append(np.add.reduceat(products, first))
        else:
            found.append(np.bincount(np.repeat(np.arange(len(n)), n), products, minlength=len(n)))
    return np.concatenate(found)


def _ordered(ids: pa.Array, x: np.ndarray, other: pa.Array, y: np.ndarray, w: np.ndarray) -> Iterator[pa.RecordBatch]:
    import pyarrow.compute as pc

    for k in range(0, len(w), OUT):
        one, two = ids.take(pa.array(x[k : k + OUT])), other.take(pa.array(y[k : k + OUT]))
        first = pc.less(one, two)
        yield pa.RecordBatch.from_arrays(
            [pc.if_else(first, one, two), pc.if_else(first, two, one), pa.array(w[k : k + OUT])], names=["src", "dst", "weight"]
        )


def _spelled(a: Rows, b: Rows, i: np.ndarray, j: np.ndarray, w: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows as pairs of their copies, a bounded number at a time."""
    na, nb = np.diff(a.copies)[i], np.diff(b.copies)[j]
    ends = (na * nb).cumsum()
    for k in range(0, int(ends[-1]) if len(ends) else 0, OUT):
        flat = np.arange(k, min(k + OUT, int(ends[-1])))
        pair = np.searchsorted(ends, flat, side="right")
        place = flat - (ends[pair] - na[pair] * nb[pair])
        yield a.copies[i[pair]] + place // nb[pair], b.copies[j[pair]] + place % nb[pair], w[pair]


def _among(a: Rows, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of copies within each row."""
    for row in np.nonzero(np.diff(a.copies) > 1)[0]:
        own = a.weights[a.start[row] : a.start[row + 1]]
        if (weight := float(own @ own)) > threshold:
            x, y = np.triu_indices(a.copies[row + 1] - a.copies[row], 1)
            yield x + a.copies[row], y + a.copies[row], np.full(len(x), weight)


def compared(blocks: DataFrame, n: int, threshold: float, result: str, plan: Plan) -> DataFrame:
    """All pairs above the threshold, of representatives or of all copies.

    ``result`` is ``edges`` or ``stars`` for ``(src, dst, weight)`` between representatives, all of them or so many that connect
    the same ones, ``full`` for those between all copies, and ``counts`` for ``(n_edges)`` of those.
    """
    from corpusmap.operators.graph import local_stars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacked: dict[int, Rows] = {}
        forest = Forest(plan.root)

        def rows(batch: pa.RecordBatch, side: str, k: int) -> tuple[int, Rows]:
            block = batch.column(f"{side}_block")[k].as_py()
            found = unpacked.pop(block, None) or _unpacked(batch, side, k, plan)
            unpacked[block] = found
            if len(unpacked) > UNPACKED:
                del unpacked[next(iter(unpacked))]
            return block, found

        for batch in batches:
            for k in range(batch.num_rows):
                (l, a), (r, b) = rows(batch, "l", k), rows(batch, "r", k)
                yield from of(a, b, l == r, forest, forest.place(l, len(a), a.hub), forest.place(r, len(b), b.hub))
            # Before the next one comes.
            del batch

    def of(a: Rows, b: Rows, same: bool, forest: Forest, at: int, to: int) -> Iterator[pa.RecordBatch]:
        total, starred = 0, []
        if result == "full" and same:
            for x, y, w in _among(a, threshold):
                yield from _ordered(a.ids, x, a.ids, y, w)
        if result == "counts" and same:
            total = sum(len(w) for _, _, w in _among(a, threshold))
        if result == "stars" and same and len(a.hub):
            # What the task starts with: rows that are connected through hubs.
            row = np.nonzero(a.hub >= 0)[0]
            yield from _ordered(a.ids, a.copies[row], plan.hubs, plan.root[a.hub[row]], np.ones(len(row)))
        if result == "stars":
            starred = [(i, j + (0 if same else len(a))) for i, j in _linked(a, b, same, threshold, forest, at, to)]
        for i, j, w in () if result == "stars" else _similar(a, b, same, threshold):
            if result == "counts":
                total += int((np.diff(a.copies)[i] * np.diff(b.copies)[j]).sum())
            elif result == "full":
                for x, y, v in _spelled(a, b, i, j, w):
                    yield from _ordered(a.ids, x, b.ids, y, v)
            else:
                led = a.lead[i] & b.lead[j]
                yield from _ordered(a.ids, a.copies[i[led]], b.ids, b.copies[j[led]], w[led])
        if result == "counts":
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], names=["n_edges"])
        if starred:
            u, v = local_stars(*(np.concatenate(c) for c in zip(*starred)))
            ids = pa.concat_arrays([a.ids, b.ids])
            place = np.concatenate([a.copies[:-1], b.copies[:-1] + len(a.ids)])
            yield from _ordered(ids, place[u], ids, place[v], np.ones(len(u)))

    held = max(1, min(n // 4, HELD[0]), min(n // 64, HELD[1]))
    parts = max(1, -(-n // held))
    sides = [blocks.coalesce(parts).select([F.col(c).alias(f"{tag}_{c}") for c in blocks.columns]) for tag in ("l", "r")]
    low, odd = F.col("l_block") < F.col("r_block"), (F.col("l_block") + F.col("r_block")) % 2 == 1
    # Each two blocks once, and about as many above the diagonal as below.
    once = (F.col("l_block") == F.col("r_block")) | ((F.col("l_block") != F.col("r_block")) & (low != odd))
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    schema = "n_edges bigint" if result == "counts" else f"src {kind}, dst {kind}, weight double"
    return sides[0].join(sides[1], once).mapInArrow(run, schema)
