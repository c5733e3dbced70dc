"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are made in one pass over the texts; from there on only eight bytes per document move. Searching works
on distinct fingerprints, so that copies cost nothing. Bits that correlate are put into the same part, because a
part of independent bits would be more selective than one of the same width that mostly repeats itself, and a search
can then avoid the unselective parts: each fingerprint allots its own thresholds ``e_i >= -1`` to the parts, with
``sum(e_i + 1) = radius + 1``, by dynamic programming on the candidates that it expects. Any fingerprint within
the radius agrees with it up to ``e_i`` in at least one part, so that probing those values finds all, and every
candidate is verified. Expected candidates come from histograms of half parts over all distinct fingerprints, which
are of fixed size.

Where a probe would still meet a crowded cell, its fingerprint leaves the probing and meets the other crowded ones
through the values within half the radius: two fingerprints lie within an even radius exactly if such
values meet, and each value links its fingerprints to the smallest, so that a crowd never becomes pairs. Pairs
of a crowded and another fingerprint are found by the probes of the other, which search all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmap.llm import near_copies
from corpusmap.llm.bpe import _texts
from corpusmap.llm.common import SHINGLE, shingle_hashes
from corpusmap.operators.graph import connected_components
from corpusmap.scratch import Tables

BITS = 64
RADIUS = 2
PARTS = 3
# Rows of a cell beyond which its probes count as crowded.
CROWD = 64
# Expected candidates that one more probe is worth.
PROBE_COST = 0.25
# Shingles whose bits are counted at once.
VOTES = 1 << 16


def simhash(hashes: np.ndarray) -> int:
    """A bit is set if more than half of the hashes set it; zero without hashes."""
    counts = np.zeros(BITS, np.int64)
    for a in range(0, len(hashes), VOTES):
        part = hashes[a : a + VOTES].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(texts: pa.Array, size: int = SHINGLE) -> pa.Array:
    found = [simhash(shingle_hashes(t.encode("utf-8", "surrogatepass"), size)) for t in _texts(texts)]
    return pa.array(np.array(found, np.uint64).view(np.int64))


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE
) -> DataFrame:
    """``(doc_id, fp)``, the fingerprint as a signed 64-bit number."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _fingerprints(batch.column(1), shingle)], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, fp bigint")


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def correlated_parts(fps: DataFrame, parts: int = PARTS) -> list[list[int]]:
    """The bits in ``parts`` groups of nearly equal size, correlated ones together.

    Counts how often two bits are set together, over all fingerprints: 4,096 sums.
    """

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        n = 0
        for batch in batches:
            bits = _bits(batch.column(0).to_numpy()).astype(np.float32)
            n += len(bits)
            # Batches are far below 2^24 rows, so the sums are exact.
            total += (bits.T @ bits).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(BITS * BITS + 1)), pa.array(np.append(total.ravel(), n))], names=["cell", "n"]
        )

    rows = fps.select("fp").mapInArrow(together, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    sums = np.zeros(BITS * BITS + 1)
    for r in rows.collect():
        sums[r["cell"]] = r["n"]
    n, both = max(sums[-1], 1), sums[:-1].reshape(BITS, BITS)
    share = np.diag(both) / n
    spread = np.sqrt(np.outer(share * (1 - share), share * (1 - share)))
    related = np.abs(np.divide(both / n - np.outer(share, share), spread, out=np.zeros((BITS, BITS)), where=spread > 0))
    left, groups = list(range(BITS)), []
    for k in range(parts):
        size = -(-len(left) // (parts - k))
        first = max(left, key=lambda i: (related[i, left].sum() - related[i, i], -i))
        group = [first]
        while len(group) < size:
            rest = [i for i in left if i not in group]
            group.append(max(rest, key=lambda i: (related[i, group].sum(), -i)))
        groups.append(sorted(group))
        left = [i for i in left if i not in group]
    return groups


def _extract(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """The value of the given bits, packed."""
    out = np.zeros(len(fps), np.int64)
    for k, b in enumerate(bits):
        out |= ((fps >> np.int64(b)) & np.int64(1)) << np.int64(k)
    return out


def _flips(width: int, radius: int) -> np.ndarray:
    """All masks of at most ``radius`` of ``width`` bits, fewest bits first."""
    masks = [0]
    for r in range(1, radius + 1):
        masks += [sum(1 << b for b in c) for c in combinations(range(width), r)]
    return np.array(masks, np.int64)


@dataclass
class Estimates:
    """For each half part: how many fingerprints lie at each distance from each of its values."""

    parts: list[list[int]]
    halves: list[list[list[int]]]
    at_distance: list[list[np.ndarray]]
    total: int

    def expected(self, fps: np.ndarray, part: int, radius: int) -> np.ndarray:
        """Expected fingerprints within each distance up to the radius in a part, halves taken as independent."""
        a, b = (t[:, _extract(fps, h)] for t, h in zip(self.at_distance[part], self.halves[part]))
        exact = [sum(a[i] * b[d - i] for i in range(d + 1)) / max(self.total, 1) for d in range(radius + 1)]
        return np.cumsum(exact, axis=0)


def estimates(fps: DataFrame, parts: list[list[int]], radius: int) -> Estimates:
    """Histograms of the half parts over all fingerprints: at most 2^11 counts for each of six halves."""
    halves = [[p[: len(p) // 2], p[len(p) // 2 :]] for p in parts]
    flat = [h for pair in halves for h in pair]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(1 << len(h), np.int64) for h in flat]
        for batch in batches:
            values = batch.column(0).to_numpy()
            for s, h in zip(sums, flat):
                s += np.bincount(_extract(values, h), minlength=len(s))
        for k, s in enumerate(sums):
            some = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(some), k)), pa.array(some), pa.array(s[some])], names=["half", "value", "n"]
            )

    rows = (
        fps.select("fp").mapInArrow(count, "half bigint, value bigint, n bigint")
        .groupBy("half", "value").agg(F.sum("n").alias("n")).collect()
    )
    counts = [np.zeros(1 << len(h)) for h in flat]
    for r in rows:
        counts[r["half"]][r["value"]] = r["n"]
    tables = []
    for c, h in zip(counts, flat):
        values = np.arange(len(c))
        near = []
        for d in range(radius + 1):
            masks = [m for m in _flips(len(h), d) if int(m).bit_count() == d]
            near.append(sum((c[values ^ m] for m in masks), np.zeros(len(c))))
        tables.append(np.array(near))
    return Estimates(parts, halves, [tables[2 * k : 2 * k + 2] for k in range(len(parts))], int(counts[0].sum()))


def allot(cost: np.ndarray, radius: int) -> np.ndarray:
    """Thresholds by dynamic programming: ``cost[part, e + 1, row]`` is minimised with ``sum(e + 1) = radius + 1``.

    Returns ``e`` by part and row; the first of equal allotments wins.
    """
    parts, _, n = cost.shape
    best = np.full((radius + 2, n), np.inf)
    best[0] = 0
    chosen = np.zeros((parts, radius + 2, n), np.int8)
    for p in range(parts):
        after = np.full((radius + 2, n), np.inf)
        for s in range(radius + 2):
            for e in range(s + 1):
                value = best[s - e] + cost[p, e]
                better = value < after[s]
                after[s] = np.where(better, value, after[s])
                chosen[p, s] = np.where(better, e, chosen[p, s])
        best = after
    out = np.zeros((parts, n), np.int8)
    left = np.full(n, radius + 1)
    for p in reversed(range(parts)):
        took = chosen[p, left, np.arange(n)]
        out[p] = took - 1
        left = left - took
    return out


def _probes(fps: DataFrame, known: Estimates, radius: int) -> DataFrame:
    """``(fp, part, value)``: the values that each fingerprint looks up."""
    flips = [[_flips(len(p), e) for e in range(radius + 1)] for p in known.parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy()
            cost = np.zeros((len(known.parts), radius + 2, len(values)))
            for p in range(len(known.parts)):
                sizes = np.array([len(f) for f in flips[p]])
                cost[p, 1:] = known.expected(values, p, radius) + PROBE_COST * sizes[:, None]
            allotted = allot(cost, radius)
            for p, bits in enumerate(known.parts):
                own = _extract(values, bits)
                for e in range(radius + 1):
                    rows = np.flatnonzero(allotted[p] == e)
                    masks = flips[p][e]
                    if len(rows):
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.repeat(values[rows], len(masks))),
                                pa.array(np.full(len(rows) * len(masks), p, np.int32)),
                                pa.array((own[rows][:, None] ^ masks).ravel()),
                            ],
                            names=["fp", "part", "value"],
                        )

    return fps.select("fp").mapInArrow(run, "fp bigint, part int, value bigint")


def _index(fps: DataFrame, parts: list[list[int]]) -> DataFrame:
    """``(other, part, value)``: every fingerprint under its value in every part."""

    def value(bits: list[int]):
        packed = F.lit(0).cast("bigint")
        for k, b in enumerate(bits):
            packed = packed.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", b).bitwiseAND(F.lit(1)), k))
        return packed

    cells = F.array(*[F.struct(F.lit(p).alias("part"), value(b).alias("value")) for p, b in enumerate(parts)])
    return fps.select(F.col("fp").alias("other"), F.inline(cells))


def _near_balls(crowd: DataFrame, radius: int) -> DataFrame:
    """Links within a crowd: values within half the radius, each linking its fingerprints to the smallest."""
    masks = [int(np.uint64(m).view(np.int64)) for m in _flips_of_all(radius // 2)]
    around = crowd.select("fp", F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask"))
    met = around.select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("point"))
    first = met.groupBy("point").agg(F.min("fp").alias("src"), F.max("fp").alias("last")).filter("src < last")
    return met.join(first.select("point", "src"), "point").filter("fp <> src").select("src", F.col("fp").alias("dst"))


def _flips_of_all(radius: int) -> list[int]:
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(BITS), r)]


def links(fps: DataFrame, radius: int = RADIUS, parts: int = PARTS, crowd: int = CROWD) -> DataFrame:
    """Links ``(src, dst)`` that connect all distinct fingerprints within an even radius of each other.

    ``fps`` is a saved table of distinct fingerprints ``(fp)``. Pairs with a fingerprint outside crowds are all
    there; within a crowd the links connect what is within the radius, through smallest members.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    tables = Tables(fps.sparkSession, "near_dup_links")
    known = estimates(fps, correlated_parts(fps, parts), radius)
    probes = tables.save(_probes(fps, known, radius), "probes")
    index = _index(fps, known.parts)
    crowded_cells = index.groupBy("part", "value").agg(F.count("*").alias("n")).filter(F.col("n") > crowd)
    crowded_cells = tables.save(crowded_cells.select("part", "value"), "crowded_cells")
    crowded = tables.save(probes.join(crowded_cells, ["part", "value"], "left_semi").select("fp").distinct(), "crowded")
    calm = probes.join(crowded, "fp", "left_anti")
    # A crowded cell is not met by any probe that is left, so its rows need not be sent.
    met = calm.join(index.join(crowded_cells, ["part", "value"], "left_anti"), ["part", "value"])
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("other")))
    found = met.filter((F.col("fp") != F.col("other")) & (apart <= radius)).select(
        F.least("fp", "other").alias("src"), F.greatest("fp", "other").alias("dst")
    )
    return found.distinct().unionByName(_near_balls(crowded, radius).distinct())


def _labels(made: DataFrame, tables: Tables, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(fp, first, component, component_id)`` for each distinct mark ``fp`` of a saved table: its smallest id, its group and
    the smallest id of that.

    ``search`` gives the links between the distinct marks. A group is the smallest mark in it: ids may repeat or be null.
    """
    firsts = tables.save(made.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    found = tables.save(search(firsts.select("fp")), "links")
    ends = found.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    roots = connected_components(ends, found).select(F.col("id").alias("fp"), "component")
    linked = tables.save(roots.join(firsts, "fp"), "linked")
    lowest = linked.groupBy("component").agg(F.min("first").alias("component_id"))
    moved = linked.join(lowest, "component").select("fp", "component", "component_id")
    return firsts.join(moved, "fp", "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component"), F.coalesce("component_id", "first").alias("component_id"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS
) -> DataFrame:
    """``(doc_id, fp, component_id)``: the smallest id that a document reaches over links within the radius.

    Defined cases: a null or empty text has fingerprint zero and links like any other; repeated rows are documents of
    one component; null ids are no component's smallest id unless nothing else is in it; empty tables give no rows.
    """
    tables = Tables(docs.sparkSession, "near_dup")
    made = tables.save(fingerprints(docs, id_col, text_col), "fingerprints")
    labels = _labels(made, tables, lambda fps: links(fps, radius))
    return made.join(labels, "fp").select("doc_id", "fp", "component_id")


def filter_documents(
    docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, similarity: float | None = None
) -> DataFrame:
    """One row of ``docs`` (with ``doc_id`` and ``text``) for each component, with all its columns.

    Texts are linked by fingerprints of ``shingle`` words within the radius or, where a ``similarity`` is given, by sets of
    ``shingle``-word shingles of this Jaccard similarity or more, which is exact. That of the smallest id stays, and of
    rows with this id one with the smallest mark (fingerprint, or key of the set). Texts without words are alike.
    """
    tables = Tables(docs.sparkSession, "near_dup")
    if similarity is not None:
        return _filter_copies(docs, shingle, similarity, tables)
    made = tables.save(fingerprints(docs, shingle=shingle), "fingerprints")
    labels = _labels(made, tables, lambda fps: links(fps, radius)).filter("first <=> component_id")
    stay = labels.groupBy("component_id").agg(F.min("fp").alias("fp")).select(F.col("fp").alias("_fp"))
    marked = _marked(docs, lambda texts: _fingerprints(texts, shingle)).join(
        tables.save(labels.join(stay, F.col("fp") == F.col("_fp")).select("fp", "first"), "stay"),
        F.col("_mark") == F.col("fp"))
    own = marked.filter(F.col("row.doc_id").eqNullSafe(F.col("first")))
    return own.dropDuplicates(["_mark"]).select("row.*")


def _filter_copies(docs: DataFrame, shingle: int, similarity: float, tables: Tables) -> DataFrame:
    """The rows that stay, known by their ids and text hashes, so that the sets are made once."""
    made = tables.save(near_copies.keyed(docs, shingle, similarity), "sets")
    labels = _labels(made.select("doc_id", F.col("key").alias("fp")), tables,
                     lambda _: near_copies.links(docs, made, shingle, similarity)).filter("first <=> component_id")
    # By the group and not by its smallest id: groups that have the same smallest id, or none, each keep a row.
    stay = labels.groupBy("component").agg(F.min("fp").alias("key"), F.min("component_id").alias("component_id"))
    rows = made.join(stay, "key").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    rows = rows.groupBy("key").agg(F.min(F.struct("doc_id", "text_hash")).alias("row"))
    rows = tables.save(rows.select(F.col("row.doc_id").alias("_id"), F.col("row.text_hash").alias("_hash")), "stay")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (near_copies.text_hash() == F.col("_hash"))
    twice = made.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).filter("n > 1")
    twice = tables.save(twice.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")), "twice")
    again = (F.col("a._hash") == F.col("b._hash")) & F.col("a._id").eqNullSafe(F.col("b._id"))
    kept = docs.join(rows.alias("a").join(twice.alias("b"), again, "left_anti"), same).drop("_id", "_hash")
    if twice.isEmpty():
        return kept
    # Rows that agree in id and text: one stays.
    more = docs.join(rows.alias("a").join(twice.alias("b"), again, "left_semi"), same)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    more = more.groupBy("_id", "_hash").agg(F.min_by(whole, F.xxhash64(whole)).alias("row"))
    return kept.unionByName(more.select("row.*"))


def _marked(docs: DataFrame, marks: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """``(row, _mark)``: whole rows with their marks."""
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("_mark", T.LongType())])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                row = pa.StructArray.from_arrays(part.columns, fields=list(part.schema))
                yield pa.RecordBatch.from_arrays([row, marks(part.column(at))], names=["row", "_mark"])

    return docs.mapInArrow(run, schema)
