"""Cosine threshold joins, strict ``similarity > threshold``, each unordered pair once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmap.functions.arrow import lengths, matrix, values
from corpusmap.functions.vectors import normalize
from corpusmap.operators import blocks as B
from corpusmap.operators import cells as C
from corpusmap.operators.cells import chunks
from corpusmap.operators.copies import Groups, collapse, count_edges, expand_edges
from corpusmap.scratch import Tables

# Bound comparisons allow for rounding; the final comparison is exact.
SLACK = 1e-9
POSTING_BLOCK = 4096
POSTING_ROWS = 20_000
BOUNDARIES = 48
# Products of postings for each row, and foreign cells that a vector visits, beyond which rows are compared in blocks. The
# visits are counted for one of so many vectors.
FEW_PRODUCTS, FEW_VISITS, COUNTED = 16, 8, 64


@dataclass
class SimilarVectors:
    """A similarity graph over distinct vectors: ``edges(src, dst, weight)`` between representatives."""

    groups: Groups
    edges: DataFrame

    def full_edges(self) -> DataFrame:
        """Edges between all ids."""
        return expand_edges(self.edges, self.groups)

    def counts(self) -> DataFrame:
        """``(n_nodes, n_edges)`` of the graph over all ids."""
        return count_edges(self.edges, self.groups)

    def pairs(self) -> DataFrame:
        """All edges between representatives, for a single reading: ``(src, dst)``."""
        return self.edges.select("src", "dst")

    def links(self) -> DataFrame:
        """Edges ``(src, dst)`` that connect the same representatives as all edges."""
        return self.edges.select("src", "dst")


@dataclass
class SimilarBlocks:
    """A similarity graph of rows whose edges are found in blocks when they are asked for, and not kept unless they are
    needed more than once."""

    groups: Groups
    blocks: DataFrame
    n_blocks: int
    plan: B.Plan
    threshold: float
    tables: Tables
    kept: dict[str, DataFrame] = field(default_factory=dict)

    def _compared(self, result: str) -> DataFrame:
        return B.compared(self.blocks, self.n_blocks, self.threshold, result, self.plan)

    @property
    def edges(self) -> DataFrame:
        """Edges between representatives, saved when they are first asked for."""
        if "edges" not in self.kept:
            self.kept["edges"] = self.tables.save(self._compared("edges"), "edges")
        return self.kept["edges"]

    def full_edges(self) -> DataFrame:
        """Edges between all ids."""
        return self._compared("full")

    def counts(self) -> DataFrame:
        """``(n_nodes, n_edges)`` of the graph over all ids."""
        nodes = self.groups.reps.agg(F.sum("n_copies").alias("n_nodes"))
        edges = self._compared("counts").agg(F.coalesce(F.sum("n_edges"), F.lit(0)).alias("n_edges"))
        return nodes.join(edges)

    def pairs(self) -> DataFrame:
        """All edges between representatives, for a single reading: ``(src, dst)``, not kept."""
        return self._compared("edges").select("src", "dst")

    def links(self) -> DataFrame:
        """Edges ``(src, dst)`` that connect the same representatives as all edges."""
        return self._compared("stars").select("src", "dst")


def check_threshold(threshold: float) -> None:
    if not 0.0 < threshold <= 1.0:
        raise ValueError(f"threshold must lie in (0, 1], not {threshold}")


def similarity_join(
    df: DataFrame, threshold: float, id_col: str = "id", vec_col: str = "embedding", method: str = "exact"
) -> DataFrame:
    """All pairs ``(src, dst, weight)`` with cosine above the threshold."""
    return similar_vectors(df, threshold, id_col, vec_col, method).full_edges()


def similar_vectors(
    df: DataFrame, threshold: float, id_col: str = "id", vec_col: str = "embedding", method: str = "exact"
) -> SimilarVectors | SimilarBlocks:
    """The similarity graph of dense vectors, over distinct vectors.

    ``exact`` joins within metric cells: cosine above t means a distance below sqrt(2 - 2t) between unit
    vectors, so a high threshold leaves each vector few cells to visit. Where vectors would visit many, and be copied for each of
    them, all are compared in blocks (``blocks.py``). ``lsh`` compares vectors that share
    a hash cell.
    """
    check_threshold(threshold)
    if method not in ("exact", "lsh"):
        raise ValueError(f"method must be 'exact' or 'lsh', not {method!r}")
    tables = Tables(df.sparkSession, "simjoin")
    tables.release()
    unit = df.select(F.col(id_col).alias("id"), normalize(F.col(vec_col)).alias("vec"))
    groups = collapse(unit, ["vec"], tables)
    nonzero = F.exists("vec", lambda x: x != 0)
    own = _self_weight(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x), threshold)
    groups = replace(groups, reps=groups.reps.withColumn("self_weight", own))
    distinct = groups.reps.filter(nonzero).select(F.col("rep").alias("id"), "vec")
    if method == "lsh":
        from corpusmap.operators.lsh import lsh_pairs

        edges = lsh_pairs(distinct, threshold, tables)
    else:
        cells = C.build_cells(distinct, tables)
        if _many_visits(cells, threshold):
            tables.drop("homes")
            size = F.size("vec")
            terms = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
            weights = F.transform("vec", lambda x: F.coalesce(x, F.lit(float("nan"))))
            reps = groups.reps.select("rep", "n_copies", "self_weight", terms.alias("indices"), weights.alias("weights"))
            return _in_blocks(replace(groups, reps=reps), threshold, tables)
        edges = _cell_pairs(cells, distinct, threshold, tables)
    return SimilarVectors(groups, tables.save(edges, "edges"))


def _self_weight(squares: Column, threshold: float) -> Column:
    """The similarity of a vector to its copies, null where it is not above the threshold."""
    return F.when(squares > threshold, squares)


def threshold_kernel(threshold: float, id_type: pa.DataType):
    """Pairs of two blocks of unit vectors above the threshold; a block against itself gives each pair once."""

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        src, dst, weight = [], [], []
        if left.num_rows and right.num_rows:
            a, b = values(left.column("id")), values(right.column("id"))
            same = left.column("qb")[0].as_py() == left.column("cb")[0].as_py()
            va, vb = matrix(left.column("vec")), matrix(right.column("vec"))
            for part in chunks(len(va), len(vb)):
                sims = va[part] @ vb.T
                i, j = np.nonzero(sims > threshold)
                w = sims[i, j]
                i = i + part.start
                keep = a[i] < b[j] if same else a[i] != b[j]
                i, j, w = i[keep], j[keep], w[keep]
                swap = a[i] > b[j]
                src.append(np.where(swap, b[j], a[i]))
                dst.append(np.where(swap, a[i], b[j]))
                weight.append(w)
        join = lambda parts: np.concatenate(parts) if parts else []
        return pa.table(
            {
                "src": pa.array(join(src), type=id_type),
                "dst": pa.array(join(dst), type=id_type),
                "weight": pa.array(join(weight), type=pa.float64()),
            }
        )

    return kernel


def arrow_id_type(df: DataFrame, col: str = "id") -> pa.DataType:
    """The Arrow type of an id column."""
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    name = df.schema[col].dataType.simpleString()
    if name not in kinds:
        raise ValueError(f"ids must be string, bigint or int, not {name}")
    return kinds[name]


def _radius(threshold: float) -> float:
    """The distance of unit vectors whose cosine is the threshold."""
    return float(np.sqrt(max(0.0, 2.0 - 2.0 * threshold))) + 1e-6


def _many_visits(cells: C.Cells, threshold: float) -> bool:
    """Whether vectors visit so many foreign cells that copying them for each would cost more than comparing all."""
    if len(cells.counts) <= FEW_VISITS:
        return False
    some = cells.homes.filter(F.pmod("h", F.lit(COUNTED)) == 0)
    return C.visits(cells, some, _radius(threshold), earlier_only=True).count() > FEW_VISITS * some.count()


def _cell_pairs(cells: C.Cells, distinct: DataFrame, threshold: float, tables: Tables) -> DataFrame:
    guests = tables.save(C.visits(cells, cells.homes, _radius(threshold), earlier_only=True), "guests")
    home_blocks = C.n_blocks(cells.counts)
    guest_blocks = C.n_blocks(C.cell_counts(guests, len(cells.counts)))

    def query_fan(cell, h):
        own = h % home_blocks[cell]
        return own, own, home_blocks[cell] + guest_blocks[cell]

    def home_fan(cell, h):
        own = h % home_blocks[cell]
        return own, np.zeros(len(cell), dtype=np.int64), own + 1

    def guest_fan(cell, h):
        return home_blocks[cell] + h % guest_blocks[cell], np.zeros(len(cell), dtype=np.int64), home_blocks[cell]

    queries = C.spread(cells.homes, "queries", query_fan)
    candidates = C.spread(cells.homes, "candidates", home_fan).unionByName(
        C.spread(guests, "candidates", guest_fan)
    )
    kernel = threshold_kernel(threshold, arrow_id_type(distinct))
    return C.compare(queries, candidates, kernel, f"src {cells.id_type}, dst {cells.id_type}, weight double")


# Sparse vectors


def sparse_similarity_join(rows: DataFrame, threshold: float) -> DataFrame:
    """All pairs of sparse unit rows ``(id, indices, weights)`` with cosine above the threshold."""
    return similar_sparse(rows, threshold).full_edges()


def similar_sparse(rows: DataFrame, threshold: float) -> SimilarVectors | SimilarBlocks:
    """The similarity graph of sparse unit rows, over distinct rows.

    Where posted terms are shared by many rows, rows are compared in blocks (``blocks.py``). Else they meet under rare terms.
    ``indices`` are ascending and number the terms from the most widespread to the rarest. Of each row only
    the rare terms are posted, so many that the terms left out, its *head*, have a joint length of at most
    the threshold; two rows above it then share a posted term. The products of a pair's shared posted terms
    are summed. What is not summed lies below the larger of the two cuts, so the lengths of both rows below
    it bound the rest. Pairs whose sum and bound exceed the threshold are verified on the whole rows.
    """
    check_threshold(threshold)
    tables = Tables(rows.sparkSession, "sparsejoin")
    groups = collapse(rows.select("id", "indices", "weights"), ["indices", "weights"], tables)
    own = _self_weight(F.aggregate("weights", F.lit(0.0), lambda s, x: s + x * x), threshold)
    groups = replace(groups, reps=groups.reps.withColumn("self_weight", own))
    reps = groups.reps.select(F.col("rep").alias("id"), "indices", "weights")
    listed = _prefix_postings(reps, threshold)
    held = F.col("held").cast("double")
    lists = listed.groupBy("term").agg(F.count("*").alias("held")).agg(F.sum(held * (held - 1) / 2)).first()
    if (lists[0] or 0.0) > FEW_PRODUCTS * reps.count():
        return _in_blocks(groups, threshold, tables, sparse=True)
    postings = tables.save(listed, "postings")
    pairs = tables.save(_candidates(postings, threshold), "candidates")
    a = reps.select(F.col("id").alias("src"), F.col("indices").alias("ai"), F.col("weights").alias("aw"))
    b = reps.select(F.col("id").alias("dst"), F.col("indices").alias("bi"), F.col("weights").alias("bw"))
    verified = (
        pairs.join(a, "src")
        .join(b, "dst")
        .select("src", "dst", _sparse_dot()("ai", "aw", "bi", "bw").alias("weight"))
        .filter(F.col("weight") > threshold)
    )
    return SimilarVectors(groups, tables.save(verified, "edges"))


def _in_blocks(groups: Groups, threshold: float, tables: Tables, sparse: bool = False) -> SimilarBlocks:
    tables.release()
    arrow_id_type(groups.reps, "rep")
    blocks, n, plan = B.pack(groups, tables, threshold, sparse)
    # The blocks hold the rows from now on.
    slim = tables.save(groups.reps.select("rep", "n_copies", "self_weight"), "sizes")
    members = groups.members if groups.has_copies else slim.select(F.col("rep").alias("id"), "rep")
    tables.drop("reps")
    tables.release()
    return SimilarBlocks(replace(groups, members=members, reps=slim), blocks, n, plan, threshold, tables)


def _prefix_postings(reps: DataFrame, threshold: float) -> DataFrame:
    """Postings ``(id, term, w, rest, cut, head, below)``.

    ``rest`` is the length of the more widespread terms, ``head`` that of the terms not posted, ``cut`` the
    first of some fixed term boundaries at or above the posted range, and ``below`` the lengths below each.
    """
    id_type = reps.schema["id"].dataType.simpleString()
    last = reps.agg(F.max(F.try_element_at("indices", F.lit(-1)))).first()[0] or 0
    bounds = np.unique(np.geomspace(1, last + 2, BOUNDARIES).astype(np.int64))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = lengths(batch.column("indices"))
            row = np.repeat(np.arange(len(size)), size)
            term = batch.column("indices").flatten().to_numpy().astype(np.int64)
            square = batch.column("weights").flatten().to_numpy() ** 2
            first = np.concatenate([[0], size.cumsum()[:-1]]).astype(int)
            before = np.concatenate([[0.0], square.cumsum()])
            upto = before[1:] - before[first][row]
            posted = upto > threshold * threshold - SLACK
            n_head = np.bincount(row[~posted], minlength=len(size))
            head = np.sqrt(np.maximum(before[first + n_head] - before[first], 0.0))
            # Terms below a boundary: the summed squares of each row, cut at the boundary.
            ends = np.searchsorted(row * (bounds[-1] + 1) + term, np.arange(len(size))[:, None] * (bounds[-1] + 1) + bounds)
            below = np.sqrt(np.maximum(before[ends] - before[first][:, None], 0.0)).astype(np.float32)
            kept = np.nonzero(posted)[0]
            owner = row[kept]
            start = np.full(len(size), last + 1, dtype=np.int64)
            np.minimum.at(start, owner, term[kept])
            cut = np.searchsorted(bounds, start).astype(np.int32)
            flat = pa.ListArray.from_arrays(
                np.arange(0, below.size + 1, below.shape[1], dtype=np.int32), np.nextafter(below, np.float32(2)).ravel()
            )
            for i in range(0, len(kept), POSTING_ROWS):
                part = slice(i, i + POSTING_ROWS)
                taken = pa.array(owner[part])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(taken),
                        pa.array(term[kept[part]]),
                        pa.array(np.sqrt(square[kept[part]])),
                        pa.array(np.sqrt(np.maximum(upto[kept[part]] - square[kept[part]], 0.0))),
                        pa.array(cut[owner[part]]),
                        pa.array(head[owner[part]]),
                        flat.take(taken),
                    ],
                    names=["id", "term", "w", "rest", "cut", "head", "below"],
                )

    schema = f"id {id_type}, term bigint, w double, rest double, cut int, head double, below array<float>"
    return reps.filter(F.size("indices") > 0).mapInArrow(post, schema)


def _candidates(postings: DataFrame, threshold: float) -> DataFrame:
    """Pairs that share a posted term and may exceed the threshold: ``(src, dst)``, each once.

    A widespread term is cut into blocks, and each pair of blocks is a join key, so no task gets its whole
    posting list. Products are summed per pair map-side first.
    """
    size = postings.groupBy("term").agg(F.ceil(F.count("*") / POSTING_BLOCK).cast("int").alias("n"))
    blocked = postings.join(size, "term").withColumn("b", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))

    def side(tag: str) -> list[Column]:
        return [F.col(c).alias(f"{tag}_{c}") for c in ("id", "w", "rest", "cut", "head", "below")]

    left = blocked.select(
        "term", F.col("b").alias("lb"), F.explode(F.sequence(F.col("b"), F.col("n") - 1)).alias("rb"), *side("l")
    )
    right = blocked.select(
        F.col("term").alias("r_term"), F.explode(F.sequence(F.lit(0), F.col("b"))).alias("r_lb"),
        F.col("b").alias("r_rb"), *side("r"),
    )
    met = left.join(
        right,
        (F.col("term") == F.col("r_term"))
        & (F.col("lb") == F.col("r_lb"))
        & (F.col("rb") == F.col("r_rb"))
        & ((F.col("lb") < F.col("rb")) | (F.col("l_id") < F.col("r_id"))),
    )

    def below_cut(tag: str, other: str) -> Column:
        # Of two rows with the same cut either may have posted more, so both take the length at the boundary.
        at = F.get(F.col(f"{tag}_below"), F.col(f"{other}_cut")).cast("double")
        return F.when(F.col(f"{tag}_cut") <= F.col(f"{other}_cut"), at).otherwise(F.col(f"{tag}_head"))

    product = F.col("l_w") * F.col("r_w")
    rows = met.select(
        F.least("l_id", "r_id").alias("src"),
        F.greatest("l_id", "r_id").alias("dst"),
        product.alias("product"),
        (product + F.col("l_rest") * F.col("r_rest")).alias("at_term"),
        (below_cut("l", "r") * below_cut("r", "l")).alias("unseen"),
    )
    summed = rows.groupBy("src", "dst").agg(
        F.sum("product").alias("seen"), F.max("at_term").alias("at_term"), F.max("unseen").alias("unseen")
    )
    least = threshold - SLACK
    return summed.filter((F.col("at_term") > least) & (F.col("seen") + F.col("unseen") > least)).select("src", "dst")


def _sparse_dot():
    """Inner products of sparse rows, a batch of pairs at a time."""

    @F.arrow_udf("double")
    def dot(ai: pa.Array, aw: pa.Array, bi: pa.Array, bw: pa.Array) -> pa.Array:
        n = len(ai)
        row_a = np.repeat(np.arange(n), lengths(ai))
        row_b = np.repeat(np.arange(n), lengths(bi))
        ta, tb = ai.flatten().to_numpy().astype(np.int64), bi.flatten().to_numpy().astype(np.int64)
        width = int(max(ta.max(initial=0), tb.max(initial=0))) + 1
        _, ia, ib = np.intersect1d(row_a * width + ta, row_b * width + tb, assume_unique=True, return_indices=True)
        products = aw.flatten().to_numpy()[ia] * bw.flatten().to_numpy()[ib]
        return pa.array(np.bincount(row_a[ia], products, minlength=n).astype(np.float64))

    return dot
