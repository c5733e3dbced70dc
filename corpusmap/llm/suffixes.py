"""Passages that occur twice, by blockwise suffix sorting with a difference cover.

The suffixes to compare are those that begin a whole window (400 bytes). Suffixes that agree on a window must lie in one
bucket: a bucket holds the suffixes whose window has the same least-hashed 64-byte string at the same place, so that each text
falls into units, runs of neighbouring suffixes around one such string. Units that agree as a whole are one, with a
number of occurrences, so that crowds of copies are settled by counting; units alone in their bucket have no partner.
What is left, the borders of repeated passages, is sorted: buckets go to blocks of bounded size, and in a block

* the ranks of a cover sample are computed first: positions whose residue by ``COVER`` is in a difference cover, ranked by their
  next 256 bytes through doubling; for any two positions some offset below ``COVER`` brings both into the sample;
* bucket by bucket suffixes are sorted by their first ``COVER`` bytes, and longer ties by the sample's ranks at the offset
  of each pair, once near the beginning and once near the end of the window; under ``COVER`` bytes at the end are left
  to compare. No suffix is ever compared byte by byte over its window.

A bucket with more than ``CROWD`` different units is cut into its suffixes, which Spark groups by a 128-bit hash of their window.

Defined cases: a null text counts as empty and nothing of it is removed; repeated rows are copies of each other, so that all of
them goes if they have a whole window; texts shorter than a window keep everything; empty tables give no rows; null and
repeated ids stay as they are, since texts are known by their hash. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmap.operators.skew import skew_join
from corpusmap.scratch import Tables

WINDOW, GRAM = 400, 64
# Positions of a buffer are the low bits of its hashes, so that the leftmost of equal strings is the least.
POSITION_BITS = 20
# Residues of the sample, and the bytes that its ranks cover.
COVER, RANKED = 64, 256
# Different units of a bucket beyond which it is cut into suffixes.
CROWD = 4096
# Bytes of text that a block holds.
BLOCK_BYTES = 2 << 20


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 64 bytes from each position on, by doubling from eight bytes."""
    h = np.ndarray(len(data) - 7, "<u8", data, strides=(1,)).copy()
    for step in (0, 8, 16, 32):
        if step:
            h = h[:-step] * np.uint64(0xC2B2AE3D27D4EB4F) + h[step:]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h


def least_in_window(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring keys."""
    span = 1
    while 2 * span <= width:
        keys = np.minimum(keys[:-span], keys[span:])
        span *= 2
    return np.minimum(keys[: len(keys) - (width - span)], keys[width - span :]) if span < width else keys


def units_of(buffer: bytes, pieces: list[tuple[int, int]], window: int = WINDOW):
    """Units of the pieces ``(begin, length)`` of a buffer: ``(lo, count, anchor offset, string hash)`` as arrays.

    A unit is ``count`` suffixes from ``lo`` on whose windows have the same least-hashed string.
    """
    data = np.frombuffer(buffer, np.uint8)
    valid = np.zeros(len(data) + 1, bool)
    opens = np.zeros(len(data) + 1, bool)
    for begin, length in pieces:
        if length >= window:
            valid[begin : begin + length - window + 1] = True
            opens[begin] = True
    if not valid.any():
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    h = gram_hashes(data)
    low = np.uint64((1 << POSITION_BITS) - 1)
    least = least_in_window(h & ~low | np.arange(len(h), dtype=np.uint64), window - GRAM + 1)
    anchor = (least & low).astype(np.int64)
    n = len(anchor)
    valid, opens = valid[: n + 1].copy(), opens[:n]
    valid[n] = False
    changed = np.append(True, anchor[1:] != anchor[:-1])
    lo = np.flatnonzero(valid[:n] & (opens | changed))
    ends = np.flatnonzero(valid[:n] & (~valid[1:] | np.append(opens[1:] | changed[1:], True)))
    return lo, ends - lo + 1, anchor[lo] - lo, h[anchor[lo]].view(np.int64)


def _pieces(texts: Iterator[bytes], window: int) -> Iterator[tuple[bytes, list[tuple[int, int, int, int]]]]:
    """Buffers of bounded size and their pieces ``(begin, length, row, offset in the text)``.

    A longer text is cut into pieces that overlap by a window less one, so that each suffix is in one piece.
    """
    most = 1 << (POSITION_BITS - 1)
    held: list[bytes] = []
    pieces, size = [], 0
    for row, text in enumerate(texts):
        for at in range(0, max(len(text) - window + 1, 0), most):
            part = text[at : at + most + window - 1]
            if size + len(part) > 2 * most - 8:
                yield b"".join(held), pieces
                held, pieces, size = [], [], 0
            held.append(part)
            pieces.append((size, len(part), row, at))
            size += len(part)
    if pieces:
        yield b"".join(held), pieces


def _bytes(column: pa.Array, rows: int = 256) -> Iterator[bytes]:
    for a in range(0, len(column), rows):
        for t in column.slice(a, rows).cast(pa.binary()).to_pylist():
            yield t or b""


UNITS = "k binary, lo bigint, size int, off int, h bigint, c1 bigint, c2 bigint"


def units(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """The units of texts ``(k, text)``: ``UNITS``, with a hash ``(c1, c2)`` of all bytes of a unit's windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for buffer, pieces in _pieces(_bytes(batch.column(1)), window):
                lo, size, off, h = units_of(buffer, [p[:2] for p in pieces], window)
                view = memoryview(buffer)
                ends = (lo + size + window - 1).tolist()
                digests = b"".join([xxhash.xxh3_128_digest(view[a:b], o) for a, b, o in zip(lo.tolist(), ends, off.tolist())])
                c = np.frombuffer(digests, np.int64).reshape(-1, 2)
                begins, _, rows, at = (np.array(x) for x in zip(*pieces))
                piece = np.searchsorted(begins, lo, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows[piece])), pa.array(lo - begins[piece] + at[piece]),
                     pa.array(size.astype(np.int32)), pa.array(off.astype(np.int32)), pa.array(h),
                     pa.array(c[:, 0].copy()), pa.array(c[:, 1].copy())],
                    names=["k", "lo", "size", "off", "h", "c1", "c2"],
                )

    return texts.mapInArrow(run, UNITS)


def difference_cover(v: int) -> np.ndarray:
    """Residues of which every difference by ``v`` is one of two of them, chosen greedily."""
    chosen, open_ = [0], set(range(1, v))
    while open_:
        def gain(x: int) -> int:
            return len({(x - c) % v for c in chosen} & open_ | {(c - x) % v for c in chosen} & open_)

        best = max((x for x in range(v) if x not in chosen), key=lambda x: (gain(x), -x))
        open_ -= {(best - c) % v for c in chosen} | {(c - best) % v for c in chosen}
        chosen.append(best)
    return np.array(sorted(chosen))


def offsets_into_cover(cover: np.ndarray, v: int) -> np.ndarray:
    """For two residues the least offset that brings both into the cover."""
    inside = np.zeros(v, bool)
    inside[cover] = True
    r = np.arange(v)
    shifted = inside[(r[:, None] + r[None, :]) % v]
    return (shifted[:, None, :] & shifted[None, :, :]).argmax(2)


def _ranked(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Dense ranks of rows with these keys, given their sorted order."""
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


class CoverRanks:
    """A text with the ranks of its cover sample: what the next ``RANKED`` bytes of two positions say about their order."""

    COVERED = difference_cover(COVER)
    OFFSETS = offsets_into_cover(COVERED, COVER)

    def __init__(self, data: np.ndarray) -> None:
        padded = np.concatenate([data, np.zeros(RANKED + 2 * COVER + 8, np.uint8)])
        self.words = np.ndarray(len(padded) - 7, ">u8", padded, strides=(1,))
        n = -(-len(data) // COVER) * COVER
        self.at = (np.arange(0, n, COVER)[:, None] + self.COVERED[None, :]).ravel()
        self.at = self.at[self.at < len(data)]
        self.place = np.zeros(len(padded), np.int64)
        self.place[self.at] = np.arange(1, len(self.at) + 1)
        columns = [self.words[self.at + 8 * j].astype(np.uint64) for j in range(COVER // 8)]
        rank = _ranked(np.lexsort(columns[::-1]), *columns)
        span = COVER
        while span < RANKED:
            after = self.place[np.minimum(self.at + span, len(padded) - 1)]
            second = np.where(after > 0, rank[after - 1] + 1, 0)
            rank = _ranked(np.lexsort((second, rank)), rank, second)
            span *= 2
        self.rank = rank

    def compare(self, a: np.ndarray, b: np.ndarray, window: int) -> np.ndarray:
        """The order (-1, 0, 1) of the windows at positions whose first ``COVER`` bytes agree."""
        out = np.zeros(len(a), np.int64)
        left = np.arange(len(a))
        for begin in (0, window - RANKED - COVER + 1):
            x, y = a[left] + begin, b[left] + begin
            offset = self.OFFSETS[x % COVER, y % COVER]
            out[left] = np.sign(self.rank[self.place[x + offset] - 1] - self.rank[self.place[y + offset] - 1])
            left = left[out[left] == 0]
        for back in range(COVER, 0, -8):
            x, y = self.words[a[left] + window - back], self.words[b[left] + window - back]
            out[left] = np.where(x > y, 1, np.where(x < y, -1, 0))
            left = left[out[left] == 0]
        return out


def _segments(order: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in their order that share all keys with another row, and their groups' numbers."""
    group = _ranked(order, *keys)[order]
    many = np.bincount(group, minlength=1)[group] > 1 if len(group) else np.zeros(0, bool)
    return order[many], group[many]


def repeated_suffixes(data: np.ndarray, at: np.ndarray, bucket: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which of the suffixes at positions ``at`` share their window with another one of their bucket."""
    found = np.zeros(len(at), bool)
    text = CoverRanks(data)
    order = np.argsort(bucket, kind="stable")
    rows, group = _segments(order, bucket)
    for j in range(0, COVER, 8):
        word = text.words[at[rows] + j].astype(np.uint64)
        order = np.lexsort((word, group))
        kept, regrouped = _segments(order, group, word)
        rows, group = rows[kept], regrouped
    # Ties beyond the first bytes: each group is split by the order against a pivot of its own.
    while len(rows):
        begin = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        size = np.diff(np.append(begin, len(group)))
        pivot = np.repeat(rows[begin + size // 2], size)
        side = text.compare(at[rows], at[pivot], window)
        order = np.lexsort((side, group))
        kept, regrouped = _segments(order, group, side)
        equal = side[kept] == 0
        found[rows[kept[equal]]] = True
        rows, group = rows[kept[~equal]], regrouped[~equal]
    return found


def _sorted_block(block: pa.Table, window: int) -> pa.Table:
    """Ranges ``(k, lo, size)`` of suffixes with a partner in their bucket, of units that occur once."""
    # The same unit comes again if a task was repeated.
    contexts = block.column("context").to_pylist()
    size, off, h = (block.column(c).to_numpy().astype(np.int64) for c in ("size", "off", "h"))
    bases = np.cumsum([0] + [len(c) for c in contexts])[:-1]
    owner = np.repeat(np.arange(len(size)), size)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    number = np.unique(h, return_inverse=True)[1]
    data = np.frombuffer(b"".join(contexts), np.uint8)
    found = repeated_suffixes(data, bases[owner] + nth, number[owner] * (window + 1) + off[owner] - nth, window)
    found &= block.column("n").to_numpy()[owner] == 1
    at = np.flatnonzero(found)
    begins = at[np.append(True, (np.diff(at) > 1) | (owner[at][1:] != owner[at][:-1]))[: len(at)]]
    ends = at[np.append((np.diff(at) > 1) | (owner[at][1:] != owner[at][:-1]), True)[: len(at)]]
    unit = pa.array(owner[begins])
    lo = block.column("lo").to_numpy()[owner[begins]] + nth[begins]
    return pa.table({"k": block.column("k").take(unit), "lo": pa.array(lo), "size": pa.array((ends - begins + 1).astype(np.int32))})


def _contexts(texts: DataFrame, window: int) -> DataFrame:
    """The units asked for, with the bytes of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for k, text, asked in zip(batch.column(0).to_pylist(), _bytes(batch.column(1), 16), batch.column(2)):
                made = asked.as_py() or []
                for a in range(0, len(made), 4096):
                    part = made[a : a + 4096]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k] * len(part), pa.binary()),
                         *[pa.array([u[c] for u in part], t) for c, t in
                           (("lo", pa.int64()), ("size", pa.int32()), ("off", pa.int32()), ("h", pa.int64()),
                            ("n", pa.int64()), ("crowded", pa.bool_()))],
                         pa.array([text[u["lo"] : u["lo"] + u["size"] + window - 1] for u in part], pa.binary())],
                        names=["k", "lo", "size", "off", "h", "n", "crowded", "context"],
                    )
                row += 1

    schema = "k binary, lo bigint, size int, off int, h bigint, n bigint, crowded boolean, context binary"
    return texts.select("k", "text", "asked").mapInArrow(run, schema)


def _suffix_hashes(contexts: DataFrame, window: int) -> DataFrame:
    """``(x1, x2, k, lo, n)``: each suffix of the units by a hash of its window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                k, lo, size, _, _, n, _, context = (c[r].as_py() for c in batch.columns)
                view = memoryview(context)
                x = np.frombuffer(b"".join([xxhash.xxh3_128_digest(view[i : i + window]) for i in range(size)]), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[:, 0].copy()), pa.array(x[:, 1].copy()), pa.array([k] * size, pa.binary()),
                     pa.array(lo + np.arange(size)), pa.array(np.full(size, n))],
                    names=["x1", "x2", "k", "lo", "n"],
                )

    return contexts.mapInArrow(run, "x1 bigint, x2 bigint, k binary, lo bigint, n bigint")


def _cut(texts: DataFrame, window: int) -> DataFrame:
    """``(k, n_removed, spans, kept_sha256)`` of texts with ranges of repeated suffixes."""
    schema = "k binary, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept_sha256 string"
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, digests = [], [], []
            for text, ranges in zip(_bytes(batch.column(1), 16), batch.column(2)):
                runs: list[list[int]] = []
                for r in sorted(ranges.as_py(), key=lambda r: r["lo"]):
                    end = r["lo"] + r["size"] + window - 1
                    if runs and r["lo"] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], end)
                    else:
                        runs.append([r["lo"], end])
                digest, at = hashlib.sha256(), 0
                for a, b in runs:
                    digest.update(text[at:a])
                    at = b
                digest.update(text[at:])
                removed.append(sum(b - a for a, b in runs))
                spans.append([{"start": a, "end": b} for a, b in runs])
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(digests, pa.string())],
                names=["k", "n_removed", "spans", "kept_sha256"],
            )

    return texts.select("k", "text", "ranges").mapInArrow(run, schema)


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, crowd: int = CROWD
) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans)``: what is left without bytes of repeated windows.

    Spans are byte offsets of the maximal removed runs, ends exclusive.
    """
    if window < RANKED + COVER:
        raise ValueError(f"windows have {RANKED + COVER} bytes at least")
    tables = Tables(docs.sparkSession, "suffixes")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.md5(text)).alias("k"), text.alias("text"))
    own = [F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("own_sha256")]
    made = units(keyed.select("k", "text").filter(F.octet_length("text") >= window), window)
    # The units of equal texts are one row with their number.
    counted = made.groupBy("k", "lo").agg(
        F.count("*").alias("n"), *[F.max(c).alias(c) for c in ("size", "off", "h", "c1", "c2")])
    counted = tables.save(counted, "units")
    first = F.min(F.struct("k", "lo", "size", "off", "h"))
    contexts = tables.save(
        counted.groupBy("c1", "c2").agg(F.sum("n").alias("n"), first.alias("u")).select("c1", "c2", "n", "u.*"), "contexts")
    shared = contexts.groupBy("h").agg(F.count("*").alias("m")).filter("m > 1")
    asked = skew_join(contexts, tables.save(shared, "shared"), ["h"], F.col("c1"))
    unit = F.struct("lo", "size", "off", "h", "n", (F.col("m") > crowd).alias("crowded"))
    asked, seen = tables.save_measured(
        asked.select("k", "size", "m", unit.alias("unit")), "asked",
        size=F.sum(F.when(F.col("m") <= crowd, F.col("size") + (window - 1))), crowded=F.count_if(F.col("m") > crowd))
    again = skew_join(counted, contexts.filter("n > 1").select("c1", "c2"), ["c1", "c2"], F.xxhash64("k", "lo"), "left_semi")
    again = tables.save(again.select("k", F.struct("lo", "size").alias("range")), "again")
    # Both lists are bounded by the text's own length.
    wanted = asked.select("k", "unit", F.lit(None).cast(again.schema["range"].dataType).alias("range")).unionByName(
        again.select("k", F.lit(None).cast(asked.schema["unit"].dataType).alias("unit"), "range"))
    wanted = wanted.groupBy("k").agg(F.collect_list("unit").alias("asked"), F.collect_list("range").alias("ranges"))
    texts = tables.save(keyed.select("k", "text").dropDuplicates(["k"]).join(wanted, "k"), "texts")
    found = tables.save(_contexts(texts.filter(F.size("asked") > 0), window), "contexts_of_texts")
    blocks = max(1, -(-(seen["size"] or 0) // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("h"), F.lit(blocks)).cast("int")
    calm = found.filter("NOT crowded").withColumn("block", block)
    hits = calm.groupBy("block").applyInArrow(lambda t: _sorted_block(t, window), "k binary, lo bigint, size int")
    if seen["crowded"]:
        suffixes = tables.save(_suffix_hashes(found.filter("crowded"), window), "suffixes")
        twice = suffixes.groupBy("x1", "x2").agg(F.count("*").alias("t")).filter("t > 1").select("x1", "x2")
        cut = skew_join(suffixes, twice, ["x1", "x2"], F.xxhash64("k", "lo"), "left_semi").filter("n = 1")
        hits = hits.unionByName(cut.select("k", "lo", F.lit(1).alias("size")))
    more = tables.save(hits.groupBy("k").agg(F.collect_list(F.struct("lo", "size")).alias("more")), "hits")
    ranged = texts.join(more, "k", "left").withColumn("ranges", F.concat("ranges", F.coalesce("more", F.array())))
    cut = tables.save(_cut(ranged.filter(F.size("ranges") > 0), window), "cut")
    rows = tables.save(keyed.select("doc_id", "k", *own), "rows")
    return skew_join(rows, cut, ["k"], F.xxhash64("doc_id"), "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce(F.size("spans"), F.lit(0)).cast("bigint").alias("n_spans"),
        F.coalesce("kept_sha256", "own_sha256").alias("kept_sha256"),
        F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"),
    )
