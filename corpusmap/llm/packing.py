"""Best-fit-decreasing packing of token pieces into sequences of equal capacity.

Pieces of one length are alike, so the packing of the whole table is decided from how many there are of each length: at
most ``capacity`` numbers come to the driver, whatever the data. Lengths fall from the longest; a segment tree over
the remaining capacities gives the tightest open bin that still fits, in logarithmic time, and bins with the
same history move together as one run. Only the last bins of a length split a run, and filling a run leaves less
than half of its room, so the plan has at most 4 x capacity x log2(2 x capacity) rows (98,304 at 2,048); it is
broadcast. Each piece finds its place by its rank among the pieces of its length: its number within the task that made
it, plus the counts of the tasks before. The result is that of one best-fit-decreasing run over all pieces.

Defined cases: a null or empty text is one piece with the closing id alone; repeated rows are packed each; an empty
table gives no rows; equal lengths are ordered by task and row. An added token of the file, such as a special one, is
found in plain text too, as the library does it. Only the named columns are read.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusmap.llm.bpe import Encoder, _texts
from corpusmap.scratch import Tables

CAPACITY = 2048
END_ID = 0
# Fixed value: the pattern by which files of this kind cut a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Runs of this many characters with or without white space could be slow or deep for a pattern engine.
LONG = 512
LONG_BLANK = re.compile(r"\s{512}")
END = struct.pack("<I", END_ID)


def ranks_of_tokenizer(text: str) -> dict[bytes, int]:
    """The ranks in a ``tokenizers`` file of byte-level BPE, whose ids follow the order of its merges."""
    model = json.loads(text)["model"]
    vocab = model["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if [vocab[a + b] for a, b in merges] != list(range(256, 256 + len(merges))):
        raise ValueError("the ids of this vocabulary do not follow its merges")
    # Bytes that print stand for themselves in such files, the others for code points from 256 on.
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printed]
    byte_of = {chr(b): b for b in printed} | {chr(256 + k): b for k, b in enumerate(others)}
    known = [a + b for a, b in merges] + list(byte_of)
    return {bytes(byte_of[c] for c in token): vocab[token] for token in known}


def added_of_tokenizer(text: str) -> dict[str, int]:
    """The added tokens of a ``tokenizers`` file and their ids."""
    made = json.loads(text)
    added = made.get("added_tokens") or []
    if added and made.get("normalizer") or any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that are matched other than by their plain content are not known here")
    return {t["content"]: t["id"] for t in added}


class PackedEncoder:
    """Ids of texts as bytes, unsigned and little-endian.

    ``tiktoken`` encodes by the ranks; a text with a long run goes through this library's own encoder, whose time and
    memory do not grow with the square of a run. Both give the ids of the file's own library.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.plain = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.patient: Encoder | None = None

    def packed(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The packed ids of each text."""
        for text in texts:
            if len(text) >= LONG and (max(map(len, text.split()), default=0) >= LONG or LONG_BLANK.search(text)):
                self.patient = self.patient or Encoder(self.ranks)
                yield np.array(next(iter(self.patient.encode([text]))), "<u4").tobytes()
            else:
                yield self.plain.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


def encode(encoder: PackedEncoder, added: dict[str, int], texts: Iterable[str]) -> Iterator[bytes]:
    """The packed ids of each text; it is cut at its leftmost, then longest, added tokens first."""
    if not added:
        yield from encoder.packed(texts)
        return
    cuts = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
    between: deque[list[bytes]] = deque()

    def parts() -> Iterator[str]:
        for text in texts:
            cut = cuts.split(text)
            between.append([struct.pack("<I", added[t]) for t in cut[1::2]])
            yield from cut[::2]

    found = iter(encoder.packed(parts()))
    for ids in found:
        tokens = between.popleft()
        yield b"".join([ids, *chain.from_iterable((token, next(found)) for token in tokens)]) if tokens else ids


class CapacityTree:
    """A segment tree over remaining capacities; each leaf holds the runs of open bins with that room."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.leaves)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def push(self, room: int, first: int, bins: int) -> None:
        """Add bins ``first .. first + bins - 1`` with ``room`` left."""
        self.runs[room].append((first, bins))
        self._mark(room, True)

    def pop(self, room: int) -> tuple[int, int]:
        """Take one run of bins with ``room`` left."""
        run = self.runs[room].pop()
        if not self.runs[room]:
            self._mark(room, False)
        return run

    def _mark(self, room: int, open_: bool) -> None:
        node = room + self.leaves
        self.open[node] = open_
        while node > 1:
            node //= 2
            self.open[node] = self.open[2 * node] or self.open[2 * node + 1]

    def tightest(self, length: int) -> int | None:
        """The smallest room of at least ``length`` that an open bin has."""
        node = length + self.leaves
        while not self.open[node]:
            # Up to the first ancestor with a subtree to the right, and down its left edge.
            while node & 1:
                node //= 2
            if not node:
                return None
            node += 1
            if not self.open[node]:
                continue
            break
        while node < self.leaves:
            node = 2 * node if self.open[2 * node] else 2 * node + 1
        return node - self.leaves


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing: rows ``(length, from_rank, to_rank, first_bin, per_bin, offset)``.

    The piece of rank r in ``[from_rank, to_rank)`` goes to bin ``first_bin + (r - from_rank) // per_bin``.
    """
    tree = CapacityTree(capacity)
    rows = []
    opened = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                bins = -(-left // (capacity // length))
                tree.push(capacity, opened, bins)
                opened += bins
                continue
            first, bins = tree.pop(room)
            fit = room // length
            full = min(bins, left // fit)
            for used, each in ((full, fit), (1 if full < bins and left - full * fit else 0, left - full * fit)):
                if not used:
                    continue
                rows.append((length, rank, rank + used * each, first, each, capacity - room))
                tree.push(room - each * length, first, used)
                first, bins, left, rank = first + used, bins - used, left - used * each, rank + used * each
            if bins:
                tree.push(room, first, bins)
    return rows


def pieces(
    docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Each text's tokens and the closing id, cut into pieces where they exceed the capacity.

    ``(doc_id, piece, start, length, ids_crc32, task, nth)``: ``nth`` numbers the pieces of one length within the task
    that made them. The table must be saved before it is packed.
    """
    with open(path, encoding="utf-8") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, added = PackedEncoder(ranks_of_tokenizer(shipped.value)), added_of_tokenizer(shipped.value)
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            row, rows = [], []
            for k, ids in enumerate(encode(encoder, added, _texts(batch.column(1)))):
                data = ids + END
                n = len(data) // 4
                start, length = 0, (n - 1) % capacity + 1
                for piece in range(-(-n // capacity)):
                    row.append(k)
                    rows.append((piece, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), seen[length]))
                    seen[length] += 1
                    start, length = start + length, capacity
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row, pa.int64())),
                    columns[0].cast(pa.int32()),
                    *columns[1:4],
                    pa.array(np.full(len(row), task, np.int32)),
                    columns[4],
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"],
            )

    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, nth bigint"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, schema)


PLAN = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("length", "from_rank", "to_rank", "first_bin", "per_bin", "base")]
)


def pack(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """A saved table of ``pieces`` with ``sequence_id`` and ``offset``."""
    spark: SparkSession = made.sparkSession
    tables = Tables(spark, "packing")
    counts = tables.save(made.groupBy("task", "length").agg(F.count("*").alias("n")), "counts")
    totals = counts.groupBy("length").agg(F.sum("n").alias("n"))
    # At most one row for each length up to the capacity.
    rows = plan({r["length"]: r["n"] for r in totals.collect()}, capacity)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    ranked = made.join(ahead, ["task", "length"]).withColumn("rank", F.col("nth") + F.col("ahead"))
    places = F.broadcast(spark.createDataFrame(rows, PLAN).withColumnRenamed("length", "plan_length"))
    at = F.col("rank") - F.col("from_rank")
    within = (
        (F.col("length") == F.col("plan_length"))
        & (F.col("rank") >= F.col("from_rank"))
        & (F.col("rank") < F.col("to_rank"))
    )
    return ranked.join(places, within).select(
        *[c for c in made.columns if c not in ("task", "nth")],
        (F.col("first_bin") + F.floor(at / F.col("per_bin"))).cast("bigint").alias("sequence_id"),
        (F.col("base") + at % F.col("per_bin") * F.col("length")).cast("bigint").alias("offset"),
    )


def pack_documents(
    docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Whole documents packed into sequences: the pieces of ``pieces`` with their places."""
    made = Tables(docs.sparkSession, "pieces").save(pieces(docs, path, capacity, id_col, text_col), "pieces")
    return pack(made, capacity)
