"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space of the word contracts: the blank and the code points 9 to 13.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"

# Words of a shingle, unless a caller names another number, and the seed of its hash.
SHINGLE = 3
SEED = 42


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of its id as text leaves no remainder by 5; null ids are not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def words(text: Column) -> Column:
    """The words of a text, in order."""
    return F.array_remove(F.split(text, SPACE + "+"), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where the body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """``(doc_id, text, label)`` of at most ``rows`` labelled rows outside the held-out fold, chosen by a hash of the id.

    The chosen labels are bounded by ``rows`` and broadcast, so that no text is shuffled.
    """
    chosen = labels.filter(~held_out()).filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    chosen = chosen.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")


def map_rows(
    docs: DataFrame, each: Callable[[], Callable[[pa.RecordBatch, list[str]], pa.RecordBatch]], text_col: str = "text"
) -> DataFrame:
    """Whole rows through a function of a batch and its texts, a few hundred rows at a time; the columns stay.

    ``each`` is called once in every task and makes the function.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = each()
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                yield change(part, [t or "" for t in part.column(at).to_pylist()])

    return docs.mapInArrow(run, docs.schema)


def shingle_hashes(text: bytes, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of every word shingle of a text; of all its words where they are fewer; none without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    digest = xxhash.xxh64_intdigest
    shingles = map(b" ".join, zip(*(words[k:] for k in range(size))))
    return np.fromiter((digest(s, seed) for s in shingles), np.uint64, len(words) - size + 1)
