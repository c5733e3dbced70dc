"""Texts to unit vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmap.functions.arrow import lengths, unit_rows
from corpusmap.functions.vectors import normalize
from corpusmap.operators.tfidf import kept_words, tfidf_fit
from corpusmap.scratch import Tables, materialize

BATCH = 16
HASHING_DIM = 256
# Most widespread terms that are sent to every task.
FREQUENT = 200_000
# TF-IDF stores keep a longer image.
TFIDF_DIM = 1024


@dataclass(frozen=True)
class Model:
    """Published weights and the way their token vectors become one vector."""

    weights: str
    pooling: str


# The selectable transformer models.
MODELS = {
    "BERT": Model("bert-base-uncased", "cls"),
    "SciBERT": Model("allenai/scibert_scivocab_uncased", "cls"),
    "BioBERT": Model("dmis-lab/biobert-v1.1", "cls"),
    "SciNCL": Model("malteos/scincl", "cls"),
    "SBERT": Model("sentence-transformers/all-mpnet-base-v2", "mean"),
    "PubMedBERT": Model("microsoft/BiomedNLP-PubMedBERT-base-uncased-abstract-fulltext", "cls"),
    "all-MiniLM-L6-v2": Model("sentence-transformers/all-MiniLM-L6-v2", "mean"),
}
# A loader returns a function from a list of texts to an (n, d) matrix.
Encoder = Callable[[list[str]], np.ndarray]
_LOADERS: dict[str, Callable[[], Encoder]] = {}


def register_model(name: str, loader: Callable[[], Encoder]) -> None:
    """Supply the encoder of a model; the loader runs once per Python worker."""
    _LOADERS[name] = loader


def check_model(name: str) -> None:
    known = {*MODELS, *_LOADERS, "hashing", "tfidf"}
    if name not in known:
        raise ValueError(f"model must be one of {sorted(known)}, not {name!r}")


def embed(df: DataFrame, text_col: str = "text", model: str = "hashing", dim: int = HASHING_DIM) -> DataFrame:
    """``(id, embedding)``: unit vectors of a text column, by a registered encoder or by feature hashing."""
    check_model(model)
    texts = df.select("id", F.col(text_col).alias("text"))
    if model == "hashing":
        return embed_hashing(texts, dim=dim)
    if model not in _LOADERS:
        raise ValueError(f"model {model!r} needs an encoder: call register_model({model!r}, loader) first")
    loader = _LOADERS[model]

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = loader()
        for batch in batches:
            texts = batch.fillna("").tolist()
            parts = [np.asarray(encoder(texts[i : i + BATCH])) for i in range(0, len(texts), BATCH)]
            yield pd.Series(list(np.concatenate(parts).astype(float))) if parts else pd.Series([], dtype=object)

    encoded = texts.select("id", encode("text").alias("v"))
    return encoded.select("id", normalize(F.col("v")).cast("array<float>").alias("embedding"))


def hash_bucket(term: Column, dim: int) -> Column:
    """The dimension a term falls into."""
    return F.pmod(F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int")


def hash_sign(term: Column) -> Column:
    """Plus or minus one, from another part of the same hash."""
    return F.when(F.substring(F.md5(term), 9, 1).isin(*"02468ace"), F.lit(1.0)).otherwise(F.lit(-1.0))


def embed_hashing(
    texts: DataFrame,
    dim: int = HASHING_DIM,
    vocabulary: DataFrame | None = None,
    stop_words: str | Sequence[str] | None = "english",
) -> DataFrame:
    """Signed feature hashing of the TF-IDF weights of all terms; a text without any gives the zero vector.

    Terms are hashed once each, in the vocabulary. Pass the corpus vocabulary to embed queries alike. The most widespread terms go
    to every task, which sums them within each text; only a text's other terms are joined to the vocabulary. The vectors are
    saved, and what they were summed from is removed.
    """
    tables = Tables(texts.sparkSession, "hashing")
    if vocabulary is None:
        vocabulary = materialize(tfidf_fit(texts, None, stop_words), "vocabulary")
    hashed = vocabulary.select(
        "term", "df", "idf", hash_bucket(F.col("term"), dim).alias("bucket"), hash_sign(F.col("term")).alias("sign")
    )
    frequent = hashed.orderBy(F.desc("df"), "term").limit(FREQUENT).toArrow()
    words = _frequent_sums(kept_words(texts, stop_words), frequent, dim)
    dense = _dense_unit(dim)
    if frequent.num_rows < FREQUENT:
        return tables.save(words.select("id", dense("buckets", "sums").alias("embedding")), "vectors")
    tables.release()
    summed = tables.save(words, "sums")
    rare = hashed.filter(F.col("df") <= F.lit(frequent.column("df")[-1].as_py()))
    rest = summed.select("id", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tf").alias("tf"))))
    weights = rest.join(rare, "term").select("id", "bucket", (F.col("sign") * F.col("tf") * F.col("idf")).alias("value"))
    added = weights.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("bucket", "value"))).alias("added"))
    buckets = F.concat("buckets", F.coalesce(F.col("added.bucket"), F.array().cast("array<int>")))
    sums = F.concat("sums", F.coalesce(F.col("added.value"), F.array().cast("array<double>")))
    found = tables.save(summed.join(added, "id", "left").select("id", dense(buckets, sums).alias("embedding")), "vectors")
    tables.drop("sums")
    tables.release()
    return found


def _frequent_sums(words: DataFrame, frequent: pa.Table, dim: int) -> DataFrame:
    """``(id, buckets, sums, terms, tf)``: the sums of a text's frequent terms by bucket, and its other terms with their numbers."""
    shipped = words.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shipped.value
        terms = table.column("term").combine_chunks()
        bucket = table.column("bucket").to_numpy()
        weight = table.column("sign").to_numpy() * table.column("idf").to_numpy()

        def listed(row: np.ndarray, *columns: pa.Array) -> list[pa.Array]:
            ends = pa.array(np.concatenate([[0], np.bincount(row, minlength=n).cumsum()]).astype(np.int32))
            return [pa.ListArray.from_arrays(ends, c) for c in columns]

        for batch in batches:
            n, flat = batch.num_rows, batch.column("words").flatten()
            place = pc.index_in(flat, value_set=terms)
            known = place.is_valid().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(n), lengths(batch.column("words")))
            at = place.drop_null().to_numpy()
            cell, of = np.unique(row[known] * dim + bucket[at], return_inverse=True)
            sums = np.bincount(of, weight[at], minlength=len(cell))
            other = flat.filter(pa.array(~known)).dictionary_encode()
            pair, tf = np.unique(row[~known] * max(len(other.dictionary), 1) + other.indices.to_numpy(), return_counts=True)
            owner, term = np.divmod(pair, max(len(other.dictionary), 1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), *listed(cell // dim, pa.array((cell % dim).astype(np.int32)), pa.array(sums, pa.float64())),
                    *listed(owner, other.dictionary.take(pa.array(term)).cast(pa.string()), pa.array(tf.astype(np.int64))),
                ],
                names=["id", "buckets", "sums", "terms", "tf"],
            )

    kind = words.schema["id"].dataType.simpleString()
    schema = f"id {kind}, buckets array<int>, sums array<double>, terms array<string>, tf array<bigint>"
    return words.mapInArrow(run, schema)


def _dense_unit(dim: int):
    """Bucket sums as dense unit vectors, a batch of records at a time."""

    @F.arrow_udf("array<float>")
    def scatter(buckets: pa.Array, sums: pa.Array) -> pa.Array:
        row = np.repeat(np.arange(len(buckets)), lengths(buckets))
        cells = np.bincount(row * dim + buckets.flatten().to_numpy(), sums.flatten().to_numpy(), minlength=len(buckets) * dim)
        flat = unit_rows(cells.reshape(len(buckets), dim)).astype(np.float32).ravel()
        return pa.ListArray.from_arrays(np.arange(0, flat.size + 1, dim, dtype=np.int32), flat)

    return scatter


def pool_cls(token_vectors: DataFrame) -> DataFrame:
    """The vector of the first token of each text."""
    return token_vectors.filter(F.col("pos") == 0).select("id", "embedding")


def pool_mean(token_vectors: DataFrame) -> DataFrame:
    """The mean of the token vectors of each text, one aggregate per dimension and text."""
    means = (
        token_vectors.select("id", F.posexplode("embedding").alias("dim", "value"))
        .groupBy("id", "dim")
        .agg(F.avg(F.col("value").cast("double")).alias("value"))
    )
    entries = F.sort_array(F.collect_list(F.struct("dim", "value")))
    return means.groupBy("id").agg(F.transform(entries, lambda e: e["value"]).alias("embedding"))
