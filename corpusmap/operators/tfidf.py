"""TF-IDF over record texts.

Terms are counted within each text, so that no table of terms and records is grouped or shuffled to be counted. Only per-term
totals, reduced map-side, are shuffled by term. A bounded vocabulary is sent to every task, which turns texts into sparse rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmap.functions.arrow import lengths
from corpusmap.functions.stopwords import ENGLISH
from corpusmap.functions.text import tokens

MAX_FEATURES = 10_000


def stop_list(stop_words: str | Sequence[str] | None) -> tuple[str, ...]:
    if stop_words is None:
        return ()
    if stop_words == "english":
        return ENGLISH
    if isinstance(stop_words, str):
        raise ValueError(f"stop_words must be 'english' or a list of words, not {stop_words!r}")
    return tuple(stop_words)


def kept_words(texts: DataFrame, stop_words: str | Sequence[str] | None) -> DataFrame:
    """``(id, words)``: the kept words of each record, in no order. Texts are gathered by id only if ids repeat."""
    texts = texts.select("id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    if texts.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        found = tokens(F.col("text"))
    else:
        texts = texts.groupBy("id").agg(F.collect_list("text").alias("texts"))
        found = F.flatten(F.transform("texts", tokens))
    stops = stop_list(stop_words)
    return texts.select("id", (F.filter(found, lambda w: ~w.isin(*stops)) if stops else found).alias("words"))


def _counted(texts: DataFrame, stop_words) -> DataFrame:
    """``(id, terms)`` with the distinct kept words of a record and their numbers: equal ones are neighbours once sorted."""
    words = kept_words(texts, stop_words).select("id", F.sort_array("words").alias("words"))
    first = F.filter(
        F.sequence(F.lit(0), F.size("words") - 1),
        lambda i: (i == 0) | (F.get(F.col("words"), i) != F.get(F.col("words"), i - 1)),
    )
    none = F.array().cast("array<int>")
    runs = words.select("id", "words", F.when(F.size("words") > 0, first).otherwise(none).alias("first"))

    def term(i: Column, k: Column) -> Column:
        end = F.coalesce(F.get(F.col("first"), k + 1), F.size("words"))
        return F.struct(F.get(F.col("words"), i).alias("term"), (end - i).cast("bigint").alias("tf"))

    return runs.select("id", F.transform("first", term).alias("terms"))


def term_counts(texts: DataFrame, stop_words: str | Sequence[str] | None = "english") -> DataFrame:
    """Occurrences of each kept term per record: ``(id, term, tf)``."""
    counted = _counted(texts, stop_words)
    # The outer form, as Spark would else find all terms of a text a second time to pass over texts without any.
    return counted.select("id", F.inline_outer("terms")).select("id", "term", "tf").filter("term IS NOT NULL")


def doc_freq(counts: DataFrame) -> DataFrame:
    """Records and occurrences per term: ``(term, df, tf)``."""
    return counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def tfidf_fit(
    texts: DataFrame, max_features: int | None = MAX_FEATURES, stop_words: str | Sequence[str] | None = "english"
) -> DataFrame:
    """The vocabulary ``(term, df, tf, idf, index)``: the most frequent terms, with smooth idf.

    ``index`` numbers the terms from the most to the least widespread. With ``max_features=None`` all terms are kept
    and, since nothing bounds them, not numbered.
    """
    n_docs = texts.count()
    terms = doc_freq(term_counts(texts, stop_words)).withColumn(
        "idf", F.log(F.lit(1.0 + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0
    )
    if max_features is None:
        return terms.withColumn("index", F.lit(None).cast("int"))
    top = terms.orderBy(F.desc("tf"), F.asc("term")).limit(max_features)
    # At most max_features rows, so one task numbers them.
    return top.withColumn("index", F.row_number().over(Window.orderBy(F.desc("df"), F.asc("term"))) - 1)


def tfidf_rows(
    texts: DataFrame,
    vocabulary: DataFrame,
    stop_words: str | Sequence[str] | None = "english",
) -> DataFrame:
    """One sparse unit vector per record: ``(id, entries)``, entries sorted by term index.

    The vocabulary must be bounded, as it is sent to every task. Lengths are summed in index order, so copies of a text get
    bit-identical vectors.
    """
    known = vocabulary.select("term", "index", "idf").filter(F.col("index").isNotNull()).toArrow()
    order = np.argsort(known.column("index").to_numpy())
    shipped = texts.sparkSession.sparkContext.broadcast(known.take(pa.array(order)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shipped.value
        terms = table.column("term").combine_chunks()
        index, idf = table.column("index").to_numpy(), table.column("idf").to_numpy()
        for batch in batches:
            words = batch.column("words")
            place = pc.index_in(words.flatten(), value_set=terms)
            row = np.repeat(np.arange(len(words)), lengths(words))[place.is_valid().to_numpy(zero_copy_only=False)]
            cell, tf = np.unique(row * max(len(terms), 1) + place.drop_null().to_numpy(), return_counts=True)
            row, at = np.divmod(cell, max(len(terms), 1))
            raw = tf * idf[at]
            norm = np.sqrt(np.bincount(row, raw * raw, minlength=len(words)))
            ends = np.concatenate([[0], np.bincount(row, minlength=len(words)).cumsum()]).astype(np.int32)
            entry = pa.StructArray.from_arrays(
                [pa.array(index[at], pa.int32()), terms.take(pa.array(at)).cast(pa.string()), pa.array(raw / norm[row], pa.float64())],
                names=["index", "term", "weight"],
            )
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(ends), entry)], names=["id", "entries"])

    kind = texts.schema["id"].dataType.simpleString()
    schema = f"id {kind}, entries array<struct<index: int, term: string, weight: double>>"
    return kept_words(texts, stop_words).mapInArrow(run, schema)


def tfidf_transform(
    texts: DataFrame,
    vocabulary: DataFrame,
    stop_words: str | Sequence[str] | None = "english",
) -> DataFrame:
    """Unit-length weights as a long table ``(id, term, weight)``."""
    rows = tfidf_rows(texts, vocabulary, stop_words)
    return rows.select("id", F.inline("entries")).select("id", "term", "weight")


def sparse_vectors(rows: DataFrame) -> DataFrame:
    """Sparse rows as ``(id, indices, weights)``, terms dropped."""
    return rows.select(
        "id",
        F.transform("entries", lambda x: x["index"]).alias("indices"),
        F.transform("entries", lambda x: x["weight"]).alias("weights"),
    )
