"""The three levels of detail of a dataset catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmap import schemas
from corpusmap.functions.text import list_or


def first_valid(col: str, order: str, sentinels: Sequence[str] = (), default: str | None = None) -> Column:
    """The first value, by ``order``, that is neither null nor a sentinel; an aggregate."""
    name, seq = F.col(col), F.col(order)
    valid = name.isNotNull() if not sentinels else name.isNotNull() & ~name.isin(*sentinels)
    # Rows that do not count get a null order, and min_by skips those.
    first = F.min_by(name, F.when(valid, seq))
    return first if default is None else F.coalesce(first, F.lit(default))


def basic_level(datasets: DataFrame) -> DataFrame:
    """Eight descriptive columns under their short names."""
    return datasets.select(
        F.col("dataset_id").alias("id"),
        F.col("dataset_origin").alias("origin"),
        F.col("dataset_url").alias("url"),
        "title",
        "keywords",
        "author",
        "date_creation",
        "description",
    )


def file_facts(files: DataFrame, dim: DataFrame) -> DataFrame:
    """Distinct extensions and engines per dataset, sorted; one shuffle, after map-side de-duplication.

    The dimension is joined without a hint, so that Spark broadcasts it by its measured size.
    """
    typed = files.filter(F.col("file_type") != "none").select("dataset_id", F.col("file_type").alias("type"))
    return (
        typed.join(dim.filter(F.col("engine") != "unknown"), "type", "left")
        .groupBy("dataset_id")
        .agg(
            F.sort_array(F.collect_set("type")).alias("file_extensions"),
            F.sort_array(F.collect_set("engine")).alias("software_engines"),
        )
        .withColumnRenamed("dataset_id", "id")
    )


def extended_level(basic: DataFrame, files: DataFrame, dim: DataFrame) -> DataFrame:
    """The basic level with file extensions and software engines."""
    return basic.join(file_facts(files, dim), "id", "left").select(
        *basic.columns,
        list_or(F.col("file_extensions"), "none").alias("file_extensions"),
        list_or(F.col("software_engines"), "unknown").alias("software_engines"),
    )


def has_extension(extended: DataFrame, extension: str = "gro") -> DataFrame:
    """Records with at least one file of that type."""
    return extended.filter(F.array_contains("file_extensions", extension))


def valid_ids(extended: DataFrame) -> DataFrame:
    """Distinct ids of the records that have structure files."""
    return has_extension(extended).select("id").distinct()


def facts_of(facts: DataFrame, valid: DataFrame) -> DataFrame:
    """Facts of the datasets in a set of valid ids."""
    return facts.join(valid, facts["dataset_id"] == valid["id"], "left_semi")


def gro_facts(gro: DataFrame) -> DataFrame:
    """First atom count and the logical OR of the content flags, per dataset."""
    return gro.groupBy(F.col("dataset_id").alias("id")).agg(
        first_valid("atom_number", "file_seq").alias("atom_number"),
        *[F.coalesce(F.bool_or(flag), F.lit(False)).alias(flag) for flag in schemas.HAS_FLAGS],
    )


def mdp_facts(mdp: DataFrame) -> DataFrame:
    """First valid run parameters per dataset."""
    return mdp.groupBy(F.col("dataset_id").alias("id")).agg(
        *[first_valid(c, "file_seq").alias(c) for c in ("dt", "nsteps", "temperature")],
        *[first_valid(c, "file_seq", ("no", "undefined"), "none").alias(c) for c in ("thermostat", "barostat")],
    )


def detailed_level(extended: DataFrame, gro: DataFrame, mdp: DataFrame) -> DataFrame:
    """Records with structure files, with structure and run facts where a dataset has both.

    The fact tables are aggregated before the joins: only partial aggregates are shuffled, and the joins
    on ``id`` reuse that partitioning. Joining to the filtered records drops the facts of all others.
    """
    facts = gro_facts(gro).join(mdp_facts(mdp), "id", "inner")
    return has_extension(extended).join(facts, "id", "left").select(*extended.columns, *schemas.FACT_COLUMNS)
