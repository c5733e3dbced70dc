"""Scans of the catalogue tables and of written levels and vectors."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmap import schemas
from corpusmap.sources.writers import vocabulary_path


def _scan(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read Parquet, and fail at once when a column is missing or of another type."""
    found = {field.name: field.dataType for field in spark.read.parquet(path).schema.fields}
    for field in schema.fields:
        if found.get(field.name) != field.dataType:
            raise ValueError(
                f"{path}: column {field.name} should be {field.dataType.simpleString()}, found {found.get(field.name)}"
            )
    return spark.read.schema(schema).parquet(path)


def read_datasets(spark: SparkSession, path: str) -> DataFrame:
    """The dataset catalogue."""
    return _scan(spark, path, schemas.DATASETS)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The file list, one row per file."""
    return _scan(spark, path, schemas.FILES)


def read_gro(spark: SparkSession, path: str) -> DataFrame:
    """Facts read from structure files."""
    return _scan(spark, path, schemas.GRO)


def read_mdp(spark: SparkSession, path: str) -> DataFrame:
    """Facts read from run-parameter files."""
    return _scan(spark, path, schemas.MDP)


def file_types(spark: SparkSession, entries: Iterable[dict[str, str]]) -> DataFrame:
    """The ``file_types`` list of a configuration file as rows ``(ord, type, engine)``."""
    rows = [(i, entry["type"], entry["engine"]) for i, entry in enumerate(entries)]
    return spark.createDataFrame(rows, "ord int, type string, engine string")


def file_type_dim(types: DataFrame) -> DataFrame:
    """One engine per file type; of several entries for a type the last one counts."""
    return types.groupBy("type").agg(F.max_by("engine", "ord").alias("engine"))


def read_level(spark: SparkSession, path: str, level: str) -> DataFrame:
    """A level from JSON; every file is an array or has one record per line. A malformed file is an error."""
    reader = spark.read.schema(schemas.level_schema(level)).option("mode", "FAILFAST")
    by_layout = _files_by_layout(spark, path)
    parts = [reader.option("multiLine", array).json(files) for array, files in by_layout.items()]
    # Without a line in any file there is nothing to tell a layout by.
    return reduce(DataFrame.unionByName, parts or [reader.json(path)])


def _files_by_layout(spark: SparkSession, path: str) -> dict[bool, list[str]]:
    """The files with a line that is not blank, by whether the first opens an array; one row for each file is read."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )
    told = lines.filter(F.trim("value") != "").withColumn("at", F.struct("block", F.monotonically_increasing_id()))
    firsts = told.groupBy("file").agg(F.min_by(F.ltrim("value").startswith("["), "at").alias("array"))
    found: dict[bool, list[str]] = {}
    for row in sorted(firsts.collect()):
        found.setdefault(row["array"], []).append(row["file"])
    return found


def read_vectors(spark: SparkSession, base: str, dataset: str, model: str) -> DataFrame:
    """The stored vectors of one dataset and model, with ``idx``, the id up to its first underscore."""
    stored = (
        spark.read.schema(
            T.StructType([*schemas.VECTORS.fields, *[T.StructField(c, T.StringType()) for c in ("dataset", "model")]])
        )
        .parquet(base)
        .filter((F.col("dataset") == dataset) & (F.col("model") == model))
    )
    if stored.filter(F.col("embedding").isNotNull()).isEmpty():
        raise ValueError(f"{base} holds no vectors of dataset {dataset!r} and model {model!r}")
    return stored.select(*schemas.VECTORS.names, F.split_part("id", F.lit("_"), F.lit(1)).alias("idx"))


def read_vocabulary(spark: SparkSession, base: str, dataset: str, model: str) -> DataFrame:
    """The vocabulary of a store, see ``writers.write_vocabulary``."""
    return spark.read.parquet(vocabulary_path(base, dataset, model))


def read_file_types(spark: SparkSession, path: str) -> DataFrame:
    """The ``file_types`` list of a YAML file as rows ``(ord, type, engine)``."""
    try:
        import yaml
    except ImportError as error:
        raise ImportError("reading YAML needs PyYAML; pass the list to file_types() instead") from error
    text = "\n".join(row["value"] for row in spark.read.text(path, wholetext=True).collect())
    return file_types(spark, yaml.safe_load(text)["file_types"])


def read_sparse(spark: SparkSession, base: str, dataset: str) -> DataFrame:
    """The exact TF-IDF rows ``(id, indices, weights)`` of a store."""
    return spark.read.parquet(f"{base.rstrip('/')}_sparse/dataset={dataset}").select("id", "indices", "weights")
