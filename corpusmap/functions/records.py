"""Rows as JSON documents and as string maps, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_document(*cols: str) -> Column:
    """A row as JSON text, nulls kept."""
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def parse_document(col: Column, schema: T.StructType | str) -> Column:
    """A JSON document as a struct."""
    return F.from_json(col, schema)


def to_metadata(df: DataFrame, *cols: str) -> Column:
    """Columns as a map of strings; arrays and structs as JSON text, a null as ``None``."""
    values = []
    for name in cols:
        col, kind = F.col(name), df.schema[name].dataType
        nested = isinstance(kind, (T.ArrayType, T.MapType, T.StructType))
        values.append(F.coalesce(F.to_json(col) if nested else col.cast("string"), F.lit("None")))
    return F.map_from_arrays(F.array(*[F.lit(c) for c in cols]), F.array(*values))


def as_store_rows(level: DataFrame, id_col: str = "id") -> DataFrame:
    """``(id, metadata, document)`` for each record of a level."""
    cols = level.columns
    return level.select(
        F.col(id_col).cast("string").alias("id"),
        to_metadata(level, *cols).alias("metadata"),
        to_document(*cols).alias("document"),
    )


def stored_vectors(vectors: DataFrame, level: DataFrame) -> DataFrame:
    """``(id, embedding, metadata, document)``: the vectors of a level's records with their store rows.

    Metadata and documents, which hold a record twice, are made of the joined records, so that those are shuffled once.
    """
    cols = level.columns
    return vectors.select("id", "embedding").join(level, "id").select(
        F.col("id").cast("string").alias("id"),
        "embedding",
        to_metadata(level, *cols).alias("metadata"),
        to_document(*cols).alias("document"),
    )


def first_engine(col: Column) -> Column:
    """The first engine of a list stored as text, or a default."""
    return F.coalesce(
        F.try_element_at(F.from_json(col, "array<string>"), F.lit(1)), F.lit("No Software Engine")
    )
