"""Table schemas."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.StringType()) for name in names]


HAS_FLAGS = ("has_protein", "has_nucleic", "has_glucid", "has_lipid", "has_water_ion")

DATASETS = T.StructType(
    _strings(
        "dataset_id", "dataset_origin", "dataset_url", "title", "keywords", "author", "date_creation", "description"
    )
)
FILES = T.StructType(
    [
        T.StructField("dataset_id", T.StringType()),
        T.StructField("file_seq", T.IntegerType()),
        T.StructField("file_type", T.StringType()),
    ]
)
GRO = T.StructType(
    [
        T.StructField("dataset_id", T.StringType()),
        T.StructField("file_seq", T.IntegerType()),
        T.StructField("atom_number", T.LongType()),
        *[T.StructField(flag, T.BooleanType()) for flag in HAS_FLAGS],
    ]
)
MDP = T.StructType(
    [
        T.StructField("dataset_id", T.StringType()),
        T.StructField("file_seq", T.IntegerType()),
        T.StructField("dt", T.DoubleType()),
        T.StructField("nsteps", T.LongType()),
        T.StructField("temperature", T.DoubleType()),
        *_strings("thermostat", "barostat"),
    ]
)

BASIC = T.StructType(_strings("id", "origin", "url", "title", "keywords", "author", "date_creation", "description"))
EXTENDED = T.StructType(
    BASIC.fields
    + [
        T.StructField("file_extensions", T.ArrayType(T.StringType())),
        T.StructField("software_engines", T.ArrayType(T.StringType())),
    ]
)
FACT_COLUMNS = ("atom_number", *HAS_FLAGS, "dt", "nsteps", "temperature", "thermostat", "barostat")
DETAILED = T.StructType(EXTENDED.fields + GRO.fields[2:] + MDP.fields[2:])
LEVELS = {"basic": BASIC, "extended": EXTENDED, "detailed": DETAILED}

VECTORS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("document", T.StringType()),
    ]
)
CLUSTERS = T.StructType(
    [
        T.StructField("idx", T.StringType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("cluster", T.LongType()),
        T.StructField("cluster_name", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)


def level_schema(level: str) -> T.StructType:
    if level not in LEVELS:
        raise ValueError(f"level must be one of {sorted(LEVELS)}, not {level!r}")
    return LEVELS[level]
