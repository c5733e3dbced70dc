"""Positions, top-k, samples and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmap.scratch import Tables


def with_position(df: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """Number the rows from 0 in the given order, without sorting them in one task.

    Rows are range-partitioned, sorted and written; each partition then starts at the number of rows
    before it. Only one count per partition is gathered.
    """
    tables = Tables(df.sparkSession, "position")
    columns = [c for c in df.columns]
    ordered = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(
            *columns,
            F.spark_partition_id().alias("_part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_row"),
        )
    )
    ordered = tables.save(ordered, "ordered")
    counts = ordered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # One row per partition of the write, so its size is bounded by the number of tasks.
    return ordered.join(F.broadcast(starts), "_part").select(
        *columns, (F.col("_start") + F.col("_row")).alias(name)
    )


def fill_ids(df: DataFrame, *order: Column | str, id_col: str = "id") -> DataFrame:
    """Give records without an id their position in the given order."""
    numbered = with_position(df, *order, name="_position")
    return numbered.withColumn(
        id_col, F.coalesce(F.col(id_col).cast("string"), F.col("_position").cast("string"))
    ).drop("_position")


def top_per_group(df: DataFrame, keys: str | list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; Spark drops the rest of a hot group before the shuffle."""
    keys = [keys] if isinstance(keys, str) else keys
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)


def sample_per_group(df: DataFrame, key: str, n: int = 10, seed: int = 0, id_col: str = "id") -> DataFrame:
    """A seeded random sample of ``n`` rows per group, without replacement."""
    ticket = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))
    return top_per_group(df, key, [ticket, F.col(id_col)], n, "sample_no")


def group_sizes(df: DataFrame, key: str) -> DataFrame:
    """Rows per group."""
    return df.groupBy(key).agg(F.count("*").alias("size"))


def largest_groups(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The ``n`` largest groups, ranked from 1; ties go to the smaller key."""
    top = group_sizes(df, key).orderBy(F.desc("size"), F.asc(key)).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("size"), F.asc(key))))


def distinct_count(df: DataFrame, key: str) -> DataFrame:
    """The number of distinct groups."""
    return df.agg(F.count_distinct(key).alias("n_groups"))


def distinct_values(df: DataFrame, key: str) -> DataFrame:
    """Sorted distinct group keys."""
    return df.select(key).distinct().orderBy(key)


def centroids(df: DataFrame, key: str, x: str = "x", y: str = "y") -> DataFrame:
    """Size, centroid and bounding box of each group of points."""
    return df.groupBy(key).agg(
        F.count("*").alias("size"),
        F.avg(x).alias("centroid_x"),
        F.avg(y).alias("centroid_y"),
        F.min(x).alias("min_x"),
        F.max(x).alias("max_x"),
        F.min(y).alias("min_y"),
        F.max(y).alias("max_y"),
    )
