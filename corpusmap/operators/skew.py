"""Equi-joins on keys of which a few may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key with more than this share of all rows is hot, so that there are at most 256 of them.
SHARE = 1 / 256
# Below this many rows no key is worth splitting.
LEAST = 4096
# Parts that the rows of a hot key are cut into.
PARTS = 64


def hot_keys(rows: DataFrame, keys: list[str], share: float = SHARE, least: int = LEAST) -> list[tuple]:
    """The keys with more than a share of all rows; counted map-side, at most ``1 / share`` of them."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("n")).first()["n"] or 0
    found = counts.filter(F.col("_n") > max(total * share, least)).select(*keys).collect()
    return [tuple(r) for r in found]


def skew_join(
    many: DataFrame, few: DataFrame, keys: list[str], salt: Column, how: str = "inner",
    share: float = SHARE, least: int = LEAST, parts: int = PARTS, hot: list[tuple] | None = None,
) -> DataFrame:
    """``many`` joined with ``few`` on ``keys`` (``inner``, ``left`` or ``left_semi``), hot keys of ``many`` in ``parts`` parts.

    The rows of a hot key go to parts by the hash ``salt`` of their own columns, and its rows of ``few`` to every
    part; all other rows move once, as in a plain join. ``hot`` names the hot keys where they are known; else
    ``many`` is counted, and should be a saved table. Null keys join nothing.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(f"{how} joins are not split")
    hot = hot_keys(many, keys, share, least) if hot is None else hot
    hot = [k for k in hot if None not in k]
    if not hot:
        return many.join(few, keys, how)
    # At most 1 / share keys.
    marks = F.broadcast(many.sparkSession.createDataFrame(hot, many.select(*keys).schema).withColumn("_hot", F.lit(True)))
    part = F.when(F.col("_hot"), F.pmod(salt, F.lit(parts))).otherwise(F.lit(0)).cast("int")
    left = many.join(marks, keys, "left").withColumn("_part", part).drop("_hot")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    right = few.join(marks, keys, "left").withColumn("_part", F.explode(every)).drop("_hot")
    return left.join(right, [*keys, "_part"], how).drop("_part")
