"""Joins in which one key holds half of all rows."""

from pyspark.sql import functions as F

from corpusmap.operators.skew import hot_keys, skew_join


def test_hot_key_is_split_and_nothing_is_lost(spark):
    many = spark.range(4000).select(F.col("id"), F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"))
    few = spark.range(0, 4000, 3).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert hot_keys(many, ["k"], least=100) == [(0,)]
    for how in ("inner", "left", "left_semi"):
        plain = sorted(many.join(few, "k", how).collect(), key=str)
        split = skew_join(many, few, ["k"], F.xxhash64("id"), how, least=100, parts=16)
        assert sorted(split.select(many.join(few, "k", how).columns).collect(), key=str) == plain
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = skew_join(many, few, ["k"], F.xxhash64("id"), "left", least=100, parts=64)
        tasks = joined.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert max(r["count"] for r in tasks) < 0.45 * 4000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
