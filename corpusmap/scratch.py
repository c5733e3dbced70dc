"""Intermediate tables in the shared checkpoint folder.

Iterative operators write each round as a Parquet table and read it back. That cuts the lineage, survives
the loss of executors, and gives the optimiser true sizes for the next round.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or by ``setCheckpointDir`` where that is unset.

    Only a single-JVM session (``local[...]``) with neither gets a temporary folder of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_KEY, None) or context.getConf().get(CHECKPOINT_KEY, None)
    folder = folder or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="corpusmap-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


class Tables:
    """Named intermediate tables of one operator call."""

    def __init__(self, spark: SparkSession, operator: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{operator}-{uuid.uuid4().hex[:12]}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return a DataFrame that reads the written table."""
        path = f"{self.base}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def save_measured(self, df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict]:
        """Like ``save``, with aggregates of the rows taken while they are written, without another job."""
        observation = Observation()
        saved = self.save(df.observe(observation, *[m.alias(k) for k, m in metrics.items()]), name)
        return saved, observation.get

    def drop(self, name: str) -> None:
        """Remove a table that a later round has replaced."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Let Spark's cleaner remove the shuffle files of finished jobs, which it does once their plans are collected."""
        gc.collect()
        self.spark._jvm.System.gc()


def materialize(df: DataFrame, operator: str) -> DataFrame:
    """Write ``df`` once so that several consumers share the result."""
    return Tables(df.sparkSession, operator).save(df, "table")
