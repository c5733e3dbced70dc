"""Sinks for levels, vectors, clusters, graphs and reports."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmap import schemas


def write_level(df: DataFrame, path: str, level: str) -> str:
    """Write a level as ``<path>/<level>_dataset.json``, one record per line, with nulls kept."""
    target = f"{path.rstrip('/')}/{level}_dataset.json"
    columns = schemas.level_schema(level).names
    df.select(*columns).write.mode("overwrite").option("ignoreNullFields", "false").json(target)
    return target


def write_vectors(df: DataFrame, base: str, dataset: str, model: str) -> str:
    """Store ``(id, embedding, metadata, document)``; a store of that name must not exist yet.

    Records without an id take their position first, see ``operators.rank.fill_ids``; those without a vector are
    left out.
    """
    target = f"{base.rstrip('/')}/dataset={dataset}/model={model}"
    df.filter(F.col("embedding").isNotNull()).select(*schemas.VECTORS.names).write.mode("errorifexists").parquet(target)
    return target


def vocabulary_path(base: str, dataset: str, model: str) -> str:
    """Where the vocabulary of a store lies: beside the store, so that its scans do not see it."""
    return f"{base.rstrip('/')}_vocabulary/dataset={dataset}/model={model}"


def write_vocabulary(vocabulary: DataFrame, base: str, dataset: str, model: str) -> None:
    """Keep the vocabulary that made a store's vectors, by which queries are embedded alike."""
    columns = ("term", "df", "tf", "idf", "index")
    vocabulary.select(*columns).write.mode("errorifexists").parquet(vocabulary_path(base, dataset, model))


def write_sparse(rows: DataFrame, base: str, dataset: str) -> None:
    """Keep the exact TF-IDF rows ``(id, indices, weights)`` of a store whose dense vectors are their image."""
    rows.select("id", "indices", "weights").write.mode("errorifexists").parquet(
        f"{base.rstrip('/')}_sparse/dataset={dataset}"
    )


def write_clusters(df: DataFrame, path: str) -> None:
    """Save one row per record: coordinates, cluster, name and metadata."""
    df.select(*schemas.CLUSTERS.names).write.mode("overwrite").parquet(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, name: str, threshold: float) -> str:
    """Export a graph as two tables under a folder named by the threshold."""
    target = f"{path.rstrip('/')}/graph_{name}_threshold_{threshold}"
    nodes.write.mode("overwrite").parquet(f"{target}/nodes")
    edges.write.mode("overwrite").parquet(f"{target}/edges")
    return target


def write_report(lines: DataFrame, path: str) -> None:
    """Write report lines as text, sorted by community, then line."""
    (
        lines.orderBy("rank", "line_no", "id")
        .select(F.col("line").alias("value"))
        .write.mode("overwrite")
        .text(path)
    )


def dataset_name(path: str) -> str:
    """The file name of a level without its ``.json``."""
    return posixpath.basename(path.rstrip("/")).replace(".json", "")


def store_name(dataset: str, model: str) -> str:
    """The name of a vector store."""
    return f"chroma_db_{dataset}_{model}"


def result_name(store: str, reduction: str, cluster: str, prefix: str = "") -> str:
    """The name of a result made from a store, e.g. with prefix ``plot_``."""
    return f"{prefix}{posixpath.basename(store.rstrip('/'))}_{reduction}_{cluster}"
