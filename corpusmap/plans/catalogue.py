"""The whole way from catalogue tables to named clusters, graph communities and reports."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmap.functions.records import stored_vectors
from corpusmap.functions.text import text_of
from corpusmap.operators import cluster as clusters
from corpusmap.operators import enrich, graph, label, reduce, report, tfidf
from corpusmap.operators.embed import HASHING_DIM, TFIDF_DIM, check_model, embed, embed_hashing
from corpusmap.operators.simjoin import similar_sparse, similar_vectors
from corpusmap.schemas import LEVELS
from corpusmap.scratch import materialize
from corpusmap.sources import readers, writers

# Under this name a TF-IDF store keeps the vocabulary of its exact rows.
SPARSE_MODEL = "tfidf_sparse"
CLUSTER_METHODS = ("knn", "hdbscan", "dbscan")


def check_choices(model: str, dataset: str, reduction: str, cluster: str) -> None:
    """Reject unknown names before any job starts."""
    check_model(model)
    for value, known, what in (
        (dataset, tuple(LEVELS), "dataset"),
        (reduction, reduce.METHODS, "reduction"),
        (cluster, CLUSTER_METHODS, "cluster"),
    ):
        if value not in known:
            raise ValueError(f"{what} must be one of {known}, not {value!r}")


def build_levels(
    spark: SparkSession, paths: dict[str, str], file_types: Iterable[dict[str, str]]
) -> dict[str, DataFrame]:
    """The three levels from the tables ``datasets``, ``files``, ``gro`` and ``mdp``."""
    basic = enrich.basic_level(readers.read_datasets(spark, paths["datasets"]))
    dim = readers.file_type_dim(readers.file_types(spark, file_types))
    extended = enrich.extended_level(basic, readers.read_files(spark, paths["files"]), dim)
    detailed = enrich.detailed_level(
        extended, readers.read_gro(spark, paths["gro"]), readers.read_mdp(spark, paths["mdp"])
    )
    return {"basic": basic, "extended": extended, "detailed": detailed}


def vectorise(level: DataFrame, model: str, vocabulary: DataFrame | None = None) -> DataFrame:
    """``(id, embedding)`` of the records of a level; hashed models take the level's vocabulary, or fit it.

    TF-IDF vectors are stored as their hashed image, which keeps inner products on average and stays dense
    and short whatever the vocabulary; exact joins use the sparse rows instead, see ``sparse_rows``.
    """
    texts = text_of(level)
    if model in ("hashing", "tfidf"):
        return embed_hashing(texts, TFIDF_DIM if model == "tfidf" else HASHING_DIM, vocabulary)
    return embed(texts, "text", model)


def sparse_rows(level: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """Sparse TF-IDF rows ``(id, indices, weights)`` of a level."""
    texts = text_of(level)
    return tfidf.sparse_vectors(tfidf.tfidf_rows(texts, tfidf.tfidf_fit(texts) if vocabulary is None else vocabulary))


def run_pipeline(
    spark: SparkSession,
    paths: dict[str, str],
    file_types: Iterable[dict[str, str]],
    out: str,
    model: str = "hashing",
    dataset: str = "basic",
    reduction: str = "umap",
    cluster: str = "hdbscan",
    threshold: float = 0.98,
    eps: float = 0.5,
    seed: int = 0,
) -> dict[str, DataFrame]:
    """Write levels, vectors, clusters, graph and report under ``out``, and return their DataFrames.

    Tables are written at vectors, coordinates and clusters, which later steps read back; errors are raised.
    """
    check_choices(model, dataset, reduction, cluster)
    levels = build_levels(spark, paths, file_types)
    written_levels = {name: writers.write_level(level, f"{out}/datasets", name) for name, level in levels.items()}
    level = readers.read_level(spark, written_levels[dataset], dataset)
    store = f"{out}/embeddings"
    name = f"{dataset}_dataset"
    vocabulary = None
    if model in ("hashing", "tfidf"):
        writers.write_vocabulary(tfidf.tfidf_fit(text_of(level), max_features=None), store, name, model)
        vocabulary = readers.read_vocabulary(spark, store, name, model)
    writers.write_vectors(stored_vectors(vectorise(level, model, vocabulary), level), store, name, model)
    if model == "tfidf":
        # The vocabulary that numbers the terms of the exact rows is kept under a name of its own.
        writers.write_vocabulary(tfidf.tfidf_fit(text_of(level)), store, name, SPARSE_MODEL)
        numbered = readers.read_vocabulary(spark, store, name, SPARSE_MODEL)
        writers.write_sparse(sparse_rows(level, numbered), store, name)
    vectors = readers.read_vectors(spark, store, name, model)

    points = materialize(reduce.reduce2d(vectors, reduction, seed=seed), "coordinates")
    if cluster == "hdbscan":
        labels = clusters.hdbscan(points)
    elif cluster == "dbscan":
        labels = clusters.cluster_numbers(clusters.dbscan(points, eps))
    else:
        labels = clusters.cluster_numbers(clusters.knn_components(points))
    titled = vectors.select("id", F.try_element_at("metadata", F.lit("title")).alias("title"))
    members = materialize(labels.join(titled, "id"), "clusters")
    named = label.with_names(members, label.name_clusters(members))
    result = (
        named.join(points, "id")
        .join(vectors.select("id", "idx", "metadata"), "id")
        .select("idx", "x", "y", "cluster", "cluster_name", "metadata")
    )
    projected = f"{out}/2d_projections/{writers.result_name(writers.store_name(name, model), reduction, cluster)}"
    writers.write_clusters(result, projected)
    written = spark.read.parquet(projected)
    plotted = report.plot_points(written)

    similar = similar_sparse(readers.read_sparse(spark, store, name), threshold) if model == "tfidf" else similar_vectors(vectors, threshold)
    similar = graph.with_all_nodes(similar, vectors)
    found = materialize(graph.communities(similar, seed=seed), "communities")
    lines = report.community_report(found, titled)
    nodes = vectors.select("id", "metadata")
    writers.write_graph(nodes, similar.full_edges(), f"{out}/graphs", writers.store_name(name, model), threshold)
    writers.write_report(lines, f"{out}/reports/{writers.store_name(name, model)}")
    return {
        "level": level, "vectors": vectors, "points": points, "clusters": written, "plot_points": plotted,
        "facets": report.facet_counts(plotted), "hulls": report.cluster_hulls(written), "communities": found,
        "report": lines, "vocabulary": vocabulary, "prompts": label.naming_prompts(members), "graph_counts": similar.counts(),
    }
