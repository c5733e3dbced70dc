import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmap.operators.embed import embed, register_model
from corpusmap.operators.rank import fill_ids
from corpusmap.plans.catalogue import run_pipeline
from corpusmap.plans.fixtures import view
from corpusmap.sources import readers, writers


def test_levels_round_trip_and_malformed_files_fail(spark, sf_dir, tmp_path):
    from corpusmap.operators.enrich import basic_level

    level = basic_level(view(spark, sf_dir, "datasets"))
    path = writers.write_level(level, str(tmp_path), "basic")
    assert readers.read_level(spark, path, "basic").exceptAll(level).isEmpty()
    array = tmp_path / "array.json"
    array.write_text('[\n {"id": "1", "title": "A"},\n {"id": "2", "title": null}\n]')
    assert readers.read_level(spark, str(array), "basic").count() == 2
    broken = tmp_path / "broken.json"
    broken.write_text('[{"id": "1", ')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_level(spark, str(broken), "basic").collect()


def test_vector_store(spark, tmp_path):
    base = str(tmp_path / "store")
    rows = spark.createDataFrame(
        [("a_1", [1.0, 0.0], {"title": "A"}, "{}")],
        "id string, embedding array<float>, metadata map<string,string>, document string",
    )
    writers.write_vectors(rows, base, "basic_dataset", "hashing")
    stored = readers.read_vectors(spark, base, "basic_dataset", "hashing")
    assert stored.first().idx == "a"
    with pytest.raises(Exception, match="(?i)already exists"):
        writers.write_vectors(rows, base, "basic_dataset", "hashing")
    with pytest.raises(ValueError, match="no vectors"):
        readers.read_vectors(spark, base, "basic_dataset", "BERT")
    scan = stored.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dataset" in scan and "ReadSchema: struct<id:string>" in scan


def test_names():
    assert writers.dataset_name("results/datasets/basic_dataset.json") == "basic_dataset"
    assert writers.result_name("x/chroma_db_a_b", "umap", "knn", "plot_") == "plot_chroma_db_a_b_umap_knn"


def test_missing_ids_become_positions(spark):
    rows = spark.createDataFrame([(None, "b"), ("x", "a"), (None, "c")], "id string, title string")
    assert {(r.id, r.title) for r in fill_ids(rows, "title").collect()} == {("x", "a"), ("1", "b"), ("2", "c")}


def test_yaml_dimension(spark, tmp_path):
    path = tmp_path / "types.yml"
    path.write_text("file_types:\n- {type: gro, engine: GROMACS}\n- {type: gro, engine: OTHER}\n")
    dim = readers.file_type_dim(readers.read_file_types(spark, str(path)))
    assert [tuple(r) for r in dim.collect()] == [("gro", "OTHER")]


def test_registered_encoder(spark):
    register_model("SBERT", lambda: lambda texts: np.array([[len(t), 1.0] for t in texts]))
    df = spark.createDataFrame([("a", "xxx"), ("b", None)], "id string, text string")
    got = {r.id: r.embedding for r in embed(df, "text", "SBERT").collect()}
    assert abs(got["a"][0] - 3 / np.sqrt(10)) < 1e-6 and got["b"] == [0.0, 1.0]
    with pytest.raises(ValueError, match="register_model"):
        embed(df, "text", "BERT")


def test_whole_catalogue(spark, sf_dir, tmp_path):
    paths = {}
    for name in ("datasets", "files", "gro", "mdp"):
        paths[name] = str(tmp_path / name)
        rows = view(spark, sf_dir, name)
        # Enough for the way through; the registered queries cover whole tables.
        rows.filter(F.col("dataset_id").cast("bigint") < 150).write.parquet(paths[name])
    types = [{"type": "gro", "engine": "GROMACS"}, {"type": "lammpstrj", "engine": "LAMMPS"}]
    out = str(tmp_path / "out")
    got = run_pipeline(spark, paths, types, out, dataset="extended", reduction="pca", cluster="knn", threshold=0.95)
    n = got["level"].count()
    assert n == got["clusters"].count() == got["communities"].count() == got["graph_counts"].first().n_nodes
    assert got["plot_points"].columns[:3] == ["idx", "cluster_name", "title"]
    lines = [r.value for r in spark.read.text(f"{out}/reports/chroma_db_extended_dataset_hashing").collect()]
    assert any(line.startswith("Cluster 1 (Size: ") for line in lines)


def test_a_folder_of_both_layouts_loses_no_record(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    (folder / "a.json").write_text("\n [\n" + ",\n".join(f'{{"id": "{i}", "title": "T"}}' for i in range(100)) + "\n]")
    (folder / "b.json").write_text("".join(f'{{"id": "x{i}", "title": null}}\n' for i in range(3)))
    rows = readers.read_level(spark, str(folder), "basic").collect()
    assert len({r.id for r in rows}) == len(rows) == 103


def test_records_without_a_vector_are_left_out_of_a_store(spark, tmp_path):
    schema = "id string, embedding array<float>, metadata map<string,string>, document string"
    rows = spark.createDataFrame([("a", [1.0], {}, "{}"), ("b", None, {}, "{}")], schema)
    writers.write_vectors(rows, str(tmp_path / "s"), "basic_dataset", "hashing")
    assert [r.id for r in readers.read_vectors(spark, str(tmp_path / "s"), "basic_dataset", "hashing").collect()] == ["a"]


def test_cleaning_takes_its_own_keys_and_words(spark):
    from corpusmap.functions.text import text_of

    level = spark.createDataFrame([("1", "Red none", "me")], "id string, title string, author string")
    assert text_of(level, excluded_keys=("title",), words_to_remove=("m",)).first().text == "e"
