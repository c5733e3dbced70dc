import pytest

from corpusmap.operators import enrich
from corpusmap.sources import readers


def test_null_cases_of_the_aggregates(spark):
    mdp = spark.createDataFrame(
        [
            ("a", 1, None, 5, None, None, "no"),
            ("a", 2, 0.5, 6, None, "undefined", "no"),
            ("a", 3, 0.7, 7, 300.0, "v-rescale", None),
        ],
        "dataset_id string, file_seq int, dt double, nsteps bigint, temperature double, thermostat string, barostat string",
    )
    row = enrich.mdp_facts(mdp).first()
    assert (row.dt, row.nsteps, row.temperature, row.thermostat, row.barostat) == (0.5, 5, 300.0, "v-rescale", "none")
    gro = spark.createDataFrame(
        [("a", 2, None, None, True), ("a", 1, None, None, None)],
        "dataset_id string, file_seq int, atom_number bigint, has_protein boolean, has_nucleic boolean",
    ).selectExpr("*", "has_nucleic AS has_glucid", "has_nucleic AS has_lipid", "has_nucleic AS has_water_ion")
    row = enrich.gro_facts(gro).first()
    assert row.atom_number is None and row.has_protein is False and row.has_nucleic is True


def test_lists_fall_back_and_last_engine_wins(spark):
    basic = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    files = spark.createDataFrame(
        [("a", 1, "gro"), ("a", 2, "pdb"), ("a", 3, "gro"), ("b", 1, "none"), ("b", 2, None)],
        "dataset_id string, file_seq int, file_type string",
    )
    types = readers.file_types(spark, [{"type": "gro", "engine": "OLD"}, {"type": "gro", "engine": "NEW"}])
    got = {r.id: r for r in enrich.extended_level(basic, files, readers.file_type_dim(types)).collect()}
    assert got["a"].file_extensions == ["gro", "pdb"] and got["a"].software_engines == ["NEW"]
    assert got["b"].file_extensions == ["none"] and got["b"].software_engines == ["unknown"]
    assert got["c"].file_extensions == ["none"]


def test_a_wrong_schema_is_an_error(spark, tmp_path):
    spark.createDataFrame([(1,)], "dataset_id int").write.parquet(str(tmp_path / "t"))
    with pytest.raises(ValueError, match="dataset_id"):
        readers.read_datasets(spark, str(tmp_path / "t"))
