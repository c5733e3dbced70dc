"""Catalogue tables derived from the benchmark tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "datasets": """
SELECT CAST(o_orderkey AS STRING) AS dataset_id, o_orderpriority AS dataset_origin,
  concat('https://example.org/d/', CAST(o_orderkey AS STRING)) AS dataset_url,
  concat(o_orderpriority, ' set ', CAST(o_orderkey AS STRING)) AS title,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE lower(o_orderstatus) END AS keywords,
  concat('Customer#', CAST(o_custkey AS STRING)) AS author,
  CAST(CAST(o_orderdate AS DATE) AS STRING) AS date_creation,
  CASE WHEN o_orderkey % 5 = 0 THEN 'none' ELSE concat('priority ', o_orderpriority) END AS description
FROM orders""",
    "li": """
SELECT *, CAST(l_orderkey AS STRING) AS dataset_id, row_number() OVER (PARTITION BY l_orderkey
  ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS file_seq FROM lineitem""",
    "files": """
SELECT dataset_id, CAST(file_seq AS INT) AS file_seq, CASE l_linenumber WHEN 1 THEN 'gro' WHEN 2 THEN 'xtc'
  WHEN 3 THEN 'mdp' WHEN 4 THEN 'none' WHEN 5 THEN 'pdb' WHEN 6 THEN 'lammpstrj' ELSE 'zip' END AS file_type FROM li""",
    "file_types": """
SELECT * FROM (VALUES (0, 'gro', 'GROMACS'), (1, 'xtc', 'GROMACS'), (2, 'mdp', 'GROMACS'),
  (3, 'lammpstrj', 'LAMMPS')) AS t(ord, type, engine)""",
    "gro": """
SELECT dataset_id, CAST(file_seq AS INT) AS file_seq,
  CASE WHEN l_quantity > 5 THEN CAST(l_quantity*1000 AS BIGINT) END AS atom_number,
  l_discount >= 0.05 AS has_protein, l_tax >= 0.06 AS has_nucleic,
  CASE WHEN l_returnflag='N' THEN NULL ELSE l_returnflag='A' END AS has_glucid,
  l_linestatus='O' AS has_lipid, l_quantity > 10 AS has_water_ion FROM li WHERE l_linenumber = 1""",
    "mdp": """
SELECT dataset_id, CAST(file_seq AS INT) AS file_seq, CASE WHEN l_discount > 0 THEN l_discount/10 END AS dt,
  CAST(l_quantity*50000 AS BIGINT) AS nsteps, CASE WHEN l_tax > 0 THEN 273.15 + l_quantity END AS temperature,
  CASE l_returnflag WHEN 'A' THEN 'no' WHEN 'N' THEN 'undefined' ELSE 'v-rescale' END AS thermostat,
  CASE l_linestatus WHEN 'O' THEN 'no' ELSE 'parrinello-rahman' END AS barostat FROM li WHERE l_linenumber = 3""",
    "text_meta": """
SELECT CAST(doc_id AS STRING) AS id, source AS origin, concat('https://example.org/doc/', CAST(doc_id AS STRING)) AS url,
  split_part(text, '.', 1) AS title, lang AS keywords, CAST(NULL AS STRING) AS author,
  '2024-01-01' AS date_creation, text AS description FROM documents""",
}
NEEDS = {
    "datasets": ("orders",),
    "li": ("lineitem",),
    "files": ("li",),
    "file_types": (),
    "gro": ("li",),
    "mdp": ("li",),
    "text_meta": ("documents",),
}


# Fixed weights that project an embedding of 64 elements onto the plane.
AXES = [[round(f(i) / 5.6, 6) for i in range(64)] for f in (math.cos, math.sin)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A benchmark table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A catalogue table over the benchmark tables."""
    sources = {
        need: view(spark, sf_dir, need) if need in VIEWS else table(spark, sf_dir, need) for need in NEEDS[name]
    }
    sql = VIEWS[name]
    for need in sources:
        sql = sql.replace(f"FROM {need}", "FROM {" + need + "}")
    return spark.sql(sql, **sources)


def ctes(*names: str) -> str:
    """The same tables as common table expressions."""
    wanted: list[str] = []
    for name in names:
        for need in (*NEEDS[name], name):
            if need in VIEWS and need not in wanted:
                wanted.append(need)
    return ",\n".join(f"{name} AS ({VIEWS[name]})" for name in wanted)
