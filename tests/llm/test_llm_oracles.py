"""The queries that SQL can express give DuckDB's rows."""

import compare
import pytest

from corpusmap.llm import oracles, queries


@pytest.mark.parametrize("name", sorted(oracles.sql()))
def test_query(spark, sf_dir, name):
    assert compare.differences(queries.QUERIES[name](spark, sf_dir), compare.connect(sf_dir), oracles.sql()[name]) is None
