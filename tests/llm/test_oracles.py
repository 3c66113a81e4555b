"""The queries that SQL can express, against their DuckDB twins."""

import pytest
from oracle_check import compare, duck

from ledgerline.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_duckdb(spark, sf, name):
    info = compare(spark, duck(sf), name, QUERIES[name], ORACLE[name], sf)
    assert info["ok"], info
