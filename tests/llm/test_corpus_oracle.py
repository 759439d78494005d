"""Corpus queries that SQL can express, against DuckDB."""

import pytest
from oracle import differences, duck

from lodestone.llm.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), ORACLE_SQL[name], duck(SF)) == ""
