"""Each query of the subpackage against its SQL, over the smallest tables."""

import pytest
from conftest import DATA, same_rows

from notelake.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query(name, spark, duck):
    got = duck.execute(ORACLE_SQL[name])
    same_rows(QUERIES[name](spark, DATA), got.fetchall(), [c[0] for c in got.description])


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE_SQL])
def test_rows(name, spark):
    assert QUERIES[name](spark, DATA).count() >= spark.read.parquet(f"{DATA}/documents.parquet").count()
