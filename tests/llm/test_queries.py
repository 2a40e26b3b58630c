import glob
import os

import pytest

from tests.test_queries import DIR, canonical
from tidemark.llm import queries

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got = queries.QUERIES[name](spark, DIR)
    cols = sorted(got.columns)
    assert canonical(got.select(*cols).collect()) == canonical(con.execute(f"select {', '.join(cols)} from ({queries.ORACLES[name]})").fetchall())


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLES])
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, DIR).count() > 0
