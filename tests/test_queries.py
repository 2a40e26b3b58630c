"""Every query that has an SQL equivalent gives the same rows on the smallest test tables."""

import glob
import os

import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def canonical(rows):
    tidy = lambda v: None if v is None or v != v else round(float(v), 5) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(tidy(v) for v in r) for r in rows), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if not entry.queries()[n].__module__.startswith("tidemark.llm")])
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, DIR)
    cols = sorted(got.columns)
    want = duck.execute(f"select {', '.join(cols)} from ({entry.oracle_sql()[name]})").fetchall()
    assert canonical(got.select(*cols).collect()) == canonical(want)


def most_rows(spark, df):
    """The most rows that any step of the query puts out."""
    store, listeners = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    before = store.executionsCount()
    df.write.format("noop").mode("overwrite").save()
    listeners.waitUntilEmpty(30_000)
    done, most = store.executionsList(), 0
    for i in range(before, done.size()):
        run = done.apply(i)
        values = store.executionMetrics(run.executionId())
        for k in range(run.metrics().size()):
            m = run.metrics().apply(k)
            if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most


def test_outer_no_keys_lists_no_pairs(spark):
    """600 windows have 90,000 pairs of one inequality; over all of a larger table there is no time for these."""
    d = DIR.replace("sf0.001", "sf0.01")
    n = spark.read.parquet(f"{d}/windows.parquet").count()
    assert n < most_rows(spark, entry.queries()["merge_outer_no_keys"](spark, d)) < 5 * n
