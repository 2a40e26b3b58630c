from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark.operators.sessions import sessionise
from tidemark.operators.wide import eav_to_cells
from tidemark.streaming import compact_runs, read_cells, stream_sessions, write_runs

T0 = datetime(2024, 1, 1)


def test_sessions_of_a_stream(frame, spark, tmp_path):
    data = [(k % 2, T0 + timedelta(seconds=s)) for k, s in enumerate([0, 3, 10, 20, 21, 40, 43, 53, 54, 90])] + [(None, T0), (1, None)]
    df = frame("k long, t timestamp", data)
    df.write.parquet(str(tmp_path / "in"))
    q = stream_sessions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "k", "t", 20_000_000, "1 hour").writeStream.format("memory").queryName("sess").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    us = lambda c: F.unix_micros(c)
    got = spark.table("sess").select("k", us("start"), us("stop"), "records")
    want = sessionise(df, "k", "t", None, 20_000_000).select("k", "start_us", "stop_us", "records")
    assert rows(got) == rows(want) and len(rows(want)) > 3


def test_runs(frame, spark, tmp_path):
    data = [(i % 3, "ab"[i % 2], i * 7 % 10, i, float(i)) for i in range(20)] + [(1, None, 3, 99, 0.0), (None, "a", 3, 99, 0.0)]
    df = frame("e long, a string, t int, id long, v double", data)
    for k in range(2):
        df.where(F.col("id") % 2 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    write_runs(stream, str(tmp_path / "runs"), "e", "a", ["t", "id"], ["v"], str(tmp_path / "cp")).awaitTermination(120)
    flat = lambda c: rows(c.select("entity", F.explode("cells").alias("a", "c")).select("entity", "a", "c.id", "c.v"))
    want = flat(eav_to_cells(df, "e", "a", ["t", "id"], ["v"]))
    assert flat(read_cells(spark, str(tmp_path / "runs"))) == want
    compact_runs(spark, str(tmp_path / "runs"), str(tmp_path / "base"))
    assert flat(read_cells(spark, str(tmp_path / "base"))) == want
