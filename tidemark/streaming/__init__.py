"""Structured Streaming forms of two operators: sessions with late data, and log-structured upserts by micro-batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.wide import compact, wide_delta


def stream_sessions(events: DataFrame, entity: str, time: str, gap_us: int, late: str = "1 day") -> DataFrame:
    """Sessions of a stream: (entity, start, stop, records); an event at most gap_us (inclusive) after the last one goes on with it.

    time is a timestamp; events later than `late` behind the latest are dropped by the watermark, which also bounds the
    state: one open session for each active entity. On a batch table the watermark does nothing.
    """
    w = F.session_window(F.col(time), f"{gap_us + 1} microseconds")
    s = events.where(F.col(entity).isNotNull() & F.col(time).isNotNull()).withWatermark(time, late).groupBy(F.col(entity), w.alias("w"))
    return s.agg(F.min(time).alias("start"), F.max(time).alias("stop"), F.count(F.lit(1)).alias("records")).drop("w")


def write_runs(rows: DataFrame, path: str, entity: str, attribute: str, version: Sequence[str], cell: Sequence[str], checkpoint_path: str, **trigger):
    """Start a query that appends each micro-batch of attribute-value rows as one run of sparse wide deltas, sorted by entity.

    A run is named by its batch, so a batch that is repeated after a failure replaces its own run: the result is exact.
    """

    def put(batch: DataFrame, n: int) -> None:
        wide_delta(batch, entity, attribute, version, cell).sortWithinPartitions("entity").write.mode("overwrite").parquet(f"{path}/run={n}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint_path).trigger(**(trigger or {"availableNow": True})).start()


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Compacted cells (entity, cells) of all runs so far: the latest version of each cell."""
    return compact([spark.read.parquet(path).drop("run")])


def compact_runs(spark: SparkSession, path: str, to: str) -> None:
    """Write all runs so far as one run elsewhere; later runs are merged with it by compact()."""
    read_cells(spark, path).sortWithinPartitions("entity").write.parquet(f"{to}/run=-1")
