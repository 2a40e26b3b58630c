"""Shared helpers: missing values, time arithmetic, checkpoints, bounded broadcasts and chunked scans."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is only broadcast when it has at most this many rows (counted, not assumed).
BROADCAST_ROWS = 20_000
EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def as_list(x) -> list:
    """None, one name or several names as a list."""
    if x is None:
        return []
    return [x] if isinstance(x, (str, Column)) else list(x)


def require(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


def need_columns(df: DataFrame, names: Iterable[str], what: str = "frame") -> None:
    missing = [n for n in names if n not in df.columns]
    require(not missing, f"unknown column(s) {missing} in {what}; it has {df.columns}")


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_time(t: T.DataType) -> bool:
    return isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType))


def q(name: str) -> Column:
    """Column by its exact name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def clean(df: DataFrame, name: str) -> Column:
    """The column with NaN as null."""
    if isinstance(type_of(df, name), (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(q(name)), q(name))
    return q(name)


def micros(c: Column, t: T.DataType | None = None) -> Column:
    """Whole microseconds since 1970-01-01 00:00:00 of a timestamp as written."""
    if isinstance(t, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(t, T.DayTimeIntervalType):
        zero = F.expr(EPOCH)
        return F.timestamp_diff("MICROSECOND", zero, zero + c)
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH), c.cast("timestamp_ntz"))


def from_micros(c: Column, t: T.DataType | None = None) -> Column:
    """Inverse of micros."""
    if isinstance(t, T.TimestampType):
        return F.timestamp_micros(c)
    if isinstance(t, T.DayTimeIntervalType):
        return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (c / F.lit(1_000_000)).cast("decimal(18,6)"))
    ntz = F.timestamp_add("MICROSECOND", c, F.expr(EPOCH))
    return ntz.cast("date") if isinstance(t, T.DateType) else ntz


def numeric_axis(df: DataFrame, name: str) -> Column:
    """A column as a number on the time axis: micros of times, the number itself otherwise."""
    t = type_of(df, name)
    if is_time(t) or isinstance(t, T.DayTimeIntervalType):
        return micros(q(name), t)
    return clean(df, name)


def fresh(df: DataFrame, *names: str, avoid: Sequence[str] = ()) -> list[str]:
    """Helper names that no column of df has, nor avoid (case counts as equal, as Spark resolves names without case)."""
    taken, out = {c.lower() for c in [*df.columns, *avoid]}, []
    for n in names:
        k = n
        while k.lower() in taken:
            k = "_" + k
        taken.add(k.lower())
        out.append(k)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. Only a session on one machine may leave it unset, as in tests: it gets a temporary folder."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        alone = sc.master == "local" or sc.master.startswith("local[")
        require(bool(where) or alone, "spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="tidemark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder (Spark deletes it with its result if spark.cleaner.referenceTracking.cleanCheckpoints is set)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_TABLES: list[tuple[SparkSession, str]] = []


def materialise(df: DataFrame) -> DataFrame:
    """The table written as Parquet to the shared folder and read again: for larger tables that several branches read, each
    perhaps only some of the columns. The files are deleted by release(), at the latest when the Python process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _TABLES:
        atexit.register(release)
    _TABLES.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Delete the tables that materialise() wrote; results that still read them are to be written before."""
    while _TABLES:
        spark, path = _TABLES.pop()
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is over
            pass


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows, else as it is (Catalyst then shuffles)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def row_ids(df: DataFrame, name: str, order_by: Sequence[str] | str | None = None) -> DataFrame:
    """Append positions 0, 1, ... in the given order.

    The order is made by a range-partitioned sort; positions are the partition's offset plus the place in it, so that no
    single task sees all rows. Without an order the positions follow the input's partitions, fixed by a checkpoint.
    """
    part, at, off = fresh(df, "__part", "__at", "__off", avoid=[name])
    base = df
    if order_by is not None and as_list(order_by):
        base = df.orderBy(*[q(c).asc_nulls_last() if isinstance(c, str) else c for c in as_list(order_by)])
    fixed = checkpoint(base.withColumn(at, F.monotonically_increasing_id()))
    fixed = fixed.withColumn(part, F.shiftright(q(at), 33))
    counts = fixed.groupBy(part).agg(F.count(F.lit(1)).alias("__n"))
    # One row for each partition: a bounded number, so one task may order them.
    offset = counts.select(part, (F.sum("__n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias(off))
    mask = F.lit((1 << 33) - 1)
    return fixed.join(F.broadcast(offset), part).withColumn(name, q(at).bitwiseAND(mask) + F.col(off)).drop(part, at, off)


#: Chunks whose summaries are scanned together where no key spreads them.
CHUNKS = 4096


def _rows_before(over: Window, at: str, later: bool) -> Window:
    """All rows ahead in the order of at, or all later ones: scanned in reverse, as a frame that ends with the partition is read anew for each row."""
    return over.orderBy(F.col(at).desc() if later else F.col(at).asc()).rowsBetween(Window.unboundedPreceding, -1)


#: How summaries are carried: (from later chunks, over a window, of several chunks, own and carried together).
_CARRY = {
    "sum_before": (False, lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0)), lambda c, at: F.sum(c), lambda own, more: own + F.coalesce(more, F.lit(0))),
    "sum_after": (True, lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0)), lambda c, at: F.sum(c), lambda own, more: own + F.coalesce(more, F.lit(0))),
    "max_before": (False, lambda c, w: F.max(c).over(w), lambda c, at: F.max(c), lambda own, more: F.greatest(own, more)),
    "max_after": (True, lambda c, w: F.max(c).over(w), lambda c, at: F.max(c), lambda own, more: F.greatest(own, more)),
    "min_before": (False, lambda c, w: F.min(c).over(w), lambda c, at: F.min(c), lambda own, more: F.least(own, more)),
    "min_after": (True, lambda c, w: F.min(c).over(w), lambda c, at: F.min(c), lambda own, more: F.least(own, more)),
    "last_before": (False, lambda c, w: F.last(c, ignorenulls=True).over(w), lambda c, at: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(at))), lambda own, more: F.coalesce(own, more)),
    "first_after": (True, lambda c, w: F.last(c, ignorenulls=True).over(w), lambda c, at: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(at))), lambda own, more: F.coalesce(own, more)),
}


def chunked(df: DataFrame, keys: Sequence[str], chunk: str | None, order: Sequence[str], summary: dict[str, Column], carry: dict[str, tuple[str, str]]) -> DataFrame:
    """Carry a summary of a key's earlier (or later) chunks into each chunk.

    A hot key would put all its rows in one window task. Here rows are cut by (keys, chunk); each chunk is summarised by
    aggregates that are combined before the shuffle, the few summaries of a key are scanned, and the result is joined
    back to the rows. summary: column -> aggregate of a chunk. carry: new column -> (how, summary column), how being
    sum_, max_ or min_ with before or after, last_before, first_after. chunk=None says that keys are whole: there is nothing to carry.
    Without keys summaries are scanned in runs of CHUNKS chunks, to which the runs' own summaries are carried.
    """
    if chunk is None:
        return df.withColumns({n: F.lit(0 if h.startswith("sum_") else None) for n, (h, _) in carry.items()})
    s = df.groupBy(*keys, chunk).agg(*[v.alias(k) for k, v in summary.items()])
    if keys:
        over = Window.partitionBy(*keys)
        s = s.select(*keys, chunk, *[_CARRY[h][1](c, _rows_before(over, chunk, _CARRY[h][0])).alias(n) for n, (h, c) in carry.items()])
    else:
        s = s.withColumn("__run", F.floor(F.col(chunk) / F.lit(CHUNKS)).cast("bigint"))
        runs = s.groupBy("__run").agg(*[_CARRY[h][2](c, chunk).alias(n) for n, (h, c) in carry.items()])
        one = Window.partitionBy()
        runs = runs.select("__run", *[_CARRY[h][1](n, _rows_before(one, "__run", _CARRY[h][0])).alias(f"__more_{n}") for n, (h, _) in carry.items()])
        over = Window.partitionBy("__run")
        s = s.join(runs, "__run").select(chunk, *[_CARRY[h][3](_CARRY[h][1](c, _rows_before(over, chunk, _CARRY[h][0])), F.col(f"__more_{n}")).alias(n) for n, (h, c) in carry.items()])
    l, r = df.alias("l"), s.alias("r")
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, chunk]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return l.join(r, cond, "left").select("l.*", *[F.col(f"r.{n}") for n in carry])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def running_offset(df: DataFrame, order_by: Sequence[str], value: str, name: str) -> DataFrame:
    """Append the sum of value over all earlier rows in a total order, without one task seeing all rows.

    Rows are range-partitioned and fixed by a checkpoint; partitions' sums give offsets, a window in each partition the rest.
    """
    part, off = fresh(df, "__part", "__off", avoid=[name])
    fixed = checkpoint(df.orderBy(*[q(c).asc_nulls_last() for c in order_by]).withColumn(part, F.spark_partition_id()))
    sums = fixed.groupBy(part).agg(F.sum(value).alias("__s"))
    offset = sums.select(part, F.coalesce(F.sum("__s").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(off))
    w = Window.partitionBy(part).orderBy(*[q(c).asc_nulls_last() for c in order_by]).rowsBetween(Window.unboundedPreceding, -1)
    return fixed.join(F.broadcast(offset), part).withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)) + F.col(off)).drop(part, off)


#: Rows that a piece of the axis holds on average.
PIECE_ROWS = 100_000


def chunk_width(df: DataFrame, at: str, t: T.DataType, keys: Sequence[Column] = ()) -> float:
    """Width of the pieces of the axis in which rows are scanned: about PIECE_ROWS rows of the largest key (of the table, without keys) in each.

    Rows' density is that between the first and the last hundredth of them, so that a few far ends don't stretch the pieces.
    """
    x = F.col(at).cast("double")
    d = df.where(F.abs(x) < float("inf"))
    row = d.agg(F.percentile_approx(x, [0.01, 0.99], 1000).alias("p"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    if not row.n:
        return 1.0
    n = d.groupBy(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] if keys else row.n
    span = row.p[1] - row.p[0] or (row.hi - row.lo) / 512
    width = span / max(1.0, n / PIECE_ROWS)
    return max(width, 1.0) if is_time(t) else width if width > 0 else 1.0


def pieces_of(c: Column, width: float) -> Column:
    """Piece of the axis that a number lies in; the infinities have pieces of their own."""
    return F.when(F.abs(c.cast("double")) < float("inf"), F.floor(c / F.lit(width)).cast("bigint")).when(c > 0, F.lit(2**62)).when(c < 0, F.lit(-(2**62)))


#: A key with more rows than this is scanned in pieces of the order's axis instead of in one window.
HOT_ROWS = 1_000_000


def hot(df: DataFrame, keys: Sequence[Column], most: int = HOT_ROWS) -> bool:
    """Does a key hold more than so many rows? Counts are combined before they are sent; the whole table counts if there are no keys."""
    n = df.groupBy(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("n")) if keys else df.agg(F.count(F.lit(1)).alias("n"))
    return not n.where(F.col("n") > most).isEmpty()
