"""Sweep line over intervals: plus and minus events, prefix sums, covered periods and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import as_list, chunked, from_micros, need_columns, numeric_axis, q, require, type_of

DAY = 86_400_000_000


def running_count(ev: DataFrame, keys: list[str], at: str, delta: str, chunk: Column | None) -> DataFrame:
    """Running sum of delta along at: (keys, at, d, n, before, first, t2, __chunk), one row for each place.

    n and before: the sum after and ahead of the place; first: it is the key's first place; t2: the key's next place. Events of
    a key are first summed by place and cut into chunks of the axis, whose sums and ends are carried, so no task holds all
    events of a hot key. chunk=None leaves keys whole.
    """
    e = ev.groupBy(*keys, at).agg(F.sum(delta).alias("d"))
    c = [] if chunk is None else ["__chunk"]
    e = e if chunk is None else e.withColumn("__chunk", chunk)
    ends = {"__s": F.sum("d"), "__a": F.min(at), "__b": F.max(at)}
    e = chunked(e, keys, c[0] if c else None, [at], ends, {"__base": ("sum_before", "__s"), "__next": ("first_after", "__a"), "__last": ("max_before", "__b")})
    o = Window.partitionBy(*keys, *c).orderBy(at)
    n = F.col("__base") + F.sum("d").over(o.rowsBetween(Window.unboundedPreceding, 0))
    e = e.withColumns({"n": n, "first": F.lag(at).over(o).isNull() & F.col("__last").isNull(), "t2": F.coalesce(F.lead(at).over(o), F.col("__next"))})
    return e.withColumn("before", F.col("n") - F.col("d")).drop("__base", "__next", "__last")


def next_in_key(rows: DataFrame, keys: list[str], at: str, carried: dict[str, str]) -> DataFrame:
    """Append to each row values of the next row of its key, through chunks (column __chunk, if there is one). carried: new column -> source column."""
    c = [x for x in rows.columns if x == "__chunk"]
    w = Window.partitionBy(*keys, *c).orderBy(at)
    first = F.min(F.struct(F.col(at).alias("__at"), *[F.col(c).alias(n) for n, c in carried.items()]))
    if not c:
        return rows.withColumns({n: F.lead(x).over(w) for n, x in carried.items()})
    rows = chunked(rows, keys, "__chunk", [at], {"__f": first}, {"__nextf": ("first_after", "__f")})
    out = {n: F.coalesce(F.lead(x).over(w), F.col("__nextf")[n]) for n, x in carried.items()}
    return rows.withColumns(out).drop("__nextf")


def periods_and_gaps(df: DataFrame, entity: str | list[str], start: str, stop: str, max_gap: float | None = None, chunk: int = 7 * DAY) -> DataFrame:
    """Continuous covered periods of each entity and the gaps between them: (entity, kind, start, stop), kind 'period' or 'gap'.

    Intervals with a null endpoint or start >= stop cover nothing; touching intervals are continuous; rows with a null entity
    are left out. max_gap: longest gap to report, in the axis' unit (microseconds of times); None reports all. Equal rows
    change nothing. An empty table gives an empty one. start and stop come back in the type they had (micros of dates become
    timestamps).
    Method: every interval is a plus event at start and a minus event at stop; a prefix sum counts the active intervals;
    a count that leaves zero opens a period, one that returns to zero closes it. chunk: width of the axis pieces that are
    scanned apart (a documented parameter of the plan; results don't depend on it).
    """
    keys = as_list(entity)
    need_columns(df, [*keys, start, stop])
    require(len(keys) > 0, "entity is needed")
    ks = [f"k{i}" for i in range(len(keys))]
    ok = q(keys[0]).isNotNull()
    for k in keys[1:]:
        ok = ok & q(k).isNotNull()
    i = df.where(ok).select(*[q(k).alias(n) for k, n in zip(keys, ks)], numeric_axis(df, start).alias("s"), numeric_axis(df, stop).alias("e")).where("s < e")
    ev = i.select(*ks, F.explode(F.array(F.struct(F.col("s").alias("t"), F.lit(1).alias("d")), F.struct(F.col("e").alias("t"), F.lit(-1).alias("d")))).alias("x")).select(*ks, "x.t", "x.d")
    e = running_count(ev, ks, "t", "d", F.floor(F.col("t") / F.lit(chunk)))
    b = e.where("(before = 0 and n > 0) or (before > 0 and n = 0)").select(*ks, "t", "__chunk", (F.col("n") > 0).alias("open"))
    b = next_in_key(b, ks, "t", {"t2": "t"}).where("t2 is not null")
    if max_gap is not None:
        b = b.where(F.col("open") | (F.col("t2") - F.col("t") <= F.lit(max_gap)))
    t = type_of(df, start)
    back = (lambda c: from_micros(c, t)) if t.typeName() in ("timestamp", "timestamp_ntz", "daytimeinterval") else (lambda c: c)
    return b.select(*[F.col(n).alias(k) for k, n in zip(keys, ks)], F.when(F.col("open"), "period").otherwise("gap").alias("kind"), back(F.col("t")).alias("start"), back(F.col("t2")).alias("stop"))
