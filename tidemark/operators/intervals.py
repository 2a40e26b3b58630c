"""Interval algebra and grouping by proximity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..common import as_list, chunk_width, chunked, clean, fresh, from_micros, hot, is_time, need_columns, numeric_axis, pieces_of, q, require, row_ids, running_offset, type_of
from .sweep import next_in_key, running_count


def combine_intervals(df: DataFrame, start_col: str = "start", stop_col: str | None = "stop", length_col: str | None = None, attr_cols=(), group_by=None, n_min: int = 1, n_max: int | None = None, keep_order: bool = False) -> DataFrame:
    """Maximal stretches of the axis covered by n_min to n_max intervals of a group: group_by + [start, stop or length].

    (1, None) is the union, (k, None) the k-fold intersection, (0, 0) the gaps, (0, None) the hull. Intervals with equal
    attr_cols count once. Touching intervals join; those of no length cover nothing but extend the hull; inverted ones and
    those with a missing endpoint are left out. An empty table gives an empty one.
    """
    require(n_max is None or n_max >= n_min, "n_max must be at least n_min")
    require((stop_col is None) != (length_col is None), "exactly one of stop_col and length_col is needed")
    keys, attrs = as_list(group_by), as_list(attr_cols)
    require(not set(keys) & set(attrs), "attr_cols and group_by overlap")
    need_columns(df, [start_col, stop_col or length_col, *keys, *attrs])
    end = clean(df, stop_col) if stop_col else clean(df, start_col) + clean(df, length_col)
    t = type_of(df, start_col)
    ks, ats = [f"k{i}" for i in range(len(keys))], [f"a{i}" for i in range(len(attrs))]
    base = df.select(*[q(c).alias(n) for c, n in zip([*keys, *attrs], [*ks, *ats])], clean(df, start_col).alias("s"), end.alias("e"))
    base = base.select(*ks, *ats, numeric_axis(base, "s").alias("s"), numeric_axis(base, "e").alias("e")).where("s <= e")
    # Keys stay whole unless one is hot; without keys the axis is always cut.
    cut = pieces_of(F.col("t"), chunk_width(base, "s", t, [F.col(k) for k in ks])) if not ks or hot(base, [F.col(k) for k in ks]) else None
    events = lambda d, names: d.select(*names, F.explode(F.array(F.struct(F.col("s").alias("t"), F.lit(1).alias("d")), F.struct(F.col("e").alias("t"), F.lit(-1).alias("d")))).alias("x")).select(*names, "x.t", "x.d")
    ev = events(base, [*ks, *ats])
    if attrs:
        # Union of each attribute first: only where its own count leaves or returns to zero.
        own = running_count(ev, [*ks, *ats], "t", "d", cut)
        once = own.select(*ks, "t", F.when((F.col("before") <= 0) & (F.col("n") > 0), 1).when((F.col("before") > 0) & (F.col("n") <= 0), -1).otherwise(0).alias("d"))
        ev = once if n_min == 0 else once.where("d <> 0")
    e = running_count(ev, ks, "t", "d", cut)
    inside = lambda c: (F.col(c) >= n_min) & (F.lit(True) if n_max is None else F.col(c) <= n_max)
    e = e.withColumns({"on": inside("n") & F.col("t2").isNotNull(), "was": inside("before") & ~F.col("first")})
    b = next_in_key(e.where("on <> was").select(*ks, "t", "on", *(["__chunk"] if cut is not None else [])), ks, "t", {"t2": "t"}).where("on and t2 is not null")
    back = (lambda c: from_micros(c, t)) if is_time(t) or t.typeName().startswith("interval") else (lambda c: c.cast(t))
    start, stop = back(F.col("t")), back(F.col("t2"))
    out = b.select(*[F.col(n).alias(k) for k, n in zip(keys, ks)], start.alias(start_col), stop.alias(stop_col) if stop_col else (stop - start).alias(length_col))
    return out.orderBy(*[q(c) for c in [*keys, start_col]]) if keep_order else out


def group_intervals(df: DataFrame, group_by=None, point_col: str | None = None, start_col: str | None = None, stop_col: str | None = None, distance=None, inclusive: bool = True, ids: str = "dense", name: str = "group_id", row_id: str | None = None) -> DataFrame:
    """Append group ids: rows of a key share one if a chain of intervals (or points) at most `distance` apart links them.

    inclusive=False asks for less than distance. Distances of times are timedeltas or microseconds. ids: 'dense' numbers groups
    0, 1, ... in the order of keys and starts; 'local' numbers them within each key, which saves a global sort. Rows with a
    missing start, or any missing key, are groups of their own; a row after one with a missing stop begins a group.
    """
    require(distance is not None, "distance is needed")
    require(ids in ("dense", "local"), f"unknown ids: {ids!r}")
    if point_col is not None:
        require(start_col is None and stop_col is None, "point_col excludes start_col and stop_col")
        start_col = stop_col = point_col
    require(start_col is not None, "point_col or start_col is needed")
    stop_col = stop_col or start_col
    keys = as_list(group_by)
    need_columns(df, [*keys, start_col, stop_col])
    if hasattr(distance, "total_seconds"):
        distance = round(distance.total_seconds() * 1_000_000)
    rid = row_id
    if rid is None:
        (rid,) = fresh(df, "__rid")
        df = row_ids(df, rid)
    s, e, own, ch, kk = fresh(df, "__s", "__e", "__own", "__chunk", "__kk")
    ks = [f"{kk}{i}" for i in range(len(keys))]
    alone = F.lit(False)
    for k in keys:
        alone = alone | clean(df, k).isNull()
    d = df.withColumns({s: numeric_axis(df, start_col), e: numeric_axis(df, stop_col), **{n: clean(df, k) for k, n in zip(keys, ks)}})
    d = d.withColumn(own, F.when(alone, q(rid)))
    part = [*ks, own]
    pieces = not keys or hot(d, [q(k) for k in part])
    if pieces:
        d = d.withColumn(ch, F.coalesce(pieces_of(q(s), chunk_width(d, s, type_of(df, start_col), [q(k) for k in part] if keys else ())), F.lit(2**62 + 1)))
    cut, c = (ch, [ch]) if pieces else (None, [])
    o = [q(s).asc_nulls_last(), q(rid)]
    last = F.max(F.struct(q(s).isNull(), q(s), q(rid), q(e).alias("e")))
    d = chunked(d, part, cut, [s], {"__m": F.max(e), "__l": last}, {"__mb": ("max_before", "__m"), "__lb": ("last_before", "__l")})
    w = Window.partitionBy(*part, *c).orderBy(*o)
    # The furthest stop so far, but nothing right after a row without a stop.
    before = F.when(F.lag(F.lit(1)).over(w).isNull(), F.when(F.col("__lb.e").isNotNull(), F.col("__mb")) if pieces else F.lit(None)).otherwise(F.when(F.lag(q(e)).over(w).isNotNull(), F.greatest("__mb", F.max(e).over(w.rowsBetween(Window.unboundedPreceding, -1)))))
    near = (q(s) <= before + F.lit(distance)) if inclusive else (q(s) < before + F.lit(distance))
    d = d.withColumn("__brk", F.when(F.coalesce(near, F.lit(False)), 0).otherwise(1)).drop("__mb", "__lb")
    d = chunked(d, part, cut, [s], {"__b": F.sum("__brk")}, {"__base": ("sum_before", "__b")})
    local = F.col("__base") + F.sum("__brk").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1
    d = d.withColumn("__local", local.cast("bigint"))
    tidy = [*ks, s, e, own, *c, "__brk", "__base", "__local"] + ([rid] if row_id is None else [])
    if ids == "local":
        return d.withColumn(name, F.col("__local")).drop(*tidy)
    count = running_offset(d.groupBy(*part).agg(F.max(F.col("__local") + 1).alias("__c")), part, "__c", "__off").drop("__c")
    a, b = d.alias("a"), count.alias("b")
    cond = F.lit(True)
    for k in part:
        cond = cond & F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`"))
    j = a.join(b, cond).select("a.*", F.col("b.__off"))
    return j.withColumn(name, (F.col("__off") + F.col("__local")).cast("bigint")).drop(*tidy, "__off")
