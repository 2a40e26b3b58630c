"""Resampling of observations and of interval-valued observations into arbitrary windows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..common import as_list, clean, fresh, from_micros, is_time, materialise, micros, need_columns, numeric_axis, q, require, row_ids, type_of
from .joins import merge_intervals
from .nodes import Tree

PLAIN = ("mean", "min", "max", "median", "std", "var", "sum", "prod", "skew", "mad", "sem", "size", "count", "nunique", "mode", "mode_count", "first", "last", "any", "all")
#: Attributes that are taken from the table itself where none are named.
MAX_ATTRIBUTES = 10_000
ZERO = ("size", "count", "nunique", "mode_count")


class custom_agg:  # noqa: N801
    """A Python aggregation: fn(pandas frame of [time, value] indexed by window id) -> frame or series with a row per window id.

    schema: DDL of its columns. It is called for the windows of one Arrow group at a time and must not keep state.
    """

    def __init__(self, fn: Callable, schema: str, name: str | None = None):
        self.fn, self.schema, self.name = fn, schema, name or getattr(fn, "__name__", "custom")


def _spec(agg: dict) -> list[tuple[str, object, str]]:
    """(attribute, aggregation, output name) of each requested column; ranks are normalised, quantiles out of range dropped."""
    out = []
    for attr, wanted in agg.items():
        for a in as_list(wanted) if not isinstance(wanted, (list, tuple)) else wanted:
            if isinstance(a, custom_agg):
                out.append((attr, a, f"{attr}__{a.name}"))
                continue
            require(isinstance(a, str), f"aggregation {a!r}: give callables as custom_agg with a schema")
            if m := re.fullmatch(r"([rt])(-?)0*(\d+)", a):
                k = int(m[3]) * (-1 if m[2] else 1)
                out.append((attr, (m[1], k), f"{attr}__{m[1]}{k}"))
            elif m := re.fullmatch(r"p(\d+(?:\.\d*)?|\.\d+)", a):
                if 0 <= float(m[1]) <= 100:
                    out.append((attr, ("p", float(m[1])), f"{attr}__{a}"))
            else:
                require(a in PLAIN, f"unknown aggregation {a!r}")
                out.append((attr, a, f"{attr}__{a}"))
    names = [n for *_, n in out]
    require(len(names) == len(set(names)), "an aggregation is requested twice")
    return out


def _windows_of(windows, df: DataFrame, **names) -> DataFrame:
    return windows if isinstance(windows, DataFrame) else windows(df, **names)


def _bounds(df: DataFrame, windows: DataFrame, time_types: list[T.DataType], start_col: str | None, stop_col: str | None) -> tuple[str | None, str | None]:
    s, e = (c if c is not None and c in windows.columns else None for c in (start_col, stop_col))
    require(s is not None or e is not None, "windows need a start or a stop")
    for c in (s, e):
        if c is not None:
            for t in time_types:
                a, b = windows.schema[c].dataType, t
                require(type(a) is type(b) or (isinstance(a, T.NumericType) and isinstance(b, T.NumericType)), f"{c} is {a.simpleString()}, the times are {b.simpleString()}")
    return s, e


def _spread(w: DataFrame, s: str | None, e: str | None) -> tuple[float | None, bool]:
    """(width of bins for windows with both ends: twice their mean length, or None; are there other windows?) in one pass."""
    inf = float("inf")
    a, b = (numeric_axis(w, c).cast("double") if c else F.lit(None).cast("double") for c in (s, e))
    finite = (F.abs(a) < inf) & (F.abs(b) < inf)
    within = finite & (a <= b)
    row = w.agg(F.avg(F.when(within, b - a)), F.max(F.when(within, b - a)), F.count(F.when(~F.coalesce(finite, F.lit(False)), 1))).first()
    if not row[0] or row[1] / row[0] >= 10_000:
        return None, True
    return 2 * row[0], row[2] > 0


def _meet(ww: DataFrame, o: DataFrame, s: str | None, e: str | None, entity: bool, include_start: bool, include_stop: bool) -> DataFrame:
    """(__w, __t, __v, __a, ...) pairs of windows (__w, __we, s, e) and their observations (__e, __t, ...).

    Windows with both ends meet observations in bins of the axis, so that a hot entity is spread. Windows without a start or a
    stop (null only where the column is missing), with infinite ends, or of very unequal lengths meet them by the nodes of a
    tree over the axis. Either way the join is by equality, and its work is that of its pairs.
    """
    cond = F.col("__e") == F.col("__we") if entity else F.lit(True)
    if s:
        cond = cond & ((F.col("__t") >= F.col(s)) if include_start else (F.col("__t") > F.col(s)))
        ww = ww.where(F.col(s).isNotNull())
    if e:
        cond = cond & ((F.col("__t") <= F.col(e)) if include_stop else (F.col("__t") < F.col(e)))
        ww = ww.where(F.col(e).isNotNull())
    cols = ["__w", *[c for c in o.columns if c != "__e"]]
    inf = float("inf")
    axis = lambda d, c, none: numeric_axis(d, c).cast("double") if c else F.lit(none)
    a, b, t = axis(ww, s, -inf), axis(ww, e, inf), axis(o, "__t", None)
    width, others = _spread(ww, s, e)
    parts = []
    if width:
        place = lambda c: F.floor(c / F.lit(float(width))).cast("bigint")
        finite = ww.where((F.abs(a) < inf) & (F.abs(b) < inf) & (a <= b)).withColumn("__wb", F.explode(F.sequence(place(a), place(b))))
        parts.append(finite.join(o.where(F.abs(t) < inf).withColumn("__b", place(t)), (F.col("__b") == F.col("__wb")) & cond).select(*cols))
    if others:
        rest = ww.where(~((F.abs(a) < inf) & (F.abs(b) < inf))) if width else ww
        tree = Tree([(o, t)])
        rest = rest.where(a <= b).withColumns({"__la": tree.leaf(a), "__lb": tree.leaf(b)}).withColumn("__node", F.explode(tree.covering(F.col("__la"), F.col("__lb"))))
        points = o.withColumn("__lt", tree.leaf(t)).withColumn("__at", F.explode(tree.above(F.col("__lt"))))
        parts.append(rest.join(points, (F.col("__at") == F.col("__node")) & cond).select(*cols))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _customised(fn: Callable, names: list[str], time_col: str, value_col: str) -> Callable:
    def run(pdf):
        frame = pdf.set_index("__w")[["__t", "__v"]].rename(columns={"__t": time_col, "__v": value_col})
        got = fn(frame)
        got = got.to_frame() if got.ndim == 1 else got
        got.columns = names
        got.index.name = "__w"
        return got.reset_index()

    return run


def resample_eav(
    df: DataFrame, windows, agg: dict | None = None, entity_col: str | None = None, time_col: str | None = None, attribute_col: str | None = None, value_col: str | None = None,
    include_start: bool = True, include_stop: bool = False, optimize: str = "time", start_col: str = "start", stop_col: str = "stop",
    window_id: str | None = None, row_id: str | None = None, approximate: bool = False, keep_order: bool = False,
) -> DataFrame:
    """Aggregate the observations of each window's entity and time span, for each attribute separately.

    One row for each window, its columns kept, plus <attribute>__<aggregation> columns: mean, min, max, median, pX, std, var,
    sum, prod, skew, mad, sem, size, count, nunique, mode, mode_count, first, last, any, all (of numbers: is one, is each other
    than 0?), rK and tK (value and time of the K-th
    observation, from the end if negative), custom_agg. Windows may overlap or lack an endpoint. Without observations size,
    count, nunique and mode_count are 0, others null; of missing values only the sum is 0, the product 1, any false, all true. Observations
    without a time are left out; those without a value count in size and ranks. Ties of ranks go by row_id, else by value.
    attribute_col=None: agg has one key, a label. window_id: unique column of windows (positions are made if None).
    approximate: quantiles by a sketch instead of exactly. optimize is accepted for compatibility: the planner chooses.
    """
    require(optimize in ("time", "memory"), f"unknown optimize: {optimize!r}")
    need_columns(df, [c for c in (time_col, attribute_col, value_col, entity_col) if c is not None])
    require(time_col is not None and value_col is not None, "time_col and value_col are needed")
    w = _windows_of(windows, df, entity_col=entity_col, time_col=time_col)
    if entity_col is not None:
        need_columns(w, [entity_col], "windows")
    s, e = _bounds(df, w, [type_of(df, time_col)], start_col, stop_col)
    if not agg:
        return w
    require(attribute_col is not None or len(agg) == 1, "several attributes need attribute_col")
    spec = _spec(agg)
    clash = {n.lower() for *_, n in spec} & {c.lower() for c in w.columns}
    require(not clash, f"windows already have {sorted(clash)}")
    original = w.columns
    wid = window_id
    if wid is None:
        (wid,) = fresh(w, "__wid")
        w = row_ids(w, wid)
    tt, vt = type_of(df, time_col), type_of(df, value_col)
    attrs = list(agg)
    o = df.select(
        *([clean(df, entity_col).alias("__e")] if entity_col else []), clean(df, time_col).alias("__t"), clean(df, value_col).alias("__v"),
        (q(attribute_col) if attribute_col else F.lit(attrs[0])).alias("__a"), *([q(row_id).alias("__id")] if row_id else []),
    ).where(F.col("__t").isNotNull() & F.col("__a").isin(*attrs))
    ww = w.select(q(wid).alias("__w"), *([clean(w, entity_col).alias("__we")] if entity_col else []), *([clean(w, s).alias("__s")] if s else []), *([clean(w, e).alias("__p")] if e else []))

    def branch(how, name) -> str:
        """Which aggregate of the pairs a column belongs to."""
        if isinstance(how, custom_agg):
            return name
        if isinstance(how, tuple) and how[0] in "rt" and how[1] not in (0, -1):
            return "first ranks" if how[1] > 0 else "last ranks"
        return how if how == "mad" else "values" if how in ("mode", "mode_count", "nunique") else "plain"

    j = _meet(ww, o, "__s" if s else None, "__p" if e else None, bool(entity_col), include_start, include_stop)
    if len({branch(how, name) for _, how, name in spec}) > 1:  # several aggregates read the pairs
        j = materialise(j)
    res = w
    tie = [F.col("__id")] if row_id else [F.col("__v").isNull(), F.col("__v").alias("tv")]

    exprs: list[Column] = []
    values, ranks, customs, mads = [], [], [], []
    one = F.col("__v")
    timed = is_time(vt)
    x = micros(one, vt) if timed else one.cast("double") if isinstance(vt, (T.NumericType, T.BooleanType)) else one
    home = (lambda c: from_micros(F.round(c).cast("bigint"), vt)) if timed else (lambda c: c)
    for a, how, name in spec:
        here = F.col("__a") == a
        v, num = F.when(here, one), F.when(here, x)
        n, cnt = F.count(F.when(here, 1)), F.count(v)
        if isinstance(how, custom_agg):
            customs.append((a, how, name))
        elif isinstance(how, tuple) and how[0] in "rt":
            if how[1] in (0, -1):
                pick = F.min_by if how[1] == 0 else F.max_by
                order = F.when(here, F.struct(F.col("__t"), *tie))
                exprs.append(pick(F.col("__v") if how[0] == "r" else F.col("__t"), order).alias(name))
            else:
                ranks.append((a, how, name))
        elif how in ("mode", "mode_count", "nunique"):
            values.append((a, how, name))
        elif how == "mad":
            mads.append((a, how, name))
        else:
            p = how[1] / 100 if isinstance(how, tuple) else 0.5
            if isinstance(how, tuple) or how == "median":
                c = home(F.percentile_approx(num, p, 10_000) if approximate else F.percentile(num, F.lit(p)))
            elif how == "sum":
                c = F.when(n > 0, F.coalesce(F.sum(F.when(here, one.cast("int") if isinstance(vt, T.BooleanType) else one)), F.lit(0)))
            elif how == "prod":
                c = F.when(n > 0, F.coalesce(F.product(num), F.lit(1.0)))
            elif how == "skew":
                c = F.when(cnt >= 3, F.coalesce(F.when(F.var_pop(num) > 0, F.skewness(num)), F.lit(0.0)) * F.sqrt(cnt * (cnt - 1)) / (cnt - 2))
            elif how == "sem":
                c = F.stddev_samp(num) / F.sqrt(cnt)
            elif how in ("std", "var"):
                c = (F.stddev_samp if how == "std" else F.var_samp)(num)
            elif how == "mean":
                c = home(F.avg(num))
            elif how in ("min", "max"):
                c = (F.min if how == "min" else F.max)(v)
            elif how in ("any", "all"):
                require(isinstance(vt, (T.NumericType, T.BooleanType)), f"{how} needs numbers")
                c = F.when(n > 0, F.coalesce((F.bool_or if how == "any" else F.bool_and)(num != 0), F.lit(how == "all")))
            elif how == "size":
                c = n
            elif how == "count":
                c = cnt
            else:  # first and last known value
                order = F.when(here & one.isNotNull(), F.struct(F.col("__t"), *tie))
                c = (F.min_by if how == "first" else F.max_by)(F.col("__v"), order)
            exprs.append(c.alias(name))

    def attach(part: DataFrame) -> None:
        nonlocal res
        res = res.join(part.withColumnRenamed("__w", "__pw"), q(wid) == F.col("__pw"), "left").drop("__pw")

    if exprs:
        attach(j.groupBy("__w").agg(*exprs))
    if values:
        c = j.where(F.col("__a").isin(*{a for a, *_ in values})).groupBy("__w", "__a", "__v").agg(F.count(F.lit(1)).alias("__n")).where("__v is not null")
        best = F.struct((-F.col("__n")).alias("m"), F.col("__v"))
        outs = []
        for a, how, name in values:
            here = F.col("__a") == a
            m = F.min(F.when(here, best))
            outs.append({"mode": m["__v"], "mode_count": -m["m"], "nunique": F.count(F.when(here, 1))}[how].alias(name))
        attach(c.groupBy("__w").agg(*outs))
    if mads:
        m = j.where(F.col("__a").isin(*{a for a, *_ in mads})).withColumn("__d", F.abs(x - F.avg(x).over(Window.partitionBy("__w", "__a"))))
        attach(m.groupBy("__w").agg(*[F.avg(F.when(F.col("__a") == a, F.col("__d"))).alias(name) for a, _, name in mads]))
    for up in (True, False):
        # Only the first (or last) rows of a window are kept, before they are sent: as many as the furthest rank asks for.
        mine = [(a, h, name) for a, h, name in ranks if (h[1] >= 0) == up]
        if not mine:
            continue
        order = [F.col("__t"), *([F.col("__id")] if row_id else [F.col("__v").asc_nulls_last()])] if up else [F.col("__t").desc(), *([F.col("__id").desc()] if row_id else [F.col("__v").desc_nulls_first()])]
        far = max(h[1] + 1 if up else -h[1] for _, h, _ in mine)
        r = j.where(F.col("__a").isin(*{a for a, *_ in mine})).withColumn("__rn", F.row_number().over(Window.partitionBy("__w", "__a").orderBy(*order))).where(F.col("__rn") <= far)
        outs = []
        for a, (kind, k), name in mine:
            here = (F.col("__a") == a) & (F.col("__rn") == (k + 1 if up else -k))
            outs.append(F.max(F.when(here, F.col("__v" if kind == "r" else "__t"))).alias(name))
        attach(r.groupBy("__w").agg(*outs))
    for a, how, name in customs:
        fields = T.StructType.fromDDL(how.schema)
        names = [f.name for f in fields]
        outs = [name if len(names) == 1 and names[0] == how.name else f"{a}__{n}" for n in names]
        schema = T.StructType([T.StructField("__w", j.schema["__w"].dataType), *fields.fields])
        part = j.where(F.col("__a") == a).select("__w", "__t", "__v").groupBy("__w").applyInPandas(_customised(how.fn, names, time_col, value_col), schema)
        attach(part.select("__w", *[q(n).alias(o2) for n, o2 in zip(names, outs)]))
    zero = {name for _, how, name in spec if how in ZERO}
    res = res.withColumns({n: F.coalesce(q(n), F.lit(0)) for n in zero}) if zero else res
    if keep_order:
        res = res.orderBy(q(wid))
    new = [c for c in res.columns if c not in original and c != wid]
    first = [name for *_, name in spec if name in new]
    return res.select(*[q(c) for c in original], *[q(c) for c in first], *[q(c) for c in new if c not in first])


def resample_interval(
    df: DataFrame, windows, attributes=None, entity_col: str | None = None, start_col: str | None = None, stop_col: str | None = None, attribute_col: str | None = None, value_col: str | None = None,
    time_col: str | None = None, epsilon: float = 1e-7, window_start: str = "start", window_stop: str = "stop", window_id: str | None = None, keep_order: bool = False,
) -> DataFrame:
    """Sum the values of intervals in each window, each in proportion to the part of it that lies in the window.

    An interval of no length counts wholly if it lies in the window; an infinite one counts epsilon times its value's sign in a
    finite overlap and wholly in an infinite one. All intervals are closed; a missing column stands for infinity. Rows with a
    missing value or endpoint, or start after stop, are left out; windows with missing or inverted endpoints get 0. One column
    for each attribute; attributes=None takes those of df (read eagerly); without attribute_col one column, named by
    attributes or 'sum'.
    """
    require(value_col is not None, "value_col is needed")
    require(start_col is not None or stop_col is not None, "start_col or stop_col is needed")
    require(start_col != stop_col, "start_col and stop_col must differ")
    need_columns(df, [c for c in (entity_col, start_col, stop_col, attribute_col, value_col) if c is not None])
    require(isinstance(type_of(df, value_col), (T.NumericType, T.BooleanType)), "values must be numbers")
    w = _windows_of(windows, df, entity_col=entity_col, time_col=time_col, start_col=start_col, stop_col=stop_col)
    if window_start not in w.columns and window_stop not in w.columns:
        window_start, window_stop = start_col, stop_col
    ws, we = _bounds(df, w, [type_of(df, c) for c in (start_col, stop_col) if c], window_start, window_stop)
    names = as_list(attributes)
    if attribute_col is None:
        require(len(names) <= 1, "several attributes need attribute_col")
        names = names or ["sum"]
    elif not names:
        names = [r[0] for r in df.select(q(attribute_col)).distinct().where(q(attribute_col).isNotNull()).orderBy(q(attribute_col)).limit(MAX_ATTRIBUTES + 1).collect()]
        require(len(names) <= MAX_ATTRIBUTES, f"more than {MAX_ATTRIBUTES} attributes; name those wanted")
    clash = {str(n).lower() for n in names} & {c.lower() for c in w.columns}
    require(not clash, f"windows already have {sorted(clash)}")
    original = w.columns
    wid = window_id
    if wid is None:
        (wid,) = fresh(w, "__wid")
        w = row_ids(w, wid)
    inf = float("inf")
    axis = lambda d, c, none: numeric_axis(d, c).cast("double") if c else F.lit(none)
    i = df.select(*([clean(df, entity_col).alias("__e")] if entity_col else []), axis(df, start_col, -inf).alias("a"), axis(df, stop_col, inf).alias("b"), clean(df, value_col).cast("double").alias("v"), (q(attribute_col) if attribute_col else F.lit(names[0])).alias("__a")).where("v is not null and a <= b")
    if attribute_col:
        i = i.where(F.col("__a").isin(*names))
    x = w.select(q(wid).alias("__w"), *([clean(w, entity_col).alias("__we")] if entity_col else []), axis(w, ws, -inf).alias("s"), axis(w, we, inf).alias("t")).where("s <= t")
    lo, hi = F.greatest("a", "s"), F.least("b", "t")
    a, b, v = F.col("a"), F.col("b"), F.col("v")
    # Unbounded on the same side everywhere: every overlap is infinite, so the entity's plain sum serves all its windows.
    everywhere = (start_col is None and ws is None) or (stop_col is None and we is None)
    totals = [F.sum(F.when(F.col("__a") == n, v)).alias(str(n)) for n in names]
    if everywhere and entity_col:
        got = x.join(i.groupBy("__e").agg(*totals), F.col("__e") == F.col("__we")).select("__w", *[q(str(n)) for n in names])
    elif everywhere:
        # One row for the whole table, read as a scalar.
        got = x.select("__w", i.agg(*totals).select(F.struct(*[q(str(n)) for n in names])).scalar().alias("__x")).select("__w", "__x.*")
    else:
        if entity_col:
            x, i = x.where("__we is not null"), i.where("__e is not null")
        pairs = merge_intervals(x, i, left_on="__we" if entity_col else None, right_on="__e" if entity_col else None, how="inner", left_start="s", left_stop="t", right_start="a", right_stop="b")
        part = F.when(a == b, v).when(b - a == inf, F.when(hi - lo == inf, v).otherwise(F.lit(epsilon) * F.signum(v))).otherwise(v * (hi - lo) / (b - a))
        got = pairs.withColumn("__x", part).groupBy("__w").agg(*[F.sum(F.when(F.col("__a") == n, F.col("__x"))).alias(str(n)) for n in names])
    res = w.join(got.withColumnRenamed("__w", "__pw"), q(wid) == F.col("__pw"), "left")
    if keep_order:
        res = res.orderBy(q(wid))
    return res.select(*[q(c) for c in original], *[F.coalesce(q(str(n)), F.lit(0.0)).alias(str(n)) for n in names])
