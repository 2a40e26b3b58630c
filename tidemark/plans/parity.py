"""Queries of the interval, resampling and ordering operators over the test tables, with their SQL equivalents."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import micros, table
from ..operators.aggregate import factorize, grouped_mode, partition_series
from ..operators.intervals import combine_intervals, group_intervals
from ..operators.joins import find_containing_interval, inner_or_cross_join, merge_aggregates, merge_intervals
from ..operators.locate import get_loc, iloc_loc, iloc_loc_assign
from ..operators.ordered import impute, prev_next_values, roll1d, shift_unequal
from ..operators.resample import custom_agg, resample_eav, resample_interval
from ..operators.windows import make_windows

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def _orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders as intervals of 0 to 44 days from their date."""
    return table(spark, d, "orders").selectExpr("o_orderkey as id", "o_custkey as k", "o_orderdate as s", "o_orderdate + make_dt_interval(cast(o_orderkey % 45 as int)) as e", "o_totalprice as v", "o_orderpriority as p")


_OI = "oi as (select o_orderkey id, o_custkey k, o_orderdate s, o_orderdate + to_days((o_orderkey % 45)::int) e, o_totalprice v, o_orderpriority p from orders), l as (select * from oi where p = '1-URGENT'), r as (select * from oi where p <> '1-URGENT')"


def _lr(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = _orders(spark, d)
    return o.where("p = '1-URGENT'"), o.where("p <> '1-URGENT'")


_ENDS = dict(left_start="s", left_stop="e", right_start="s", right_stop="e")
_IDS = dict(left_id="id", right_id="id")
_ON = "l.k = r.k and l.s <= r.e and r.s <= l.e"


def _merged(spark, d, **kw):
    a, b = _lr(spark, d)
    return merge_intervals(a, b, on="k", **_ENDS, **kw)


def _how(how: str, sql: str):
    def f(spark: SparkSession, d: str) -> DataFrame:
        return _merged(spark, d, how=how).select("id_x", "k_x", "id_y", "k_y", "v_y")

    f.__name__ = f"merge_overlap_{how}"
    query(f"with {_OI} select l.id id_x, l.k k_x, r.id id_y, r.k k_y, r.v v_y from l {sql} join r on {_ON}")(f)


for _h, _s in (("inner", ""), ("left", "left"), ("right", "right"), ("outer", "full outer")):
    _how(_h, _s)


@query(f"with {_OI} select l.id id_x, r.id id_y from l join r on l.k = r.k and l.s < l.e and r.s <= r.e and l.s <= r.e and r.s < l.e")
def merge_open_closed(spark, d):
    """[s, e) on the left, [s, e] on the right: intervals of no length are empty on the left and points on the right."""
    a, b = _lr(spark, d)
    return merge_intervals(a, b, on="k", how="inner", **_ENDS, include_left_stop=False).select("id_x", "id_y")


@query(f"with {_OI} select l.id id_x, r.id id_y from l join r on l.k = r.k and l.s >= r.s and l.s <= r.e")
def merge_point_in_interval(spark, d):
    a, b = _lr(spark, d)
    return merge_intervals(a, b, on="k", how="inner", left_start="s", left_stop="s", right_start="s", right_stop="e").select("id_x", "id_y")


@query(f"with {_OI} select l.id id_x, r.id id_y from l left join r on l.k = r.k and l.s = r.s")
def merge_points(spark, d):
    a, b = _lr(spark, d)
    return merge_intervals(a, b, on="k", how="left", left_start="s", left_stop="s", right_start="s", right_stop="s").select("id_x", "id_y")


@query(f"with {_OI} select l.id id_x, r.id id_y from l join r on l.k = r.k and r.s <= l.e")
def merge_half_open(spark, d):
    """Left intervals without a start, right ones without a stop."""
    a, b = _lr(spark, d)
    return merge_intervals(a, b, on="k", how="inner", left_stop="e", right_start="s").select("id_x", "id_y")


def _keep(keep: str, sql: str):
    def f(spark: SparkSession, d: str) -> DataFrame:
        return _merged(spark, d, how="inner", keep=keep, **_IDS).select("id_x", "id_y")

    f.__name__ = f"merge_keep_{keep}"
    query(f"with {_OI}, m as (select l.id id_x, min(r.id) a, max(r.id) b from l join r on {_ON} group by 1) {sql}")(f)


_keep("first", "select id_x, a id_y from m")
_keep("last", "select id_x, b id_y from m")
_keep("both", "select id_x, a id_y from m union select id_x, b from m")


@query(f"with {_OI} select coalesce(l.id, -1) left_id, coalesce(r.id, -1) right_id from l full outer join r on {_ON}")
def merge_indexers(spark, d):
    return _merged(spark, d, how="outer", return_indexers=True, **_IDS)


_W = "select distinct window_id id, subject_id k, start s, stop e from windows"


@query(f"with w as ({_W}) select a.id id_x, b.id id_y from w a join w b on a.s < a.e and b.s < b.e and a.s < b.e and b.s < a.e")
def merge_no_keys(spark, d):
    """All pairs of overlapping windows, whatever their subjects: the binned join."""
    w = table(spark, d, "windows").selectExpr("window_id as id", "subject_id as k", "start as s", "stop as e").distinct()
    return merge_intervals(w, w, how="inner", **_ENDS, include_left_stop=False, include_right_stop=False).select("id_x", "id_y")


def _windows(spark, d):
    return table(spark, d, "windows").selectExpr("window_id as id", "subject_id as k", "start as s", "stop as e").distinct()


@query(f"with w as ({_W}) select a.id id_x, count(*) n, min(b.id) lo, max(b.id) hi from w a join w b on b.s <= a.e group by 1")
def merge_half_line_no_keys(spark, d):
    """Windows that have begun when a window stops: a single inequality, no keys."""
    w = _windows(spark, d)
    return merge_intervals(w, w, how="inner", left_stop="e", right_start="s").groupBy("id_x").agg(F.count(F.lit(1)).alias("n"), F.min("id_y").alias("lo"), F.max("id_y").alias("hi"))


@query(f"with w as ({_W}), n as (select * from w where id % 2 = 0) select a.id id_x, count(b.id) n, min(b.id) lo from n a full outer join w b on a.s < a.e and b.s is not null and b.s < a.e group by 1")
def merge_outer_no_keys(spark, d):
    """All rows of both sides: windows [s, e) with even ids and half-lines from windows' starts. Only aggregates of the pairs, whose number is quadratic, so they aren't listed."""
    w = _windows(spark, d)
    r = merge_aggregates(w.where("id % 2 = 0"), w, {"n": ("count", "id"), "lo": ("min", "id")}, how="outer", left_start="s", left_stop="e", right_start="s", include_left_stop=False)
    return r.groupBy(F.col("id").alias("id_x")).agg(F.sum("n").alias("n"), F.min("lo").alias("lo"))


@query(f"with {_OI} select l.id id_x, r.id id_y from l join r on {_ON}")
def merge_binned_keys(spark, d):
    return _merged(spark, d, how="inner", bin_width="auto").select("id_x", "id_y")


_PI = "p as (select distinct point_id, subject_id k, point from points), i as (select interval_id id, subject_id k, min(start) s, min(stop) e from intervals group by 1, 2)"


def _points_intervals(spark, d):
    p = table(spark, d, "points").selectExpr("point_id", "subject_id as k", "point").distinct()
    i = table(spark, d, "intervals").groupBy(F.col("interval_id").alias("id"), F.col("subject_id").alias("k")).agg(F.min("start").alias("s"), F.min("stop").alias("e"))
    return p, i


def _find(which: str, cols: str):
    def f(spark: SparkSession, d: str) -> DataFrame:
        p, i = _points_intervals(spark, d)
        r = find_containing_interval(p, i, "point", which=which, start_col="s", stop_col="e", group_by="k", point_id="point_id", interval_id="id")
        return r.select("point_id", *[c for c in r.columns if c.endswith("__point")])

    f.__name__ = f"find_interval_{which}"
    query(f"with {_PI}, m as (select point_id, min(id) a, max(id) b from p join i on p.k is not distinct from i.k and s <= e and point >= s and point <= e group by 1) select p.point_id, {cols} from p left join m using (point_id)")(f)


_find("first", "coalesce(a, -1) first__point")
_find("last", "coalesce(b, -1) last__point")
_find("both", "coalesce(a, -1) first__point, coalesce(b, -1) last__point")


@query(f"with {_PI}, m as (select point_id, min(id) a from p join i on p.k is not distinct from i.k and point >= s and point < s + interval 2 hour group by 1) select p.point_id, coalesce(a, -1) first__point from p left join m using (point_id)")
def find_interval_length(spark, d):
    p, i = _points_intervals(spark, d)
    i = i.withColumn("len", F.lit(timedelta(hours=2)))
    return find_containing_interval(p, i, "point", start_col="s", stop_col=None, length_col="len", group_by="k", include_stop=False, point_id="point_id", interval_id="id").select("point_id", "first__point")


# ---- resampling


def _events(spark, d, holes: bool = False) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    return e.withColumn("value", F.when(F.col("event_id") % 3 != 0, F.col("value"))) if holes else e


_EV = "ev as (select event_id, user_id, ts, event_type, case when event_id % 3 <> 0 then value end value from events)"
_PW = "w as (select event_id wid, user_id, ts - interval 7 day start, ts stop from events where event_type = 'purchase')"
_J = "j as (select w.wid, ev.* from w left join ev on w.user_id = ev.user_id and ev.ts >= w.start and ev.ts < w.stop)"


def _purchases(spark, d):
    return _events(spark, d).where("event_type = 'purchase'").select(F.col("event_id").alias("wid"), "user_id", F.expr("ts - interval 7 days").alias("start"), F.col("ts").alias("stop"))


_EAV = dict(entity_col="user_id", time_col="ts", attribute_col="event_type", value_col="value", window_id="wid", row_id="event_id")


def _eav(spark, d, agg, **kw):
    return resample_eav(_events(spark, d, True), _purchases(spark, d), agg, **_EAV, **kw)


_C = "event_type = 'click'"


@query(f"""with {_EV}, {_PW}, {_J} select wid, round(avg(value) filter ({_C}) + 1e-9, 6) mean, round(min(value) filter ({_C}), 6) lo, round(max(value) filter ({_C}), 6) hi,
  round(stddev_samp(value) filter ({_C}) + 1e-9, 6) sd, round(var_samp(value) filter ({_C}) + 1e-7, 4) vr, round(case when count(*) filter ({_C}) > 0 then coalesce(sum(value) filter ({_C}), 0) end, 4) sm,
  case when count(*) filter ({_C}) > 0 then round(coalesce(ln(product(value) filter ({_C} and value > 0)), 0), 4) end pr,
  round(stddev_samp(value) filter ({_C}) / sqrt(count(value) filter ({_C})) + 1e-9, 6) se, count(*) filter ({_C}) sz, count(value) filter ({_C}) ct, count(distinct value) filter ({_C}) nu from j group by wid""")
def eav_stats(spark, d):
    r = _eav(spark, d, {"click": ["mean", "min", "max", "std", "var", "sum", "sem", "size", "count", "nunique"]})
    pos = _events(spark, d, True).withColumn("value", F.when((F.col("value") > 0), F.col("value")))
    p = resample_eav(pos, _purchases(spark, d), {"click": ["prod"]}, **_EAV).select("wid", F.round(F.ln("click__prod"), 4).alias("pr"))
    # Both sides add a little before rounding: decimals of few places lie on the ties of rounding.
    c = lambda a, n, k=6: F.round(F.col(f"click__{a}") + {4: 1e-7, 6: 1e-9}[k] * (a in ("mean", "std", "var", "sem")), k).alias(n)
    return r.join(p, "wid").select("wid", c("mean", "mean"), c("min", "lo"), c("max", "hi"), c("std", "sd"), c("var", "vr", 4), c("sum", "sm", 4), "pr", c("sem", "se"), F.col("click__size").alias("sz"), F.col("click__count").alias("ct"), F.col("click__nunique").alias("nu"))


@query(f"with {_EV}, {_PW}, {_J} select wid, round(case when count(value) filter ({_C}) >= 3 then coalesce(skewness(value) filter ({_C}), 0) end, 4) sk from j group by wid")
def eav_skew(spark, d):
    return _eav(spark, d, {"click": ["skew"]}).select("wid", F.round("click__skew", 4).alias("sk"))


@query(f"with {_EV}, {_PW}, {_J} select wid, round(quantile_cont(value, 0.25) filter ({_C}), 6) q1, round(median(value) filter ({_C}), 6) q2, round(quantile_cont(value, 0.333) filter (event_type = 'view'), 6) v3 from j group by wid")
def eav_quantiles(spark, d):
    r = _eav(spark, d, {"click": ["p25", "median"], "view": ["p33.3"]})
    return r.select("wid", F.round("click__p25", 6).alias("q1"), F.round("click__median", 6).alias("q2"), F.round("`view__p33.3`", 6).alias("v3"))


@query("""with ev as (select event_id, user_id, ts, event_type, case when event_id % 3 <> 0 then floor(value / 10) end v from events), w as (select event_id wid, user_id, ts - interval 30 day start, ts stop from events where event_type = 'purchase'),
  c as (select wid, v, count(*) n from w join ev on w.user_id = ev.user_id and ev.ts >= w.start and ev.ts < w.stop and event_type = 'click' and v is not null group by 1, 2),
  m as (select wid, min_by(v, (-n, v)) mode, max(n) n from c group by 1) select w.wid, m.mode, coalesce(n, 0) mode_count from w left join m on w.wid = m.wid""")
def eav_mode(spark, d):
    e = _events(spark, d, True).withColumn("value", F.floor(F.col("value") / 10).cast("double"))
    w = _purchases(spark, d).withColumn("start", F.expr("stop - interval 30 days"))
    return resample_eav(e, w, {"click": ["mode", "mode_count"]}, **_EAV).select("wid", F.col("click__mode").alias("mode"), F.col("click__mode_count").alias("mode_count"))


@query(f"with {_EV}, {_PW}, {_J}, m as (select *, avg(value) over (partition by wid) mu from j where {_C}), x as (select wid, round(avg(abs(value - mu)), 6) mad from m group by 1) select w.wid, mad from w left join x on w.wid = x.wid")
def eav_mad(spark, d):
    return _eav(spark, d, {"click": ["mad"]}).select("wid", F.round("click__mad", 6).alias("mad"))


@query(f"""with {_EV}, {_PW}, {_J}, k as (select *, row_number() over (partition by wid order by ts, event_id) - 1 a, row_number() over (partition by wid order by ts desc, event_id desc) b from j where {_C}),
  m as (select wid, max(value) filter (a = 0) r0, max(value) filter (b = 1) r_1, max(ts) filter (a = 0) t0, max(ts) filter (b = 1) t_1, max(value) filter (a = 2) r2, max(ts) filter (b = 3) t_3 from k group by 1)
  select w.wid, r0, r_1, epoch_us(t0) t0, epoch_us(t_1) t_1, r2, epoch_us(t_3) t_3 from w left join m on w.wid = m.wid""")
def eav_ranks(spark, d):
    r = _eav(spark, d, {"click": ["r0", "r-01", "t0", "t-1", "r2", "t-3"]})
    us = lambda c: micros(F.col(f"`click__{c}`"))
    return r.select("wid", F.col("click__r0").alias("r0"), F.col("`click__r-1`").alias("r_1"), us("t0").alias("t0"), us("t-1").alias("t_1"), F.col("click__r2").alias("r2"), us("t-3").alias("t_3"))


@query(f"""with {_EV}, {_PW}, {_J} select wid, min_by(value, (ts, event_id)) filter ({_C} and value is not null) f, max_by(value, (ts, event_id)) filter ({_C} and value is not null) l from j group by wid""")
def eav_first_last(spark, d):
    """First and last known value."""
    return _eav(spark, d, {"click": ["first", "last"]}).select("wid", F.col("click__first").alias("f"), F.col("click__last").alias("l"))


@query(f"""with {_EV}, {_PW}, {_J} select wid, case when count(*) filter ({_C}) > 0 then coalesce(bool_or(event_id % 5 > 2) filter ({_C} and value is not null), false) end a,
  case when count(*) filter ({_C}) > 0 then coalesce(bool_and(event_id % 5 > 2) filter ({_C} and value is not null), true) end b from j group by wid""")
def eav_any_all(spark, d):
    e = _events(spark, d, True).withColumn("value", F.when(F.col("value").isNotNull(), (F.col("event_id") % 5 > 2).cast("double")))
    return resample_eav(e, _purchases(spark, d), {"click": ["any", "all"]}, **_EAV).select("wid", F.col("click__any").alias("a"), F.col("click__all").alias("b"))


@query(f"""with {_EV}, {_PW}, {_J} select wid, case when count(*) filter ({_C}) > 0 then coalesce(product(case when value is not null then (event_id % 5 - 2) / 2 end) filter ({_C}), 1) end p from j group by wid""")
def eav_prod_signed(spark, d):
    """Products with zeros and signs; 1 over missing values only."""
    e = _events(spark, d, True).withColumn("value", F.when(F.col("value").isNotNull(), (F.col("event_id") % 5 - 2) / F.lit(2.0)))
    return resample_eav(e, _purchases(spark, d), {"click": ["prod"]}, **_EAV).select("wid", (F.col("click__prod") + F.lit(0.0)).alias("p"))


@query(f"with {_EV}, w as (select user_id, max(ts) stop from events group by 1) select w.user_id, count(ev.ts) filter ({_C}) sz, count(value) filter ({_C}) ct from w left join ev on w.user_id = ev.user_id and ev.ts < w.stop group by 1")
def eav_open_window(spark, d):
    """Windows without a start."""
    w = _events(spark, d).groupBy("user_id").agg(F.max("ts").alias("stop"))
    r = resample_eav(_events(spark, d, True), w, {"click": ["size", "count"]}, **{**_EAV, "window_id": "user_id"})
    return r.select("user_id", F.col("click__size").alias("sz"), F.col("click__count").alias("ct"))


@query(f"with {_EV}, {_PW} select wid, count(ev.ts) n from w left join ev on w.user_id = ev.user_id and ev.ts > w.start and ev.ts <= w.stop and event_type = 'purchase' group by 1")
def eav_include_stop(spark, d):
    return _eav(spark, d, {"purchase": ["size"]}, include_start=False, include_stop=True).select("wid", F.col("purchase__size").alias("n"))


@query("""with w as (select event_id wid, user_id, ts - interval 1 day start, ts - interval 1 hour stop from events) select w.user_id, epoch_us(w.start) start_us, count(e.ts) n from w left join events e on e.user_id = w.user_id and e.ts >= w.start and e.ts < w.stop and e.event_type = 'view' group by w.wid, 1, 2""")
def eav_make_windows_rel(spark, d):
    """A window before each event: from one day to one hour ahead of it."""
    m = make_windows(start_rel=timedelta(days=-1), stop_rel=timedelta(hours=-1), anchor="ts")
    r = resample_eav(_events(spark, d), m, {"view": ["size"]}, entity_col="user_id", time_col="ts", attribute_col="event_type", value_col="value", row_id="event_id")
    return r.select("user_id", micros(F.col("start")).alias("start_us"), F.col("view__size").alias("n"))


@query("""with w as (select user_id, max(ts) - interval 7 day start, max(ts) - interval 2 day stop from events group by 1) select w.user_id, epoch_us(w.stop) stop_us, round(avg(e.value), 6) m from w left join events e on e.user_id = w.user_id and e.ts >= w.start and e.ts < w.stop and e.event_type = 'view' group by 1, 2""")
def eav_make_windows_last(spark, d):
    """One window for each user, relative to the last event."""
    m = make_windows(df=lambda df, entity_col, time_col, **_: df.groupBy(entity_col).agg(F.max(time_col).alias(time_col)), start_rel=timedelta(days=-7), duration=timedelta(days=5), anchor="ts")
    r = resample_eav(_events(spark, d), m, {"view": ["mean"]}, entity_col="user_id", time_col="ts", attribute_col="event_type", value_col="value", row_id="event_id")
    return r.select("user_id", micros(F.col("stop")).alias("stop_us"), F.round("view__mean", 6).alias("m"))


@query("""with v as (select user_id, ts, value from events where event_type = 'click'), w as (select user_id, max(ts) - interval 60 day start, max(ts) stop from events group by 1),
  x as (select w.user_id, max(value) - min(value) rng, count(value)::double n from w join v on w.user_id = v.user_id and v.ts >= w.start and v.ts < w.stop group by 1) select w.user_id, round(rng, 6) rng, n from w left join x on w.user_id = x.user_id""")
def eav_custom_agg(spark, d):
    def span(frame):
        g = frame.groupby(level=0)["value"]
        out = g.agg(["min", "max", "count"])
        return out.assign(rng=out["max"] - out["min"], n=out["count"].astype(float))[["rng", "n"]]

    w = _events(spark, d).groupBy("user_id").agg((F.max("ts") - F.expr("interval 60 days")).alias("start"), F.max("ts").alias("stop"))
    r = resample_eav(_events(spark, d), w, {"click": [custom_agg(span, "rng double, n double")]}, **{**_EAV, "window_id": "user_id"})
    return r.select("user_id", F.round("click__rng", 6).alias("rng"), F.col("click__n").alias("n"))


def _months(spark, d) -> DataFrame:
    """One window a month for each customer with orders."""
    o = _orders(spark, d)
    return o.select("k", F.date_trunc("month", "s").cast("timestamp_ntz").alias("start")).distinct().withColumn("stop", F.expr("start + interval 30 days"))


_MW = "mw as (select distinct k, date_trunc('month', s)::timestamp as start, date_trunc('month', s)::timestamp + interval 30 day as stop from oi)"
_PART = "case when s = e then v else v * (epoch_us(least(e, stop)) - epoch_us(greatest(s, start)))::double / (epoch_us(e) - epoch_us(s)) end"


@query(f"with {_OI}, {_MW} select mw.k, epoch_us(start) start_us, round(coalesce(sum({_PART}) filter (p = '1-URGENT'), 0) + 1e-6, 3) urgent, round(coalesce(sum({_PART}) filter (p = '5-LOW'), 0) + 1e-6, 3) low from mw left join oi on oi.k = mw.k and s <= stop and e >= start group by 1, 2")
def interval_resample(spark, d):
    r = resample_interval(_orders(spark, d), _months(spark, d), ["1-URGENT", "5-LOW"], entity_col="k", start_col="s", stop_col="e", attribute_col="p", value_col="v", window_start="start", window_stop="stop")
    return r.select("k", micros(F.col("start")).alias("start_us"), F.round(F.col("1-URGENT") + 1e-6, 3).alias("urgent"), F.round(F.col("5-LOW") + 1e-6, 3).alias("low"))


@query(f"with {_OI}, {_MW} select mw.k, epoch_us(start) start_us, round(coalesce(sum(v), 0), 3) total from mw left join oi on oi.k = mw.k and s >= start and s <= stop group by 1, 2")
def interval_resample_points(spark, d):
    r = resample_interval(_orders(spark, d).withColumn("e", F.col("s")), _months(spark, d), "total", entity_col="k", start_col="s", stop_col="e", value_col="v", window_start="start", window_stop="stop")
    return r.select("k", micros(F.col("start")).alias("start_us"), F.round("total", 3).alias("total"))


@query(f"with {_OI}, {_MW} select mw.k, epoch_us(stop) stop_us, round(coalesce(t, 0), 3) total from (select distinct k, stop from mw) mw left join (select k, sum(v) t from oi group by 1) x on x.k = mw.k")
def interval_resample_unbounded(spark, d):
    """Neither intervals nor windows have a start: every window gets its entity's sum."""
    w = _months(spark, d).select("k", "stop")
    r = resample_interval(_orders(spark, d), w, "total", entity_col="k", stop_col="e", value_col="v", window_start="start", window_stop="stop")
    return r.select("k", micros(F.col("stop")).alias("stop_us"), F.round("total", 3).alias("total"))


@query(f"with {_OI}, w as (select distinct date_trunc('month', s)::timestamp + interval 30 day stop from oi) select epoch_us(stop) stop_us, round((select sum(v) from oi where p = '1-URGENT'), 2) urgent, round((select sum(v) from oi where p = '5-LOW'), 2) low from w")
def interval_resample_no_entity(spark, d):
    """Without entity and without starts: every window gets the whole table's sums."""
    w = _months(spark, d).select("stop").distinct()
    r = resample_interval(_orders(spark, d), w, ["1-URGENT", "5-LOW"], stop_col="e", attribute_col="p", value_col="v", window_stop="stop")
    return r.select(micros(F.col("stop")).alias("stop_us"), F.round("`1-URGENT`", 2).alias("urgent"), F.round("`5-LOW`", 2).alias("low"))


# ---- interval algebra

_SWEEP = """ev as (select {g} g, s t, 1 d from x union all select {g}, e, -1 from x), b as (select g, t, sum(d) d from ev group by 1, 2), c as (select g, t, sum(d) over (partition by g order by t) n, lead(t) over (partition by g order by t) t2 from b),
  seg as (select g, t, t2 from c where t2 is not null and {cond}), i as (select *, case when lag(t2) over (partition by g order by t) = t then 0 else 1 end brk from seg), j as (select *, sum(brk) over (partition by g order by t) grp from i)
  select g k, epoch_us(min(t)) s_us, epoch_us(max(t2)) e_us from j group by g, grp"""


def _combine(name: str, cond: str, **kw):
    def f(spark: SparkSession, d: str) -> DataFrame:
        r = combine_intervals(_orders(spark, d), "s", "e", group_by="k", **kw)
        return r.select("k", micros(F.col("s")).alias("s_us"), micros(F.col("e")).alias("e_us"))

    f.__name__ = name
    query(f"with {_OI}, x as (select * from oi), {_SWEEP.format(g='k', cond=cond)}")(f)


_combine("combine_union", "n >= 1")
_combine("combine_intersect2", "n >= 2", n_min=2)
_combine("combine_gaps", "n = 0", n_min=0, n_max=0)
_combine("combine_exactly_one", "n = 1", n_min=1, n_max=1)


@query(f"with {_OI}, x as (select * from oi), {_SWEEP.format(g='0', cond='n = 0')}")
def combine_gaps_ungrouped(spark, d):
    r = combine_intervals(_orders(spark, d), "s", "e", n_min=0, n_max=0)
    return r.select(F.lit(0).alias("k"), micros(F.col("s")).alias("s_us"), micros(F.col("e")).alias("e_us"))


@query(f"""with {_OI}, u0 as (select k, p, s, e, max(e) over (partition by k, p order by s, e rows between unbounded preceding and 1 preceding) pe from oi), u1 as (select *, sum(case when pe >= s then 0 else 1 end) over (partition by k, p order by s, e rows unbounded preceding) grp from u0),
  x as (select k, p, min(s) s, max(e) e from u1 group by k, p, grp), {_SWEEP.format(g='k', cond='n >= 2')}""")
def combine_attr(spark, d):
    """Where orders of two or more priorities are open at once."""
    r = combine_intervals(_orders(spark, d), "s", "e", attr_cols="p", group_by="k", n_min=2)
    return r.select("k", micros(F.col("s")).alias("s_us"), micros(F.col("e")).alias("e_us"))


@query(f"with {_OI}, x as (select * from oi), z as ({_SWEEP.format(g='k', cond='n >= 1').replace('ev as', 'select * from (with ev as', 1)})) select k, s_us, e_us - s_us len_us from z")
def combine_length(spark, d):
    o = _orders(spark, d).withColumn("len", F.col("e") - F.col("s"))
    r = combine_intervals(o, "s", None, "len", group_by="k")
    return r.select("k", micros(F.col("s")).alias("s_us"), micros(F.col("len"), r.schema["len"].dataType).alias("len_us"))


def _dense(pre: str, cols: str) -> str:
    return f"{pre}, b as (select *, case when near then 0 else 1 end brk from a) select {cols}, (sum(brk) over (order by k, s, id rows unbounded preceding) - 1)::bigint as gid from b"


@query("with a as (select user_id k, ts s, event_id id, coalesce(ts <= lag(ts) over (partition by user_id order by ts, event_id) + interval 6 hour, false) near from events)" + _dense("", "id").replace(", b as", ", b as", 1))
def group_points(spark, d):
    return group_intervals(_events(spark, d), "user_id", point_col="ts", distance=timedelta(hours=6), row_id="event_id", name="gid").select(F.col("event_id").alias("id"), "gid")


@query(f"with {_OI}, m as (select *, max(e) over (partition by k order by s, id rows between unbounded preceding and 1 preceding) pe from oi), a as (select *, coalesce(s <= pe + interval 5 day, false) near from m)" + _dense("", "id"))
def group_intervals_days(spark, d):
    return group_intervals(_orders(spark, d), "k", start_col="s", stop_col="e", distance=timedelta(days=5), row_id="id", name="gid").select("id", "gid")


@query(f"with {_OI}, m as (select *, max(e) over (partition by k order by s, id rows between unbounded preceding and 1 preceding) pe from oi), a as (select *, coalesce(s < pe + interval 5 day, false) near from m)" + _dense("", "id"))
def group_exclusive(spark, d):
    return group_intervals(_orders(spark, d), "k", start_col="s", stop_col="e", distance=timedelta(days=5), inclusive=False, row_id="id", name="gid").select("id", "gid")


@query("with a as (select ts s, event_id id, coalesce(ts <= lag(ts) over (order by ts, event_id) + interval 30 minute, false) near, 0 k from events)" + _dense("", "id"))
def group_ungrouped(spark, d):
    return group_intervals(_events(spark, d), None, point_col="ts", distance=timedelta(minutes=30), row_id="event_id", name="gid").select(F.col("event_id").alias("id"), "gid")


# ---- order


@query("select event_id, lag(event_type) over w event_type_prev, lead(value) over w value_next from events window w as (partition by user_id order by ts, event_id)")
def prev_next(spark, d):
    r = prev_next_values(_events(spark, d), "ts", "user_id", {"event_type": {"prev_name": "event_type_prev"}, "value": {"next_name": "value_next"}}, row_id="event_id")
    return r.select("event_id", "event_type_prev", "value_next")


@query(f"with {_EV} select event_id, lag(value, 1, -1.0) over w p, lead(value, 1, -2.0) over w n from ev window w as (partition by user_id order by ts, event_id)")
def prev_next_fill(spark, d):
    r = prev_next_values(_events(spark, d, True), "ts", "user_id", {"value": {"prev_name": "p", "prev_fill": -1.0, "next_name": "n", "next_fill": -2.0}}, row_id="event_id")
    return r.select("event_id", "p", "n")


@query("select event_id, row_number() over (partition by user_id order by ts, event_id) = 1 first, row_number() over (partition by user_id order by ts desc, event_id desc) = 1 last from events")
def first_last(spark, d):
    return prev_next_values(_events(spark, d), "ts", "user_id", first_indicator_name="first", last_indicator_name="last", row_id="event_id").select("event_id", "first", "last")


@query("select event_id, lag(value) over w value_prev, lead(value) over w value_next from events window w as (order by ts, event_id)")
def prev_next_ungrouped(spark, d):
    return prev_next_values(_events(spark, d), "ts", None, "value", row_id="event_id").select("event_id", "value_prev", "value_next")


_F = "last_value(value ignore nulls) over (partition by user_id order by ts, event_id rows between {} preceding and current row)"
_B = "first_value(value ignore nulls) over (partition by user_id order by ts, event_id rows between current row and {} following)"


def _impute(name: str, sql: str, **kw):
    def f(spark: SparkSession, d: str) -> DataFrame:
        r = impute(_events(spark, d, True), group_by="user_id", order_by=["ts", "event_id"], columns="value", **kw)
        return r.select("event_id", F.round("value", 6).alias("value"))

    f.__name__ = name
    query(f"with {_EV} {sql}")(f)


_U = "unbounded"
_impute("impute_ffill", f"select event_id, round({_F.format(_U)}, 6) as value from ev", method="ffill")
_impute("impute_bfill", f"select event_id, round({_B.format(_U)}, 6) as value from ev", method="bfill")
_impute("impute_limit", f"select event_id, round({_F.format(1)}, 6) as value from ev", method="ffill", limit=1)
_impute("impute_afill", f", x as (select event_id, value, {_F.format(_U)} a, {_B.format(_U)} b from ev) select event_id, round(coalesce(value, coalesce(a, b) + (coalesce(b, a) - coalesce(a, b)) / 2), 6) as value from x", method="afill")
_LIN = """, n as (select *, row_number() over (partition by user_id order by ts, event_id) rn from ev), x as (select *, case when value is not null then rn end ra from n),
  y as (select *, last_value(value ignore nulls) over p v0, last_value(ra ignore nulls) over p r0, first_value(value ignore nulls) over q v1, first_value(ra ignore nulls) over q r1 from x
    window p as (partition by user_id order by rn rows between unbounded preceding and current row), q as (partition by user_id order by rn rows between current row and unbounded following)),
  z as (select event_id, user_id, ts, coalesce(value, case when r0 is not null and r1 is not null then v0 + (v1 - v0) * (rn - r0) / (r1 - r0) end) as value from y)"""
_impute("impute_linear", _LIN + " select event_id, round(value, 6) as value from z", method="linear")
_impute("impute_lfill", _LIN + f" select event_id, round(coalesce(value, {_F.format(_U)}, {_B.format(_U)}), 6) as value from z", method="lfill")


@query("with n as (select event_id, event_type, row_number() over (order by ts, event_id) - 1 p, count(*) over () c from events) select a.event_id, b.event_type rolled from n a join n b on b.p = (a.p + 3) % a.c")
def rolled(spark, d):
    return roll1d(_events(spark, d), "event_type", -3, ["ts", "event_id"], "rolled").select("event_id", "rolled")


@query("select event_id, coalesce(event_type <> lag(event_type) over (partition by user_id order by ts, event_id), true) changed from events")
def shift_changed(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _events(spark, d).select("event_id", shift_unequal(F.col("event_type"), -1, w).alias("changed"))


# ---- groups and keys


@query("with c as (select l_suppkey, l_returnflag v, count(*) n from lineitem group by 1, 2) select l_suppkey, min_by(v, (-n, v)) mode, max(n) count from c group by 1")
def grouped_mode_flags(spark, d):
    return grouped_mode(table(spark, d, "lineitem"), "l_suppkey", "l_returnflag")


@query("""with e as (select user_id, case when event_id % 3 <> 0 then event_type end v from events), c as (select user_id, v, count(*) n from e group by 1, 2) select user_id, min_by(coalesce(v, ''), (-n, v is null, v)) as mode0, max(n) count from c group by 1""")
def grouped_mode_nulls(spark, d):
    e = _events(spark, d).withColumn("event_type", F.when(F.col("event_id") % 3 != 0, F.col("event_type")))
    return grouped_mode(e, "user_id", "event_type", dropna=False).select("user_id", F.coalesce("mode", F.lit("")).alias("mode0"), "count")


@query("select c_custkey, dense_rank() over (order by f) - 1 as key from (select *, min(c_custkey) over (partition by c_nationkey, c_mktsegment) f from customer)")
def factorize_first(spark, d):
    return factorize(table(spark, d, "customer"), columns=["c_nationkey", "c_mktsegment"], order_by="c_custkey").select("c_custkey", "key")


@query("select c_custkey, dense_rank() over (order by c_nationkey, c_mktsegment) - 1 as key from customer")
def factorize_sorted(spark, d):
    return factorize(table(spark, d, "customer"), columns=["c_nationkey", "c_mktsegment"], sort=True).select("c_custkey", "key")


@query("with a as (select 'c' t, c_custkey id, c_nationkey n from customer union all select 's', s_suppkey, s_nationkey from supplier) select t, id, dense_rank() over (order by n) - 1 as key from a")
def factorize_two(spark, d):
    c, s = factorize(table(spark, d, "customer"), table(spark, d, "supplier"), columns="c_nationkey", right_columns="s_nationkey", sort=True)
    return c.select(F.lit("c").alias("t"), F.col("c_custkey").alias("id"), "key").unionByName(s.select(F.lit("s").alias("t"), F.col("s_suppkey").alias("id"), "key"))


@query("select n_nationkey, n_name, r_name from nation join region on n_regionkey = r_regionkey")
def inner_join(spark, d):
    return inner_or_cross_join(table(spark, d, "nation"), table(spark, d, "region"), on="n_regionkey").select("n_nationkey", "n_name", "r_name")


@query("select n_nationkey, r_regionkey from nation cross join region")
def cross_join(spark, d):
    return inner_or_cross_join(table(spark, d, "nation"), table(spark, d, "region")).select("n_nationkey", "r_regionkey")


@query("select n_nationkey, n_name from (select *, row_number() over (order by n_name) - 1 p from nation) where p >= 3 and p < 17 and (p - 3) % 2 = 0")
def iloc_slice(spark, d):
    return iloc_loc(table(spark, d, "nation"), slice(3, 17, 2), ["n_nationkey", "n_name"], order_by="n_name")


@query("select n_nationkey, case when p in (0, 4, 24) then 'x' else n_name end n_name from (select *, row_number() over (order by n_nationkey) - 1 p from nation)")
def iloc_assign(spark, d):
    return iloc_loc_assign(table(spark, d, "nation"), [0, 4, -1], "n_name", "x", order_by="n_nationkey").select("n_nationkey", "n_name")


@query("select p as position from (select *, row_number() over (order by n_nationkey) - 1 p from nation) where n_regionkey = 2")
def get_loc_key(spark, d):
    return get_loc(table(spark, d, "nation"), "n_regionkey", 2, order_by="n_nationkey")


@query("select p as position from (select row_number() over (order by n_nationkey) - 1 p from nation) where p % 4 = 1")
def get_loc_mask(spark, d):
    return get_loc(table(spark, d, "nation"), "n_regionkey", [i % 4 == 1 for i in range(table(spark, d, "nation").count())], order_by="n_nationkey")


@query("select p as position from (select *, row_number() over (order by n_nationkey) - 1 p from nation) where n_name between 'NATION_10' and 'NATION_2'")
def get_loc_slice(spark, d):
    return get_loc(table(spark, d, "nation"), "n_name", slice("NATION_10", "NATION_2"), order_by="n_nationkey")


@query("select n_nationkey from (select *, row_number() over (order by n_name) - 1 p from nation) where p % 3 <> 0")
def iloc_mask(spark, d):
    return iloc_loc(table(spark, d, "nation"), [i % 3 != 0 for i in range(table(spark, d, "nation").count())], "n_nationkey", order_by="n_name")


@query("""with recursive o as (select o_custkey, count(*)::double n from orders group by 1), r as (select *, row_number() over (order by o_custkey) i from o),
  f(i, rests, bin) as (select 0::bigint, []::double[], -1::bigint union all
    select r.i, case when k is null then list_append(rests, 200.0 - g.n) else list_concat(list_concat(rests[:k - 1], [rests[k] - g.n]), rests[k + 1:]) end, case when k is null then len(rests) else k - 1 end
    from (select f.*, r.n, r.i ri, nullif(list_position(list_transform(f.rests, lambda x: x >= r.n), true), 0) k from f join r on r.i = f.i + 1) g join r on r.i = g.ri)
  select o_custkey, r.n, bin from f join r using (i)""")
def partition_bins_in_order(spark, d):
    """Customers in order packed into bins of at most 200 orders: first fit."""
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return partition_series(n, "n", 200.0, shuffle=False, order_by="o_custkey")


@query()
def partition_bins(spark, d):
    """Customers packed into bins of at most 200 orders."""
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return partition_series(n, "n", 200.0, order_by="o_custkey")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return QUERIES["merge_overlap_inner"](spark, d)
