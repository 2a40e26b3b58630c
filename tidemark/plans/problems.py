"""Queries of the core problems (wide tables, grids, intervals, sessions, filling) over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import micros, q, require, table
from ..functions.values import readings
from ..operators.donors import GRAIN, LEAST, MONTH, SHRINK, fill_from_donors
from ..operators.grid import regular_grid
from ..operators.sessions import sessionise
from ..operators.sweep import DAY, periods_and_gaps
from ..operators.wide import eav_to_cells, typed_wide

HOUR = 3_600_000_000
#: Attribute types that a wide table may have.
MAX_COLUMNS = 2000


def typed_readings(spark: SparkSession, d: str, usable: bool | None = True) -> DataFrame:
    return readings(table(spark, d, "observations"), table(spark, d, "attr_types"), usable)


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """Latest usable reading of each subject and attribute; one sparse delta for each quarter of arrival, compacted."""
    r = typed_readings(spark, d).select("subject_id", "code", "timestamp", "recorded_at", F.col("obs_id").alias("id"), "num", "txt", "tm")
    load = F.coalesce(F.year("recorded_at") * 4 + F.quarter("recorded_at"), F.lit(0))
    return eav_to_cells(r, "subject_id", "code", ["timestamp", "id"], ["num", "txt", "tm"], load)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    # Every entity has cells; a plain explode would have the optimizer compute them again in a filter.
    return _cells(spark, d).select(F.col("entity").alias("subject_id"), F.explode_outer("cells").alias("attribute", "cell")).select("subject_id", "attribute", F.col("cell.id").alias("obs_id"))


def _types(spark: SparkSession, d: str) -> dict[str, str]:
    rows = table(spark, d, "attr_types").where("attribute is not null").limit(MAX_COLUMNS + 1).collect()
    require(len(rows) <= MAX_COLUMNS, f"more than {MAX_COLUMNS} attribute types")
    return {r.attribute: r.kind for r in rows}


def p1_wide(spark: SparkSession, d: str) -> DataFrame:
    types = _types(spark, d)
    return typed_wide(_cells(spark, d), types, "subject_id")


def p1_wide_long(spark: SparkSession, d: str) -> DataFrame:
    """The wide table's typed columns turned back into rows, one for each value: (subject_id, attribute, num, txt, tm_us)."""
    kinds = _types(spark, d)
    require(len({a.lower() for a in kinds}) == len(kinds), "attributes that differ in case only have other column names")
    none = F.lit(None)

    def row(a: str, kind: str):
        c = q(a)
        num = c.cast("double") if kind in ("double", "int", "bool") else none.cast("double")
        txt = c if kind in ("category", "string") else none.cast("string")
        return F.struct(F.lit(a).alias("attribute"), num.alias("num"), txt.alias("txt"), (micros(c) if kind == "timestamp" else none.cast("bigint")).alias("tm_us"))

    long = p1_wide(spark, d).select("subject_id", F.explode(F.array(*[row(a, k) for a, k in kinds.items()])).alias("x")).select("subject_id", "x.*")
    return long.where("num is not null or txt is not null or tm_us is not null")


def _grid(spark: SparkSession, d: str) -> DataFrame:
    periodic = table(spark, d, "attr_types").where("period_s is not null")
    r = readings(table(spark, d, "observations"), periodic).where("num is not null")
    return regular_grid(r, table(spark, d, "windows"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).where("missing").select("window_id", "attribute", "slot")


def p2_grid(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    out = periods_and_gaps(table(spark, d, "intervals"), "subject_id", "start", "stop", max_gap=30 * DAY)
    t = out.schema["start"].dataType
    return out.select("subject_id", "kind", micros(F.col("start"), t).alias("start_us"), micros(F.col("stop"), t).alias("stop_us"))


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "observations").select("subject_id", F.col("timestamp").alias("start"), F.col("timestamp").alias("stop"))
    i = table(spark, d, "intervals").select("subject_id", "start", "stop")
    return sessionise(o.unionByName(i), "subject_id", "start", "stop", 2 * HOUR)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d).select("subject_id", "start_us", "stop_us")


def p6_sessions(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d)


def _filled(spark: SparkSession, d: str) -> DataFrame:
    r = typed_readings(spark, d, usable=None)
    return fill_from_donors(r.withColumn("timestamp_us", micros(F.col("timestamp"), r.schema["timestamp"].dataType)))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    # Only what got a donor: with the bare ids the optimizer would drop the matching.
    return _filled(spark, d).where("donor_id is not null").select("obs_id")


def p7_filled(spark: SparkSession, d: str) -> DataFrame:
    return _filled(spark, d)


QUERIES = {"p1_found": p1_found, "p1_wide": p1_wide, "p1_wide_long": p1_wide_long, "p2_found": p2_found, "p2_grid": p2_grid, "p4_found": p4_found, "p6_found": p6_found, "p6_sessions": p6_sessions, "p7_found": p7_found, "p7_filled": p7_filled}

_NORM = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
_BLANK = r"[\s\x{A0}\x{1680}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: readings: recognised readings of a subject (r) with typed value; usable ones have u.
READINGS = rf"""
keys as (select k, min_by(code, (p, code)) code from (
    select {_NORM.format('attribute')} k, 0 p, attribute code from attr_types union all
    select {_NORM.format('label')} k, 1 p, attribute code from attr_types) where k <> '' group by k),
raw as (select o.*, a.attribute code, a.kind, a.low, a.high, a.period_s, a.levels,
    lower(regexp_replace(coalesce(a.unit, ''), '\s', '', 'g')) un,
    regexp_replace(o.value, '^{_BLANK}+|{_BLANK}+$', '', 'g') t
  from observations o join keys on {_NORM.format('o.attribute')} = keys.k join attr_types a on a.attribute = keys.code
  where o.subject_id is not null),
nums as (select *, regexp_extract(t, '^([+-]?(?:\d+(?:[.,]\d*)?|[.,]\d+)(?:[eE][+-]?\d+)?)', 1) head from raw),
nums2 as (select *, lower(regexp_replace(substr(t, length(head) + 1), '{_BLANK}', '', 'g')) rest, {_NORM.format('t')} plain,
    regexp_replace(regexp_replace(regexp_replace(t, '^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})', '\3-\2-\1'), '^(\d{{4}})/(\d\d?)/(\d\d?)', '\1-\2-\3'), '^(\d{{4}})(\d\d)(\d\d)(T|$)', '\1-\2-\3\4') tt from nums),
nums3 as (select *, case when kind in ('double', 'int') then case when head <> '' and (rest = '' or rest = un
      or (un = '°c' and rest in ('c', 'degc', 'celsius')) or (un = 'bpm' and rest in ('/min', '1/min', 'beats/min')) or (un = '/min' and rest in ('1/min', 'bpm'))
      or (un = '%' and rest in ('percent', 'pct')))
      then try_cast(replace(head, ',', '.') as double) end
    when kind = 'bool' then case when lower(t) in ('yes', 'y', 'true', 't', '1') then 1.0 when lower(t) in ('no', 'n', 'false', 'f', '0') then 0.0 end end x,
    case when regexp_matches(tt, '^\d{{4}}-\d\d?-\d\d?[T ]+\d{{4}}$') then try_cast(regexp_replace(tt, '[T ]+(\d\d)(\d\d)$', ' \1:\2:00') as timestamp)
      when regexp_matches(tt, '^\d{{4}}-\d\d?-\d\d?[T ]+\d\d?:\d\d$') then try_cast(replace(tt, 'T', ' ') || ':00' as timestamp)
      when regexp_matches(tt, '^\d{{4}}-\d\d?-\d\d?') then try_cast(replace(tt, 'T', ' ') as timestamp) end y from nums2),
r as (select *, case when kind = 'bool' then x when (low is null or isnan(low) or x >= low) and (high is null or isnan(high) or x <= high) and (kind = 'double' or x = floor(x)) then x end num,
    case when kind = 'category' and plain <> '' and list_contains(list_transform(string_split(levels, '|'), lambda l: regexp_replace(lower(l), '[^\p{{L}}\p{{N}}]+', '', 'g')), plain) then plain
      when kind = 'string' and plain not in ('', 'na', 'nan', 'none', 'null', 'nil', 'missing', 'unknown', 'notdone', 'notavailable', 'notrecorded') then t end txt,
    case when kind = 'timestamp' then y end tm from nums3),
u as (select * from r where num is not null or txt is not null or tm is not null)"""

_ISLANDS = """{pre}
m as (select *, max(e) over (partition by subject_id order by s, e rows between unbounded preceding and 1 preceding) pe from i),
g as (select *, sum(case when pe is not null and s <= pe + {gap} then 0 else 1 end) over (partition by subject_id order by s, e rows unbounded preceding) grp from m),
f as (select subject_id, grp, min(s) s, max(e) e, count(*) n from g group by 1, 2)
"""
_P6_I = f"""with i as (select subject_id, epoch_us(timestamp) s, epoch_us(timestamp) e from observations where subject_id is not null and timestamp is not null
  union all select subject_id, epoch_us(start), epoch_us(stop) from intervals where subject_id is not null and start <= stop),"""

ORACLES = {
    "p1_found": f"with {READINGS} select subject_id, code as attribute, max_by(obs_id, (timestamp, obs_id)) as obs_id from u where timestamp is not null group by 1, 2",
    "p1_wide_long": f"""with {READINGS}, b as (select subject_id, code, max_by({{'num': num, 'txt': txt, 'tm': tm}}, (timestamp, obs_id)) v from u where timestamp is not null group by 1, 2)
      select subject_id, code as attribute, v.num as num, v.txt as txt, epoch_us(v.tm) as tm_us from b""",
    "p2_found": f"""with {READINGS},
      w as (select distinct window_id, subject_id, start, stop from windows where start < stop and subject_id is not null),
      v as (select subject_id, code, period_s, epoch_us(timestamp) t from u where period_s is not null and num is not null and timestamp is not null),
      h as (select distinct w.window_id, w.subject_id, code, period_s, epoch_us(start) s, epoch_us(stop) e from w join v on w.subject_id = v.subject_id and t >= epoch_us(start) and t < epoch_us(stop)),
      g as (select *, unnest(range(0, (e - s) // (period_s::bigint * 1000000))) slot from h)
      select window_id, code as attribute, slot from g where not exists (select 1 from v where v.subject_id = g.subject_id and v.code = g.code
        and t >= s + slot * period_s::bigint * 1000000 and t < s + (slot + 1) * period_s::bigint * 1000000)""",
    "p4_found": _ISLANDS.format(pre="with i as (select subject_id, epoch_us(start) s, epoch_us(stop) e from intervals where subject_id is not null and start < stop),", gap=0)
    + f"""select subject_id, 'period' as kind, s as start_us, e as stop_us from f union all
    select * from (select subject_id, 'gap', e, lead(s) over (partition by subject_id order by s) n from f) where n - e <= {30 * DAY}""",
    "p6_found": _ISLANDS.format(pre=_P6_I, gap=2 * HOUR) + "select subject_id, s as start_us, e as stop_us from f",
    "p6_sessions": _ISLANDS.format(pre=_P6_I, gap=2 * HOUR) + "select subject_id, s as start_us, e as stop_us, e - s as duration_us, n as records from f",
    "p7_found": f"""with {READINGS},
      x as (select distinct obs_id, subject_id, code, epoch_us(timestamp) t, (num is not null or txt is not null or tm is not null) ok from r where timestamp is not null)
      select distinct a.obs_id from x a join x b on a.subject_id = b.subject_id and a.code = b.code and not a.ok and b.ok and abs(a.t - b.t) <= {HOUR}""",
    "p7_filled": f"""with {READINGS},
      x as (select obs_id, subject_id, code, epoch_us(timestamp) t, num, txt, tm, (num is not null or txt is not null or tm is not null) ok,
        coalesce(num, ('0x' || substr(md5(txt), 1, 8))::bigint / 4294967296.0, epoch_us(tm) / {DAY}.0) y, (epoch_us(timestamp) % {DAY} + {DAY}) % {DAY} * 2 * pi() / {DAY} g from r where timestamp is not null),
      c as (select subject_id, code, t // {MONTH} k, count(*) n, avg(y) y, avg(t / {DAY}.0) d, avg(sin(g)) sn, avg(cos(g)) cs, var_pop(y) yy, var_pop(sin(g)) ss, var_pop(cos(g)) cc, covar_pop(sin(g), cos(g)) sc, covar_pop(sin(g), y) sy, covar_pop(cos(g), y) cy,
        var_pop(t / {DAY}.0) dd, covar_pop(t / {DAY}.0, y) dy from x where ok group by all),
      a1 as (select code, sum(n) n, sum(n * y) / sum(n) m, sum(n * ss) a, sum(n * cc) b, sum(n * sc) c, sum(n * sy) p, sum(n * cy) q, sqrt(sum(n * yy) / sum(n)) sd from c group by 1),
      att as (select code, m, sd, case when a * b - c * c > 1e-6 * n * n then (p * b - q * c) / (a * b - c * c) else 0 end bs, case when a * b - c * c > 1e-6 * n * n then (q * a - p * c) / (a * b - c * c) else 0 end bc from a1),
      s1 as (select subject_id, code, sum(n) n, sum(n * y) / sum(n) y, sum(n * d) / sum(n) d, sum(n * sn) / sum(n) sn, sum(n * cs) / sum(n) cs,
        case when sum(n) >= {LEAST} then (sum(n * dy) + sum(n * d * y) - sum(n * d) * sum(n * y) / sum(n)) / sum(n)
        / (greatest((sum(n * dd) + sum(n * d * d) - sum(n * d) * sum(n * d) / sum(n)) / sum(n), 0) + 1) else 0 end slope from c group by 1, 2),
      src as (select subject_id, code, slope, (n * y + {SHRINK} * m) / (n + {SHRINK}) - slope * d - bs * sn - bc * cs base from s1 join att using (code)),
      z as (select x.*, base + slope * (t / {DAY}.0) + bs * sin(g) + bc * cos(g) line, sd from x join src using (subject_id, code) join att using (code)),
      m as (select a.obs_id, a.subject_id, a.code, abs(a.t - b.t) d, b.obs_id donor_id, b.num, b.txt, b.tm,
        case when b.sd > 0 then round(abs(a.line - b.line - case when b.txt is null then (b.y - b.line) / {1 + SHRINK} else 0 end) / (b.sd * {GRAIN})) else 0 end gap
        from z a join z b on a.subject_id = b.subject_id and a.code = b.code and not a.ok and b.ok and abs(a.t - b.t) <= {HOUR})
      select obs_id, subject_id, code as attribute, donor_id, num, txt, tm, d as distance_us from (select *, row_number() over (partition by obs_id order by gap, d, donor_id) k from m) where k = 1""",
}
