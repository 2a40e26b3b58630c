"""Joins on overlap and containment of intervals, combined with equality keys."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..common import as_list, chunked, clean, fresh, hot, is_time, materialise, need_columns, numeric_axis, q, require, row_ids, type_of
from .nodes import Tree

#: A key with more rows than this on a side gets bins by itself, as its pairs would grow with the square of its rows.
HOT_KEY = 50_000
#: If rows would touch more bins than this on average, or a single row more than that, nodes of a tree take the place of bins.
MOST_BINS, MOST_BINS_OF_A_ROW = 50, 100_000


class _Side:
    """Endpoints of one side of a join: None stands for an infinite end."""

    def __init__(self, df: DataFrame, start: str | None, stop: str | None, closed_start: bool, closed_stop: bool):
        need_columns(df, [c for c in (start, stop) if c is not None])
        self.df, self.start, self.stop = df, start, stop
        self.closed_start, self.closed_stop = closed_start, closed_stop
        self.point = start is not None and start == stop
        self.void = self.point and not (closed_start and closed_stop)

    def at(self, alias: str, name: str | None) -> Column | None:
        if name is None:
            return None
        c = F.col(f"{alias}.`{name}`")
        return F.when(~F.isnan(c), c) if self.df.schema[name].dataType.typeName() in ("double", "float") else c

    def filled(self, alias: str) -> Column:
        """The interval isn't empty: no missing endpoint, start before stop (or equal if both ends are closed)."""
        a, b = self.at(alias, self.start), self.at(alias, self.stop)
        if a is None and b is None:
            return F.lit(True)
        if a is None or b is None or self.point:
            return (a if a is not None else b).isNotNull()
        return (a <= b) if self.closed_start and self.closed_stop else (a < b)


def _overlap(l: _Side, r: _Side) -> Column:
    """Both intervals are filled and share a point (open and closed ends as flagged; a continuum of points)."""
    cond = l.filled("l") & r.filled("r")
    ls, le, rs, re = l.at("l", l.start), l.at("l", l.stop), r.at("r", r.start), r.at("r", r.stop)
    if l.point and r.point:
        return cond & (ls == rs)
    if ls is not None and re is not None:
        cond = cond & ((ls <= re) if l.closed_start and r.closed_stop else (ls < re))
    if rs is not None and le is not None:
        cond = cond & ((rs <= le) if r.closed_start and l.closed_stop else (rs < le))
    return cond


def _axis(s: _Side, name: str | None, none: float) -> Column:
    return F.lit(none) if name is None else numeric_axis(s.df, name).cast("double")


def _on_axis(s: _Side) -> bool:
    """Are the side's ends numbers or times?"""
    kinds = ("double", "float", "long", "integer", "short", "byte", "decimal")
    return all(c is None or is_time(type_of(s.df, c)) or type_of(s.df, c).typeName().startswith(kinds) or isinstance(type_of(s.df, c), T.DayTimeIntervalType) for c in (s.start, s.stop))


def _full(s: _Side) -> DataFrame:
    """Rows whose interval isn't empty: the others match nothing and need no place on the axis."""
    return s.df.alias("x").where(s.filled("x")).select("x.*")


def _bin_width(l: _Side, r: _Side, width: float | str | None) -> float | None:
    """Width of bins of the axis (chosen if it is None or 'auto'), or None if there are rows that would touch too many."""
    if None in (l.start, l.stop, r.start, r.stop) or not (_on_axis(l) and _on_axis(r)):
        return None
    spans = []
    for s in (l, r):
        a, b = _axis(s, s.start, 0.0), _axis(s, s.stop, 0.0)
        spans.append(_full(s).agg(F.avg(b - a), F.min(a), F.max(b), F.count(F.lit(1)), F.max(b - a)).first())
    known = [x for x in spans if x[0] is not None]
    if any(not abs(v) < float("inf") for x in known for v in (x[1], x[2], x[4])):
        return None
    if width in (None, "auto"):
        lo, hi = min((x[1] for x in known), default=0.0), max((x[2] for x in known), default=0.0)
        width = max((x[0] for x in known), default=0.0) or (hi - lo) / max(1.0, max((x[3] for x in known), default=1.0)) or 1.0
    if any(x[4] / width > MOST_BINS_OF_A_ROW for x in known) or any(x[0] / width > MOST_BINS for x in known):
        return None
    return float(width)


def _binned(s: _Side, width: float) -> DataFrame:
    """A row for each bin that an interval touches; __lo is its first bin."""
    a, b = (F.floor(_axis(s, c, 0.0) / F.lit(width)).cast("bigint") for c in (s.start, s.stop))
    d = _full(s).withColumns({"__lo": a, "__hi": F.greatest(a, b)})
    return d.withColumn("__bin", F.explode(F.sequence("__lo", "__hi"))).drop("__hi")


def _through_nodes(l: _Side, r: _Side, tree: Tree, cond: Column, cols: list[Column]) -> DataFrame:
    """Inner join by equality of nodes: each pair of overlapping rows is met once, through the later of the two starts.

    The row that starts later (the right one of equal starts) is a point at its start, the other a range; any lengths, infinite ends included, will do.
    """
    ld, rd = (_full(s).withColumns({"__a": _axis(s, s.start, -float("inf")), "__b": _axis(s, s.stop, float("inf"))}) for s in (l, r))
    point = lambda d: d.withColumn("__p", tree.leaf(F.col("__a"))).withColumn("__node", F.explode(tree.above(F.col("__p"))))
    span = lambda d: d.withColumns({"__p": tree.leaf(F.col("__a")), "__q": tree.leaf(F.col("__b"))}).withColumn("__node", F.explode(tree.covering(F.col("__p"), F.col("__q"))))
    meet = F.col("l.__node") == F.col("r.__node")
    one = span(ld).alias("l").join(point(rd).alias("r"), meet & cond & (F.col("r.__a") >= F.col("l.__a"))).select(*cols)
    two = point(ld).alias("l").join(span(rd).alias("r"), meet & cond & (F.col("l.__a") > F.col("r.__a"))).select(*cols)
    return one.union(two)


def _hot_keys(left: DataFrame, right: DataFrame, lk: list[str], rk: list[str]) -> bool:
    """Has a key more than HOT_KEY rows on a side? One job counts both sides."""
    side = lambda d, ks, n: d.select(*[q(k).alias(f"k{i}") for i, k in enumerate(ks)], F.lit(n).alias("side"))
    try:
        both = side(left, lk, 0).union(side(right, rk, 1))
    except Exception:  # keys of types that don't unite
        return hot(left, [q(k) for k in lk], HOT_KEY) or hot(right, [q(k) for k in rk], HOT_KEY)
    return hot(both, [q(c) for c in both.columns], HOT_KEY)


def merge_intervals(
    left: DataFrame, right: DataFrame, on=None, left_on=None, right_on=None, how: str = "left",
    left_start: str | None = None, left_stop: str | None = None, right_start: str | None = None, right_stop: str | None = None,
    include_left_start: bool = True, include_left_stop: bool = True, include_right_start: bool = True, include_right_stop: bool = True,
    suffixes: Sequence[str] = ("_x", "_y"), keep: str = "all", keep_order: bool = False, return_indexers: bool = False,
    left_id: str | None = None, right_id: str | None = None, bin_width: float | str | None = None,
) -> DataFrame:
    """Join rows with equal keys and overlapping intervals.

    how: inner, left, right or outer. A start or stop that is None is infinite; the same column as start and stop makes
    points. Missing (null, nan) endpoints make an interval empty, and empty intervals match nothing; null keys equal each
    other. keep: all, first, last or both of a left row's matches (of a right row's, if how is right) in the order of ids; with
    outer, right rows that aren't kept come back as unmatched. Overlapping column names, keys included, get suffixes.
    left_id, right_id: unique columns that name rows and order them; where they are needed and not given, positions are made.
    return_indexers: only (left_id, right_id), -1 for missing. keep_order sorts the result by the rows' order.
    bin_width: width of bins of the axis that join the equality keys, 'auto' to choose; without keys, or with a key of more than
    HOT_KEY rows, the axis is always cut: into bins, or where there are infinite ends or very unequal lengths into the nodes of
    a tree, by which ranges and starts meet in equality joins. bin_width=0 leaves keys whole and saves the count of their rows.
    """
    require(how in ("inner", "left", "right", "outer"), f"unknown how: {how!r}")
    require(keep in ("all", "first", "last", "both"), f"unknown keep: {keep!r}")
    require(on is None or (left_on is None and right_on is None), "on excludes left_on and right_on")
    lk, rk = (as_list(on), as_list(on)) if on is not None else (as_list(left_on), as_list(right_on))
    require(len(lk) == len(rk), "as many left as right keys are needed")
    need_columns(left, lk, "left")
    need_columns(right, rk, "right")
    one_sided = (left_start is None and left_stop is None) or (right_start is None and right_stop is None)
    same_way = (left_start is None and right_start is None) or (left_stop is None and right_stop is None)
    require(bool(lk) or not (one_sided or same_way), "no columns to join on")
    l0, r0 = (_Side(left, left_start, left_stop, include_left_start, include_left_stop), _Side(right, right_start, right_stop, include_right_start, include_right_stop))
    for s, n in ((l0, "left"), (r0, "right")):
        if s.void:
            warnings.warn(f"points of the {n} side with an open end match nothing", stacklevel=2)
    cut = not (l0.void or r0.void or (l0.point and r0.point)) and _on_axis(l0) and _on_axis(r0)
    if cut and lk:
        finite = None not in (left_start, left_stop, right_start, right_stop)
        cut = bool(bin_width) or (bin_width is None and finite and _hot_keys(left, right, lk, rk))
    bins = _bin_width(l0, r0, bin_width) if cut else None
    tree = Tree([(s.df, _axis(s, c, 0.0)) for s in (l0, r0) for c in dict.fromkeys((s.start, s.stop)) if c is not None]) if cut and bins is None else None
    ids = keep != "all" or keep_order or return_indexers or (cut and how != "inner")
    lid, rid = left_id, right_id
    hidden = []
    if ids and lid is None:
        (lid,) = fresh(left, "__lid")
        left = row_ids(left, lid)
        hidden.append(("l", lid))
    if ids and rid is None:
        (rid,) = fresh(right, "__rid")
        right = row_ids(right, rid)
        hidden.append(("r", rid))
    l, r = _Side(left, left_start, left_stop, include_left_start, include_left_stop), _Side(right, right_start, right_stop, include_right_start, include_right_stop)
    lcols, rcols = [c for c in left.columns if ("l", c) not in hidden], [c for c in right.columns if ("r", c) not in hidden]
    both = {c.lower() for c in lcols} & {c.lower() for c in rcols}
    rename = lambda c, k: c + suffixes[k] if c.lower() in both else c
    out = [F.col(f"l.`{c}`").alias(rename(c, 0)) for c in lcols] + [F.col(f"r.`{c}`").alias(rename(c, 1)) for c in rcols]

    def matching(ls: _Side, rs: _Side, kind: str, cols: list[Column]) -> DataFrame:
        cond = F.lit(False) if l.void or r.void else _overlap(l, r)
        for a, b in zip(lk, rk):
            cond = F.col(f"l.`{a}`").eqNullSafe(F.col(f"r.`{b}`")) & cond
        if tree:
            return _through_nodes(ls, rs, tree, cond, cols)
        ld, rd = ls.df, rs.df
        if bins:
            ld, rd = _binned(ls, bins), _binned(rs, bins)
            cond = (F.col("l.__bin") == F.col("r.__bin")) & cond & (F.col("l.__bin") == F.greatest("l.__lo", "r.__lo"))
        return ld.alias("l").join(rd.alias("r"), cond, kind).select(*cols)

    if not ids:
        return matching(l, r, {"outer": "full_outer"}.get(how, how), out)

    ends = lambda s, keys, i: [q(c) for c in dict.fromkeys([*keys, *[x for x in (s.start, s.stop) if x], i])]
    lsmall, rsmall = left.select(*ends(l, lk, lid)), right.select(*ends(r, rk, rid))
    of = lambda s, d: _Side(d, s.start, s.stop, s.closed_start, s.closed_stop)
    pairs = matching(of(l, lsmall), of(r, rsmall), "inner", [F.col(f"l.`{lid}`").alias("__l"), F.col(f"r.`{rid}`").alias("__r")])
    if keep != "all":
        per, other = ("__r", "__l") if how == "right" else ("__l", "__r")
        which = {"first": [F.min(other)], "last": [F.max(other)], "both": [F.min(other), F.max(other)]}[keep]
        pairs = pairs.groupBy(per).agg(F.array_distinct(F.array(*which)).alias("__o")).select(per, F.explode("__o").alias(other))
    p = pairs
    if how in ("left", "outer"):
        p = left.select(q(lid).alias("__l")).join(p, "__l", "left")
    if how == "right":
        p = right.select(q(rid).alias("__r")).join(p, "__r", "left")
    if how == "outer":
        rest = right.select(q(rid).alias("__r")).join(pairs.select("__r"), "__r", "left_anti").select(F.lit(None).cast(left.schema[lid].dataType).alias("__l"), "__r")
        p = p.select("__l", "__r").unionByName(rest)
    order = [F.col("__r").asc_nulls_last(), F.col("__l").asc_nulls_last()] if how == "right" else [F.col("__l").asc_nulls_last(), F.col("__r").asc_nulls_last()]
    if return_indexers:
        res = p.select("__l", "__r")
        if keep_order:
            res = res.orderBy(*order)
        return res.select(F.coalesce("__l", F.lit(-1)).alias("left_id"), F.coalesce("__r", F.lit(-1)).alias("right_id"))
    res = p.join(left.alias("l"), F.col("__l") == F.col(f"l.`{lid}`"), "left").join(right.alias("r"), F.col("__r") == F.col(f"r.`{rid}`"), "left")
    return (res.orderBy(*order) if keep_order else res).select(*out)


#: Aggregates that pairs needn't be listed for: of rows, and of several aggregates together.
_AGGREGATES = {"count": (F.count, F.sum), "min": (F.min, F.min), "max": (F.max, F.max)}


def merge_aggregates(
    left: DataFrame, right: DataFrame, aggs: dict[str, tuple[str, str]], how: str = "left",
    left_start: str | None = None, left_stop: str | None = None, right_start: str | None = None, right_stop: str | None = None,
    include_left_start: bool = True, include_left_stop: bool = True, include_right_start: bool = True, include_right_stop: bool = True,
) -> DataFrame:
    """Append to left rows aggregates of the right rows that overlap them, where a single inequality decides that: the right
    starts before the left stops, or stops after it starts. Sides are given as in merge_intervals, without keys, and the ends of
    the other inequality are None (one of them at least).

    aggs: new column -> (count, min or max, right column); a count is of values that aren't null, 0 if there are none. how: left,
    or outer, by which the right rows that overlap no left row are aggregated to one row more, with nulls for left's columns
    (there is none if all overlap some).

    The number of pairs grows with the square of the rows, so none are listed: rows of one place on the axis are aggregated,
    and the places scanned in chunks, cut where the data lie.
    """
    require(how in ("left", "outer"), f"unknown how: {how!r}")
    require(bool(aggs) and all(a in _AGGREGATES for a, _ in aggs.values()), f"aggs need count, min or max: {aggs!r}")
    need_columns(right, [c for _, c in aggs.values()], "right")
    clash = {c.lower() for c in left.columns} & {n.lower() for n in aggs}
    require(not clash, f"left has {sorted(clash)}")
    l, r = _Side(left, left_start, left_stop, include_left_start, include_left_stop), _Side(right, right_start, right_stop, include_right_start, include_right_stop)
    up, down = None not in (left_stop, right_start), None not in (left_start, right_stop)
    require(up != down, "one inequality is needed: left_stop and right_start, or left_start and right_stop")
    require(_on_axis(l) and _on_axis(r), "ends must be numbers or times")
    lat, rat, closed = (left_stop, right_start, include_left_stop and include_right_start) if up else (left_start, right_stop, include_left_start and include_right_stop)
    place = lambda s, c: F.when(F.lit(not s.void) & s.filled("x"), s.at("x", c))
    use = [(f"__v{i}", f"__s{i}", f"__c{i}", n, *a) for i, (n, a) in enumerate(aggs.items())]
    ls = left.alias("x").select(place(l, lat).alias("__at"), F.lit(1).alias("__l"), F.lit(0).alias("__r"), *[F.lit(None).cast(type_of(right, c)).alias(v) for v, *_, c in use])
    rs = right.alias("x").select(place(r, rat).alias("__at"), F.lit(0).alias("__l"), F.lit(1).alias("__r"), *[F.col(f"x.`{c}`").alias(v) for v, *_, c in use])
    d = materialise(ls.union(rs).groupBy("__at").agg(F.sum("__l").alias("__l"), F.sum("__r").alias("__r"), *[_AGGREGATES[a][0](v).alias(v) for v, *_, a, _ in use]))

    at = d.where("__at is not null")
    axis = numeric_axis(at, "__at").cast("double")
    at = at.withColumn("__chunk", Tree([(at, axis)]).leaf(axis))
    to, back = ("before", "after") if up else ("after", "before")
    summary = {s: _AGGREGATES[a][1](v) for v, s, *_, a, _ in use} | {"__sl": F.sum("__l")}
    at = chunked(at, [], "__chunk", ["__at"], summary, {c: (f"{'sum' if a == 'count' else a}_{to}", s) for _, s, c, _, a, _ in use} | {"__cl": (f"sum_{back}", "__sl")})
    scan = {w: Window.partitionBy("__chunk").orderBy(F.col("__at").asc() if w == "before" else F.col("__at").desc()).rowsBetween(Window.unboundedPreceding, 0 if closed else -1) for w in ("before", "after")}
    total = lambda v, w, c: F.coalesce(F.sum(v).over(scan[w]), F.lit(0)) + F.col(c)
    join = {"count": total, "min": lambda v, w, c: F.least(F.min(v).over(scan[w]), c), "max": lambda v, w, c: F.greatest(F.max(v).over(scan[w]), c)}
    at = at.select("__at", "__r", *[v for v, *_ in use], total("__l", back, "__cl").alias("__met"), *[join[a](v, to, c).alias(s) for v, s, c, _, a, _ in use])

    (here,) = fresh(left, "__here")
    placed = left.alias("x").select("x.*", place(l, lat).alias(here))
    value = lambda c, a: F.coalesce(c, F.lit(0)) if a == "count" else c
    res = placed.alias("l").join(at.alias("r"), F.col(f"l.{here}") == F.col("r.__at"), "left").select(*[F.col(f"l.`{c}`") for c in left.columns], *[value(F.col(f"r.{s}"), a).alias(n) for _, s, _, n, a, _ in use])
    if how == "left":
        return res
    cols = ["__r", *[v for v, *_ in use]]
    rest = at.where("__met = 0").select(*cols).union(d.where("__at is null").select(*cols))
    rest = rest.agg(F.sum("__r").alias("__r"), *[_AGGREGATES[a][1](v).alias(v) for v, *_, a, _ in use]).where("__r > 0")
    return res.union(rest.select(*[F.lit(None).cast(type_of(left, c)).alias(c) for c in left.columns], *[F.col(v) for v, *_ in use]))


def find_containing_interval(
    points: DataFrame, intervals: DataFrame, point_cols, which: str = "first", start_col: str | None = "start", stop_col: str | None = "stop",
    length_col: str | None = None, group_by=None, include_start: bool = True, include_stop: bool = True, point_id: str | None = None, interval_id: str | None = None,
) -> DataFrame:
    """Append to points the first, last or both intervals that contain them, -1 where there is none.

    point_cols: one column or several; the new columns are first__<col> and last__<col>. Intervals are named and ordered by
    interval_id (positions if None). length_col replaces the endpoint that is None: stop = start + length, or start = stop -
    length. group_by: keys that must be equal (null equals null). Missing points are in no interval.
    """
    cols = as_list(point_cols)
    require(which in ("first", "last", "both"), f"unknown which: {which!r}")
    require(len(cols) > 0, "point_cols is empty")
    keys = as_list(group_by)
    need_columns(points, [*cols, *keys], "points")
    need_columns(intervals, [*keys, *[c for c in (start_col, stop_col, length_col) if c]], "intervals")
    if length_col is not None:
        require((start_col is None) != (stop_col is None), "length_col needs exactly one endpoint")
        (end,) = fresh(intervals, "__end")
        if stop_col is None:
            intervals, stop_col = intervals.withColumn(end, q(start_col) + q(length_col)), end
        else:
            intervals, start_col = intervals.withColumn(end, q(stop_col) - q(length_col)), end
    iid, pid = interval_id, point_id
    if iid is None:
        (iid,) = fresh(intervals, "__iid")
        intervals = row_ids(intervals, iid)
    if pid is None:
        (pid,) = fresh(points, "__pid")
        points = row_ids(points, pid)
    ks = [f"__k{i}" for i in range(len(keys))]
    stacked = points.select(q(pid).alias("__p"), *[q(k).alias(n) for k, n in zip(keys, ks)], F.explode(F.array(*[F.struct(F.lit(i).alias("i"), clean(points, c).alias("t")) for i, c in enumerate(cols)])).alias("x"))
    stacked = stacked.select("__p", *ks, F.col("x.i").alias("__i"), F.col("x.t").alias("__t")).where("__t is not null")
    iv = intervals.select(q(iid).alias("__iv"), *[q(k).alias(n) for k, n in zip(keys, ks)], *[clean(intervals, c).alias(n) for c, n in ((start_col, "__s"), (stop_col, "__e")) if c])
    pairs = merge_intervals(stacked, iv, on=ks or None, how="inner", left_start="__t", left_stop="__t", right_start="__s" if start_col else None, right_stop="__e" if stop_col else None, include_right_start=include_start, include_right_stop=include_stop)
    wanted = {"first": ["first"], "last": ["last"], "both": ["first", "last"]}[which]
    aggs = [(F.min if w == "first" else F.max)(F.when(F.col("__i") == i, F.col("__iv"))).alias(f"{w}__{c}") for w in wanted for i, c in enumerate(cols)]
    found = pairs.groupBy("__p").agg(*aggs)
    res = points.alias("p").join(found.alias("f"), F.col(f"p.`{pid}`") == F.col("f.__p"), "left")
    names = [f"{w}__{c}" for w in wanted for c in cols]
    return res.select(*[F.col(f"p.`{c}`") for c in points.columns if not (c == pid and point_id is None)], *[F.coalesce(F.col(f"f.`{n}`"), F.lit(-1)).alias(n) for n in names])


def inner_or_cross_join(left: DataFrame, right: DataFrame, on: str | None = None, right_key: str | None = None) -> DataFrame:
    """Inner join of left.on with right's key (its first column unless right_key is given), or the cross join if on is None or no column of left.

    Column names of the two must differ. The right key isn't part of the result of the inner join.
    """
    joined = on is not None and on in left.columns
    key = right_key or (right.columns[0] if joined else None)
    clash = {c.lower() for c in left.columns} & {c.lower() for c in right.columns if not (joined and c == key)}
    require(not clash, f"both sides have {sorted(clash)}")
    if not joined:
        return left.crossJoin(right)
    r = right.withColumnRenamed(key, "__key")
    return left.join(r, q(on) == F.col("__key")).drop("__key")
