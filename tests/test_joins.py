import itertools
import random

import pytest

from tests.conftest import rows
from tidemark import find_containing_interval, inner_or_cross_join, merge_aggregates, merge_intervals

ENDS = dict(left_start="s", left_stop="e", right_start="s", right_stop="e")


def iv(frame, pairs):
    return frame("id long, s double, e double", [(i, a, b) for i, (a, b) in enumerate(pairs)])


# The documented results of small joins (HOW, KEEP and the vector of test_containing_interval_with_infinities).
HOW = {
    "inner": [(0, 2), (2, 1), (2, 2)],
    "left": [(0, 2), (1, -1), (2, 1), (2, 2), (3, -1)],
    "right": [(-1, 0), (2, 1), (0, 2), (2, 2)],
    "outer": [(0, 2), (1, -1), (2, 1), (2, 2), (3, -1), (-1, 0)],
}


@pytest.mark.parametrize("how", HOW)
def test_how(frame, how):
    l, r = iv(frame, [(0.0, 2.0), (7.0, 8.0), (1.0, 5.0), (8.0, 9.0)]), iv(frame, [(10.0, 11.0), (4.0, 5.0), (0.0, 3.0)])
    got = merge_intervals(l, r, how=how, **ENDS, return_indexers=True, left_id="id", right_id="id", keep_order=True)
    assert [tuple(x) for x in got.collect()] == HOW[how]


KEEP = {
    "A": ([(4, 5), (4, 6), (0, 0), (2, 2), (-7, -4), (50, 52)], [(1, 2), (23, 24), (3, 4), (-10, -7), (10, 15), (4, 4), (-1, 0), (-2, 0), (3, 4), (12, 14), (2, 2)], dict(left_start="s", left_stop="s", right_start="s", right_stop="e"),
          {"all": ([0, 0, 0, 1, 1, 1, 2, 2, 3, 3, 4], [2, 5, 8, 2, 5, 8, 6, 7, 0, 10, 3]), "first": ([0, 1, 2, 3, 4], [2, 2, 6, 0, 3]), "last": ([0, 1, 2, 3, 4], [8, 8, 7, 10, 3]), "both": ([0, 0, 1, 1, 2, 2, 3, 3, 4], [2, 8, 2, 8, 6, 7, 0, 10, 3])}),
    "B": ([(-1, 7), (-3, -1), (1, 9), (0, 5), (5, 7)], [(0, 0), (2, 2), (4, 4), (6, 6)], dict(left_start="s", left_stop="e", right_start="s", right_stop="s"),
          {"first": ([0, 2, 3, 4], [0, 1, 0, 3]), "last": ([0, 2, 3, 4], [3, 3, 2, 3]), "both": ([0, 0, 2, 2, 3, 3, 4], [0, 3, 1, 3, 0, 2, 3])}),
    "C": ([(0, 4), (-3, -1)], [(1, 4), (-1, 2), (2, 5), (-2, 3), (1, 3), (-4, -1)], ENDS,
          {"all": ([0, 0, 0, 0, 0, 1, 1, 1], [0, 1, 2, 3, 4, 1, 3, 5]), "first": ([0, 1], [0, 1]), "last": ([0, 1], [4, 5]), "both": ([0, 0, 1, 1], [0, 4, 1, 5])}),
}


@pytest.mark.parametrize("case,keep", [(c, k) for c in KEEP for k in KEEP[c][3]])
def test_keep(frame, case, keep):
    a, b, ends, want = KEEP[case]
    f = lambda x: [(float(p), float(q)) for p, q in x]
    got = merge_intervals(iv(frame, f(a)), iv(frame, f(b)), how="inner", keep=keep, return_indexers=True, left_id="id", right_id="id", **ends)
    assert rows(got) == sorted(zip(*want[keep]), key=repr)


def brute(ls, rs, cls, cle, crs, cre):
    out = []
    for i, (a, b) in enumerate(ls):
        for j, (c, d) in enumerate(rs):
            if None in (a, b, c, d):
                continue
            if (a > b if cls and cle else a >= b) or (c > d if crs and cre else c >= d):
                continue
            if (b < c if cle and crs else b <= c) or (d < a if cre and cls else d <= a):
                continue
            out.append((i, j))
    return out


@pytest.mark.parametrize("flags", list(itertools.product([True, False], repeat=4)))
def test_open_closed(frame, flags):
    pairs = [(float(a), float(b)) for a in range(4) for b in range(4)]
    d = iv(frame, pairs)
    names = ("include_left_start", "include_left_stop", "include_right_start", "include_right_stop")
    got = merge_intervals(d, d, how="inner", **ENDS, **dict(zip(names, flags)), return_indexers=True, left_id="id", right_id="id")
    assert rows(got) == sorted(brute(pairs, pairs, *flags), key=repr)


def test_keys_missing_ends_and_infinities(frame):
    rnd = random.Random(3)
    inf, nan = float("inf"), float("nan")

    def make(n):
        out = []
        for i in range(n):
            a, b = rnd.randint(0, 20), rnd.randint(0, 20)
            a, b = rnd.choice([float(a)] * 8 + [-inf, nan, None]), rnd.choice([float(b)] * 8 + [inf, nan, None])
            out.append((i, rnd.choice([1, 2, None]), a, b))
        return out

    a, b = make(60), make(60)
    tidy = lambda x: None if x is None or x != x else x
    want = [(x[0], y[0]) for x in a for y in b if x[1] == y[1] and brute([(tidy(x[2]), tidy(x[3]))], [(tidy(y[2]), tidy(y[3]))], True, True, True, True)]
    schema = "id long, k int, s double, e double"
    for width in (None, "auto", 3.0):
        got = merge_intervals(frame(schema, a), frame(schema, b), on="k", how="inner", **ENDS, return_indexers=True, left_id="id", right_id="id", bin_width=width)
        assert rows(got) == sorted(want, key=repr), width


def test_hot_keys_get_bins(frame, monkeypatch):
    from tidemark.operators import joins

    rnd = random.Random(9)
    a, b = ([(i, 1, float(s), float(s + rnd.randint(0, 9))) for i, s in enumerate(rnd.randint(0, 500) for _ in range(120))] for _ in "ab")
    want = sorted(((i, j) for i, j in brute([x[2:] for x in a], [x[2:] for x in b], True, True, True, True)), key=repr)
    l, r = frame("id long, k int, s double, e double", a), frame("id long, k int, s double, e double", b)
    monkeypatch.setattr(joins, "HOT_KEY", 50)
    got = merge_intervals(l, r, on="k", how="inner", **ENDS)
    assert rows(got, "id_x", "id_y") == want and "__bin" in got._jdf.queryExecution().toString()
    outer = merge_intervals(l, r, on="k", how="outer", **ENDS)
    assert outer.count() == len(want) + len(set(range(120)) - {i for i, _ in want}) + len(set(range(120)) - {j for _, j in want})


@pytest.mark.parametrize("ends", [("s", "e", None, "e"), ("s", "e", "s", None), (None, "e", "s", "e"), ("s", "s", None, "e"), ("s", None, None, "e"), (None, "e", None, "e")])
def test_half_infinite(frame, ends):
    rnd = random.Random(1)
    a, b = ([(i, 1, float(rnd.randint(0, 9)), float(rnd.randint(0, 9))) for i in range(25)] for _ in "ab")
    inf = float("inf")
    end = lambda r, s, e: (-inf if s is None else r[2], inf if e is None else r[3] if e == "e" else r[2])
    want = [(x[0], y[0]) for x in a for y in b if brute([end(x, *ends[:2])], [end(y, *ends[2:])], True, True, True, True)]
    got = merge_intervals(frame("id long, k int, s double, e double", a), frame("id long, k int, s double, e double", b), on="k", how="inner", left_start=ends[0], left_stop=ends[1], right_start=ends[2], right_stop=ends[3], return_indexers=True, left_id="id", right_id="id")
    assert rows(got) == sorted(want, key=repr)


def planned(df):
    """Names of the join operators in the plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {x for x in ("BroadcastNestedLoopJoin", "CartesianProduct") if x in plan}


@pytest.mark.parametrize("how", ["inner", "left", "outer"])
@pytest.mark.parametrize("ends", [("s", "e", None, "e"), ("s", "e", "s", None), (None, "e", "s", "e"), ("s", "s", None, "e"), ("s", None, "e", "e"), (None, "e", "s", None)])
def test_half_infinite_without_keys(frame, ends, how):
    """Single inequalities meet by nodes of a tree, not by a nested loop."""
    rnd = random.Random(4)
    a, b = ([(i, rnd.choice([float(rnd.randint(0, 9))] * 9 + [None]), rnd.choice([float(rnd.randint(0, 9))] * 9 + [float("nan")])) for i in range(30)] for _ in "ab")
    inf = float("inf")
    value = lambda x: None if x is None or x != x else x
    end = lambda r, s, e: (-inf if s is None else value(r[1] if s == "s" else r[2]), inf if e is None else value(r[1] if e == "s" else r[2]))
    pairs = [(x[0], y[0]) for x in a for y in b if brute([end(x, *ends[:2])], [end(y, *ends[2:])], True, True, True, True)]
    want = pairs + [(i, -1) for i in range(30) if how != "inner" and all(p[0] != i for p in pairs)] + [(-1, j) for j in range(30) if how == "outer" and all(p[1] != j for p in pairs)]
    schema = "id long, s double, e double"
    got = merge_intervals(frame(schema, a), frame(schema, b), how=how, left_start=ends[0], left_stop=ends[1], right_start=ends[2], right_stop=ends[3], return_indexers=True, left_id="id", right_id="id")
    assert rows(got) == sorted(want, key=repr) and not planned(got)


@pytest.mark.parametrize("unit", ["long", "timestamp_ntz", "double"])
def test_long_and_infinite_intervals_without_keys(frame, unit):
    """Lengths from 0 to 10^9, and infinite ends: no row is spread over bins, and none is lost."""
    rnd = random.Random(5)
    make = lambda n: [(i, s, s + rnd.choice([0, 1, 5, 5, 10**9])) for i, s in enumerate(rnd.randint(0, 300) for _ in range(n))]
    a, b = make(70), make(60)
    inf = float("inf")
    if unit == "double":
        a, b = ([(i, float(s), float(e)) for i, s, e in x] for x in (a, b))
        a[:3], b[:2] = [(0, -inf, 5.0), (1, 100.0, inf), (2, -inf, inf)], [(0, None, 10.0**9), (1, inf, inf)]
    if unit == "timestamp_ntz":
        from datetime import datetime, timedelta

        a, b = ([(i, *(datetime(2024, 1, 1) + timedelta(milliseconds=v) for v in p)) for i, *p in x] for x in (a, b))
    want = sorted(brute([x[1:] for x in a], [x[1:] for x in b], True, True, True, True), key=repr)
    got = merge_intervals(frame(f"id long, s {unit}, e {unit}", a), frame(f"id long, s {unit}, e {unit}", b), how="inner", **ENDS)
    assert rows(got, "id_x", "id_y") == want and not planned(got)


def test_tree(spark):
    """Every range of leaves is covered once, by few nodes, and a point meets a range in one node or none."""
    from pyspark.sql import functions as F

    from tidemark.operators.nodes import Tree

    t = Tree([(spark.range(1000), F.col("id"))], 16)
    assert t.size >= 15 and t.levels == t.size.bit_length()
    d = spark.range(t.size).select(F.col("id").alias("lo")).crossJoin(spark.range(t.size).select(F.col("id").alias("hi")))
    d = d.select("lo", "hi", t.covering(F.col("lo"), F.col("hi")).alias("c")).crossJoin(spark.range(t.size).select(F.col("id").alias("p"), t.above(F.col("id")).alias("a")))
    wrong = d.where(F.size(F.array_intersect("c", "a")) != F.when((F.col("lo") <= F.col("p")) & (F.col("p") <= F.col("hi")), 1).otherwise(0))
    assert wrong.count() == 0 and d.agg(F.max(F.size("c"))).first()[0] <= 2 * t.levels
    one = Tree([(spark.range(0), F.col("id"))])
    assert one.size == 1 and spark.range(3).select(one.leaf(F.col("id")).alias("x"), F.size(one.covering(F.lit(0), F.lit(0)))).distinct().collect() == [(0, 1)]


def test_columns_outer_keep_and_errors(frame):
    l, r = frame("id long, k int, v string", [(0, 1, "a"), (1, None, "b")]), frame("id long, k int, w string", [(0, 1, "x"), (1, 1, "y"), (2, 5, "z")])
    got = merge_intervals(l, r, on="k", how="outer", keep="first", left_id="id", right_id="id")
    assert got.columns == ["id_x", "k_x", "v", "id_y", "k_y", "w"]
    assert rows(got, "id_x", "id_y") == sorted([(0, 0), (1, None), (None, 1), (None, 2)], key=repr)
    assert merge_intervals(l, r.limit(0), on="k", how="left").count() == 2
    for kw in (dict(how="cross"), dict(keep="some"), dict(on="k", left_on="k"), dict(left_on=["k"], right_on=[]), dict(left_start="id")):
        with pytest.raises(ValueError):
            merge_intervals(l, r, **kw)
    with pytest.warns(UserWarning):
        assert merge_intervals(l, r, on="k", how="inner", left_start="id", left_stop="id", right_start="id", right_stop="id", include_left_start=False).count() == 0


def test_containing_interval_with_infinities(frame):
    inf = float("inf")
    i = frame("id long, g int, start double, stop double", [(k, *x) for k, x in enumerate([(0, 5.7, 6.3), (1, 1.9, 1.8), (1, -inf, 0.5), (0, 478.0, inf), (0, -inf, -87.2), (1, 3.3, 4.0), (0, -66.1, -56.7), (0, 143.5, 143.6), (1, 132.4, 157.7)])])
    pts = [(0, x) for x in (-58746.0, -0.1, 6.0, 143.5, 143.6, 209.9, 492064.523)] + [(1, x) for x in (0.0, 0.5, 1.85, 144.4, 3079.51)]
    p = frame("pid long, g int, x double, y double", [(k, g, x, None) for k, (g, x) in enumerate(pts)])
    got = find_containing_interval(p, i, ["x", "y"], group_by="g", interval_id="id", point_id="pid", which="both")
    assert [r[0] for r in got.orderBy("pid").select("first__x").collect()] == [4, -1, 0, 7, 7, -1, 3, 2, 2, -1, 8, -1]
    assert {r[0] for r in got.select("last__y").collect()} == {-1}
    one = find_containing_interval(p.limit(1), i, ["x", "y"], group_by="g")
    assert one.columns == ["pid", "g", "x", "y", "first__x", "first__y"] and one.count() == 1
    for kw in (dict(point_cols="x", which="any"), dict(point_cols=[]), dict(point_cols="x", length_col="stop")):
        with pytest.raises(ValueError):
            find_containing_interval(p, i, **kw)


def test_inner_or_cross(frame):
    a, b = frame("x int, k int", [(1, 1), (2, 9)]), frame("key int, z string", [(1, "q"), (2, "r")])
    assert rows(inner_or_cross_join(a, b, "k")) == [(1, 1, "q")]
    assert inner_or_cross_join(a, b).count() == 4
    with pytest.raises(ValueError):
        inner_or_cross_join(a, a)


@pytest.mark.parametrize("ends,closed", [(("s", "e", "s", None), False), (("s", "e", "s", None), True), ((None, "e", "s", "e"), True), (("s", "s", None, "e"), True), (("s", "s", None, "e"), False), (("s", None, None, "e"), False)])
def test_aggregates_without_pairs(frame, monkeypatch, ends, closed):
    """Counts and extremes by a single inequality are those of the pairs, several places in a chunk; ids repeat, ends are missing or infinite."""
    from tidemark.operators import nodes

    monkeypatch.setattr(nodes.Tree.__init__, "__defaults__", (4,))
    rnd = random.Random(11)
    end = lambda inf: rnd.choice([float(rnd.randint(0, 12))] * 9 + [None, float("nan"), inf])
    a, b = ([(rnd.choice([k // 2] * 9 + [None]), end(-float("inf")), end(float("inf"))) for k in range(40)] for _ in "ab")
    of = lambda r, c: "open" if c is None else None if (v := r["_se".index(c)]) is None or v != v else v
    before = lambda x, y, both: x < y or (both and x == y)
    filled = lambda s, e, both: None not in (s, e) and ("open" in (s, e) or before(s, e, both))
    pairs = []
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            (ls, le), (rs, re) = (of(x, c) for c in ends[:2]), (of(y, c) for c in ends[2:])
            if filled(ls, le, closed) and filled(rs, re, True) and (before(rs, le, closed) if ends[1] and ends[2] else before(ls, re, closed)):
                pairs.append((i, j))
    ids = lambda js: [b[j][0] for j in js if b[j][0] is not None]
    seen = lambda js: (len(ids(js)), min(ids(js), default=None), max(ids(js), default=None))
    want = [(a[i][0], *seen([j for k, j in pairs if k == i])) for i in range(40)]
    rest = set(range(40)) - {j for _, j in pairs}
    l, r = (frame("id long, s double, e double", x) for x in (a, b))
    got = merge_aggregates(l, r, {"n": ("count", "id"), "lo": ("min", "id"), "hi": ("max", "id")}, how="outer", left_start=ends[0], left_stop=ends[1], right_start=ends[2], right_stop=ends[3], include_left_start=closed, include_left_stop=closed)
    assert rows(got, "id", "n", "lo", "hi") == sorted(want + [(None, *seen(rest))] * bool(rest), key=repr)


def test_aggregates_of_empty_tables_times_and_errors(frame):
    from datetime import datetime

    l = frame("id long, s timestamp_ntz, e timestamp_ntz", [(1, datetime(2024, 1, 1), datetime(2024, 1, 2)), (2, datetime(2024, 1, 2), datetime(2024, 1, 1))])
    r = frame("k long, t date", [(7, datetime(2024, 1, 2).date()), (8, datetime(2024, 1, 3).date()), (9, None)])
    kw = dict(how="outer", left_start="s", left_stop="e", right_start="t")
    agg = {"n": ("count", "k"), "hi": ("max", "k")}
    assert rows(merge_aggregates(l, r, agg, **kw), "id", "n", "hi") == sorted([(1, 1, 7), (2, 0, None), (None, 2, 9)], key=repr)
    assert rows(merge_aggregates(l, r, agg, **dict(kw, how="left"), include_right_start=False), "id", "n") == [(1, 0), (2, 0)]
    assert rows(merge_aggregates(l.limit(0), r, agg, **kw), "id", "n", "hi") == [(None, 3, 9)]
    assert rows(merge_aggregates(l, r.limit(0), agg, **kw), "id", "n", "hi") == sorted([(1, 0, None), (2, 0, None)], key=repr)
    for bad in (dict(kw, how="inner"), dict(kw, right_stop="t"), dict(kw, right_start=None)):
        with pytest.raises(ValueError):
            merge_aggregates(l, r, agg, **bad)
    for aggs in ({}, {"n": ("sum", "k")}, {"n": ("count", "v")}, {"ID": ("count", "k")}):
        with pytest.raises(ValueError):
            merge_aggregates(l, r, aggs, **kw)
