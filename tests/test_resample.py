import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark import custom_agg, make_windows, resample_eav, resample_interval

# The documented example of resampling.
OBS = [(1000, 0, "attr_1", None), (1000, 10, "attr_1", 85.7), (1000, 20, "attr_1", 151.4), (1000, 30, "attr_1", 137.8), (1000, 5, "attr_2", None), (1000, 9, "attr_2", 49.0), (1000, 25, "attr_2", 50.0), (1000, 34, "attr_2", 50.0), (1000, 7, "attr_3", 0.1), (1000, 17, "attr_3", 0.2), (1001, 1, "attr_2", 38.7), (1001, -1, "attr_2", 36.1), (1001, None, "attr_2", 1.0)]
WIN = [(0, 1000, -1, 0), (1, 1000, 0, 8), (2, 1000, 1, 41), (3, 1000, 7, 17), (4, 1001, 0, 2), (5, 1001, 3, 1), (6, 77, 0, 99), (7, None, 0, 9)]
COLS = dict(entity_col="entity", time_col="t", attribute_col="a", value_col="v")


def tables(frame):
    return frame("entity long, t long, a string, v double", OBS), frame("w long, entity long, start long, stop long", WIN)


def test_corner_cases(frame):
    o, w = tables(frame)
    got = resample_eav(o, w, {"attr_1": ["p25", "p101"], "attr_2": ["sum", "count", "size", "prod"], "attr_3": ["r-1", "r0", "t-01", "t0", "r1"]}, **COLS, window_id="w", keep_order=True)
    assert got.columns == ["w", "entity", "start", "stop", "attr_1__p25", "attr_2__sum", "attr_2__count", "attr_2__size", "attr_2__prod", "attr_3__r-1", "attr_3__r0", "attr_3__t-1", "attr_3__t0", "attr_3__r1"]
    n = None
    want = [(n, n, 0, 0, n, n, n, n, n, n), (n, 0.0, 0, 1, 1.0, 0.1, 0.1, 7, 7, n), (111.75, 149.0, 3, 4, 122500.0, 0.2, 0.1, 17, 7, 0.2), (85.7, 49.0, 1, 1, 49.0, 0.1, 0.1, 7, 7, n), (n, 38.7, 1, 1, 38.7, n, n, n, n, n), (n, n, 0, 0, n, n, n, n, n, n)]
    res = [tuple(r)[4:] for r in got.collect()]
    for a, b in zip(res, want):
        assert a == pytest.approx(b) if None not in b else all((x is None and y is None) or x == pytest.approx(y) for x, y in zip(a, b))
    assert res[6][1:3] == (None, 0) and res[7][1:3] == (None, 0)


@pytest.mark.parametrize("ends", [("start", "stop", True, False), ("start", "stop", False, True), (None, "stop", True, True), ("start", None, True, False)])
def test_against_brute_force(frame, ends):
    rnd = random.Random(4)
    obs = [(i, rnd.randint(0, 3), float(rnd.randint(0, 60)), rnd.choice("xy"), rnd.choice([None, float(rnd.randint(0, 5))])) for i in range(150)]
    win = [(i, rnd.randint(0, 4), float(s), float(s + rnd.randint(-1, 25))) for i, s in enumerate(rnd.randint(0, 60) for _ in range(30))]
    s, e, cs, ce = ends
    w = frame("w long, e long, start double, stop double", win).drop(*[c for c in ("start", "stop") if c not in (s, e)])
    aggs = ["mean", "min", "max", "median", "std", "var", "sum", "size", "count", "nunique", "mode", "mode_count", "skew", "mad", "sem", "first", "last", "r1", "t-2"]
    got = resample_eav(frame("id long, e long, t double, a string, v double", obs), w, {"x": aggs}, entity_col="e", time_col="t", attribute_col="a", value_col="v", include_start=cs, include_stop=ce, window_id="w", row_id="id")
    for r in got.collect():
        _, ent, a, b = win[r.w]
        inside = sorted((o for o in obs if o[1] == ent and o[3] == "x" and (s is None or (o[2] >= a if cs else o[2] > a)) and (e is None or (o[2] <= b if ce else o[2] < b))), key=lambda o: (o[2], o[0]))
        vs = [o[4] for o in inside if o[4] is not None]
        m = statistics.fmean(vs) if vs else None
        cnt = {v: vs.count(v) for v in vs}
        mode = min(cnt, key=lambda v: (-cnt[v], v)) if vs else None
        n = len(vs)
        sd = statistics.stdev(vs) if n > 1 else None
        pv = statistics.pvariance(vs) if vs else 0
        skew = None if n < 3 else 0.0 if pv == 0 else (sum((v - m) ** 3 for v in vs) / n / pv**1.5) * (n * (n - 1)) ** 0.5 / (n - 2)
        want = dict(mean=m, min=min(vs, default=None), max=max(vs, default=None), median=statistics.median(vs) if vs else None, std=sd, var=sd and sd**2 if sd else sd, sum=sum(vs) if inside else None, size=len(inside), count=n, nunique=len(cnt), mode=mode, mode_count=cnt.get(mode, 0), skew=skew,
                    mad=statistics.fmean(abs(v - m) for v in vs) if vs else None, sem=sd / n**0.5 if sd is not None else None, first=vs[0] if vs else None, last=vs[-1] if vs else None, r1=inside[1][4] if len(inside) > 1 else None, **{"t-2": inside[-2][2] if len(inside) > 1 else None})
        for k, v in want.items():
            x = r[f"x__{k}"]
            assert (x is None and v is None) or x == pytest.approx(v), (r.w, k, x, v)


def test_categories_times_custom_and_errors(frame):
    o = frame("t long, v string", [(1, "b"), (2, "a"), (2, None), (3, "b")])
    w = frame("start long, stop long", [(0, 9), (2, 3), (9, 9)])
    got = resample_eav(o, w, {"lab": ["mode", "mode_count", "count", "r0"]}, time_col="t", value_col="v")
    assert rows(got, "lab__mode", "lab__mode_count", "lab__count", "lab__r0") == sorted([("b", 2, 3, "b"), ("a", 1, 1, "a"), (None, 0, 0, None)], key=repr)
    day = datetime(2024, 1, 1)
    o2 = frame("e int, t timestamp_ntz, v timestamp_ntz", [(1, day, day), (1, day + timedelta(hours=1), day + timedelta(hours=2))])
    w2 = frame("e int, start timestamp_ntz, stop timestamp_ntz", [(1, day, day + timedelta(days=1))])
    got = resample_eav(o2, w2, {"z": ["mean", "max", "p50"]}, entity_col="e", time_col="t", value_col="v").first()
    assert (got["z__mean"], got["z__max"], got["z__p50"]) == (day + timedelta(hours=1), day + timedelta(hours=2), day + timedelta(hours=1))
    o3, w3 = tables(frame)

    def spread(f):
        return f.groupby(level=0)["v"].agg(lambda s: s.max() - s.min())

    got = resample_eav(o3, w3, {"attr_1": [custom_agg(spread, "spread double")]}, **COLS, window_id="w")
    assert got.where("w = 2").first()["attr_1__spread"] == pytest.approx(65.7)
    assert resample_eav(o3, w3, None, **COLS).columns == w3.columns
    assert resample_eav(o3.limit(0), w3.limit(0), {"attr_1": ["mean"]}, **COLS).count() == 0
    for agg, kw in (({"a": ["mean"], "b": ["mean"]}, dict(attribute_col=None)), ({"a": ["meen"]}, {}), ({"a": ["mean", "mean"]}, {}), ({"a": ["mean"]}, dict(time_col="zz")), ({"a": [len]}, {})):
        with pytest.raises(ValueError):
            resample_eav(o3, w3, agg, **{**COLS, **kw})
    with pytest.raises(ValueError):
        resample_eav(o3, w3.drop("start", "stop"), {"a": ["mean"]}, **COLS)


def part(v, a, b, s, t, eps=1e-7):
    inf = float("inf")
    lo, hi = max(a, s), min(b, t)
    if s > t or a > b or lo > hi:
        return 0.0
    if a == b:
        return v
    if b - a == inf:
        return v if hi - lo == inf else eps * ((v > 0) - (v < 0))
    return v * (hi - lo) / (b - a)


@pytest.mark.parametrize("ends", [("a", "b", "start", "stop"), ("a", None, "start", "stop"), (None, "b", "start", None), ("a", "b", None, "stop"), (None, "b", None, "stop")])
def test_interval_against_brute_force(frame, ends):
    rnd = random.Random(8)
    inf = float("inf")
    ivs = [(rnd.randint(0, 2), float(rnd.choice([-inf, *range(0, 30)])), float(rnd.choice([inf, *range(0, 40)])), rnd.choice("pq"), rnd.choice([None, -2.0, 3.0, 5.0])) for _ in range(60)]
    win = [(i, rnd.randint(0, 3), float(rnd.randint(0, 30)), float(rnd.randint(0, 40))) for i in range(20)]
    a, b, s, e = ends
    w = frame("w long, g int, start double, stop double", win)
    got = resample_interval(frame("g int, a double, b double, k string, v double", ivs), w if s and e else w.drop("start" if not s else "stop"), ["p", "q", "none"], entity_col="g", start_col=a, stop_col=b, attribute_col="k", value_col="v", window_id="w")
    for r in got.collect():
        _, g, ws, we = win[r.w]
        for k in ("p", "q", "none"):
            want = sum(part(v, x if a else -inf, y if b else inf, ws if s else -inf, we if e else inf) for gg, x, y, kk, v in ivs if gg == g and kk == k and v is not None and (not (a and b) or x <= y))
            assert r[k] == pytest.approx(want, abs=1e-9), (r.w, k)


def test_interval_names_and_errors(frame):
    d, w = frame("a double, b double, v double", [(0.0, 2.0, 4.0)]), frame("start double, stop double", [(1.0, 5.0), (None, 5.0)])
    assert rows(resample_interval(d, w, start_col="a", stop_col="b", value_col="v"), "sum") == [(0.0,), (2.0,)]
    for kw in (dict(value_col="a", start_col="b", stop_col="b"), dict(value_col="v"), dict(value_col="v", start_col="a", attributes=["x", "y"])):
        with pytest.raises(ValueError):
            resample_interval(d, w, **kw)
    with pytest.raises(ValueError):
        resample_interval(d.withColumn("v", F.lit("x")), w, start_col="a", stop_col="b", value_col="v")


def test_make_windows(frame):
    t = datetime(2024, 1, 1)
    df = frame("e int, t timestamp_ntz, v double", [(1, t, 1.0), (2, t + timedelta(days=1), 2.0)])
    h = timedelta(hours=1)
    with pytest.warns(UserWarning):
        got = make_windows(start_rel=-h, duration=2 * h)(df, entity_col="e", time_col="t")
    assert rows(got) == [(1, t - h, t + h), (2, t + timedelta(days=1) - h, t + timedelta(days=1) + h)]
    assert rows(make_windows(entity="all", stop="t", duration=h)(df, entity_col="e", time_col="t")) == [("all", t - h, t), ("all", t + timedelta(days=1) - h, t + timedelta(days=1))]
    assert make_windows(start=t, stop="t")(df, start_col="x", stop_col="y").columns == ["x", "y"]
    last = make_windows(df=lambda df, **_: df.groupBy("e").agg(F.max("t").alias("t")), stop_rel=h, anchor="t")(df, entity_col="e", time_col="t")
    assert last.columns == ["e", "stop"]
    for kw in (dict(), dict(start=1, start_rel=2), dict(stop=1, stop_rel=2), dict(duration=1), dict(start=1, stop=2, duration=1)):
        with pytest.raises(ValueError):
            make_windows(**kw)
    for kw in (dict(start="nope"), dict(start=[1, 2]), dict(start_rel=h)):
        with pytest.raises(ValueError):
            make_windows(**kw)(df, entity_col="e")
    with pytest.raises(ValueError):
        make_windows(start=t)(None)
    assert "start=" in repr(make_windows(start="t"))


def test_interval_refuses_too_many_attributes(spark):
    d = spark.range(10_001).selectExpr("id as k", "0D as a", "1D as b", "1D as v")
    w = spark.range(1).selectExpr("0D as a", "1D as b")
    with pytest.raises(ValueError, match="more than 10000 attributes"):
        resample_interval(d, w, start_col="a", stop_col="b", attribute_col="k", value_col="v")


@pytest.mark.parametrize("ends", [("start", "stop"), ("start", None), (None, "stop")])
@pytest.mark.parametrize("entity", ["g", None])
def test_windows_of_any_length(frame, ends, entity):
    """Open, infinite, tiny and huge windows against brute force; nothing is joined by a nested loop."""
    rnd = random.Random(8)
    inf = float("inf")
    obs = [(i, rnd.choice([1, 1, 1, 2, None]), rnd.choice([float(rnd.randint(0, 99))] * 9 + [None, inf]), "a", float(i)) for i in range(150)]
    win = [(k, rnd.choice([1, 1, 2, None]), *rnd.choice([(float(s), float(s + n))] * 6 + [(-inf, float(s)), (float(s), inf), (None, float(s)), (float(s + 9), float(s))])) for k, s, n in ((k, rnd.randint(0, 90), rnd.choice([0, 1, 5, 10**6])) for k in range(80))]
    w = frame("wid long, g int, start double, stop double", win).select("wid", "g", *[c for c in ends if c])
    got = resample_eav(frame("id long, g int, t double, a string, v double", obs), w, {"a": ["size", "sum", "r1", "t-2", "nunique"]}, entity_col=entity, time_col="t", attribute_col="a", value_col="v", window_id="wid", row_id="id")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    for r in got.collect():
        _, g, s, e = win[r.wid]
        s, e = (-inf if ends[0] is None else s), (None if ends[1] is None else e)
        mine = sorted((t, i, v) for i, h, t, _, v in obs if t is not None and (entity is None or (g is not None and g == h)) and s is not None and t >= s and (ends[1] is None or (e is not None and t < e)))
        assert (r.a__size, r.a__sum, r.a__nunique) == (len(mine), sum(m[2] for m in mine) if mine else None, len(mine)), win[r.wid]
        assert (r.a__r1, r["a__t-2"]) == (mine[1][2] if len(mine) > 1 else None, mine[-2][0] if len(mine) > 1 else None)


def test_whole_sums_without_entity(frame):
    iv = frame("e double, v double, a string", [(1.0, 2.0, "x"), (5.0, 3.0, "y"), (None, 9.0, "x"), (2.0, None, "x")])
    got = resample_interval(iv, frame("w int, stop double", [(0, 1.0), (1, None), (2, 7.0)]), ["x", "y", "z"], stop_col="e", attribute_col="a", value_col="v", window_stop="stop")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert rows(got, "w", "x", "y", "z") == [(0, 2.0, 3.0, 0.0), (1, 0.0, 0.0, 0.0), (2, 2.0, 3.0, 0.0)] and "NestedLoop" not in plan and "Cartesian" not in plan
