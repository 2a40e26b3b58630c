import random

import pytest

from tests.conftest import rows
from tidemark import combine_intervals, group_intervals
from tidemark.operators import intervals
from tidemark.operators.sweep import periods_and_gaps


@pytest.fixture(params=[False, True])
def hotness(monkeypatch, request):
    """Keys that count as hot are scanned in pieces; the result is the same."""
    monkeypatch.setattr(intervals, "hot", lambda *a, **k: request.param)


def cover(ivs, attr, n_min, n_max):
    """Brute force over unit cells and endpoints."""
    pts = sorted({p for s, e, _ in ivs for p in (s, e)})
    out = []
    for a, b in zip(pts, pts[1:]):
        live = [x for x in ivs if x[0] <= a and x[1] >= b]
        n = len({x[2] for x in live}) if attr else len(live)
        if n >= n_min and (n_max is None or n <= n_max):
            if out and out[-1][1] == a:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
    return out


@pytest.mark.parametrize("n_min,n_max,attr", [(1, None, False), (2, None, False), (0, 0, False), (0, None, False), (1, 1, False), (1, None, True), (2, 2, True), (0, 0, True)])
def test_combine(frame, n_min, n_max, attr, hotness):
    rnd = random.Random(7)
    data = [(g, float(s), float(s + rnd.randint(0, 6)), rnd.choice("ab")) for g in range(5) for s in [rnd.randint(0, 40) for _ in range(12)]]
    got = combine_intervals(frame("g int, s double, e double, a string", data + [(9, None, 3.0, "a"), (9, 5.0, 1.0, "a")]), "s", "e", attr_cols="a" if attr else (), group_by="g", n_min=n_min, n_max=n_max)
    want = [(g, *x) for g in range(5) for x in cover([d[1:] for d in data if d[0] == g], attr, n_min, n_max)]
    assert rows(got) == sorted(want, key=repr)


def test_combine_ungrouped_empty_length_and_errors(frame):
    d = frame("s double, e double, l double", [(0.0, 2.0, 2.0), (1.0, 3.0, 2.0), (5.0, 6.0, 1.0)])
    assert rows(combine_intervals(d, "s", "e")) == [(0.0, 3.0), (5.0, 6.0)]
    assert rows(combine_intervals(d, "s", None, "l")) == [(0.0, 3.0), (5.0, 1.0)]
    assert combine_intervals(d.limit(0), "s", "e", n_min=0).count() == 0
    for kw in (dict(n_min=2, n_max=1), dict(stop_col="e", length_col="l"), dict(stop_col=None), dict(stop_col="e", attr_cols="l", group_by="l")):
        with pytest.raises(ValueError):
            combine_intervals(d, "s", **kw)


def closure(data, dist, inclusive):
    """Groups of (key, start, stop) rows as a partition of ids, by brute force."""
    n = len(data)
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            a, b = data[i], data[j]
            if a[0] is None or b[0] is None or a[0] != b[0] or None in (a[1], b[1]):
                continue
            gap = max(a[1], b[1]) - min(a[2], b[2])
            if gap <= dist if inclusive else gap < dist:
                parent[find(i)] = find(j)
    return {frozenset(i for i in range(n) if find(i) == r) for r in {find(i) for i in range(n)}}


@pytest.mark.parametrize("inclusive", [True, False])
def test_group_intervals(frame, inclusive, hotness):
    rnd = random.Random(5)
    data = [(rnd.choice([1, 2, 3]), s, s + rnd.randint(1, 4)) for s in [rnd.randint(0, 60) for _ in range(60)]] + [(None, 5, 6), (None, 5, 6), (1, None, None)]
    df = frame("id long, k int, s int, e int", [(i, *d) for i, d in enumerate(data)])
    got = group_intervals(df, "k", start_col="s", stop_col="e", distance=2, inclusive=inclusive, row_id="id", name="gid")
    by = {}
    for r in got.collect():
        by.setdefault(r.gid, set()).add(r.id)
    assert {frozenset(x) for x in by.values()} == closure(data, 2, inclusive)
    assert sorted(by) == list(range(len(by)))
    first = {g: min((data[i][0] is None, data[i][0] or 0, data[i][1] is None, data[i][1] or 0) for i in ids) for g, ids in by.items()}
    assert [first[g] for g in sorted(first)] == sorted(first.values())


def test_group_points_stop_missing_and_errors(frame, hotness):
    df = frame("id long, s double, e double", [(0, 0.0, 1.0), (1, 1.0, None), (2, 2.0, 3.0), (3, 3.0, 4.0)])
    got = group_intervals(df, start_col="s", stop_col="e", distance=5, row_id="id")
    assert [r.group_id for r in got.orderBy("id").collect()] == [0, 0, 1, 1]
    local = group_intervals(df, point_col="s", distance=0.5, row_id="id", ids="local")
    assert [r.group_id for r in local.orderBy("id").collect()] == [0, 1, 2, 3]
    for kw in (dict(point_col="s"), dict(distance=1), dict(point_col="s", start_col="s", distance=1), dict(point_col="s", distance=1, ids="x")):
        with pytest.raises(ValueError):
            group_intervals(df, **kw)


def test_periods_and_gaps(frame):
    """Null ends, keys and rows twice, inverted and empty intervals, touching ones, far gaps, clashing names, no rows."""
    schema = "kind string, k1 long, t double, n double, __chunk int"
    data = [("x", 1, 0.0, 2.0, 0), ("x", 1, 0.0, 2.0, 0), ("y", 1, 2.0, 3.0, 0), ("x", 1, 5.0, 6.0, 0), ("x", 1, 5.5, 5.7, 0), ("x", 1, 90.0, 91.0, 0), ("x", None, 0.0, 1.0, 0), ("x", 1, 4.0, 4.0, 0), ("x", 1, 7.0, 4.0, 0), ("x", 1, None, 9.0, 0), ("x", 2, 1.0, 2.0, 0)]
    got = periods_and_gaps(frame(schema, data), "k1", "t", "n", max_gap=10, chunk=3)
    assert rows(got) == sorted([(1, "period", 0.0, 3.0), (1, "gap", 3.0, 5.0), (1, "period", 5.0, 6.0), (1, "period", 90.0, 91.0), (2, "period", 1.0, 2.0)], key=repr)
    every = periods_and_gaps(frame(schema, data), "k1", "t", "n", chunk=1)
    assert (1, "gap", 6.0, 90.0) in rows(every)
    assert periods_and_gaps(frame(schema, []), "k1", "t", "n").count() == 0


def test_periods_match_brute_force(frame):
    rnd = random.Random(2)
    data = [(rnd.randint(0, 3), float(s), float(s + rnd.randint(-1, 8))) for s in [rnd.randint(0, 300) for _ in range(150)]]
    got = periods_and_gaps(frame("k long, s double, e double", data), "k", "s", "e", chunk=17)
    want = []
    for k in range(4):
        p = cover([(s, e, 0) for g, s, e in data if g == k and s < e], False, 1, None)
        want += [(k, "period", *x) for x in p] + [(k, "gap", a[1], b[0]) for a, b in zip(p, p[1:])]
    assert rows(got) == sorted(want, key=repr)
