import random

import numpy as np
import pytest

from tests.conftest import rows
from tidemark.llm import digest
from tidemark.llm.digest import digests, estimate, merge_digests, percentiles
from tidemark.llm.nearest import nearest_in_time


def test_nearest(frame):
    rnd = random.Random(1)
    left = [(i, rnd.choice([1, 2, None]), rnd.choice([rnd.randint(0, 3000)] * 9 + [None]), "x") for i in range(200)]
    right = [(rnd.randint(0, 900), rnd.choice([1, 2, None]), rnd.choice([rnd.randint(0, 3000) // 7 * 7] * 9 + [None]), "y") for _ in range(250)]
    left, right = left + left[:3] + [(None, 1, 5, "z")], right + right[:9]
    want = []
    for i, k, t, _ in set(left):
        near = [(abs(t - u), j) for j, k2, u, _ in right if None not in (i, k, t, k2, u) and k2 == k and abs(t - u) <= 37]
        if near:
            want.append((i, min(near)[1], min(near)[0]))
    l, r = frame("lid long, k long, b long, rid string", left), frame("rid long, k long, lt long, d string", right)
    for rings in (1, 2, 4):
        assert rows(nearest_in_time(l, r, "lid", "rid", "k", "k", "b", "lt", 37, rings)) == sorted(want, key=repr)
    assert nearest_in_time(l.limit(0), r, "lid", "rid", "k", "k", "b", "lt", 37).count() == 0
    assert nearest_in_time(l, r.limit(0), "lid", "rid", "k", "k", "b", "lt", 37).count() == 0
    with pytest.raises(ValueError):
        nearest_in_time(l, r, "lid", "rid", "k", "k", "b", "lt", 0)


def test_percentiles_are_certified(frame):
    rng = np.random.default_rng(0)
    vals = {"a": rng.lognormal(0, 2, 20_000), "b": np.repeat([1.0, 2.0, 3.0], 500), "c": np.array([7.0]), "d": np.concatenate([rng.normal(0, 1, 3000), rng.normal(50, 1, 3000)])}
    data = [(g, float(v)) for g, vs in vals.items() for v in vs] + [("a", None), ("a", float("nan")), (None, 1.0), ("e", None)]
    df = frame("grp string, weight double", data).repartition(7)
    got = percentiles(df, "grp", "weight", size=100).collect()
    assert {r.grp for r in got} == set("abcd")
    for r in got:
        v = np.sort(vals[r.grp])
        assert r.n == len(v)
        assert r.rank_low == pytest.approx(np.searchsorted(v, r.value, "left") / len(v)) and r.rank_high == pytest.approx(np.searchsorted(v, r.value, "right") / len(v))
        assert r.rank_error == pytest.approx(max(r.rank_low - r.q, r.q - r.rank_high, 0)) and r.rank_error <= np.pi / 100 + 1 / len(v)
    assert percentiles(df.limit(0), "grp", "weight").count() == 0


def test_digests_of_loads_combine(frame):
    rng = np.random.default_rng(1)
    v = rng.gamma(2, 3, 9000)
    loads = [frame("g string, x double", [("k", float(x)) for x in v[i::3]]) for i in range(3)]
    d = merge_digests([digests(x, "g", "x", 100) for x in loads], 100)
    assert d.count() < 220 and d.groupBy().sum("weight").first()[0] == 9000
    est = {r.q: r.value for r in estimate(d, [0, 0.1, 0.5, 0.9, 1]).collect()}
    assert est[0] == v.min() and est[1] == v.max()
    for q in (0.1, 0.5, 0.9):
        assert abs((v < est[q]).mean() - q) < 0.01


@pytest.mark.parametrize("shape", ["sorted", "reversed", "interleaved", "ties", "heavy"])
def test_stated_error_holds_over_all_merges(frame, shape):
    """Many loads, in orders that part a group's values unevenly between tasks: within the stated error after three clusterings."""
    rng = np.random.default_rng(3)
    v = {"sorted": np.arange(20_000.0), "reversed": np.arange(20_000.0)[::-1], "interleaved": np.arange(20_000.0) * 7919 % 20_011, "ties": rng.integers(0, 40, 20_000) * 1.0, "heavy": rng.standard_cauchy(20_000)}[shape]
    df = frame("g string, x double", [("k", float(x)) for x in v]).repartition(31, "x" if shape == "interleaved" else "g") if shape != "sorted" else frame("g string, x double", [("k", float(x)) for x in v]).repartitionByRange(31, "x")
    for size in (20, 100):
        got = percentiles(df, "g", "x", [k / 50 for k in range(51)], size=size).collect()
        assert len(got) == 51 and max(r.rank_error for r in got) <= np.pi / size + 1 / len(v)


def test_infinities_and_many_groups(frame, monkeypatch):
    inf = float("inf")
    data = [("a", x) for x in [-inf] * 30 + [1.0] * 40 + [2.0] * 20 + [inf] * 10] + [("b", -inf), ("b", inf), ("c", inf)]
    df = frame("g string, x double", data)
    q = [0.1, 0.25, 0.5, 0.8, 0.95]
    want = rows(percentiles(df, "g", "x", q), "grp", "n", "q", "value", "rank_error")
    assert [(r[2], r[3]) for r in want if r[0] == "a"] == [(0.1, -inf), (0.25, -inf), (0.5, 1.0), (0.8, 2.0), (0.95, inf)]
    monkeypatch.setattr(digest, "GROUPS", 1)
    salted = percentiles(df, "g", "x", q)
    assert rows(salted, "grp", "n", "q", "value", "rank_error") == want


def test_values_meet_estimates_without_being_sent(frame):
    df = frame("g string, x double", [("k", float(i)) for i in range(50)])
    est = estimate(digests(df, "g", "x"), [0.5])
    plan = digest.certify(df, "g", "x", est, [0.5])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_equal_values_keep_their_value(frame):
    """A centroid's mean that rounding carries past values of many equal ones would stand beside all of them."""
    data = [("k", x) for v, n in ((96.6, 97), (0.1, 153), (94.6, 211), (7.3, 139)) for x in [v] * n]
    got = percentiles(frame("g string, x double", data).repartition(3), "g", "x", [k / 20 for k in range(21)]).collect()
    assert len(got) == 21 and max(r.rank_error for r in got) <= 1 / 100
    inside = {r.q: r.value for r in got}
    assert [inside[q] for q in (0.1, 0.4, 0.7, 0.95)] == [0.1, 7.3, 94.6, 96.6]
    big = percentiles(frame("g string, x double", [("k", x) for x in [-1.7e308] * 400 + [1.7e308] * 400]), "g", "x", [0.25, 0.75], size=20).collect()
    assert {r.q: r.value for r in big} == {0.25: -1.7e308, 0.75: 1.7e308}


def test_estimates_beyond_the_stated_error_are_made_again(frame, monkeypatch):
    """Between two peaks interpolation passes most of the next centroid; the centroid that holds the place doesn't."""
    data = [("two", float(x >= 60)) for x in range(100)] + [("flat", float(x)) for x in range(100)] + [(None, 1.0)]
    df, q = frame("grp string, __grp double", data).coalesce(1), [0, *[k / 200 for k in range(105, 131)], 1]
    most = {}
    for r in percentiles(df, "grp", "__grp", q, size=40).collect():
        most[r.grp] = max(most.get(r.grp, 0), r.rank_error)
    bound = 0.8 * most["two"]
    assert most["flat"] < bound
    monkeypatch.setattr(digest, "stated_error", lambda size=0: digest.F.lit(bound))
    got = percentiles(df, "grp", "__grp", q, size=40).collect()
    assert len(got) == 2 * len(q) and max(r.rank_error for r in got) <= bound
    for g, most in (("two", 1.0), ("flat", 99.0)):
        at = [v for _, v in sorted((r.q, r.value) for r in got if r.grp == g)]
        assert at == sorted(at) and (at[0], at[-1]) == (0.0, most)


def test_a_task_clusters_each_value_once():
    """Clustering centroids again with every batch would add errors that the stated one doesn't count."""
    v = np.random.default_rng(2).permutation(300_000.0 + np.arange(300_000))
    batches = (digest.pd.DataFrame({"grp": "k", "mean": x, "weight": 1.0}) for x in np.split(v, 30))
    out = list(digest._leaf(20)(batches))
    assert [len(d) <= 22 for d in out] == [True, True] and [d.weight.sum() for d in out] == [210_000, 90_000]
