import random
import time
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark import factorize, get_loc, grouped_mode, iloc_loc, iloc_loc_assign, impute, partition_series, prev_next_values, roll1d, shift_equal
from tidemark import common
from tidemark.operators import locate, ordered


@pytest.fixture(params=[False, True])
def hotness(monkeypatch, request):
    """Keys that count as hot are scanned in pieces; the result is the same."""
    monkeypatch.setattr(ordered, "hot", lambda *a, **k: request.param)


def test_prev_next(frame, monkeypatch, hotness):
    df = frame("id long, g int, t double, v string", [(0, 1, 2.0, "b"), (1, 1, 1.0, "a"), (2, 1, None, "c"), (3, None, 1.0, "d"), (4, None, 2.0, "e")])
    got = prev_next_values(df, "t", "g", {"v": {"prev_name": "p", "prev_fill": "-", "next_name": "n"}, "zz": {}}, "first", "last", row_id="id", inplace=False)
    assert rows(got) == sorted([(0, "a", "c", False, False), (1, "-", "b", True, False), (2, "b", None, False, True), (3, "-", None, True, True), (4, "-", None, True, True)], key=repr)
    monkeypatch.setattr(ordered, "PIECE", 2)
    flat = prev_next_values(df.drop("g"), "t", None, ["v"], "first", "last", row_id="id")
    order = ["a", "d", "b", "e", "c"]
    for r in flat.collect():
        i = order.index(r.v)
        assert (r.v_prev, r.v_next, r["first"], r["last"]) == (order[i - 1] if i else None, order[i + 1] if i < 4 else None, i == 0, i == 4)
    assert prev_next_values(df, "t", "g") is df
    with pytest.raises(ValueError):
        prev_next_values(df, "g", "g", "v")
    with pytest.raises(ValueError):
        prev_next_values(df, None, "g", "v")


def test_impute_lfill_vector(frame, hotness):
    groups = [[None, 1, None, 3, None], [None, None, None], [8, 9, None], [None, 10]]
    want = [[1, 1, 2, 3, 3], [None, None, None], [8, 9, 9], [10, 10]]
    df = frame("g int, i int, v double", [(g, i, None if v is None else float(v)) for g, vs in enumerate(groups) for i, v in enumerate(vs)])
    got = {(r.g, r.i): r.v for r in impute(df, "lfill", "g", order_by="i").collect()}
    assert got == {(g, i): v for g, vs in enumerate(want) for i, v in enumerate(vs)}


@pytest.mark.parametrize("method,limit", [("linear", None), ("linear", 1), ("linear", 2), ("ffill", 2), ("bfill", 1), ("ffill", None), ("afill", None), ("afill", 1)])
def test_impute_against_pandas(frame, method, limit, hotness):
    rnd = random.Random(1)
    data = [(g, i, rnd.choice([None, float(rnd.randint(0, 9)), float("nan")])) for g in range(4) for i in range(15)]
    got = {(r.g, r.i): r.v for r in impute(frame("g int, i int, v double", data), method, "g", limit, "i").collect()}
    p = pd.DataFrame(data, columns=["g", "i", "v"])
    p["v"] = p.v.astype(float)
    by = p.groupby("g").v
    if method == "linear":
        w = by.transform(lambda s: s.interpolate("linear", limit=limit, limit_area="inside"))
    elif method == "afill":
        a, b = by.transform(lambda s: s.ffill(limit=limit)), by.transform(lambda s: s.bfill(limit=limit))
        w = p.v.fillna(((a.fillna(b) + b.fillna(a)) / 2))
    else:
        w = by.transform(lambda s: getattr(s, method)(limit=limit))
    for (g, i), x in zip(zip(p.g, p.i), w):
        y = got[(g, i)]
        assert (y is None and np.isnan(x)) or abs(y - x) < 1e-9, (g, i)
    with pytest.raises(ValueError):
        impute(frame("g int, i int, v double", data), "mean", "g", order_by="i")
    with pytest.raises(ValueError):
        impute(frame("g int, i int, v double", data), "ffill", "g")


def test_impute_times_and_text(frame):
    t = datetime(2024, 1, 1)
    df = frame("i int, t timestamp_ntz, s string", [(0, t, "a"), (1, None, None), (2, t + timedelta(hours=2), "b")])
    assert rows(impute(df, "linear", order_by="i", columns="t"), "t")[1][0] == t + timedelta(hours=1)
    assert rows(impute(df, "ffill", order_by="i"), "s") == [("a",), ("a",), ("b",)]
    with pytest.raises(ValueError):
        impute(df, "linear", order_by="i", columns="s")


@pytest.mark.parametrize("method", ["ffill", "bfill", "afill", "linear", "lfill"])
def test_impute_grows_with_the_rows(spark, method):
    """Twice the rows of a key take about twice the time, not four times it; a million rows in one key end soon."""

    def took(n):
        df = spark.range(n, numPartitions=2).selectExpr("id % 1 as g", "id as i", "case when id % 5000 = 0 then double(id) end as v")
        t = time.time()
        impute(df, method, "g", order_by="i").write.format("noop").mode("overwrite").save()
        return time.time() - t

    took(20_000)
    assert took(40_000) < 3 * took(20_000) + 2
    assert took(1_000_000) < 15  # some 2 s on 8 cores


def test_impute_keyless_by_text(frame, monkeypatch):
    """Neither keys nor an axis: pieces by position."""
    monkeypatch.setattr(ordered, "PIECE", 3)
    data = [(f"{i:03d}", float(i) if i % 7 == 2 else None) for i in range(30)]
    got = {r.k: r.v for r in impute(frame("k string, v double", data), "lfill", order_by="k").collect()}
    w = pd.Series([v for _, v in data]).interpolate("linear", limit_area="inside").ffill().bfill()
    assert [got[k] for k, _ in data] == pytest.approx(list(w))


def test_carries_without_keys_go_through_runs(frame, monkeypatch):
    monkeypatch.setattr(common, "CHUNKS", 3)
    data = [(i, i // 2, (i * 7) % 11 if i % 5 else None) for i in range(60)]
    df = frame("i int, c long, v int", data).where("c <> 9")
    carry = {"s": ("sum_before", "a"), "x": ("max_before", "b"), "n": ("min_after", "d"), "l": ("last_before", "b"), "f": ("first_after", "b")}
    got = common.chunked(df, [], "c", ["i"], {"a": F.sum("v"), "b": F.max("v"), "d": F.min("v")}, carry).collect()
    known = [(c, v) for _, c, v in data if c != 9]
    top = {c: max((v for k, v in known if k == c and v is not None), default=None) for c, _ in known}
    assert len(got) == 58
    for r in got:
        b, a = [v for c, v in known if c < r.c and v is not None], [v for c, v in known if c > r.c and v is not None]
        near = lambda cs: next((top[c] for c in cs if top.get(c) is not None), None)
        assert (r.s, r.x, r.n, r.l, r.f) == (sum(b), max(b, default=None), min(a, default=None), near(range(r.c - 1, -1, -1)), near(range(r.c + 1, 31)))


def test_grouped_mode(frame):
    df = frame("g int, v double", [(0, 2.0), (0, 0.0), (1, None), (1, 1.0), (2, float("nan")), (1, None), (0, 0.0), (2, None), (None, 5.0)])
    assert rows(grouped_mode(df, "g", "v")) == [(0, 0.0, 2), (1, 1.0, 1), (2, None, 0)]
    assert rows(grouped_mode(df, "g", "v", dropna=False)) == [(0, 0.0, 2), (1, None, 2), (2, None, 2)]
    assert grouped_mode(df.limit(0), "g", "v").count() == 0
    with pytest.raises(ValueError):
        grouped_mode(df, "g")


def test_factorize(frame):
    a = frame("i int, x double, y string", [(0, 2.0, "b"), (1, None, "a"), (2, float("nan"), "a"), (3, 2.0, "b"), (4, 1.0, None)])
    assert [r.key for r in factorize(a, columns=["x", "y"], order_by="i").orderBy("i").collect()] == [0, 1, 1, 0, 2]
    assert [r.key for r in factorize(a, columns=["x", "y"], sort=True).orderBy("i").collect()] == [1, 2, 2, 1, 0]
    b = frame("j int, key0 double, y string", [(0, 5.0, "z"), (1, 2.0, "b")])
    l, r, n = factorize(a, b, ["x", "y"], ["key0", "y"], return_count=True, order_by="i", right_order_by="j")
    assert n == 4 and [x.key for x in r.orderBy("j").collect()] == [3, 0] and l.columns == ["i", "x", "y", "key"]
    with pytest.raises(ValueError):
        factorize(a, b, ["x"], ["key0", "y"])


def test_partition_series(frame):
    rnd = random.Random(0)
    vs = [float(rnd.randint(1, 12)) for _ in range(80)]
    df = frame("i int, v double", list(enumerate(vs)))
    for shuffle in (True, False):
        got = partition_series(df, "v", 10, shuffle=shuffle, order_by="i").collect()
        sums, count = {}, {}
        for r in got:
            sums[r.bin] = sums.get(r.bin, 0) + r.v
            count[r.bin] = count.get(r.bin, 0) + 1
        assert len(got) == 80 and all(s <= 10 or count[b] == 1 for b, s in sums.items()) and sorted(sums) == list(range(len(sums)))
    assert {r.bin for r in partition_series(df, "v", 1e9).collect()} == {0}
    bins, want = [], []
    for v in vs:
        k = next((k for k, left in enumerate(bins) if v <= left and left > 0), None)
        if k is None:
            bins.append(10 - v if v < 10 else 0)
            k = len(bins) - 1
        else:
            bins[k] -= v
        want.append(k)
    assert [r.bin for r in partition_series(df, "v", 10, shuffle=False, order_by="i").orderBy("i").collect()] == want


def test_locators(frame, monkeypatch):
    df = frame("k string, n int, v double", [(c, i % 3, float(i)) for i, c in enumerate("abcdefghij")])
    assert rows(iloc_loc(df, slice(2, 8, 3), ["k"], "k")) == [("c",), ("f",)]
    assert rows(iloc_loc(df, [0, -1], "k", "k")) == [("a",), ("j",)]
    assert rows(iloc_loc(df, [True] + [False] * 9, "k", "k")) == [("a",)]
    assert rows(iloc_loc_assign(df, slice(None, 2), ["v"], 9, "k"), "k", "v")[:3] == [("a", 9.0), ("b", 9.0), ("c", 2.0)]
    assert rows(get_loc(df, "k", "c", "k")) == [(2,)]
    assert rows(get_loc(df, ["n", "k"], (1,), "k")) == [(1,), (4,), (7,)]
    assert rows(get_loc(df, ["n", "k"], [(1, "b"), (2, "c")], "k")) == [(1,), (2,)]
    assert rows(get_loc(df, "k", slice("b", "d"), "k")) == [(1,), (2,), (3,)]
    assert rows(get_loc(df, ["n", "k"], [(1, "b"), (2,)], "k")) == [(1,), (2,), (5,), (8,)]
    assert rows(get_loc(df, "k", [], "k")) == [] and rows(get_loc(df, "k", ["c", "c"], "k")) == [(2,)]
    assert rows(iloc_loc(df, slice(None, None, -4), "k", "k")) == [("b",), ("f",), ("j",)]
    monkeypatch.setattr(locate, "LISTED", 1)
    assert rows(iloc_loc(df, [0, -1, 0], "k", "k")) == [("a",), ("j",)]
    assert rows(iloc_loc_assign(df, [0, 9], ["v"], -1, "k"), "v")[0:2] == [(-1.0,), (-1.0,)] and iloc_loc_assign(df, [0, 9], ["v"], 9, "k").columns == df.columns
    with pytest.raises(KeyError):
        get_loc(df, "k", ["a", "zz"], "k")
    with pytest.raises(IndexError):
        get_loc(df, "k", [True], "k")


def test_shifts(frame):
    df = frame("i int, v int", [(0, 5), (1, 5), (2, None), (3, None)])
    w = Window.orderBy("i")
    assert [tuple(r) for r in df.select(shift_equal(F.col("v"), -1, w), ordered.shift_unequal(F.col("v"), -1, w)).collect()] == [(False, True), (True, False), (False, True), (False, True)]
    assert [r.r for r in roll1d(df, "v", 1, "i", "r").orderBy("i").collect()] == [None, 5, 5, None]


def test_shared_folder(spark, tmp_path):
    """Tables go to the session's folder and are deleted by release(); a cluster without such a folder is refused."""
    import os

    t = common.materialise(spark.range(3))
    path = common._TABLES[-1][1]
    assert t.count() == 3 and path.startswith(common.shared_dir(spark))
    common.release()
    assert not os.path.exists(path.removeprefix("file:")) and common._TABLES == []

    class Nowhere:
        """A session on several machines that names no folder."""

        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"
            _jsc = type("j", (), {"sc": lambda self: type("s", (), {"getCheckpointDir": lambda self: type("o", (), {"isEmpty": lambda self: True})()})()})()
            getConf = staticmethod(dict)

        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Nowhere)
