"""The problems' operators on small tables with every kind of dirt, against brute force."""

import os
import random
import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark.functions.values import readings
from tidemark.operators.donors import fill_from_donors
from tidemark.operators.grid import HORIZONS, regular_grid, smooth
from tidemark.operators.sessions import sessionise
from tidemark.operators.wide import compact, eav_to_cells, typed_wide, wide_delta
from tidemark.plans import problems

T0 = datetime(2024, 1, 1)
TYPES = "attribute string, label string, kind string, unit string, low double, high double, period_s int, levels string"
TYPE_ROWS = [
    ("HR", "heart rate", "double", "bpm", 20.0, 300.0, 900, None), ("Temp", "body temperature", "double", "°C", 30.0, 44.0, 3600, None), ("GCS", "coma score", "int", None, 3.0, 15.0, None, None),
    ("Pos", "body position", "category", None, None, None, None, "supine|left side"), ("Vent", "ventilated", "bool", None, None, None, None, None), ("Adm", "admission time", "timestamp", None, None, None, None, None), ("Bed", "bed code", "string", None, None, None, None, None),
]
OBS = "obs_id long, subject_id long, attribute string, timestamp timestamp_ntz, value string, recorded_at timestamp_ntz, device string, cells int, Kind string, code int, num string"

VALUES = [
    ("hr", "80", 80.0), (" H R. ", "+80.5 BPM", 80.5), ("heart_rate", "80,5", 80.5), ("Heart-Rate", "8.0e1", 80.0), ("HR", "80 bpm", 80.0), ("HR", "<80", None), ("HR", "> 80", None), ("HR", "999", None), ("HR", "1.2.3", None), ("HR", "inf", None), ("HR", "--4", None), ("HR", "cuff err 3", None),
    ("HR", "", None), ("HR", None, None), ("HR", " 80 ", 80.0), ("HR", "80 kg", None), ("Temp", "37.1°C", 37.1), ("temp", "37.1 degC", 37.1), ("TEMP", "37.1 C", 37.1), ("GCS", "7.0", 7.0), ("GCS", "7.5", None), ("GCS", "+7", 7.0), ("Vent", "Yes ", 1.0), ("Vent", "f", 0.0), ("Vent", "maybe", None), ("Vent", "0", 0.0), ("Vent", "yes/no", None),
    ("Pos", "Left-Side", "leftside"), ("Pos", "suppine", None), ("Bed", "B-1", "B-1"), ("Bed", "n/a", None), ("Bed", "—", None), ("Bed", "not done", None), ("Adm", "2024-01-05 06:07:08", datetime(2024, 1, 5, 6, 7, 8)), ("Adm", "05.01.2024 06:07", datetime(2024, 1, 5, 6, 7)), ("Adm", "20240105T0607", datetime(2024, 1, 5, 6, 7)),
    ("Adm", "2024/01/05 06:07", datetime(2024, 1, 5, 6, 7)), ("Adm", "2024-01-05T06:07", datetime(2024, 1, 5, 6, 7)), ("Adm", "30.02.2024 06:07", None), ("Adm", "0000-00-00", None), ("Adm", "yesterday", None), ("unknown thing", "1", None),
]


def test_values(frame):
    o = frame("obs_id long, subject_id long, attribute string, value string", [(i, 1, a, v) for i, (a, v, _) in enumerate(VALUES)] + [(99, None, "HR", "80")])
    got = {r.obs_id: (r.num, r.txt, r.tm) for r in readings(o, frame(TYPES, TYPE_ROWS), None).collect()}
    for i, (a, v, want) in enumerate(VALUES):
        if a == "unknown thing":
            assert i not in got
        else:
            assert [x for x in got[i] if x is not None] == ([] if want is None else [want]), (a, v)
    assert 99 not in got


def random_obs(n, seed=0):
    rnd = random.Random(seed)
    pick = lambda *x: rnd.choice(x)
    out = []
    for i in range(n):
        t = T0 + timedelta(seconds=rnd.randint(0, 30_000), microseconds=pick(0, 1))
        out.append((rnd.randint(0, n * 2), pick(1, 1, 1, 2, 3, None), pick("HR", "heart rate", "temp", "GCS", "x", None), pick(t, t, t, None), pick("70", "71 bpm", "36,5", "7", "n/a", None, "999", ""), T0, "d", 0, "k", 1, "z"))
    return out + out[:5]


@pytest.fixture(scope="module")
def typed(spark):
    def make(data):
        o = spark.createDataFrame(data, OBS)
        return readings(o, spark.createDataFrame(TYPE_ROWS, TYPES), None)

    return make


def collected(r):
    return {(x.obs_id, x.subject_id, x.code, x.timestamp, x.usable, x.num) for x in r.collect()}


def test_wide(typed):
    data = random_obs(300)
    r = typed(data)
    u = r.where("usable")
    best = {}
    for i, s, c, t, ok, v in collected(u):
        if t is not None:
            best[s, c] = max(best.get((s, c), (T0 - timedelta(days=1), 0)), (t, i))
    cells = eav_to_cells(u.withColumn("id", F.col("obs_id")), "subject_id", "code", ["timestamp", "id"], ["num", "txt", "tm"], F.col("obs_id") % 3)
    flat = lambda c: rows(c.select("entity", F.explode("cells").alias("a", "c")).select("entity", "a", "c.id"))
    assert flat(cells) == sorted(((s, c, i) for (s, c), (t, i) in best.items()), key=repr)
    src = u.withColumn("id", F.col("obs_id"))
    args = ("subject_id", "code", ["timestamp", "id"], ["num", "txt", "tm"])
    assert flat(compact([wide_delta(src.where("obs_id % 2 = 0"), *args), wide_delta(src.where("obs_id % 2 = 1"), *args)])) == flat(cells)
    w = typed_wide(cells, {"HR": "double", "GCS": "int", "hr": "double"}, "subject_id", "__id")
    assert w.columns == ["subject_id", "GCS", "GCS__id", "HR", "HR__id", "hr_2", "hr_2__id"] and w.count() == len({s for s, _ in best})
    assert eav_to_cells(src.limit(0), *args).count() == 0


@pytest.mark.parametrize("piece,halo", [(24 * 3600, 6 * 3600), (3600, 0)])
def test_grid_slots(frame, typed, piece, halo):
    r = typed(random_obs(400, 1))
    us = lambda t: int((t - T0).total_seconds() * 1e6 + 0.5)
    win = [(k, s, T0 + timedelta(seconds=a), T0 + timedelta(seconds=b)) for k, (s, a, b) in enumerate([(1, 0, 20_000), (1, 100, 4000), (1, 100, 4000), (2, 5000, 5000), (3, 9000, 100), (1, 3, 1000), (2, 0, 30_000), (None, 0, 99)])]
    win += [(9, 1, None, T0), win[0]]
    got = regular_grid(r.where("num is not null"), frame("window_id long, subject_id long, start timestamp_ntz, stop timestamp_ntz, value string", [(*w, "z") for w in win]), piece * 1_000_000, halo * 1_000_000)
    want = []
    obs = [(s, c, t) for _, s, c, t, ok, v in collected(r) if ok and t is not None]
    for wid, s, a, b in {w for w in win if None not in w and w[2] < w[3]}:
        for code, p in (("HR", 900), ("Temp", 3600)):
            own = [t for s2, c, t in obs if s2 == s and c == code]
            if any(a <= t < b for t in own):
                for k in range((us(b) - us(a)) // (p * 1_000_000)):
                    lo = a + timedelta(seconds=k * p)
                    want.append((wid, code, k, not any(lo <= t < lo + timedelta(seconds=p) for t in own)))
    assert rows(got.select("window_id", "attribute", "slot", "missing")) == sorted(want, key=repr)
    near = got.where("missing = false").select("value").collect()
    assert all(x.value is not None and 20 < x.value < 300 for x in near)


def posterior(t, z, h):
    """Mean and variance of the level given all readings, by the joint normal distribution of all states."""
    seen = ~np.isnan(z)
    mean, var = z[seen].mean(), z[seen].var()
    r = max(0.5 * np.mean(np.diff(z[seen]) ** 2), 1e-6 * (abs(mean) + 1e-3) ** 2)
    w, n = 3 * r / h**3, len(t)
    p = [np.diag([max(var, r), w * h])]
    steps = []
    for d in np.diff(t):
        f = np.array([[1, d], [0, 1]])
        steps.append(f)
        p.append(f @ p[-1] @ f.T + w * np.array([[d**3 / 3, d**2 / 2], [d**2 / 2, d]]))
    c = np.zeros((n, n))
    for i in range(n):
        m = p[i]
        for j in range(i, n):
            c[i, j] = c[j, i] = m[0, 0]
            if j < n - 1:
                m = m @ steps[j].T
    k = c[:, seen] @ np.linalg.inv(c[np.ix_(seen, seen)] + r * np.eye(seen.sum()))
    return mean + k @ (z[seen] - mean), np.diag(c - k @ c[seen]), -0.5 * (np.linalg.slogdet(c[np.ix_(seen, seen)] + r * np.eye(seen.sum()))[1] + (z[seen] - mean) @ np.linalg.solve(c[np.ix_(seen, seen)] + r * np.eye(seen.sum()), z[seen] - mean))


def test_smoother_is_the_exact_posterior():
    rng = np.random.default_rng(0)
    t = np.cumsum(rng.choice([0.0, 0.3, 1.0, 2.5], 40))
    z = 5 + np.sin(t / 4) + rng.normal(0, 0.2, 40)
    z[10:16] = np.nan
    level, var = smooth(t[None], z[None], np.array([40]))
    mean, v, _ = max((posterior(t, z, h) for h in HORIZONS), key=lambda x: x[2])
    assert np.allclose(level[0], mean, atol=1e-6) and np.allclose(var[0], v, rtol=1e-4, atol=1e-9)
    both, _ = smooth(np.stack([t, t]), np.stack([z, z[::-1]]), np.array([40, 20]))
    assert np.allclose(both[0], level[0])
    assert np.isnan(smooth(t[None], np.full((1, 40), np.nan), np.array([40]))[0]).all()


def test_sessions(frame):
    rnd = random.Random(6)
    data = []
    for _ in range(200):
        s = rnd.randint(0, 4000)
        data.append((rnd.choice([1, 2, None]), rnd.choice([s, s, s, None]), s + rnd.choice([0, 0, 5, 300, -3])))
    data += data[:4] + [(7, 0, 5000), (7, 10, 12), (7, 5010, 5011), (8, -30, -30), (8, -20, -20), (8, -9, -9)]
    got = sessionise(frame("k long, c long, e long", data), "k", "c", "e", 10, chunk_cells=3)
    want = []
    for k in {d[0] for d in data if d[0] is not None}:
        cur = None
        for s, e in sorted((s, e) for kk, s, e in data if kk == k and s is not None and s <= e):
            if cur and s <= cur[1] + 10:
                cur[1], cur[2] = max(cur[1], e), cur[2] + 1
            else:
                cur = [s, e, 1]
                want.append((k, cur))
    assert rows(got) == sorted(((k, c[0], c[1], c[1] - c[0], c[2]) for k, c in want), key=repr)
    assert sessionise(frame("k long, c long, e long", []), "k", "c", "e", 10).count() == 0


def test_fill(typed):
    r = typed(random_obs(500, 3)).withColumn("timestamp_us", F.unix_micros(F.col("timestamp").cast("timestamp")))
    got = {x.obs_id: x for x in fill_from_donors(r).collect()}
    every = collected(r)
    hour = timedelta(hours=1)
    want = {}
    for i, s, c, t, ok, _ in every:
        if t is not None and not ok:
            donors = {(j, v) for j, s2, c2, t2, ok2, v in every if ok2 and t2 is not None and s2 == s and c2 == c and abs(t2 - t) <= hour}
            if donors:
                want.setdefault(i, set()).update(donors)
    assert set(got) == set(want)
    assert all((x.donor_id, x.num) in want[i] for i, x in got.items())
    assert fill_from_donors(r.limit(0)).count() == 0


def test_found_readings_come_through_the_matching(spark):
    """The optimizer keeps the predictors and the choice of the donor in p7_found."""
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables here")
    read = set()
    for part in problems.p7_found(spark, d)._jdf.queryExecution().optimizedPlan().collectLeaves().mkString("|").split("|"):
        read |= set(re.findall(r"\b(num|txt|tm|d_y|sn_y|cs_y)#", part))
    assert read == {"num", "txt", "tm", "d_y", "sn_y", "cs_y"}


def test_fill_takes_the_nearest_prediction(frame):
    """The donor nearest to the reading's prediction goes before a nearer in time; equal predictions go by time, then id."""
    minute = 60_000_000
    schema = "obs_id long, subject_id long, code string, timestamp_us long, usable boolean, num double, txt string, tm timestamp_ntz"
    steep = [(k, 1, "A", 240 * k * minute, True, 10.0 * k, None, None) for k in range(60)]
    at = 120 * minute + 40 * 240 * minute
    steep += [(100, 1, "A", at - 50 * minute, True, 400.0, None, None), (101, 1, "A", at + 20 * minute, True, 100.0, None, None), (102, 1, "A", at, False, None, None, None), (102, 1, "A", at, False, None, None, None)]
    flat = [(k, 2, "B", k * minute, True, 5.0, None, None) for k in (200, 199, 210)] + [(300, 2, "B", 205 * minute, False, None, None, None), (301, 2, "B", 500 * minute, False, None, None, None)]
    got = {x.obs_id: (x.donor_id, x.num, x.distance_us) for x in fill_from_donors(frame(schema, steep + flat)).collect()}
    assert got == {102: (100, 400.0, 50 * minute), 300: (200, 5.0, 5 * minute)}


@pytest.mark.parametrize("hours", [1, 5, 24, 10_000])
def test_grid_smooths_whole_sources(frame, hours):
    """Pieces give what the smoother gives for all readings of the source at once, also far from any reading."""
    rng = np.random.default_rng(3)
    at = np.sort(np.concatenate([rng.uniform(0, 40, 60), rng.uniform(200, 230, 25), [400.0]]))
    value = lambda t: 37 + np.sin(np.asarray(t) / 15) + rng.normal(0, 0.2, len(t))
    obs = [(1, "Temp", int(t * 3.6e9), float(v), 3600) for t, v in zip(at, value(at))]
    obs += [(1, "HR", int(t * 3.6e9), float(v), 900) for t, v in zip(at[::2], value(at[::2]))] + [(2, "Temp", 7_200_000_000, 36.5, 3600)]
    win = [(1, 1, 0, 90 * 3_600_000_000), (2, 1, 150 * 3_600_000_000, 420 * 3_600_000_000), (3, 2, 0, 99 * 3_600_000_000)]
    got = regular_grid(frame("subject_id long, code string, timestamp long, num double, period_s int", obs), frame("window_id long, subject_id long, start long, stop long", win), hours * 3_600_000_000).collect()
    assert len(got) == 360 * 5 + 99 and not any(x.value is None or np.isnan(x.value) or x.sd is None or np.isnan(x.sd) for x in got)
    subject = {w[0]: w[1] for w in win}
    for s, code, period in ((1, "Temp", 3600e6), (1, "HR", 900e6), (2, "Temp", 3600e6)):
        mine = sorted((x for x in got if subject[x.window_id] == s and x.attribute == code), key=lambda x: x.at_us)
        places = sorted([(o[2], -1, o[3]) for o in obs if o[:2] == (s, code)] + [(x.at_us, x.slot, np.nan) for x in mine])
        t, slot, z = (np.array(c, dtype=float) for c in zip(*places))
        level, var = smooth((t - t[0])[None] / period, z[None], np.array([len(t)]))
        assert np.allclose([x.value for x in mine], level[0][slot >= 0], rtol=1e-6, atol=1e-6) and np.allclose([x.sd for x in mine], np.sqrt(var[0][slot >= 0]), rtol=1e-4, atol=1e-9)
        assert [x.missing for x in mine] == [not any(x.at_us <= o[2] < x.at_us + period for o in obs if o[:2] == (s, code)) for x in mine]


def test_wide_refuses_too_many_types(spark, monkeypatch):
    many = spark.range(problems.MAX_COLUMNS + 1).selectExpr("concat('a', id) as attribute", "'double' as kind")
    monkeypatch.setattr(problems, "table", lambda *_: many)
    with pytest.raises(ValueError, match="attribute types"):
        problems.p1_wide(spark, "")
