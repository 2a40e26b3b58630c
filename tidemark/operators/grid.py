"""Irregular readings onto a regular grid: Kalman smoother with a continuous-time local trend per source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import materialise, need_columns, numeric_axis, require

HOUR = 3_600_000_000
#: Horizons (in periods) among which each source's smoothness is chosen by likelihood.
HORIZONS = (3.0, 12.0, 100.0)
#: Places that a block of series may hold: about 200 bytes each while it is solved.
CELLS = 200_000
OUT = "window_id bigint, attribute string, slot bigint, at_us bigint, missing boolean, value double, sd double"
#: What a piece's readings say about its first and last state, for one horizon (see _elements), and the state it is solved with.
ELEMENT = "a00 a01 a10 a11 b0 b1 c00 c01 c11 j00 j01 j11 e0 e1 logs squares".split()
KEYS = ["subject_id", "code", "piece"]
FACTS = "n c0 m2 d2 z_first z_last t_first t_last reading".split()
STATE = 14


def _moved(x, p, h, w):
    """State's mean and variance h periods later."""
    x0, x1 = x
    p00, p01, p11 = p
    return (x0 + h * x1, x1), (p00 + h * (2 * p01 + h * p11) + w * h**3 / 3, p01 + h * p11 + w * h**2 / 2, p11 + w * h)


def _forward(dt, seen, zz, r, w, x, p, keep: bool):
    """Filter of many series: log-likelihoods, or with keep the states before and after every place."""
    ll, store = 0.0, []
    for k in range(dt.shape[1]):
        (a0, a1), (b00, b01, b11) = _moved(x, p, dt[:, k], w)
        s = seen[:, k]
        v = b00 + r
        e = np.where(s, zz[:, k] - a0, 0.0)
        g0, g1 = np.where(s, b00 / v, 0.0), np.where(s, b01 / v, 0.0)
        # r / v rather than 1 - gain, which rounds to nothing after a long time without readings.
        rest = np.where(s, r / v, 1.0)
        x, p = (a0 + g0 * e, a1 + g1 * e), (b00 * rest, b01 * rest, b11 - g1 * b01)
        if keep:
            store.append((a0, a1, b00, b01, b11, *x, *p))
        else:
            ll = ll + np.where(s, -0.5 * (np.log(v) + e * e / v), 0.0)
    return store if keep else ll


def _backward(dt, f, last) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed level and its variance at every place, from the filter's states and the smoothed last state."""
    n, m = dt.shape
    level, variance = np.empty((n, m)), np.empty((n, m))
    s0, s1, c00, c01, c11 = last
    level[:, -1], variance[:, -1] = s0, np.maximum(c00, 0.0)
    for k in range(m - 2, -1, -1):
        h = dt[:, k + 1]
        a0, a1, b00, b01, b11 = f[k + 1][:5]
        n0, n1, u00, u01, u11 = f[k][5:]
        det = b00 * b11 - b01 * b01
        det = np.where(det > 1e-300, det, 1e-300)
        # Gain = U F' inv(B), F = [[1, h], [0, 1]].
        m00, m01, m10, m11 = u00 + h * u01, u01, u01 + h * u11, u11
        j00, j01 = (m00 * b11 - m01 * b01) / det, (m01 * b00 - m00 * b01) / det
        j10, j11 = (m10 * b11 - m11 * b01) / det, (m11 * b00 - m10 * b01) / det
        # Steps of no time leave the state as it is; the general gain is then the identity but for rounding.
        same = h <= 0
        j00, j01, j10, j11 = np.where(same, 1.0, j00), np.where(same, 0.0, j01), np.where(same, 0.0, j10), np.where(same, 1.0, j11)
        e0, e1 = s0 - a0, s1 - a1
        g00, g01, g11 = c00 - b00, c01 - b01, c11 - b11
        s0, s1 = n0 + j00 * e0 + j01 * e1, n1 + j10 * e0 + j11 * e1
        c00 = u00 + j00 * (j00 * g00 + j01 * g01) + j01 * (j00 * g01 + j01 * g11)
        c01 = u01 + j10 * (j00 * g00 + j01 * g01) + j11 * (j00 * g01 + j01 * g11)
        c11 = u11 + j10 * (j10 * g00 + j11 * g01) + j11 * (j10 * g01 + j11 * g11)
        level[:, k], variance[:, k] = s0, np.maximum(c00, 0.0)
    return level, variance


def _steps(t: np.ndarray, length: np.ndarray) -> np.ndarray:
    dt = np.diff(t, axis=1, prepend=t[:, :1])
    return np.where(np.arange(t.shape[1])[None, :] < length[:, None], np.maximum(dt, 0.0), 0.0)


def _noise(mean, var, d2, dn):
    """Variance of a reading's noise: half the mean square of differences between successive readings."""
    return np.maximum(np.where(dn > 0, 0.5 * d2 / np.maximum(dn, 1), var), 1e-6 * (np.abs(mean) + 1e-3) ** 2)


def _squares(seen, zz):
    """Sum of squared differences between successive readings of each series, and their number."""
    n, m = seen.shape
    last, have, d2, dn = np.zeros(n), np.zeros(n, bool), np.zeros(n), np.zeros(n)
    for k in range(m):
        s = seen[:, k]
        use = s & have
        d2 += np.where(use, (zz[:, k] - last) ** 2, 0.0)
        dn += use
        last, have = np.where(s, zz[:, k], last), have | s
    return d2, dn


def smooth(t: np.ndarray, z: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed level and its variance at every place of many whole series at once.

    t: (series, places) times in periods, rising; z: readings, nan where there is none; length: used places of each series.
    A series without readings gives nan. State is (level, slope) with white-noise acceleration of density w; a reading
    is the level plus noise of variance r. r comes from the series' own successive differences, w from the horizon of
    greatest likelihood: w = 3 r / horizon^3. At the first place the level is the readings' mean, give or take their spread,
    the slope nil, give or take what w makes of it in a horizon. All series step together, so a step is a few numpy operations.
    """
    n = len(t)
    seen = ~np.isnan(z)
    count = seen.sum(1)
    zz = np.where(seen, z, 0.0)
    mean = zz.sum(1) / np.maximum(count, 1)
    var = (np.where(seen, z - mean[:, None], 0.0) ** 2).sum(1) / np.maximum(count, 1)
    r = _noise(mean, var, *_squares(seen, zz))
    dt = _steps(t, length)

    def forward(horizon, keep: bool):
        w = 3 * r / horizon**3
        return _forward(dt, seen, zz, r, w, (mean.copy(), np.zeros(n)), (np.maximum(var, r), np.zeros(n), w * horizon), keep)

    scores = np.stack([forward(np.full(n, h), False) for h in HORIZONS])
    f = forward(np.asarray(HORIZONS)[scores.argmax(0)], True)
    level, variance = _backward(dt, f, f[-1][5:])
    none = (count == 0)[:, None]
    return np.where(none, np.nan, level), np.where(none, np.nan, variance)


def _groups(p: pd.DataFrame, keys: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First row and length of each group of sorted rows, and each row's group."""
    new = np.ones(len(p), bool)
    new[1:] = np.any([(c := p[k].to_numpy())[1:] != c[:-1] for k in keys], axis=0)
    begin = np.flatnonzero(new)
    return begin, np.diff(np.append(begin, len(p))), np.cumsum(new) - 1


def _blocks(begin: np.ndarray, length: np.ndarray, which: np.ndarray, cells: int = CELLS):
    """Groups of like length together, (groups, rows, used): a block holds a bounded number of places."""
    order = which[np.argsort(length[which], kind="stable")]
    at = 0
    while at < len(order):
        some = order[at : at + max(1, min(512, cells // int(length[order[min(at + 511, len(order) - 1)]])))]
        at += len(some)
        m = int(length[some].max())
        yield some, begin[some][:, None] + np.minimum(np.arange(m)[None, :], length[some][:, None] - 1), np.arange(m)[None, :] < length[some][:, None]


def _elements(dt: np.ndarray, seen: np.ndarray, zz: np.ndarray, horizon: float) -> np.ndarray:
    """(series, ELEMENT): what pieces say about their first state x, for noise of variance 1.

    The last state is normal with mean A x + b and variance C; the readings' log-likelihood is
    -(logs + squares) / 2 + e x - x J x / 2.
    """
    n = len(dt)
    w = 3 / horizon**3
    a00, a01, a10, a11 = np.ones(n), np.zeros(n), np.zeros(n), np.ones(n)
    b, c = (np.zeros(n), np.zeros(n)), (np.zeros(n), np.zeros(n), np.zeros(n))
    j00, j01, j11, e0, e1, logs, squares = np.zeros((7, n))
    for k in range(dt.shape[1]):
        h = dt[:, k]
        (b0, b1), (c00, c01, c11) = _moved(b, c, h, w)
        a00, a01 = a00 + h * a10, a01 + h * a11
        s = seen[:, k]
        v = c00 + 1.0
        u = np.where(s, 1.0 / v, 0.0)
        e = zz[:, k] - b0
        j00, j01, j11 = j00 + a00 * a00 * u, j01 + a00 * a01 * u, j11 + a01 * a01 * u
        e0, e1 = e0 + a00 * e * u, e1 + a01 * e * u
        logs, squares = logs + np.where(s, np.log(v), 0.0), squares + e * e * u
        g0, g1, rest = c00 * u, c01 * u, np.where(s, u, 1.0)
        a00, a01, a10, a11 = a00 * rest, a01 * rest, a10 - g1 * a00, a11 - g1 * a01
        b, c = (b0 + g0 * e, b1 + g1 * e), (c00 * rest, c01 * rest, c11 - g1 * c01)
    return np.stack([a00, a01, a10, a11, *b, *c, j00, j01, j11, e0, e1, logs, squares], axis=1)


def _sum_up(p: pd.DataFrame) -> pd.DataFrame:
    """One row for each piece: sums of its readings and its elements for each horizon, readings taken from the piece's mean."""
    begin, length, group = _groups(p, KEYS)
    t, slot, period = p["t"].to_numpy(), p["slot"].to_numpy(), p["period"].to_numpy()
    read = slot < 0
    z = np.where(read, p["z"].to_numpy(dtype=float), np.nan)
    facts, el = np.full((len(begin), len(FACTS)), np.nan), np.empty((len(begin), len(HORIZONS) * len(ELEMENT)))
    for some, idx, inside in _blocks(begin, length, np.arange(len(begin))):
        seen = inside & read[idx]
        n = seen.sum(1)
        zz = np.where(seen, z[idx], 0.0)
        c0 = zz.sum(1) / np.maximum(n, 1)
        zz = np.where(seen, zz - c0[:, None], 0.0)
        dt = _steps((t[idx] - t[begin[some]][:, None]) / period[begin[some]][:, None].astype(float), length[some])
        first, last = seen.argmax(1), seen.shape[1] - 1 - seen[:, ::-1].argmax(1)
        row, none = np.arange(len(some)), n == 0
        ends = [np.where(none, np.nan, x) for x in (z[idx[row, first]], z[idx[row, last]])]
        facts[some] = np.stack([n, c0, (zz**2).sum(1), _squares(seen, zz)[0], *ends, t[begin[some]], t[begin[some] + length[some] - 1], np.where(none, np.nan, t[idx[row, first]])], axis=1)
        el[some] = np.concatenate([_elements(dt, seen, zz, h) for h in HORIZONS], axis=1)
    out = p.iloc[begin][[*KEYS, "period"]].reset_index(drop=True)
    out["slots"] = np.bincount(group, ~read) > 0
    return pd.concat([out, pd.DataFrame(np.concatenate([facts, el], axis=1), columns=_columns())], axis=1)


def _columns() -> list[str]:
    return [*FACTS, *(f"{c}_{k}" for k in range(len(HORIZONS)) for c in ELEMENT)]


def _meet(p, j):
    """inv(I + P J), its product with P, and the determinant of I + P J; P and J symmetric."""
    p00, p01, p11 = p
    j00, j01, j11 = j
    dp, dj = np.maximum(p00 * p11 - p01 * p01, 0.0), np.maximum(j00 * j11 - j01 * j01, 0.0)
    d = 1 + p00 * j00 + 2 * p01 * j01 + p11 * j11 + dp * dj
    inverse = ((1 + p01 * j01 + p11 * j11) / d, -(p00 * j01 + p01 * j11) / d, -(p01 * j00 + p11 * j01) / d, (1 + p00 * j00 + p01 * j01) / d)
    return inverse, ((p00 + dp * j11) / d, (p01 - dp * j01) / d, (p11 + dp * j00) / d), d


def _times(k, x):
    return k[0] * x[0] + k[1] * x[1], k[2] * x[0] + k[3] * x[1]


def _symmetric(p, x):
    return p[0] * x[0] + p[1] * x[1], p[1] * x[0] + p[2] * x[1]


def _around(k, p):
    """K P K'."""
    u00, u01, u10, u11 = k[0] * p[0] + k[1] * p[1], k[0] * p[1] + k[1] * p[2], k[2] * p[0] + k[3] * p[1], k[2] * p[1] + k[3] * p[2]
    return u00 * k[0] + u01 * k[1], u00 * k[2] + u01 * k[3], u10 * k[2] + u11 * k[3]


def _carry(p: pd.DataFrame) -> pd.DataFrame:
    """From the rows of whole sources, sorted by piece, the state with which each piece that has slots is solved.

    Mean, spread, noise and horizon are the whole source's. The filter steps over whole pieces by their elements; what later
    readings say of a piece's last state comes back the same way, so pieces solved apart are the source solved at once.
    """
    begin, length, group = _groups(p, KEYS[:2])
    fact = {c: p[c].to_numpy(dtype=float) for c in FACTS}
    n, c0, m2 = fact["n"], fact["c0"], fact["m2"]
    el = p[_columns()[len(FACTS) :]].to_numpy(dtype=float).reshape(len(p), len(HORIZONS), len(ELEMENT))
    period = p["period"].to_numpy(dtype=float)
    slots = p["slots"].to_numpy(dtype=bool)
    # Whole sources' sums; differences over the edges of pieces join those within.
    per = lambda x: np.bincount(group, x, len(begin))
    count = per(n)
    mean = per(n * c0) / np.maximum(count, 1)
    var = per(m2 + n * (c0 - mean[group]) ** 2) / np.maximum(count, 1)
    full = np.flatnonzero(n > 0)
    edge = full[1:][group[full[1:]] == group[full[:-1]]]
    before = full[:-1][group[full[1:]] == group[full[:-1]]]
    d2 = per(fact["d2"]) + np.bincount(group[edge], (fact["z_first"][edge] - fact["z_last"][before]) ** 2, len(begin))
    r = _noise(mean, var, d2, count - 1)
    sigma = np.sqrt(r)
    state = np.full((len(p), STATE), np.nan)
    h3 = np.asarray(HORIZONS)
    wanted = np.flatnonzero((np.bincount(group, slots, len(begin)) > 0) & (count > 0))
    for some, idx, inside in _blocks(begin, length, wanted, CELLS // 20):
        k = len(some)
        # In the source's own measure: from its mean, in units of its noise.
        w = np.broadcast_to(3 / h3**3, (k, len(h3)))
        x = (np.zeros((k, len(h3))), np.zeros((k, len(h3))))
        v = (np.repeat(np.maximum(var[some] / r[some], 1.0)[:, None], len(h3), 1), np.zeros((k, len(h3))), w * h3)
        ll = np.zeros((k, len(h3)))
        m = idx.shape[1]
        starts, ends = np.empty((m, 5, k, len(h3))), np.empty((m, 5, k, len(h3)))

        def measured(row, some=some):
            e = np.moveaxis(el[row], -1, 0)
            s, d = sigma[some][:, None], ((c0[row] - mean[some]) / sigma[some] * (n[row] > 0))[:, None]
            a, c, j = tuple(e[:4]), tuple(e[6:9]), tuple(e[9:12])
            y = (e[12] / s, e[13] / s)
            b = (e[4] / s + d - a[0] * d, e[5] / s - a[2] * d)
            return a, b, c, j, (y[0] + j[0] * d, y[1] + j[1] * d), e[14] + e[15] / s**2 + d * d * j[0] + 2 * d * y[0]

        def gap(row, earlier, some=some):
            return ((fact["t_first"][row] - fact["t_last"][earlier]) / period[begin[some]])[:, None]

        for i in range(m):
            row, on = idx[:, i], inside[:, i][:, None]
            if i:
                x2, v2 = _moved(x, v, np.where(on, gap(row, idx[:, i - 1]), 0.0), w)
                x, v = tuple(np.where(on, q, o) for q, o in zip(x2, x)), tuple(np.where(on, q, o) for q, o in zip(v2, v))
            starts[i] = np.stack([*x, *v])
            a, b, c, j, e, const = measured(row)
            inverse, s, d = _meet(v, j)
            jx = _symmetric(j, x)
            q = (e[0] - jx[0], e[1] - jx[1])
            sq = _symmetric(s, q)
            ll += np.where(on, -0.5 * (const + np.log(d)) + x[0] * (e[0] - 0.5 * jx[0]) + x[1] * (e[1] - 0.5 * jx[1]) + 0.5 * (q[0] * sq[0] + q[1] * sq[1]), 0.0)
            ve = _symmetric(v, e)
            ax = _times(a, _times(inverse, (x[0] + ve[0], x[1] + ve[1])))
            av = _around(a, s)
            x = tuple(np.where(on, y + z, o) for y, z, o in zip(ax, b, x))
            v = tuple(np.where(on, y + z, o) for y, z, o in zip(av, c, v))
            ends[i] = np.stack([*x, *v])
        best = ll.argmax(1)
        pick = lambda y: tuple(z[np.arange(k), best] for z in y)
        wb = 3 / h3[best] ** 3
        j, e, later = (np.zeros(k),) * 3, (np.zeros(k),) * 2, np.full(k, np.inf)
        for i in range(m - 1, -1, -1):
            row, on = idx[:, i], inside[:, i]
            x0, x1, *v = pick(ends[i])
            inverse, s, _ = _meet(v, j)
            ve = _symmetric(v, e)
            last = (*_times(inverse, (x0 + ve[0], x1 + ve[1])), *s)
            values = np.stack([mean[some], sigma[some], h3[best], *pick(starts[i]), *last, later], axis=1)
            state[row[on]] = values[on]
            if not i:
                break
            a, b, c, own, mine, _ = measured(row)
            a, b, c, own, mine = map(pick, (a, b, c, own, mine))
            inverse, s, _ = _meet(j, c)
            jb = _symmetric(j, b)
            y = _times(inverse, (e[0] - jb[0], e[1] - jb[1]))
            back = (a[0], a[2], a[1], a[3])  # A'
            j2, e2 = tuple(p + q for p, q in zip(own, _around(back, s))), tuple(p + q for p, q in zip(mine, _times(back, y)))
            h = np.where(on, gap(row, idx[:, i - 1])[:, 0], 0.0)
            inverse, s, _ = _meet(j2, (wb * h**3 / 3, wb * h**2 / 2, wb * h))
            y = _times(inverse, e2)
            f = (np.ones(k), np.zeros(k), h, np.ones(k))
            j, e = tuple(np.where(on, q, o) for q, o in zip(_around(f, s), j)), tuple(np.where(on, q, o) for q, o in zip(_times(f, y), e))
            later = np.where(on & (n[row] > 0), fact["reading"][row], later)
    keep = slots & ~np.isnan(state[:, 0])
    out = p.loc[keep, [*KEYS, "period"]].reset_index(drop=True)
    out["t"] = fact["t_first"][keep].astype("int64")
    out["state"] = list(state[keep])
    return out


def _solve(p: pd.DataFrame) -> pd.DataFrame:
    """Rows of whole pieces, the state's first: grid places with filled value, deviation and missing flag."""
    begin, length, group = _groups(p, KEYS)
    t, slot, wid, code = (p[c].to_numpy() for c in ("t", "slot", "window_id", "code"))
    period = p["period"].to_numpy()
    grid, read = slot >= 0, slot == -1
    z = np.where(read, p["z"].to_numpy(dtype=float), np.nan)
    wanted = np.flatnonzero(grid)
    useful = np.unique(group[wanted])
    state = np.full((len(begin), STATE), np.nan)
    head = np.flatnonzero(slot == -2)
    if len(head):
        state[group[head]] = np.stack(p["state"].to_numpy()[head])
    # A step is empty when the next reading, in the piece or after it, comes a period or more after its start.
    since = t - t[begin[group]]
    axis = since + group * (int(since.max()) + 2)
    readings = np.flatnonzero(read)
    to = np.searchsorted(axis[readings], axis[wanted], "left")
    own = np.append(readings, -1)[to]
    here = (own >= 0) & (group[own] == group[wanted])
    missing = np.where(here, t[own], state[group[wanted], 13]) >= t[wanted] + period[wanted]
    level, dev = np.empty(len(p)), np.empty(len(p))
    for some, idx, inside in _blocks(begin, length, useful):
        s = state[some].T
        seen = inside & read[idx]
        zz = np.where(seen, (z[idx] - s[0][:, None]) / s[1][:, None], 0.0)
        dt = _steps(since[idx] / period[begin[some]][:, None].astype(float), length[some])
        f = _forward(dt, seen, zz, np.ones(len(some)), 3 / s[2] ** 3, (s[3], s[4]), (s[5], s[6], s[7]), True)
        lv, vr = _backward(dt, f, s[8:13])
        level[idx[inside]], dev[idx[inside]] = (s[0][:, None] + s[1][:, None] * lv)[inside], (s[1][:, None] * np.sqrt(vr))[inside]
    w = wanted
    return pd.DataFrame({"window_id": wid[w], "attribute": code[w], "slot": slot[w], "at_us": t[w], "missing": missing, "value": level[w], "sd": dev[w]})


def _whole(keys: list[str], work, rows: int = 50_000):
    """work on rows of whole groups, sorted by their keys; the last group of a batch waits for the rest of it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for b in batches:
            if not len(b):
                continue
            held.append(b)
            size += len(b)
            if size < rows:
                continue
            p = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            tail = np.all([(c := p[k].to_numpy()) == c[-1] for k in keys], axis=0)
            if not tail.all():
                yield work(p[~tail].reset_index(drop=True))
                p = p[tail].reset_index(drop=True)
            held, size = [p], len(p)
        if held:
            yield work(pd.concat(held, ignore_index=True))

    return run


def regular_grid(obs: DataFrame, windows: DataFrame, piece: int = 24 * HOUR, halo: int = 6 * HOUR) -> DataFrame:
    """Series of one step per period from each window's start: (window_id, attribute, slot, at_us, missing, value, sd).

    obs: subject_id, code, timestamp, num (a usable number), period_s. windows: window_id, subject_id, start, stop, half-open.
    One series for each valid window (both endpoints, start < stop, non-null subject) and attribute with a period of which the
    subject has a reading in the window; its steps are those that lie wholly in the window. missing: the step has no reading;
    value and sd: smoothed level at the step's start and its standard deviation, from all readings of the source.
    Equal rows of windows count once; readings with null timestamp, number or period are left out; empty tables give an
    empty one; extra columns are ignored.

    Sources (subject, attribute) are cut into pieces of the time axis, so that a hot source is spread over tasks. Each piece
    is summed up by what it says of its first and last state; a source's few sums give its noise, horizon and the states at
    the edges of its pieces, so the result is that of the whole source smoothed at once (smooth), whatever piece is. halo,
    once the reach of readings beyond a piece, has no effect.
    """
    need_columns(obs, ["subject_id", "code", "timestamp", "num", "period_s"], "readings")
    need_columns(windows, ["window_id", "subject_id", "start", "stop"], "windows")
    require(piece > 0 and halo >= 0, "piece must be positive, halo not negative")
    o = obs.select("subject_id", "code", numeric_axis(obs, "timestamp").cast("bigint").alias("t"), F.col("num").cast("double").alias("z"), (F.col("period_s").cast("bigint") * 1_000_000).alias("period"))
    o = materialise(o.where("t is not null and z is not null and period > 0 and subject_id is not null and code is not null"))  # read by all branches below
    w = windows.select("window_id", "subject_id", numeric_axis(windows, "start").cast("bigint").alias("s"), numeric_axis(windows, "stop").cast("bigint").alias("e")).where("s < e and subject_id is not null and window_id is not null").distinct()
    # Which attributes a window has: readings meet windows in cells of the axis, and pairs are reduced before they are sent.
    cell = lambda c: F.floor(c / F.lit(piece))
    spread = w.withColumn("c", F.explode(F.sequence(cell(F.col("s")), cell(F.col("e") - 1))))
    have = spread.join(o.withColumn("c", cell(F.col("t"))), ["subject_id", "c"]).where("t >= s and t < e")
    have = materialise(have.groupBy("window_id", "subject_id", "s", "e", "code").agg(F.first("period").alias("period")))  # read by both branches below
    steps = F.floor((F.col("e") - F.col("s")) / F.col("period")).cast("bigint")
    slots = have.withColumn("n", steps).where("n > 0").select("subject_id", "code", "window_id", "s", "period", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("slot"))
    slots = slots.withColumn("t", F.col("s") + F.col("slot") * F.col("period")).withColumn("piece", cell(F.col("t")))
    read = o.select("subject_id", "code", cell(F.col("t")).alias("piece"), "t", "period", "z", F.lit(0).cast("bigint").alias("window_id"), F.lit(-1).cast("bigint").alias("slot"))
    arranged = lambda d, keys, *then: d.repartition(*keys).sortWithinPartitions(*keys, *then)
    kinds = {f.name: f.dataType.simpleString() for f in read.schema}
    key = ", ".join(f"{k} {kinds[k]}" for k in (*KEYS, "period"))
    # Of the slots, only the first and the last of a piece bound it.
    bounds = slots.groupBy(*KEYS).agg(F.first("period").alias("period"), F.array(F.min("t"), F.max("t")).alias("ts")).select(*KEYS, F.explode("ts").alias("t"), "period", F.lit(None).cast("double").alias("z"), F.lit(0).cast("bigint").alias("slot"))
    sums = arranged(read.drop("window_id").unionByName(bounds), KEYS, "t", "slot", "z").mapInPandas(_whole(KEYS, _sum_up), f"{key}, slots boolean, " + ", ".join(f"{c} double" for c in _columns()))
    states = arranged(sums, KEYS[:2], "piece").mapInPandas(_whole(KEYS[:2], _carry), f"{key}, t bigint, state array<double>")
    states = states.withColumns({"z": F.lit(None).cast("double"), "window_id": F.lit(0).cast("bigint"), "slot": F.lit(-2).cast("bigint")})
    none = F.lit(None).cast("array<double>")
    cols = [*KEYS, "t", "period", "z", "window_id", "slot", "state"]
    both = slots.withColumns({"z": F.lit(None).cast("double"), "state": none}).select(*cols).unionByName(read.withColumn("state", none).select(*cols)).unionByName(states.select(*cols))
    return arranged(both, KEYS, "t", "slot", "z").mapInPandas(_whole(KEYS, _solve), OUT)
