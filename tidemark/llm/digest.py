"""Percentiles of very large numeric columns: merging centroid digests with certified rank error."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import checkpoint, fresh, materialise, need_columns, q, require, small

#: Centroids of a digest are at most about this many.
SIZE = 200
#: Digests that are merged further are so many times finer.
FINER = 4
#: Groups whose estimates (a few numbers each) may be broadcast to the values; with more, salted values and estimates meet by a shuffle.
GROUPS = 100_000
SALTS = 16


def _cluster(group: np.ndarray, mean: np.ndarray, weight: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cluster weighted values of many groups at once: (group, mean, weight) of the centroids.

    Values are sorted within groups; with q the quantile at a value's middle, values sharing a unit of
    k(q) = size (asin(2 q - 1) / pi + 1/2) join a centroid, so centroids are small at the ends and large in the middle. The
    first and the last value of a group stay alone: minimum and maximum are exact; infinities share no centroid with numbers.
    A mean lies within its values however it is rounded: the mean of equal values is that value.
    """
    o = np.lexsort((mean, group))
    group, mean, weight = group[o], mean[o], weight[o]
    new = np.ones(len(group), bool)
    new[1:] = group[1:] != group[:-1]
    begin = np.flatnonzero(new)
    g = np.cumsum(new) - 1
    total = np.add.reduceat(weight, begin)
    cum = np.cumsum(weight)
    before = cum - weight - (cum[begin] - weight[begin])[g]
    mid = (before + weight / 2) / total[g]
    k = np.floor(size * (np.arcsin(np.clip(2 * mid - 1, -1, 1)) / np.pi + 0.5)).astype(np.int64)
    cut = new.copy()
    with np.errstate(invalid="ignore"):
        cut[1:] |= (k[1:] != k[:-1]) | (np.isinf(mean[1:] - mean[:-1]) | np.isnan(mean[1:] - mean[:-1])) & (mean[1:] != mean[:-1])
    end = np.append(begin[1:], len(group)) - 1
    cut[np.minimum(begin + 1, len(group) - 1)] = True
    cut[end] = True
    at = np.flatnonzero(cut)
    w = np.add.reduceat(weight, at)
    with np.errstate(over="ignore", invalid="ignore"):
        m = np.add.reduceat(mean * weight, at) / w
    return group[at], np.fmin(np.fmax(m, mean[at]), mean[np.append(at[1:], len(group)) - 1]), w


#: Rows that a task clusters at once.
LEAF_ROWS = 200_000


def _leaf(size: float):
    bound = LEAF_ROWS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        names: dict = {}
        rows = 0

        def squeeze() -> pd.DataFrame:
            nonlocal held, names, rows
            group, mean, weight = _cluster(*(np.concatenate(x) for x in zip(*held)), size)
            back = np.array(list(names), dtype=object)
            held, names, rows = [], {}, 0
            return pd.DataFrame({"grp": back[group], "mean": mean, "weight": weight})

        for b in batches:
            codes, uniq = pd.factorize(b["grp"])
            ids = np.array([names.setdefault(u, len(names)) for u in uniq], dtype=np.int64)
            held.append((ids[codes], b["mean"].to_numpy(dtype=float), b["weight"].to_numpy(dtype=float)))
            rows += len(b)
            if rows > bound:  # each value is clustered once here, as the stated error has it, and memory stays bounded
                yield squeeze()
        if rows:
            yield squeeze()

    return run


def digests(df: DataFrame, group: str, value: str, size: int = SIZE) -> DataFrame:
    """Centroid digest of each group's values: (grp, mean, weight), several rows a group; combine them with merge_digests.

    Null and nan values and null groups are left out. Tasks cluster their own rows, so only centroids are sent on.
    """
    need_columns(df, [group, value])
    v = df.select(q(group).cast("string").alias("grp"), q(value).cast("double").alias("mean"), F.lit(1.0).alias("weight")).where("grp is not null and mean is not null and not isnan(mean)")
    return v.mapInPandas(_leaf(size), "grp string, mean double, weight double")


def merge_digests(parts: Sequence[DataFrame], size: int = SIZE, salts: int = SALTS) -> DataFrame:
    """Merge digests of any number of loads or tasks by re-clustering: (grp, mean, weight), about size centroids a group.

    Two levels: centroids are first merged in salted parts of a group, FINER times finer, then the parts' centroids in the
    group, each by sorted clustering in window functions, so a group with very many digests is spread over tasks.
    """
    require(len(parts) > 0, "merge_digests needs a digest")
    d = parts[0]
    for p in parts[1:]:
        d = d.unionByName(p)
    d = d.withColumn("salt", F.pmod(F.xxhash64("mean", "weight"), F.lit(salts)))
    level = _recluster(d, ["grp", "salt"], size * FINER)
    return _recluster(level, ["grp"], size).select("grp", "mean", "weight")


def _between(v: Column, low: Column, high: Column) -> Column:
    """v, which rounding may have carried past its bounds, within them."""
    return F.least(F.greatest(v, low), high)


def _recluster(d: DataFrame, keys: list[str], size: int) -> DataFrame:
    w = Window.partitionBy(*keys)
    o = w.orderBy("mean", "weight").rowsBetween(Window.unboundedPreceding, 0)
    x = d.withColumns({"cum": F.sum("weight").over(o), "total": F.sum("weight").over(w), "rn": F.row_number().over(w.orderBy("mean", "weight")), "of": F.count(F.lit(1)).over(w)})
    mid = (F.col("cum") - F.col("weight") / 2) / F.col("total")
    k = F.floor(F.lit(float(size)) * (F.asin(F.least(F.greatest(2 * mid - 1, F.lit(-1.0)), F.lit(1.0))) / F.lit(np.pi) + 0.5))
    k = F.when(F.col("rn") == 1, F.lit(-1)).when(F.col("rn") == F.col("of"), F.lit(size + 2)).when(F.col("mean") == float("-inf"), -2).when(F.col("mean") == float("inf"), size + 3).otherwise(k)
    return x.groupBy(*keys, k.alias("k")).agg(_between(F.sum(F.col("mean") * F.col("weight")) / F.sum("weight"), F.min("mean"), F.max("mean")).alias("mean"), F.sum("weight").alias("weight")).drop("k")


def estimate(digest: DataFrame, quantiles: Sequence[float], between: bool = True) -> DataFrame:
    """(grp, q, value): each quantile by linear interpolation between the middles of centroids; ends are the exact minimum and maximum.

    between=False gives the mean of the centroid that holds the place: coarser, but never beyond that centroid.
    """
    w = Window.partitionBy("grp").orderBy("mean", "weight")
    x = digest.withColumns({"cum": F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("weight").over(Window.partitionBy("grp"))})
    x = x.withColumn("mid", F.col("cum") - F.col("weight") / 2)
    x = x.withColumns({"mid2": F.lead("mid").over(w), "mean2": F.lead("mean").over(w), "mid0": F.lag("mid").over(w)})
    x = x.withColumn("q", F.explode(F.array(*[F.lit(float(v)) for v in quantiles])))
    t = F.col("q") * F.col("n")
    if not between:
        holds = (F.col("cum") - F.col("weight") <= t) & ((t < F.col("cum")) | F.col("mid2").isNull())
        return x.where(holds).select("grp", "q", F.col("mean").alias("value"))
    here = ((F.col("mid") <= t) & (F.col("mid2").isNull() | (t < F.col("mid2")))) | (F.col("mid0").isNull() & (t < F.col("mid")))
    infinite = (F.abs("mean") == float("inf")) | (F.abs("mean2") == float("inf"))
    v = F.when(F.col("mid2").isNull() | (t <= F.col("mid")), F.col("mean")).when(infinite, F.when(t <= F.col("mid") + F.col("weight") / 2, F.col("mean")).otherwise(F.col("mean2"))).otherwise(_between(F.col("mean") + (F.col("mean2") - F.col("mean")) * (t - F.col("mid")) / (F.col("mid2") - F.col("mid")), F.col("mean"), F.col("mean2")))
    return x.where(here).select("grp", "q", v.alias("value"))


def certify(df: DataFrame, group: str, value: str, est: DataFrame, quantiles: Sequence[float]) -> DataFrame:
    """Second counting pass over all values: (grp, n, q, value, rank_low, rank_high, rank_error).

    rank_low and rank_high are the shares of values below, and at or below, the estimate; rank_error is how far q lies outside
    that range (0 if inside): the certified error of the estimate, whatever the digest did. Counts are combined map-side.
    Estimates of at most GROUPS groups are broadcast, so values aren't sent at all; beyond that values are salted, so that a
    group's values are spread over tasks.
    """
    k = range(len(quantiles))
    at = est.groupBy("grp").agg(*[F.max(F.when(F.col("q") == float(v), F.col("value"))).alias(f"e{i}") for i, v in enumerate(quantiles)])
    at = checkpoint(at)
    v = df.select(q(group).cast("string").alias("grp"), q(value).cast("double").alias("v")).where("grp is not null and v is not null and not isnan(v)")
    on = ["grp"]
    if at.count() <= GROUPS:
        at = F.broadcast(at)
    else:
        v, at = v.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))), at.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        on = ["grp", "salt"]
    counts = [F.count(F.when(F.col("v") < F.col(f"e{i}"), 1)).alias(f"b{i}") for i in k] + [F.count(F.when(F.col("v") <= F.col(f"e{i}"), 1)).alias(f"a{i}") for i in k]
    c = v.join(at, on).groupBy("grp").agg(F.count(F.lit(1)).alias("n"), *[F.max(f"e{i}").alias(f"e{i}") for i in k], *counts)
    each = F.array(*[F.struct(F.lit(float(p)).alias("q"), F.col(f"e{i}").alias("value"), (F.col(f"b{i}") / F.col("n")).alias("low"), (F.col(f"a{i}") / F.col("n")).alias("high")) for i, p in enumerate(quantiles)])
    x = c.select("grp", "n", F.explode(each).alias("x")).select("grp", "n", "x.*")
    return x.select("grp", "n", "q", "value", F.col("low").alias("rank_low"), F.col("high").alias("rank_high"), F.greatest(F.col("low") - F.col("q"), F.col("q") - F.col("high"), F.lit(0.0)).alias("rank_error"))


def percentiles(df: DataFrame, group: str, value: str, quantiles: Sequence[float] = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99), size: int = SIZE) -> DataFrame:
    """Certified percentiles of each group: (grp, n, q, value, rank_low, rank_high, rank_error).

    The stated error is pi / size + 1 / n of the ranks (1.6 % at 200, and one value). With u = pi / size: values in a cell of a
    clustering of size s span at most pi / (2 s) of the ranks between the middles of its first and its last part, so a
    centroid of several parts holds at most twice that, and a place is wrong by its weight less its first or its last part.
    Values are clustered three times. In a task, FINER = 4 times finer and with parts of one value, a place moves by up to
    u / 8; in a salted part of a group, as fine but with larger parts, by up to 2 u / 8. At last a centroid holds the place: its cell
    spans u / 2, and half a part's weight, at most u / 8, comes to it. That is u in all, for the mean of the centroid that holds the place.
    Interpolation is closer nearly always, but between two peaks or many equal values it may pass most of the next centroid.
    Therefore the errors found by counting (rank_error) decide: groups in which one is beyond the stated error get all
    their estimates from the centroids that hold the places, by a second pass over those groups' values only. Should an error
    exceed the stated one even then, the query fails instead of giving a wrong certificate. Null and nan values and null groups are
    left out, infinities are not (they have centroids of their own); groups without values have no row.
    """
    require(all(0 <= v <= 1 for v in quantiles), "quantiles lie in 0..1")

    def certified(values: DataFrame, between: bool) -> DataFrame:
        est = estimate(merge_digests([digests(values, group, value, size * FINER)], size), quantiles, between)
        return materialise(certify(values, group, value, est, quantiles))

    c = certified(df, True)
    (name,) = fresh(df, "__grp")
    worse = c.where(F.col("rank_error") > stated_error(size)).select(F.col("grp").alias(name)).distinct()
    if not worse.isEmpty():
        worse = small(checkpoint(worse))
        again = certified(df.join(worse, q(group).cast("string") == q(name), "left_semi"), False)
        c = c.join(worse, F.col("grp") == q(name), "left_anti").unionByName(again)
    broken = F.raise_error(F.concat(F.lit("rank error beyond the stated one in group "), "grp")).cast("double")
    return c.withColumn("rank_error", F.when(F.col("rank_error") <= stated_error(size), F.col("rank_error")).otherwise(broken))


def stated_error(size: int = SIZE) -> Column:
    """Bound of the rank error of a group of n values."""
    return F.lit(np.pi / size) + 1 / F.col("n")
