"""Grouped modes, keys as integers, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..common import as_list, clean, fresh, need_columns, q, require, row_ids, running_offset


def grouped_mode(df: DataFrame, group_by, column: str | None = None, dropna: bool = True) -> DataFrame:
    """Most frequent value of each group and its count: group_by + [mode, count].

    Of equally frequent values the smallest is taken. dropna: missing values don't count (a group of missing values has a
    null mode of count 0); otherwise null is a value that loses ties. Groups with a missing key are left out.
    """
    require(column is not None, "column is needed")
    keys = as_list(group_by)
    need_columns(df, [*keys, column])
    v = clean(df, column)
    d = df.select(*[clean(df, k).alias(f"k{i}") for i, k in enumerate(keys)], v.alias("v"))
    for i in range(len(keys)):
        d = d.where(F.col(f"k{i}").isNotNull())
    ks = [f"k{i}" for i in range(len(keys))]
    n = d.groupBy(*ks, "v").agg(F.count(F.lit(1)).alias("n"))
    if dropna:
        n = n.withColumn("n", F.when(F.col("v").isNull(), F.lit(0)).otherwise(F.col("n")))
    # Largest count first, then the smallest value; a max over (count, inverted order) isn't possible for every type, so min.
    best = n.groupBy(*ks).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("v").isNull().alias("z"), F.col("v").alias("v"))).alias("b"))
    return best.select(*[F.col(k).alias(c) for k, c in zip(ks, keys)], F.col("b.v").alias("mode"), (-F.col("b.m")).cast("bigint").alias("count"))


def factorize(left: DataFrame, right: DataFrame | None = None, columns=None, right_columns=None, sort: bool = False, return_count: bool = False, name: str = "key", order_by=None, right_order_by=None):
    """Append an integer key that is equal for equal rows of columns, across both tables.

    sort=True numbers by the values' order (missing last), otherwise by first appearance in order_by, left before right.
    Missing values equal each other. Returns left, or (left, right), and with return_count also the number of keys.
    """
    lc = as_list(columns) or list(left.columns)
    rc = as_list(right_columns) or (lc if right is not None and all(c in right.columns for c in lc) else list(right.columns) if right is not None else [])
    require(right is None or len(lc) == len(rc), "as many left as right columns are needed")
    need_columns(left, lc, "left")
    if right is not None:
        need_columns(right, rc, "right")
    ks = [f"k{i}" for i in range(len(lc))]
    take = lambda d, cs: [clean(d, c).alias(k) for c, k in zip(cs, ks)]
    if sort:
        allk = left.select(*take(left, lc))
        if right is not None:
            allk = allk.unionByName(right.select(*take(right, rc)))
        distinct, order = allk.distinct(), ks
    else:
        p, s = "__at", "__side"
        lo = row_ids(left, p, order_by).select(*take(left, lc), F.lit(0).alias(s), p)
        if right is not None:
            lo = lo.unionByName(row_ids(right, p, right_order_by).select(*take(right, rc), F.lit(1).alias(s), p))
        distinct = lo.groupBy(*ks).agg(F.min(F.struct(s, p)).alias("o")).select(*ks, F.col(f"o.{s}").alias(s), F.col(f"o.{p}").alias(p))
        order = [s, p]
    numbered = running_offset(distinct.withColumn("__one", F.lit(1)), order, "__one", "__key").select(*ks, "__key")

    def attach(d: DataFrame, cs: list[str]) -> DataFrame:
        cond = F.lit(True)
        for c, k in zip(cs, ks):
            cond = cond & F.col(f"n.{k}").eqNullSafe(F.when(~F.isnan(F.col(f"d.`{c}`")), F.col(f"d.`{c}`")) if isinstance(d.schema[c].dataType, (T.DoubleType, T.FloatType)) else F.col(f"d.`{c}`"))
        return d.alias("d").join(numbered.alias("n"), cond).select("d.*", F.col("n.__key").cast("bigint").alias(name))

    out: list = [attach(left, lc)]
    if right is not None:
        out.append(attach(right, rc))
    if return_count:
        out.append(numbered.count())
    return out[0] if len(out) == 1 else tuple(out)


def partition_series(df: DataFrame, column: str, n: float, shuffle: bool = True, name: str = "bin", order_by=None, seed: int = 0) -> DataFrame:
    """Append bins so that the sum of each bin is at most n (an entry of n or more has a bin of its own): first fit in order.

    First fit is sequential by its nature: only the two numbers (position, size) of each row reach the one task that packs,
    in bounded batches; its state is a tree over the bins' rests, in which the first bin with room is found in about log2(bins)
    steps (a million rows take some 5 s). shuffle puts rows in a random but fixed order first.
    """
    need_columns(df, [column])
    pos, = fresh(df, "__pos")
    d = row_ids(df, pos, order_by)
    key = F.xxhash64(q(pos), F.lit(seed)) if shuffle else q(pos)
    total = d.agg(F.sum(column)).first()[0]
    if total is None or total <= n:
        return d.withColumn(name, F.lit(0).cast("bigint")).drop(pos)
    line = d.select(q(pos).alias("p"), key.alias("o"), q(column).cast("double").alias("v")).coalesce(1).sortWithinPartitions("o", "p")

    def pack(batches):
        import pandas as pd

        # A node holds the largest rest below it; bin k is leaf cap + k. Bins that are full, or not begun, hold nothing.
        none = -float("inf")
        cap, made = 1024, 0
        tree = [none] * (2 * cap)

        def put(k: int, rest: float) -> None:
            k += cap
            tree[k] = rest
            while k > 1:
                k //= 2
                most = max(tree[2 * k], tree[2 * k + 1])
                if tree[k] == most:
                    break
                tree[k] = most

        for b in batches:
            out = []
            for v in b["v"]:
                if v <= tree[1]:
                    k = 1
                    while k < cap:
                        k *= 2
                        if not v <= tree[k]:
                            k += 1
                    rest = tree[k] - v
                    k -= cap
                else:
                    k, rest = made, n - v
                    made += 1
                    if made > cap:
                        leaves = tree[cap:] + [none] * cap
                        cap *= 2
                        tree = [none] * cap + leaves
                        for j in range(cap - 1, 0, -1):
                            tree[j] = max(tree[2 * j], tree[2 * j + 1])
                out.append(k)
                put(k, rest if rest > 0 else none)
            yield pd.DataFrame({"p": b["p"], "bin": out})

    bins = line.mapInPandas(pack, "p bigint, bin bigint")
    return d.join(bins, q(pos) == F.col("p")).withColumn(name, F.col("bin")).drop(pos, "p", *(["bin"] if name != "bin" else []))
