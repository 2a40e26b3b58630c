"""Matching records by nearest time: expanding-ring joins on doubled buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import checkpoint, need_columns, numeric_axis, q, require


def nearest_in_time(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_entity: str, right_entity: str, left_time: str, right_time: str, tolerance: int, rings: int = 4) -> DataFrame:
    """Each left record with the right record of the same entity nearest in time: (left_id, right_id, distance_us).

    Pairs lie at most tolerance (inclusive, microseconds) apart, before or after; among equally near ones the smallest
    right_id is taken. Left records without a near enough partner have no row; records with null id, entity or time are left
    out; equal rows count once (a left id that occurs with several times or entities gets a row for its nearest pair);
    empty tables give an empty one; extra columns are ignored, whatever their names.

    Method: ring k has buckets of width tolerance / 2^(rings - 1 - k). A left record meets the right records of its own and
    the two adjacent buckets, which hold everything within one width; a nearest partner at most that far away is provably the
    nearest and is accepted, other left records go on to buckets of double width. The best partner is kept map-side.
    Right records without any left record in the widest buckets are dropped first, so they are sent once.
    """
    require(tolerance > 0 and rings >= 1, "tolerance and rings must be positive")
    need_columns(left, [left_id, left_entity, left_time], "left")
    need_columns(right, [right_id, right_entity, right_time], "right")
    l = left.select(q(left_id).alias("lid"), q(left_entity).alias("k"), numeric_axis(left, left_time).cast("bigint").alias("lt")).where("lid is not null and k is not null and lt is not null")
    r = right.select(q(right_id).alias("rid"), q(right_entity).alias("k"), numeric_axis(right, right_time).cast("bigint").alias("t")).where("rid is not null and k is not null and t is not null")
    bucket = lambda c, w: F.floor(c / F.lit(w)).cast("bigint")
    around = lambda c, w: F.explode(F.array(*[bucket(F.col(c), w) + d for d in (-1, 0, 1)]))
    cells = l.select("k", around("lt", tolerance).alias("b")).distinct()
    r = checkpoint(r.withColumn("b", bucket(F.col("t"), tolerance)).join(cells, ["k", "b"], "left_semi").drop("b"))
    found, open_ = None, l
    for ring in range(rings):
        width = -(-tolerance // (1 << (rings - 1 - ring)))
        last = ring == rings - 1
        probes = open_.select("lid", "k", "lt", around("lt", width).alias("b"))
        near = r.withColumn("b", bucket(F.col("t"), width)).join(probes, ["k", "b"])
        gap = F.abs(F.col("t") - F.col("lt"))
        best = near.where(gap <= F.lit(min(width, tolerance))).groupBy("lid", "k", "lt").agg(F.min(F.struct(gap.alias("d"), "rid")).alias("m"))
        best = checkpoint(best.select("lid", "k", "lt", "m.rid", "m.d"))
        found = best if found is None else found.unionByName(best)
        if last:
            break
        open_ = open_.join(best.select("lid", "k", "lt"), ["lid", "k", "lt"], "left_anti")
    one = found.groupBy("lid").agg(F.min(F.struct("d", "rid")).alias("m"))
    return one.select(F.col("lid").alias(left_id), F.col("m.rid").alias(right_id), F.col("m.d").alias("distance_us"))
