"""Held-out accuracy on the test tables, against plain ways: an attribute's mean, the last known value.

A copied value carries its own noise, so matching can't beat means by much; it has to beat copying the last value.
"""

import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.common import micros, table
from tidemark.operators.donors import fill_from_donors
from tidemark.operators.grid import regular_grid
from tidemark.plans.problems import typed_readings

DIR = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def usable(spark):
    r = typed_readings(spark, DIR).where("num is not null and kind = 'double' and timestamp is not null and period_s is not null")
    return r.dropDuplicates(["obs_id"]).withColumn("timestamp_us", micros(F.col("timestamp"))).withColumn("held", F.col("obs_id") % 10 == 3).cache()


def errors(df, guess, truth):
    """Mean absolute error of each attribute, in its spread; averaged over attributes."""
    r = df.groupBy("code").agg(F.avg(F.abs(F.col(guess) - F.col(truth))).alias("e"), F.stddev(truth).alias("s"), F.count(F.lit(1)).alias("n")).where("n > 50 and s > 0").collect()
    assert len(r) >= 3
    return sum(x.e / x.s for x in r) / len(r)


def test_filled_values(usable):
    masked = usable.withColumn("usable", ~F.col("held")).withColumn("truth", F.col("num")).withColumn("num", F.when(~F.col("held"), F.col("num")))
    filled = fill_from_donors(masked).select("obs_id", F.col("num").alias("guess"), "donor_id")
    means = usable.where("not held").groupBy("code").agg(F.avg("num").alias("mean"))
    before = masked.select("obs_id", F.last("num", True).over(Window.partitionBy("subject_id", "code").orderBy("timestamp_us")).alias("last"))
    both = filled.join(masked.where("held").select("obs_id", "code", "truth"), "obs_id").join(means, "code").join(before.where("last is not null"), "obs_id")
    assert both.count() > 200 and both.where("donor_id = obs_id").count() == 0
    guess = errors(both, "guess", "truth")
    assert guess < errors(both, "mean", "truth") and guess < errors(both, "last", "truth")


def test_smoothed_values(spark, usable):
    grid = regular_grid(usable.where("not held"), table(spark, DIR, "windows")).where("missing")
    w = table(spark, DIR, "windows").select("window_id", "subject_id").distinct()
    held = usable.where("held").select("subject_id", "code", "timestamp_us", F.col("num").alias("truth"), "period_s")
    near = grid.join(w, "window_id").withColumnRenamed("attribute", "code").join(held, ["subject_id", "code"]).where("timestamp_us >= at_us and timestamp_us < at_us + period_s * 1000000L and value is not null")
    means = usable.where("not held").groupBy("code").agg(F.avg("num").alias("mean"))
    both = near.join(means, "code")
    assert both.count() > 200
    assert errors(both, "value", "truth") < 0.85 * errors(both, "mean", "truth")
    # A held-out reading lies around the level with the level's uncertainty and its own noise, which neighbours' differences tell.
    by = Window.partitionBy("subject_id", "code").orderBy("timestamp_us")
    noise = usable.where("not held").withColumn("d", F.col("num") - F.lag("num").over(by)).groupBy("subject_id", "code").agg((F.avg(F.col("d") ** 2) / 2).alias("r"), F.count("d").alias("n")).where("n >= 20")
    within = both.join(noise, ["subject_id", "code"]).select((F.abs(F.col("value") - F.col("truth")) <= 2 * F.sqrt(F.col("sd") ** 2 + F.col("r"))).cast("int").alias("x")).agg(F.avg("x"), F.count("x")).first()
    assert within[1] > 100 and 0.9 < within[0] < 0.99, within  # 95 % of normal readings lie within two deviations
