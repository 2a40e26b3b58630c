"""Filling missing values from similar records: predictive mean matching with donor identifiers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import materialise, micros, need_columns, q, require, small

MINUTE = 60_000_000
DAY = 86_400_000_000
MONTH = 30 * DAY
#: Gaps between predictions count as equal within this part of an attribute's spread.
GRAIN = 1e-6
#: Strength of the pull of a source's level to its attribute's mean, and of a reading's own value to its source's line, in readings.
SHRINK = 5.0
#: A source's slope needs so many readings.
LEAST = 3


def _target(num: Column, txt: Column, tm_us: Column) -> Column:
    """What is predicted: the number; of texts a fixed hash in [0, 1); of times the days since 1970."""
    h = F.conv(F.substring(F.md5(txt.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return F.coalesce(num, F.when(txt.isNotNull(), h), tm_us / F.lit(float(DAY)))


def _angle(t: Column) -> Column:
    return F.pmod(t, F.lit(DAY)) * F.lit(2 * math.pi / DAY)


def fit(donors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Predictors from donors (s, code, t, y): of attributes (code, bs, bc, sd) and of sources (s, code, slope, base).

    An attribute's daily cycle is least squares over the deviations from the means of each source's months, sd its spread. A
    source has a level, shrunk to its attribute's mean, and a trend a day, damped like a ridge estimate; base + slope * days +
    cycle is the prediction. Readings are sent once, as four columns, to their source's month (which parts hot sources), where
    all sums are made; months' sums are few and are kept for both predictors.
    """
    angle, day, y = _angle(F.col("t")), F.col("t") / F.lit(float(DAY)), F.col("y")
    terms = {"y": y, "sn": F.sin(angle), "cs": F.cos(angle), "d": day}
    pairs = [("y", "y"), ("sn", "sn"), ("cs", "cs"), ("sn", "cs"), ("sn", "y"), ("cs", "y"), ("d", "d"), ("d", "y")]
    month = donors.withColumn("month", F.floor(F.col("t") / F.lit(MONTH)).cast("bigint")).repartition("s", "code", "month").groupBy("s", "code", "month")
    sums = materialise(month.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(k) for k, c in terms.items()], *[F.covar_pop(terms[i], terms[j]).alias(f"{i}_{j}") for i, j in pairs]))
    n = F.col("n")
    within = lambda c: F.sum(n * F.col(c))
    att = sums.groupBy("code").agg(within("sn_sn").alias("a"), within("cs_cs").alias("b"), within("sn_cs").alias("c"), within("sn_y").alias("p"), within("cs_y").alias("q"), (within("y_y") / F.sum(n)).alias("v"), (within("y") / F.sum(n)).alias("m"), F.sum(n).alias("n"))
    det = F.col("a") * F.col("b") - F.col("c") * F.col("c")
    ok = det > F.lit(1e-6) * n * n
    bs = F.when(ok, (F.col("p") * F.col("b") - F.col("q") * F.col("c")) / det).otherwise(0.0)
    bc = F.when(ok, (F.col("q") * F.col("a") - F.col("p") * F.col("c")) / det).otherwise(0.0)
    # A source's covariance is that within its months and that of their means.
    whole = lambda i, j: (within(f"{i}_{j}") + F.sum(n * F.col(i) * F.col(j)) - F.sum(n * F.col(i)) * F.sum(n * F.col(j)) / F.sum(n)) / F.sum(n)
    slope = F.when(F.sum(n) >= LEAST, whole("d", "y") / (F.greatest(whole("d", "d"), F.lit(0.0)) + 1.0)).otherwise(0.0)
    mean = lambda c: F.sum(n * F.col(c)) / F.sum(n)
    att = att.select("code", "m", bs.alias("bs"), bc.alias("bc"), F.sqrt("v").alias("sd"))
    src = sums.groupBy("s", "code").agg(F.sum(n).alias("n"), mean("y").alias("y"), mean("d").alias("d"), mean("sn").alias("sn"), mean("cs").alias("cs"), slope.alias("slope"))
    level = (n * F.col("y") + F.lit(SHRINK) * F.col("m")) / (n + F.lit(SHRINK))
    src = src.join(small(att), "code").select("s", "code", "slope", (level - F.col("slope") * F.col("d") - F.col("bs") * F.col("sn") - F.col("bc") * F.col("cs")).alias("base"))
    return att.drop("m"), src


def fill_from_donors(rows: DataFrame, within: int = 60 * MINUTE, id_col: str = "obs_id") -> DataFrame:
    """Filled readings: (obs_id, subject_id, attribute, donor_id, num, txt, tm, distance_us), one row per filled reading.

    rows: obs_id, subject_id, code, timestamp_us, usable, num, txt, tm. A reading that isn't usable is filled from the
    usable readings of the same subject and attribute at most `within` microseconds before or after (inclusive): the donor is
    the one whose prediction is nearest to the reading's own (gaps within GRAIN of the attribute's spread are equal), then the
    nearer in time, then the smaller id; its observed value and its id are copied. Readings without such a donor have no row.
    Rows with null subject, attribute or time are left out; a repeated row gives one filled row, and weighs twice in the fit;
    an empty table gives an empty one.

    Method: predictive mean matching. Predictors are fitted on all usable readings: an attribute's daily cycle, a source's
    level and trend; the prediction of a usable number or time also takes in the reading itself, as one reading against SHRINK.
    Predictors join the readings to fill, which are few; donors and these meet in cells of the time axis of width `within`
    (readings to fill in three cells), the exact range is checked, both predictions are made from the source's predictors, and
    the best donor is kept map-side before anything is sent. Cells bound what meets; a hot cell is split by the adaptive skew join.
    """
    need_columns(rows, [id_col, "subject_id", "code", "timestamp_us", "usable", "num", "txt", "tm"])
    require(within > 0, "within must be positive")
    whole = q(id_col).isNotNull() & F.col("subject_id").isNotNull() & F.col("code").isNotNull() & F.col("timestamp_us").isNotNull()
    base = materialise(rows.where(whole).select(q(id_col).alias("id"), F.col("subject_id").alias("s"), "code", F.col("timestamp_us").alias("t"), "usable", "num", "txt", "tm"))  # read by four branches below
    donors = base.where("usable").drop("usable")
    fitted = donors.select("s", "code", "t", _target(F.col("num"), F.col("txt"), micros(F.col("tm"))).alias("y"))
    att, src = fit(fitted)
    cell = lambda c: F.floor(c / F.lit(within)).cast("bigint")
    r = base.where("not usable").select(F.col("id").alias("rid"), "s", "code", F.col("t").alias("rt"))
    r = r.join(src, ["s", "code"]).join(small(att), "code")
    r = r.withColumn("cell", F.explode(F.array(*[cell(F.col("rt")) + k for k in (-1, 0, 1)])))
    m = r.join(donors.withColumn("cell", cell(F.col("t"))), ["s", "code", "cell"]).where(F.abs(F.col("t") - F.col("rt")) <= within)
    line = lambda t: F.col("base") + F.col("slope") * (t / F.lit(float(DAY))) + F.col("bs") * F.sin(_angle(t)) + F.col("bc") * F.cos(_angle(t))
    own = F.when(F.col("txt").isNotNull(), 0.0).otherwise((_target(F.col("num"), F.col("txt"), micros(F.col("tm"))) - line(F.col("t"))) / F.lit(1.0 + SHRINK))
    gap = F.abs(line(F.col("rt")) - line(F.col("t")) - own)
    grains = F.when(F.col("sd") > 0, F.round(gap / (F.col("sd") * GRAIN))).otherwise(0.0)
    best = F.struct(grains.alias("gap"), F.abs(F.col("t") - F.col("rt")).alias("dist"), F.col("id").alias("donor"), "num", "txt", "tm")
    out = m.groupBy("rid").agg(F.min(best).alias("b"), F.first("s").alias("subject_id"), F.first("code").alias("attribute"))
    return out.select(F.col("rid").alias(id_col), "subject_id", "attribute", F.col("b.donor").alias("donor_id"), F.col("b.num").alias("num"), F.col("b.txt").alias("txt"), F.col("b.tm").alias("tm"), F.col("b.dist").alias("distance_us"))
