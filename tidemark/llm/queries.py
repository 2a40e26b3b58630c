"""Queries of this subpackage over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import checkpoint, materialise, table
from ..functions.values import readings
from ..plans.problems import READINGS
from .digest import percentiles, stated_error
from .leak import find_leaks
from .nearest import nearest_in_time
from .personal import find_personal, redact
from .tokens import encode_corpus

SECOND = 1_000_000
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return nearest_in_time(table(spark, d, "points"), table(spark, d, "observations"), "point_id", "obs_id", "subject_id", "subject_id", "point", "timestamp", 90 * SECOND)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("point_id", "obs_id")


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d)


def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of the usable numbers by attribute code ('attribute:...') and by subject of windows ('subject:...')."""
    numeric = table(spark, d, "attr_types").where("kind in ('double', 'int')")
    r = readings(table(spark, d, "observations"), numeric).where("num is not null").select("obs_id", "subject_id", "code", "timestamp", "num").distinct()
    subjects = table(spark, d, "windows").select("subject_id").where("subject_id is not null").distinct().withColumn("w", F.lit(True))
    r = materialise(r.select("subject_id", "code", "num").join(subjects, "subject_id", "left"))
    by = F.array_compact(F.array(F.concat(F.lit("attribute:"), "code"), F.when(F.col("w"), F.concat(F.lit("subject:"), F.col("subject_id").cast("string")))))
    return percentiles(r.select(F.explode(by).alias("grp"), "num"), "grp", "num")


def p5_within(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of values, and whether each estimate lies within the stated error of its rank."""
    return p5_percentiles(spark, d).select("grp", "n", "q", (F.col("rank_error") <= stated_error()).alias("within"))


def p8_ids(spark: SparkSession, d: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"), vocabulary)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return find_personal(table(spark, d, "documents"))


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return redact(docs, checkpoint(find_personal(docs)))


QUERIES = {"p3_found": p3_found, "p3_pairs": p3_pairs, "p5_percentiles": p5_percentiles, "p5_within": p5_within, "p8_ids": p8_ids, "p9_found": p9_found, "p10_found": p10_found, "p10_redacted": p10_redacted}

_P3 = f"""with r as (select subject_id, epoch_us(timestamp) t, min(obs_id) obs_id from observations where subject_id is not null and timestamp is not null and obs_id is not null group by 1, 2),
  p as (select distinct point_id, subject_id, epoch_us(point) t from points where subject_id is not null and point is not null and point_id is not null),
  j as (select point_id, obs_id, abs(p.t - r.t) d from p join r on p.subject_id = r.subject_id and r.t between p.t - {90 * SECOND} and p.t + {90 * SECOND})"""

ORACLES = {
    "p3_found": _P3 + " select point_id, min_by(obs_id, (d, obs_id)) as obs_id from j group by 1",
    "p5_within": f"""with {READINGS}, v as (select distinct obs_id, subject_id, code, timestamp, num from r where kind in ('double', 'int') and num is not null),
      g as (select 'attribute:' || code grp, num from v union all select 'subject:' || subject_id, num from v where subject_id in (select subject_id from windows)), c as (select grp, count(*) n from g group by 1)
      select grp, n, q, true as within from c, (select unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99])::double q)""",
    "p3_pairs": _P3 + " select point_id, min_by(obs_id, (d, obs_id)) as obs_id, min(d) as distance_us from j group by 1",
}
