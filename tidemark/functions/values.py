"""Reading typed values out of text as entered, as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import q, small

# Spellings that merely say that there is no value (without case, spaces and punctuation).
ABSENT = ("", "na", "nan", "none", "null", "nil", "missing", "unknown", "notdone", "notavailable", "notrecorded")
# Spellings of yes and no.
YES = ("yes", "y", "true", "t", "1")
NO = ("no", "n", "false", "f", "0")
# Other spellings of a unit (without case and spaces).
UNIT_SPELLINGS = {
    "°c": ("c", "degc", "celsius", "ºc", "℃"),
    "bpm": ("/min", "1/min", "beats/min"),
    "/min": ("1/min", "bpm"),
    "mmhg": ("mmhg",),
    "%": ("percent", "pct"),
}
#: White space of any script; Java's \s has only ASCII's.
BLANK = r"[\s\u00A0\u1680\u2000-\u200B\u2028\u2029\u202F\u205F\u3000\uFEFF]"
NUMBER = r"^([+-]?(?:\d+(?:[.,]\d*)?|[.,]\d+)(?:[eE][+-]?\d+)?)"


def letters(c: Column) -> Column:
    """Text without case, spaces and punctuation."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def attribute_keys(types: DataFrame) -> DataFrame:
    """(key, code, kind, low, high, period_s, units, levels): one row for each spelling (code or label) of an attribute.

    Where two attributes share a spelling, codes go before labels, then the smaller code.
    """
    unit = F.lower(F.regexp_replace(F.coalesce("unit", F.lit("")), BLANK, ""))
    spell = F.create_map(*[x for k, v in UNIT_SPELLINGS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    units = F.array_union(F.array(unit), F.coalesce(F.try_element_at(spell, unit), F.array().cast("array<string>")))
    levels = F.transform(F.split(F.coalesce("levels", F.lit("")), r"\|"), letters)
    t = types.select(F.col("attribute").alias("code"), "label", "kind", "low", "high", "period_s", units.alias("units"), levels.alias("levels"))
    both = t.select(F.explode(F.array(F.struct(letters("code").alias("key"), F.lit(0).alias("p")), F.struct(letters("label").alias("key"), F.lit(1).alias("p")))).alias("k"), "*")
    rest = ["code", "kind", "low", "high", "period_s", "units", "levels"]
    best = both.where("k.key is not null and k.key <> '' and code is not null").groupBy(F.col("k.key").alias("key")).agg(F.min(F.struct(F.col("k.p"), *rest)).alias("m"))
    return best.select("key", *[F.col(f"m.{c}").alias(c) for c in rest])


#: Columns that readings get; columns of the input with these names (in any case) make room for them.
ADDED = ("code", "kind", "low", "high", "period_s", "units", "levels", "num", "txt", "tm", "usable", "__key", "__t", "__n", "__v")


def recognised(obs: DataFrame, types: DataFrame, attribute: str = "attribute") -> DataFrame:
    """Rows of obs whose attribute is the code or label of a type, with that type's columns.

    Columns of obs that are named like an added one (ADDED) are left out. Rows with a null or unknown attribute have no row.
    """
    keys = attribute_keys(types)
    obs = obs.select(*[q(c) for c in obs.columns if c == attribute or c.lower() not in ADDED])
    return obs.withColumn("__key", letters(F.col(attribute))).join(small(keys.withColumnRenamed("key", "__key")), "__key").drop("__key")


def number(text: Column, units: Column) -> Column:
    """Number that a text holds, with decimal point or comma, sign, exponent and one of the units; else null."""
    head = F.regexp_extract(text, NUMBER, 1)
    rest = F.substring(text, F.length(head) + 1, F.length(text))
    ok = (head != "") & ((rest == "") | F.array_contains(units, F.lower(F.regexp_replace(rest, BLANK, ""))))
    return F.when(ok, F.replace(head, F.lit(","), F.lit(".")).try_cast("double"))


def moment(text: Column) -> Column:
    """Timestamp that a text holds (year first, or day first if dotted, or digits only); null if it isn't in the calendar."""
    t = F.regexp_replace(text, r"^(\d{1,2})\.(\d{1,2})\.(\d{4})(?=\D|$)", "$3-$2-$1")
    t = F.regexp_replace(t, r"^(\d{4})/(\d{1,2})/(\d{1,2})(?=\D|$)", "$1-$2-$3")
    t = F.regexp_replace(t, r"^(\d{4})(\d\d)(\d\d)(?=\D|$)", "$1-$2-$3")
    t = F.regexp_replace(t, r"^(\S+)[T ]+(\d{1,2}):?(\d\d)(?::?(\d\d))?(\.\d+)?Z?$", "$1 $2:$3:0$4$5")
    t = F.regexp_replace(t, r":0(\d\d)(\.\d+)?$", ":$1$2")
    t = F.regexp_replace(t, r":0$", ":00")
    return F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}( \d{1,2}:\d\d:\d\d(\.\d{1,9})?)?$"), t.try_cast("timestamp_ntz"))


def with_value(df: DataFrame, value: str = "value") -> DataFrame:
    """Append num (double; of double, int and bool), txt (of category and string), tm (timestamp) and usable.

    Takes the columns of recognised(). A null or blank value is never usable.
    """
    text = stripped(F.col(value))
    df = df.withColumn("__t", text)
    t, kind = F.col("__t"), F.col("kind")
    n = number(t, F.col("units"))
    df = df.withColumn("__n", F.when(kind.isin("double", "int"), n).when((kind == "bool") & F.lower(t).isin(*YES), 1.0).when((kind == "bool") & F.lower(t).isin(*NO), 0.0))
    n = F.col("__n")
    inside = (F.col("low").isNull() | F.isnan("low") | (n >= F.col("low"))) & (F.col("high").isNull() | F.isnan("high") | (n <= F.col("high"))) & ~F.isnan(n)
    num = F.when((kind == "bool") | (inside & ((kind == "double") | (n == F.floor(n)))), n)
    plain = letters(t)
    txt = F.when((kind == "category") & (plain != "") & F.array_contains("levels", plain), plain).when((kind == "string") & ~plain.isin(*ABSENT), t)
    tm = F.when(kind == "timestamp", moment(t))
    # One generated struct a row: filters on it stay above it, so the text is read once, however often its values are used.
    df = df.select("*", F.explode(F.array(F.struct(num.alias("num"), txt.alias("txt"), tm.alias("tm")))).alias("__v")).drop("__t", "__n")
    df = df.withColumns({c: F.col("__v")[c] for c in ("num", "txt", "tm")}).drop("__v")
    return df.withColumn("usable", F.col("num").isNotNull() | F.col("txt").isNotNull() | F.col("tm").isNotNull())


def readings(obs: DataFrame, types: DataFrame, usable: bool | None = True) -> DataFrame:
    """Recognised readings with subject and typed value; usable: only those with (True) or all (None)."""
    r = with_value(recognised(obs.where(F.col("subject_id").isNotNull()), types))
    return r.where("usable") if usable else r
