"""Rows by position or key."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..common import as_list, fresh, need_columns, q, require, row_ids


#: Positions and keys beyond this many are joined as a table instead of listed in the plan.
LISTED = 1000


def _rows(df: DataFrame, rows, pos: str) -> tuple[DataFrame, Column]:
    """The table and a condition on its positions: a slice, a mask, a list of positions, or one position (negative ones count from the end)."""
    n = None

    def size() -> int:
        nonlocal n
        n = df.count() if n is None else n
        return n

    if isinstance(rows, slice):
        if any(x is not None and x < 0 for x in (rows.start, rows.stop)) or (rows.step or 1) < 0:
            lo, hi, step = rows.indices(size())
        else:
            lo, hi, step = rows.start or 0, rows.stop, rows.step or 1
        if step < 0:
            return df, (q(pos) <= lo) & (q(pos) > hi) & ((F.lit(lo) - q(pos)) % -step == 0)
        cond = (q(pos) >= lo) & ((q(pos) - lo) % step == 0)
        return df, cond if hi is None else cond & (q(pos) < hi)
    if hasattr(rows, "tolist"):
        rows = rows.tolist()
    if isinstance(rows, int) and not isinstance(rows, bool):
        rows = [rows]
    rows = list(rows)
    if rows and all(isinstance(x, bool) for x in rows):
        if len(rows) != size():
            raise IndexError(f"mask of length {len(rows)} for {size()} rows")
        rows = [i for i, x in enumerate(rows) if x]
    if any(x < 0 for x in rows):
        rows = [x + size() if x < 0 else x for x in rows]
    if len(rows) <= LISTED:
        return df, q(pos).isin(*rows) if rows else F.lit(False)
    at, hit = fresh(df, "__wanted", "__hit")
    wanted = df.sparkSession.createDataFrame(pd.DataFrame({at: sorted(set(rows))})).withColumn(hit, F.lit(True))
    return df.join(wanted, q(pos) == q(at), "left").drop(at), q(hit).isNotNull()


def iloc_loc(df: DataFrame, rows, cols, order_by=None) -> DataFrame:
    """Rows by position in order_by, columns by name."""
    names = list(df.columns) if isinstance(cols, slice) and cols == slice(None) else as_list(cols)
    need_columns(df, names)
    (pos,) = fresh(df, "__pos")
    d = row_ids(df, pos, order_by)
    d, cond = _rows(d, rows, pos)
    return d.where(cond).select(*[q(c) for c in names])


def iloc_loc_assign(df: DataFrame, rows, cols, value, order_by=None) -> DataFrame:
    """The table with value in the given rows (positions in order_by) and columns; a new table, as tables don't change."""
    names = list(df.columns) if isinstance(cols, slice) and cols == slice(None) else as_list(cols)
    need_columns(df, names)
    (pos,) = fresh(df, "__pos")
    d = row_ids(df, pos, order_by)
    d, cond = _rows(d, rows, pos)
    return d.withColumns({c: F.when(cond, F.lit(value).cast(df.schema[c].dataType)).otherwise(q(c)) for c in names}).select(*[q(c) for c in df.columns])


def get_loc(df: DataFrame, key_cols, target, order_by=None, allow_mask: bool = True, allow_slice: bool = True) -> DataFrame:
    """Positions (column position) of the rows with key `target` in order_by.

    target: a value, a tuple (of several key columns, perhaps only the first ones), a list of values or of tuples, a mask
    (IndexError if of another length) or a slice of values, both ends included. A missing key raises KeyError.
    """
    keys = as_list(key_cols)
    need_columns(df, keys)
    d = row_ids(df, "__pos", order_by)
    if isinstance(target, slice):
        require(allow_slice and len(keys) == 1, "slices need a single key column")
        cond = F.lit(True)
        if target.start is not None:
            cond = cond & (q(keys[0]) >= F.lit(target.start))
        if target.stop is not None:
            cond = cond & (q(keys[0]) <= F.lit(target.stop))
        return d.where(cond).select(F.col("__pos").alias("position"))
    if hasattr(target, "tolist"):
        target = target.tolist()
    if isinstance(target, list):
        if target and all(isinstance(x, bool) for x in target) and allow_mask:
            d, cond = _rows(d, target, "__pos")
            return d.where(cond).select(F.col("__pos").alias("position"))
        targets = [x if isinstance(x, tuple) else (x,) for x in target]
    else:
        targets = [target if isinstance(target, tuple) else (target,)]
    if any(len(t) > len(keys) for t in targets):
        raise KeyError(target)
    # One join for each number of key columns that is given, however many keys there are.
    found = None
    for k in sorted({len(t) for t in targets}):
        names = [f"t{i}" for i in range(k)]
        schema = T.StructType([T.StructField(n, df.schema[c].dataType) for n, c in zip(names, keys)])
        wanted = df.sparkSession.createDataFrame(list(dict.fromkeys(t for t in targets if len(t) == k)), schema)
        cond = F.lit(True)
        for c, n in zip(keys, names):
            cond = cond & q(c).eqNullSafe(F.col(n))
        missing = wanted.join(d, cond, "left_anti").first()
        if missing is not None:
            raise KeyError(tuple(missing) if k > 1 else missing[0])
        here = d.join(wanted, cond, "left_semi").select(F.col("__pos").alias("position"))
        found = here if found is None else found.unionByName(here).distinct()
    return d.limit(0).select(F.col("__pos").alias("position")) if found is None else found
