"""Operators on rows in an order: neighbours, filling, shifts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..common import as_list, chunk_width, chunked, clean, fresh, from_micros, hot, is_time, micros, need_columns, pieces_of, q, require, row_ids, type_of

#: Rows of one piece where there is no key to spread a table by.
PIECE = 100_000


def _keys_of(df: DataFrame, group_by, rid: str) -> list[Column]:
    """Partition keys in which a row with a missing key stands alone."""
    keys = as_list(group_by)
    alone = F.lit(False)
    for k in keys:
        alone = alone | clean(df, k).isNull()
    return [*[clean(df, k) for k in keys], F.when(alone, q(rid))] if keys else []


def prev_next_values(df: DataFrame, sort_by=None, group_by=None, columns=None, first_indicator_name: str | None = None, last_indicator_name: str | None = None, keep_sorted: bool = False, inplace: bool = True, row_id: str | None = None) -> DataFrame:
    """Values of the previous and next row of each group in the order of sort_by (missing last; ties by row_id).

    columns: {column: {prev_name, prev_fill, next_name, next_fill}}, or names, which give <name>_prev and <name>_next. Missing
    values aren't skipped; fills stand at a group's first and last row. Unknown columns are passed over. A row with a missing
    key is a group of its own. inplace=False gives only the new columns (and row_id, if named). keep_sorted sorts the result.
    Without group_by the table is cut into pieces by position; if a key has more than HOT_ROWS rows, keys are cut into pieces of
    their first sort column, or by position if that is neither a number nor a time. So no task holds such a key.
    """
    sort, keys = as_list(sort_by), as_list(group_by)
    require(len(sort) > 0, "sort_by is needed")
    require(not set(sort) & set(keys), "sort_by and group_by overlap")
    need_columns(df, [*sort, *keys])
    spec = columns if isinstance(columns, dict) else {c: {"prev_name": f"{c}_prev", "next_name": f"{c}_next"} for c in as_list(columns)}
    spec = {c: s for c, s in spec.items() if c in df.columns}
    if not spec and not first_indicator_name and not last_indicator_name:
        return df if inplace else df.select(*as_list(row_id))
    rid = row_id
    original = df.columns
    axis = is_time(type_of(df, sort[0])) or isinstance(type_of(df, sort[0]), T.NumericType)
    if keys and rid is None:
        (rid,) = fresh(df, "__pos")
        df = row_ids(df, rid)
    part = _keys_of(df, keys, rid)
    whole = bool(keys) and not hot(df, part)
    if not whole and not (keys and axis):  # pieces by position
        (rid2,) = fresh(df, "__at")
        df = row_ids(df, rid2, [*[clean(df, c).asc_nulls_last() for c in sort], *([q(rid).asc_nulls_last()] if rid else [])])
        rid, part = rid2, _keys_of(df, keys, rid2)
    if whole:
        order = [*[clean(df, c).asc_nulls_last() for c in sort], q(rid)]
        w = Window.partitionBy(*part).orderBy(*order)
        lag, lead = (lambda c, i: F.lag(F.struct(c.alias("v"))).over(w)), (lambda c, i: F.lead(F.struct(c.alias("v"))).over(w))
        tidy = []
    else:
        # Pieces by position, or of the first sort column's axis for each key: edges of pieces are carried to their neighbours.
        names = fresh(df, "__piece", "__before", "__after", *[f"__k{i}" for i in range(len(part))])
        piece, before, after, ks = names[0], names[1], names[2], names[3:]
        df = df.withColumns(dict(zip(ks, part))) if ks else df
        if keys and axis:
            x = clean(df, sort[0]) if not is_time(type_of(df, sort[0])) else micros(q(sort[0]), type_of(df, sort[0]))
            df = df.withColumn(piece, F.coalesce(pieces_of(x, chunk_width(df.withColumn(piece, x), piece, type_of(df, sort[0]), [q(k) for k in ks])), F.lit(2**62 + 1)))
        else:
            df = df.withColumn(piece, F.floor(q(rid) / F.lit(PIECE)).cast("bigint"))
        place = [y for j, c in enumerate(sort) for y in (clean(df, c).isNull().alias(f"n{j}"), clean(df, c).alias(f"s{j}"))]
        vals = [F.struct(q(c).alias("v")).alias(f"c{i}") for i, c in enumerate(spec)]
        edge = F.struct(*place, q(rid).alias("p"), F.struct(F.lit(1).alias("v")).alias("c_"), *vals)
        df = chunked(df, ks, piece, [rid], {"__a": F.max(edge), "__b": F.min(edge)}, {before: ("last_before", "__a"), after: ("first_after", "__b")})
        w = Window.partitionBy(*ks, piece).orderBy(*[clean(df, c).asc_nulls_last() for c in sort], q(rid))
        tidy = [piece, before, after, *ks]
        lag = lambda c, i: F.coalesce(F.lag(F.struct(c.alias("v"))).over(w), q(before)[f"c{i}"])
        lead = lambda c, i: F.coalesce(F.lead(F.struct(c.alias("v"))).over(w), q(after)[f"c{i}"])
    new: dict[str, Column] = {}
    for i, (key, s) in enumerate(spec.items()):
        for how, move in (("prev", lag), ("next", lead)):
            if s.get(f"{how}_name"):
                row = move(q(key), i)
                fill = F.lit(s.get(f"{how}_fill")).cast(type_of(df, key))
                new[s[f"{how}_name"]] = F.when(row.isNull(), fill).otherwise(row["v"])
    if first_indicator_name:
        new[first_indicator_name] = lag(F.lit(1), "_").isNull()
    if last_indicator_name:
        new[last_indicator_name] = lead(F.lit(1), "_").isNull()
    res = df.withColumns(new)
    if keep_sorted:
        res = res.orderBy(*[q(k).asc_nulls_last() for k in keys], *[q(c).asc_nulls_last() for c in sort], q(rid))
    keep = original if inplace else as_list(row_id)
    return res.select(*[q(c) for c in keep if c not in new], *[q(c) for c in new]).drop(*[t for t in tidy if t not in original])


def impute(df: DataFrame, method: str = "ffill", group_by=None, limit: int | None = None, order_by=None, columns=None) -> DataFrame:
    """Fill missing values of each group in the order of order_by.

    ffill, bfill: last or next known value, at most `limit` rows away. afill: the mean of both, or the one there is. linear:
    on the line between both by row position, the first `limit` rows of a gap. lfill: linear, then ffill, then bfill. columns:
    all but the keys and order by default; those that aren't numbers or times only by ffill and bfill. Work grows with the rows
    of a key, not their square; tables without keys, and keys of more than HOT_ROWS rows, are scanned in pieces.
    """
    require(method in ("ffill", "bfill", "afill", "linear", "lfill"), f"unknown method: {method!r}")
    require(limit is None or limit > 0, "limit must be positive")
    order, keys = as_list(order_by), as_list(group_by)
    require(len(order) > 0, "order_by is needed: rows of a table have no order of their own")
    names = as_list(columns) if columns is not None else [c for c in df.columns if c not in keys and c not in order]
    need_columns(df, [*order, *keys, *names])
    plain = [c for c in names if isinstance(type_of(df, c), T.NumericType) or is_time(type_of(df, c))]
    if method in ("afill", "linear", "lfill"):
        require(columns is None or plain == names, f"only numbers and times have a mean or a line: {[c for c in names if c not in plain]}")
        names = plain
    if not names:
        return df
    ks = [clean(df, k) for k in keys]
    axis = is_time(type_of(df, order[0])) or isinstance(type_of(df, order[0]), T.NumericType)
    helper = fresh(df, "__piece", "__rn", "__base", "__at", *[f"__k{i}" for i in range(len(ks))], *[f"{e}{i}" for i in range(len(names)) for e in ("__p", "__n")])
    piece, rn, base, pos, kn, edges = *helper[:4], helper[4 : 4 + len(ks)], helper[4 + len(ks) :]
    d = df.withColumns(dict(zip(kn, ks))) if kn else df
    pieces = not keys or hot(df, ks)
    by = [c.asc_nulls_last() for c in [clean(d, order[0]), *[q(c) for c in order[1:]]]]
    if pieces:
        if axis:
            x = clean(d, order[0]) if not is_time(type_of(df, order[0])) else micros(q(order[0]), type_of(df, order[0]))
            cut = F.coalesce(pieces_of(x, chunk_width(d.withColumn(piece, x), piece, type_of(df, order[0]), [q(k) for k in kn])), F.lit(2**62 + 1))
        else:
            d = row_ids(d, pos, by)
            by, cut = [q(pos)], F.floor(q(pos) / F.lit(PIECE)).cast("bigint")
        d = chunked(d.withColumn(piece, cut), kn, piece, order, {"__c": F.count(F.lit(1))}, {base: ("sum_before", "__c")})
    else:
        d = d.withColumns({piece: F.lit(0), base: F.lit(0)})
    w = Window.partitionBy(*kn, piece).orderBy(*by)
    d = d.withColumn(rn, q(base) + F.row_number().over(w))
    # Rows' numbers leave no ties, so the reverse order is the same order read backwards.
    before, after = (Window.partitionBy(*kn, piece).orderBy(c).rowsBetween(Window.unboundedPreceding, 0) for c in (q(rn).asc(), q(rn).desc()))
    at = lambda c: F.when(clean(d, c).isNotNull(), F.struct(q(rn).alias("r"), clean(d, c).alias("v")))
    if pieces:
        known = {f"__m{k}{i}": f(at(c)) for i, c in enumerate(names) for k, f in (("x", F.max), ("n", F.min))}
        carry = {edges[2 * i + j]: (how, f"__m{k}{i}") for i in range(len(names)) for j, (how, k) in enumerate((("last_before", "x"), ("first_after", "n")))}
        d = chunked(d, kn, piece, order, known, carry)
    new: dict[str, Column] = {}
    for i, c in enumerate(names):
        t, v = type_of(df, c), clean(df, c)
        # The known values around each row, with their row numbers, within the piece or carried from other pieces.
        p, n = F.last(at(c), True).over(before), F.last(at(c), True).over(after)
        if pieces:
            p, n = F.coalesce(p, q(edges[2 * i])), F.coalesce(n, q(edges[2 * i + 1]))
        near = (lambda a, b: F.lit(True)) if limit is None else (lambda a, b: a - b <= limit)
        back, ahead = F.when(near(q(rn), p["r"]), p["v"]), F.when(near(n["r"], q(rn)), n["v"])
        if method in ("ffill", "bfill"):
            new[c] = back if method == "ffill" else ahead
            continue
        num = (lambda y, t=t: micros(y, t)) if is_time(t) else (lambda y: y.cast("double"))
        home = (lambda y, t=t: from_micros(F.round(y).cast("bigint"), t)) if is_time(t) else (lambda y: y)
        own = v if is_time(t) else v.cast("double")
        if method == "afill":
            b, f = num(F.coalesce(back, ahead)), num(F.coalesce(ahead, back))
            new[c] = F.when(v.isNotNull(), own).otherwise(home(b + (f - b) / 2))
            continue
        line = num(p["v"]) + (num(n["v"]) - num(p["v"])) * (q(rn) - p["r"]) / (n["r"] - p["r"])
        new[c] = F.when(v.isNotNull(), own).when(near(q(rn), p["r"]), home(line))
    res = d.withColumns(new).select(*[q(c) for c in df.columns])
    if method == "lfill":
        for m in ("ffill", "bfill"):
            res = impute(res, m, keys, limit, order, names)
    return res


def shift_compare(column: Column, shift: int, cmp: Callable[[Column, Column], Column], window, other: Column | None = None, fill_value: bool = False) -> Column:
    """cmp(value, other's value `shift` rows ahead) in a window's order (behind if negative); fill_value where there is no such row."""
    o = column if other is None else other
    row = F.lead(F.struct(o.alias("v")), shift).over(window) if shift >= 0 else F.lag(F.struct(o.alias("v")), -shift).over(window)
    return F.when(row.isNull(), F.lit(fill_value)).otherwise(F.coalesce(cmp(column, row["v"]), F.lit(False)))


def shift_equal(column: Column, shift: int, window, other: Column | None = None, fill_value: bool = False) -> Column:
    return shift_compare(column, shift, lambda a, b: a == b, window, other, fill_value)


def shift_unequal(column: Column, shift: int, window, other: Column | None = None, fill_value: bool = True) -> Column:
    """Missing values differ from everything, themselves included."""
    return shift_compare(column, shift, lambda a, b: F.coalesce(a != b, F.lit(True)), window, other, fill_value)


def roll1d(df: DataFrame, column: str, shift: int, order_by, name: str, group_by=None) -> DataFrame:
    """Append the column moved `shift` rows on in the order, the last rows' values coming round to the first."""
    keys, order = as_list(group_by), as_list(order_by)
    require(len(order) > 0, "order_by is needed")
    need_columns(df, [column, *keys, *order])
    p, n, r = fresh(df, "__p", "__n", "__r")
    if keys:
        w = Window.partitionBy(*[q(k) for k in keys])
        d = df.withColumns({p: F.row_number().over(w.orderBy(*[q(c).asc_nulls_last() for c in order])) - 1, n: F.count(F.lit(1)).over(w)})
    else:
        d = row_ids(df, p, order)
        d = d.crossJoin(F.broadcast(d.agg(F.count(F.lit(1)).alias(n))))  # one row
    src = d.select(*[q(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.pmod(q(p) + F.lit(shift), q(n)).alias(r), q(column).alias("__v"))
    cond = F.col(f"d.`{p}`") == F.col(f"s.`{r}`")
    for i, k in enumerate(keys):
        cond = cond & F.col(f"d.`{k}`").eqNullSafe(F.col(f"s.__k{i}"))
    return d.alias("d").join(src.alias("s"), cond, "left").select(*[F.col(f"d.`{c}`") for c in df.columns], F.col("s.__v").alias(name))
