"""Grouping activity into sessions by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..common import checkpoint, chunked, need_columns, numeric_axis, q, require


def sessionise(df: DataFrame, entity: str, start: str, stop: str | None, gap: int, chunk_cells: int = 84) -> DataFrame:
    """Sessions of each entity: (entity, start_us, stop_us, duration_us, records).

    A session goes on while the next start is at most gap (inclusive, in microseconds) after the latest end so far. Rows with
    a null entity, start or stop, or start > stop, are no activity; stop=None makes every row a moment. Equal rows count as
    records, but change nothing else. An empty table gives an empty one.

    Method: starts that share a cell of width gap always share a session, so rows are first summed up by (entity, cell)
    map-side: first start, latest end, count. Each cell links to its predecessor if that lies within the gap of the latest end
    so far, else it is a root; self-joins double the pointers until roots stabilise; cells are then aggregated by root. The
    latest end so far is carried through chunks of chunk_cells cells, so no task scans all cells of a hot entity.
    """
    need_columns(df, [entity, start, *([stop] if stop else [])])
    require(gap > 0, "gap must be positive")
    s = numeric_axis(df, start)
    e = numeric_axis(df, stop) if stop else s
    rows = df.select(q(entity).alias("k"), s.alias("s"), e.alias("e")).where("k is not null and s is not null and e is not null and s <= e")
    cell = F.floor(F.col("s") / F.lit(gap)).cast("bigint")
    cells = rows.groupBy("k", cell.alias("c")).agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count(F.lit(1)).alias("n"))
    cells = cells.withColumn("__chunk", F.floor(F.col("c") / F.lit(chunk_cells)).cast("bigint"))
    cells = chunked(cells, ["k"], "__chunk", ["c"], {"__e": F.max("e"), "__c": F.max("c")}, {"__emax": ("max_before", "__e"), "__clast": ("last_before", "__c")})
    w = Window.partitionBy("k", "__chunk").orderBy("c")
    until = F.greatest(F.col("__emax"), F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    previous = F.coalesce(F.lag("c").over(w), F.col("__clast"))
    linked = F.coalesce(F.col("s") <= until + F.lit(gap), F.lit(False))
    nodes = checkpoint(cells.select("k", "c", "s", "e", "n", F.when(linked, previous).otherwise(F.col("c")).alias("p")))
    roots = double_pointers(nodes.select("k", "c", "p"))
    out = nodes.drop("p").join(roots, ["k", "c"]).groupBy("k", "p").agg(F.min("s").alias("start_us"), F.max("e").alias("stop_us"), F.sum("n").alias("records"))
    return out.select(F.col("k").alias(entity), "start_us", "stop_us", (F.col("stop_us") - F.col("start_us")).alias("duration_us"), "records")


def double_pointers(links: DataFrame) -> DataFrame:
    """(k, c, p): node c of key k points to p, roots to themselves. Returns the same with p the root of each node.

    Each round replaces a pointer by its target's pointer, so paths halve: about log2(longest path) rounds. Nodes whose target
    is a root are settled and leave the next round's left side; targets are looked up among all nodes.
    """
    links = links.withColumn("root", F.col("c") == F.col("p"))
    done = links.where("root").select("k", "c", "p")
    active = links.where("not root").select("k", "c", "p")
    table = links
    while True:
        l, r = active.alias("l"), table.alias("r")
        step = l.join(r, (F.col("l.k") == F.col("r.k")) & (F.col("l.p") == F.col("r.c"))).select("l.k", "l.c", F.col("r.p").alias("p"), F.col("r.root").alias("settled"))
        step = checkpoint(step)
        done = done.unionByName(step.where("settled").select("k", "c", "p"))
        active = step.where("not settled").select("k", "c", "p")
        if active.isEmpty():
            return done
        # A settled node serves as a root from now on: its pointer is final.
        table = done.select("k", "c", "p", F.lit(True).alias("root")).unionByName(active.select("k", "c", "p", F.lit(False).alias("root")))
