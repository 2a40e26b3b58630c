"""Attribute-value rows into wide tables, log-structured: sparse wide deltas with versioned cells, compacted by latest version."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import fresh, q, require

TYPED = {"double": "double", "int": "bigint", "bool": "boolean", "category": "string", "string": "string", "timestamp": "timestamp_ntz"}


def wide_delta(batch: DataFrame, entity: str, attribute: str, version: Sequence[str], cell: Sequence[str]) -> DataFrame:
    """One batch of rows as a sparse wide delta: (entity, cells), cells mapping each attribute present to (version..., cell...).

    Of rows of the same cell the greatest version stays; equal versions are decided by the cell's own columns, so that the
    result doesn't depend on the order of rows. Rows with null entity, attribute or version are left out: they name no cell.
    The greatest version is kept map-side, so a hot entity sends at most one row for each attribute and map task. A row of
    the result holds at most as many cells as there are attributes.
    """
    v = F.struct(*[q(c) for c in version], *[q(c) for c in cell])
    whole = [q(c).isNotNull() for c in [entity, attribute, *version]]
    keep = whole[0]
    for c in whole[1:]:
        keep = keep & c
    best = batch.where(keep).groupBy(q(entity).alias("entity"), q(attribute).alias("attribute")).agg(F.max(v).alias("cell"))
    return best.groupBy("entity").agg(F.map_from_entries(F.collect_list(F.struct("attribute", "cell"))).alias("cells"))


def compact(runs: Sequence[DataFrame]) -> DataFrame:
    """Merge runs of sparse wide deltas: per entity and attribute the cell of the greatest version. Order of runs doesn't matter.

    An entity's deltas, one of each run, are merged cell by cell; runs that already lie by entity aren't sent again.
    """
    require(len(runs) > 0, "compact needs a run")
    merged = runs[0]
    for r in runs[1:]:
        merged = merged.unionByName(r)
    deltas = merged.groupBy("entity").agg(F.collect_list("cells").alias("m"))
    latest = F.aggregate(F.slice("m", 2, F.size("m")), F.element_at("m", 1), lambda a, b: F.map_zip_with(a, b, lambda k, x, y: F.greatest(x, y)))
    return deltas.select("entity", latest.alias("cells"))


def eav_to_cells(df: DataFrame, entity: str, attribute: str, version: Sequence[str], cell: Sequence[str], batch: Column | None = None) -> DataFrame:
    """Rows into compacted cells (entity, cells). batch: expression that names the load a row came with.

    Every load becomes one sparse wide delta (a run); an entity's deltas lie together and are compacted where they lie, without
    being sent again. An entity has one delta of each load, of at most as many cells as there are attributes. With batch=None
    there is one load.
    """
    if batch is None:
        return wide_delta(df, entity, attribute, version, cell)
    (b,) = fresh(df, "__batch")
    v = F.struct(*[q(c) for c in version], *[q(c) for c in cell])
    keep = q(entity).isNotNull() & q(attribute).isNotNull()
    for c in version:
        keep = keep & q(c).isNotNull()
    best = df.where(keep).groupBy(q(entity).alias("entity"), batch.alias(b), q(attribute).alias("attribute")).agg(F.max(v).alias("cell"))
    # A delta of one load: all attributes of an entity in one sparse row.
    runs = best.repartition("entity").groupBy("entity", b).agg(F.map_from_entries(F.collect_list(F.struct("attribute", "cell"))).alias("cells"))
    return compact([runs.drop(b)])


def typed_wide(cells: DataFrame, types: dict[str, str], entity: str = "entity", id_suffix: str | None = None) -> DataFrame:
    """Compacted cells as one row per entity with a typed column for each attribute of types (attribute -> kind).

    Cells hold num, txt and tm as values.with_value gives them. id_suffix: also give the id of the reading behind each cell.
    An attribute that an entity lacks is null; attributes that differ only in case get distinct names by a trailing number.
    """
    used, out = {entity.lower()}, []
    for a, kind in sorted(types.items()):
        name, n = a, 2
        while name.lower() in used:
            name, n = f"{a}_{n}", n + 1
        used.add(name.lower())
        c = F.col("cells")[F.lit(a)]
        v = {"double": c["num"], "int": c["num"].cast("bigint"), "bool": c["num"] == 1.0, "timestamp": c["tm"]}.get(kind, c["txt"])
        out.append(v.alias(name))
        if id_suffix:
            out.append(c["id"].alias(name + id_suffix))
    return cells.select(F.col("entity").alias(entity), *out)
