"""Ranges of an axis as nodes of a binary tree, so that ranges and the points in them meet by equality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Leaves of the tree (a power of two): the axis is cut at quantiles of the data, so leaves hold about equally many ends.
LEAVES = 256


class Tree:
    """A binary tree over the axis, cut where the ends of some tables lie.

    A range is covered by few nodes (at most two of a level); a point lies in one node of each level. A range and a point in it
    share exactly one node, if their leaves allow; whether the point is in the range is to be checked besides. Cuts are
    found by one aggregate of each table (a quantile sketch); they only spread the work, results don't depend on them.
    """

    def __init__(self, ends: Sequence[tuple[DataFrame, Column]], leaves: int = LEAVES):
        cuts: set[float] = set()
        for df, c in ends:
            x = c.cast("double")
            n = max(1, leaves // len(ends) - 1)
            got = df.where((F.abs(x) < float("inf"))).agg(F.percentile_approx(x, [(k + 1) / (n + 1) for k in range(n)], 4 * leaves)).first()[0]
            cuts |= set(got or [])
        self.cuts = sorted(cuts)
        self.size = 1
        while self.size <= len(self.cuts):
            self.size *= 2
        self.levels = self.size.bit_length()

    def leaf(self, c: Column) -> Column:
        """Number of cuts at or below a value, by binary search."""
        if self.size == 1:
            return F.lit(0).cast("bigint")
        cuts = F.array(*[F.lit(x) for x in [*self.cuts, *[float("inf")] * (self.size - len(self.cuts))]])
        steps = F.array(*[F.lit(self.size >> k) for k in range(1, self.levels)])
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.element_at(cuts, at + step) <= c, at + step).otherwise(at)).cast("bigint")

    def above(self, leaf: Column) -> Column:
        """Nodes from a leaf up to the root."""
        return F.array(*[F.shiftright(leaf + F.lit(self.size), k) for k in range(self.levels)])

    def covering(self, lo: Column, hi: Column) -> Column:
        """Nodes that cover the leaves lo to hi, both included; none if lo lies after hi."""
        found = []
        for k in range(self.levels):
            a = F.shiftright(lo + F.lit(self.size + (1 << k) - 1), k)
            b = F.shiftright(hi + F.lit(self.size + 1), k)
            found += [F.when((a < b) & (a % 2 == 1), a), F.when((a < b) & (b % 2 == 1), b - 1)]
        return F.array_compact(F.array(*found))
