"""Ordered groups of which one may hold a large share of all rows.

Rows of a group are read in order by one task, unless the group is long. The rows of a
long group are cut into ranges of its order column, so they spread over many tasks; what
a range needs to know of those before it (a count, a state) is folded from one small row
a range.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class LongGroups:
    """The long groups of a table, with the upper bounds of their ranges."""

    key: str
    order: str
    bounds: dict = field(default_factory=dict)

    @classmethod
    def of(
        cls, rows: DataFrame, key: str, order: str, least: int = 100_000, share: int = 1000, ranges: int = 64
    ) -> LongGroups:
        """Groups with over ``least`` rows and over 1/``share`` of all rows, so fewer than
        ``share`` groups whatever the table, each with at most ``ranges`` ranges. Only the
        two columns are read."""
        sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > least)
        found = {r[0]: r[1] for r in sizes.orderBy(F.desc("n")).limit(share).collect()}
        if found:
            total = rows.count()
            found = {k: [] for k, n in found.items() if n * share > total}
        long = cls(key, order, found)
        if long:
            steps = [i / ranges for i in range(1, ranges)]
            cuts = rows.filter(long.holds()).groupBy(key).agg(F.percentile_approx(order, steps, 1000))
            long.bounds.update((r[0], sorted(set(r[1] or []))) for r in cuts.collect())
        return long

    def __bool__(self) -> bool:
        return bool(self.bounds)

    def holds(self) -> Column:
        """Whether a row belongs to a long group."""
        known = F.coalesce(F.col(self.key).isin([k for k in self.bounds if k is not None]), F.lit(False))
        return known | F.col(self.key).isNull() if None in self.bounds else known

    def ranged(self, rows: DataFrame, into: str) -> DataFrame:
        """``rows`` with the number of the range: how many bounds of its group lie below."""
        if not self:
            return rows.withColumn(into, F.lit(0))
        order = rows.schema[self.order].dataType.simpleString()
        kind = f"__key {rows.schema[self.key].dataType.simpleString()}, __bounds array<{order}>"
        table = rows.sparkSession.createDataFrame(list(self.bounds.items()), kind)
        joined = rows.join(F.broadcast(table), F.col(self.key).eqNullSafe(F.col("__key")), "left")
        below = F.size(F.filter("__bounds", lambda b: b < F.col(self.order)))
        number = F.when(F.col(self.order).isNull() | F.col("__bounds").isNull(), 0).otherwise(below)
        return joined.withColumn(into, number).drop("__key", "__bounds")
