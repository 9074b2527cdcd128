"""Greedy chains: the first row of a group opens, then the first row that stands far enough behind the last opening."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from procure_spark.registry import written


def _joined(left: DataFrame, right: DataFrame, on: dict[str, str], how: str = "inner") -> DataFrame:
    """left with right's columns as ``_name``, joined where columns are equal or both null."""
    right = right.withColumnsRenamed({c: f"_{c}" for c in right.columns})
    return left.join(right, [F.col(a).eqNullSafe(F.col(f"_{b}")) for a, b in on.items()], how)


def with_next(points: DataFrame, group: Sequence[str], at: str, reach: int, stretch: int) -> DataFrame:
    """Distinct (group, at) -> (group, at, next): the least ``at`` of the group that is at least at + reach. Points meet within
    stretches of the axis, so that no task has a group as a whole; what a stretch lacks is the first point of the next one."""
    cell = lambda c: F.floor(F.col(c) / stretch)
    firsts = points.groupBy(*group, cell(at).alias("__cell")).agg(F.min(at).alias("__first"))
    probes = points.select(*group, at, (F.col(at) + reach).alias("__to"), F.lit(0).alias("__kind")).withColumn("__cell", cell("__to"))
    here = points.select(*group, F.lit(None).cast("long").alias(at), F.col(at).alias("__to"), F.lit(1).alias("__kind"), cell(at).alias("__cell"))
    # Backwards, so that the last point seen is the next one; of equal places the point comes before the probe.
    back = Window.partitionBy(*group, "__cell").orderBy(F.desc("__to"), F.desc("__kind"))
    inside = F.last(F.when(F.col("__kind") == 1, F.col("__to")), ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    found = probes.unionByName(here).withColumn("__in", inside).filter("__kind = 0")
    # The same over stretches, a row each: the first point of the first stretch behind that has any.
    over = Window.partitionBy(*group).orderBy(F.desc("__cell"), "__kind")
    cells = found.select(*group, "__cell", F.lit(0).alias("__kind"), F.lit(None).cast("long").alias("__first")).distinct().unionByName(firsts.select(*group, "__cell", F.lit(1).alias("__kind"), "__first"))
    later = F.last("__first", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))
    behind = cells.withColumn("__later", later).groupBy(*group, "__cell").agg(F.min(F.when(F.col("__kind") == 0, F.struct(F.col("__later").alias("x"))))["x"].alias("__later"))
    joined = _joined(found, behind, {c: c for c in (*group, "__cell")}, "left")
    return joined.select(*group, at, F.coalesce("__in", "___later").alias("next"))


def openings(rows: DataFrame, group: Sequence[str], at: str, reach: int, stretch: int | None = None) -> DataFrame:
    """(group, at) -> the distinct (group, at) that open. Those behind a gap of ``reach`` open in any case; from there chains
    are followed by doubled steps, so that the rounds grow with the logarithm of the longest chain without a gap."""
    points = rows.select(*group, F.col(at).cast("long").alias(at)).filter(F.col(at).isNotNull()).distinct()
    points = written(points, "chain-points")
    steps = written(with_next(points, group, at, reach, stretch or 64 * reach), "chain-steps")
    before = F.lag(at).over(Window.partitionBy(*group).orderBy(at))
    open_ones = written(points.withColumn("__b", before).filter(F.col("__b").isNull() | (F.col(at) - F.col("__b") >= reach)).drop("__b"), "chain-open")
    count = open_ones.count()
    own = {c: c for c in group}
    while True:
        ahead = _joined(open_ones, steps, {**own, at: at}).select(*group, F.col("_next").alias(at)).filter(F.col(at).isNotNull())
        more = written(open_ones.unionByName(ahead).distinct(), "chain-open")
        now = more.count()
        if now == count:
            return more
        open_ones, count = more, now
        twice = _joined(steps, steps, {**own, "next": at}).select(*group, at, F.col("_next").alias("next"))
        steps = written(twice.filter("next is not null"), "chain-steps")
