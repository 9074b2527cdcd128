"""Budgeted and ordered selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procure_spark.registry import written

#: Steps of the greedy budget between looks at what is open.
STEPS = 4

#: Parts that a group is dealt into.
DEALT = 64


def take_budget_prefix(df: DataFrame, group: Sequence[str], order: Sequence[Column], size: Column, budget: int, spread: Sequence[str] = ()) -> DataFrame:
    """Rows in order up to the first that would exceed the budget. With ``spread``, columns that tell a group's rows apart, each group
    is first dealt into ``DEALT`` parts by them: what a part's budget doesn't reach, the group's doesn't either."""
    if spread:
        dealt = df.withColumn("__part", F.pmod(F.xxhash64(*spread), F.lit(DEALT)))
        df = take_budget_prefix(dealt, [*group, "__part"], order, size, budget).drop("__part", "used")
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(size).over(w)).filter(F.col("used") <= budget)


def _greedy_step(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Takes each group's longest run of open rows that fits what is left, and drops rows that don't fit any more."""
    upto = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    whole = upto.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    is_open = F.col("__taken").isNull()
    rows = rows.withColumn("__run", F.sum(F.when(is_open, F.col("__size")).otherwise(0)).over(upto))
    rows = rows.withColumn("__over", F.max(is_open & (F.col("__run") > F.col("__left"))).over(upto))
    takes = is_open & ~F.col("__over")
    rows = rows.withColumn("__used", F.coalesce(F.max(F.when(takes, F.col("__run"))).over(whole), F.lit(0)))
    left = F.col("__left") - F.col("__used")
    taken = F.when(~is_open, F.col("__taken")).when(takes, True).when(F.col("__size") > left, False)
    return rows.withColumns({"__taken": taken, "__left": left}).drop("__run", "__over", "__used")


def take_budget_greedy(df: DataFrame, group: Sequence[str], key: str, order: Sequence[str], size: str, budget: int, skip_reason: Column | None = None) -> DataFrame:
    """(group, key, reason): in order, rows that still fit are taken (reason null), others skipped
    (``over_budget``); rows with a reason of their own never count.

    Up to the first row that doesn't fit, what is used is a running sum. So each step takes the longest run of rows that fits, and drops the
    row behind it with all that are larger than what is left; the next step does so with the rest. Steps share one shuffle and
    sort of keys and sizes; after ``STEPS`` of them rows are written and those that are open are gone on with. A step takes or drops
    a row of each group at least; as what is left shrinks and larger rows go at once, a few steps are the rule."""
    reason = skip_reason if skip_reason is not None else F.lit(None).cast("string")
    by = [f"__o{i}" for i in range(len(order))]
    lean = df.select(*group, key, *[F.col(o).alias(n) for o, n in zip(order, by, strict=True)], F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long")).alias("__size"), reason.alias("__why"))
    lean = lean.withColumn("__why", F.coalesce("__why", F.when(F.col("__size") > budget, "over_budget")))
    out = lean.filter("__why is not null").select(*group, key, F.col("__why").alias("reason"))
    rows = lean.filter("__why is null").drop("__why").withColumns({"__taken": F.lit(None).cast("boolean"), "__left": F.lit(budget).cast("long")})
    while True:
        for _ in range(STEPS):
            rows = _greedy_step(rows, group, [*by, key, "__size"])
        rows = written(rows, "greedy")
        out = out.unionByName(rows.filter("__taken is not null").select(*group, key, F.when(~F.col("__taken"), "over_budget").alias("reason")))
        rows = rows.filter("__taken is null")
        if not rows.limit(1).count():
            return out


def select_sections(df: DataFrame, group: Sequence[str], order: Sequence[str], text: str, start: str, end: str, excluded: str) -> DataFrame:
    """Rows inside sections: from a start pattern on, up to and with an end pattern's row; rows that an
    excluded pattern fits are left out."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    told = F.struct(low.rlike(start).alias("start"), low.rlike(end).alias("end"), low.rlike(excluded).alias("out"))
    rows = df.select("*", F.inline_outer(F.array(told)))  # computed once, before the window
    state = F.when(F.col("end"), 0).when(F.col("start"), 1)
    carried = F.coalesce(F.last(state, ignorenulls=True).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("__in", (F.col("start") | (carried == 1)) & ~F.col("out")).filter("__in").drop("__in", "start", "end", "out")


def with_neighbours(df: DataFrame, group: Sequence[str], order: Sequence[str], flag: Column) -> DataFrame:
    """Flagged rows and those next to them."""
    w = Window.partitionBy(*group).orderBy(*order)
    marked = df.withColumn("__flag", flag)
    near = F.col("__flag") | F.coalesce(F.lag("__flag").over(w), F.lit(False)) | F.coalesce(F.lead("__flag").over(w), F.lit(False))
    return marked.withColumn("__near", near).filter("__near").drop("__near", "__flag")


def renumber(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "number") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def deadline_notices(df: DataFrame, deadline: str, key: str, risk: str, n: int = 5, urgent: Sequence[str] = ("High",)) -> DataFrame:
    """The n nearest deadlines with an urgency."""
    rows = df.filter(F.col(deadline).isNotNull()).orderBy(deadline, key).limit(n)
    return rows.withColumn("urgency", F.when(F.col(risk).isin(*urgent), "high").otherwise("normal"))
