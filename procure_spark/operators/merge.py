"""Merging records, facts and positions. What comes first is told by an explicit sequence column; of rows
with equal ones the smaller value, so that reruns agree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procure_spark import lexicons as L
from procure_spark.functions.text import blank, is_blank, once


def longest(col: str, seq: str) -> Column:
    """Aggregate: the longest text, of equally long ones the first."""
    text = blank(F.col(col).cast("string"))
    return F.min_by(F.col(col), F.struct(-F.length(text), F.col(seq), F.col(col)))


def first_filled(col: str, seq: str) -> Column:
    """Aggregate: the first text that isn't blank, or null."""
    return F.min_by(F.col(col), F.when(~is_blank(F.col(col).cast("string")), F.struct(F.col(seq), F.col(col))))


def first_of(col: str, seq: str) -> Column:
    """Aggregate: the value of the first row, null or not."""
    return F.min(F.struct(F.col(seq).alias("s"), F.col(col).alias("v")))["v"]


def in_order(value: Column, seq: Column) -> Column:
    """Aggregate: values as an array in their sequence, nulls left out."""
    return F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(seq.alias("s"), value.alias("v"))))), lambda x: x["v"])


def distinct_ignoring_case(values: Column) -> Column:
    """An array's texts, each once whatever its case, at its first place."""
    firsts = lambda v, lows: F.filter(v, lambda x, i: F.array_position(lows, F.lower(F.trim(x))) == i + 1)
    return once(values, lambda v: once(F.transform(v, lambda x: F.lower(F.trim(x))), lambda lows: firsts(v, lows)))


def merge_notices(df: DataFrame, key: str, seq: str, longest_of: Sequence[str], first_filled_of: Sequence[str] = (), first_of_all: Sequence[str] = ()) -> DataFrame:
    """One row per key: the longest texts, the first filled ones, and the first row's other fields."""
    return df.groupBy(key).agg(
        *[longest(c, seq).alias(c) for c in longest_of], *[first_filled(c, seq).alias(c) for c in first_filled_of], *[first_of(c, seq).alias(c) for c in first_of_all], F.count("*").alias("merged")
    )


def merge_positions(df: DataFrame, keys: Sequence[str], seq: str, filled: Sequence[str], lists: Sequence[str], flags: Sequence[str] = ()) -> DataFrame:
    """One row per key, numbered by first appearance: first filled values, lists united in order, any
    flag; duplicates counts the rows that were merged into it."""
    merged = df.groupBy(*keys).agg(
        F.min(seq).alias("first_seq"),
        *[first_filled(c, seq).alias(c) for c in filled],
        *[distinct_ignoring_case(F.flatten(in_order(F.col(c), F.col(seq)))).alias(c) for c in lists],
        *[F.bool_or(c).alias(c) for c in flags],
        (F.count("*") - 1).alias("duplicates"),
    )
    return merged.withColumn("number", F.row_number().over(Window.partitionBy(*keys[:-1]).orderBy("first_seq", keys[-1])))


def merge_requirements(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Requirements of one key: as positions are, with the highest confidence and its fragment, mode
    ``mixed`` where they differ, and distinct notes."""
    return df.groupBy(*keys).agg(
        F.min(seq).alias("first_seq"),
        first_of("position_name", seq).alias("position_name"),
        first_filled("quantity", seq).alias("quantity"),
        first_filled("unit", seq).alias("unit"),
        distinct_ignoring_case(F.flatten(in_order(F.col("characteristics"), F.col(seq)))).alias("characteristics"),
        F.max("confidence").alias("confidence"),
        F.min_by("source_fragment", F.struct(-F.col("confidence"), F.col(seq), F.col("source_fragment"))).alias("source_fragment"),
        F.when(F.min("extraction_mode") < F.max("extraction_mode"), "mixed").otherwise(F.min("extraction_mode")).alias("extraction_mode"),
    )


CONFIDENCE = {"high": 10, "medium": 5, "low": 1}
PENALTY = {"partial": 3, "ocr_failed": 7}


def fact_weight(confidence: Column, status: Column) -> Column:
    """10, and 10, 5 or 1 by confidence, less 3 or 7 for doubtful readings."""
    more = F.coalesce(*[F.when(confidence == k, v) for k, v in CONFIDENCE.items()], F.lit(1))
    less = F.coalesce(*[F.when(status == k, v) for k, v in PENALTY.items()], F.lit(0))
    return F.lit(10) + more - less


def merge_select(df: DataFrame, keys: Sequence[str], value: str, weight: str, seq: str, variants: int = 5) -> DataFrame:
    """Vote for one value: modes agree (one value), select (the heaviest weighs twice the next), else
    conflict, with up to ``variants`` values, heaviest first."""
    votes = df.groupBy(*keys, value).agg(F.sum(weight).alias("w"), F.min(seq).alias("s"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("w"), F.col("s"), F.col(value).alias("v"))))
    top = votes.groupBy(*keys).agg(ranked.alias("r"))
    one, clear = F.size("r") == 1, F.col("r")[0]["w"] <= 2 * F.try_element_at("r", F.lit(2))["w"]
    mode = F.when(one, "agree").when(clear, "select").otherwise("conflict")
    return top.select(
        *keys,
        mode.alias("merge_mode"),
        F.when(mode != "conflict", F.col("r")[0]["v"]).alias("final_value"),
        F.transform(F.slice("r", 1, variants), lambda x: x["v"]).alias("variants"),
        (mode == "conflict").alias("conflict_flag"),
    )


def merge_aggregate(df: DataFrame, keys: Sequence[str], value: str, weight: str, seq: str, status: str) -> DataFrame:
    """All distinct values, heaviest fact first; conflict if any fact says so."""
    per = df.groupBy(*keys, value).agg(F.max(weight).alias("w"), F.min_by(seq, F.struct(-F.col(weight), F.col(seq))).alias("s"), F.bool_or(F.col(status) == "conflict").alias("c"))
    values = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("w"), F.col("s"), F.col(value).alias("v")))), lambda x: x["v"])
    return per.groupBy(*keys).agg(values.alias("values"), F.bool_or("c").alias("conflict_flag"))


def reconcile(facts: DataFrame, group: str, topics: Sequence[str] = tuple(L.TOPICS), select: Sequence[str] = tuple(L.SELECT_TOPICS), valid: Sequence[str] = ("ok", "partial", "ocr_failed", "conflict")) -> DataFrame:
    """facts (group, seq, topic, value_raw, confidence, status): one row per group and topic; ``not_found``
    where no valid fact is."""
    good = facts.filter(F.col("status").isin(*valid) & ~is_blank(F.col("value_raw"))).withColumn("w", fact_weight(F.col("confidence"), F.col("status")))
    votes = merge_select(good.filter(F.col("topic").isin(*select)), [group, "topic"], "value_raw", "w", "seq")
    votes = votes.select(group, "topic", "merge_mode", F.when(F.col("conflict_flag"), F.col("variants")).otherwise(F.array("final_value")).alias("values"), "conflict_flag")
    lists = merge_aggregate(good.filter(~F.col("topic").isin(*select)), [group, "topic"], "value_raw", "w", "seq", "status").select(group, "topic", F.lit("aggregate").alias("merge_mode"), "values", "conflict_flag")
    spine = facts.select(group).distinct().select(group, F.explode(F.array(*[F.lit(t) for t in topics])).alias("topic"))
    found = spine.join(votes.unionByName(lists), [group, "topic"], "left")
    return found.select(group, "topic", F.coalesce("merge_mode", F.lit("not_found")).alias("merge_mode"), F.coalesce("values", F.array().cast("array<string>")).alias("values"), F.coalesce("conflict_flag", F.lit(False)).alias("conflict_flag"))


def ordered_distinct(df: DataFrame, keys: Sequence[str], col: str, order: str) -> DataFrame:
    """(keys, values): a column's texts per key, each once whatever its case, by first appearance."""
    w = Window.partitionBy(*keys, F.lower(F.trim(col))).orderBy(order)
    firsts = df.filter(~is_blank(F.col(col))).withColumn("__r", F.row_number().over(w)).filter("__r = 1")
    return firsts.groupBy(*keys).agg(in_order(F.col(col), F.col(order)).alias("values"))


def facts_by_topic(facts: DataFrame, group: str, keep: Sequence[str] = ("ok", "partial")) -> DataFrame:
    """(group, facts): map of topic to its facts in sequence."""
    per = facts.filter(F.col("status").isin(*keep)).groupBy(group, "topic").agg(F.array_sort(F.collect_list(F.struct("seq", "value_raw", "confidence"))).alias("f"))
    return per.groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("topic", "f")))).alias("facts"))
