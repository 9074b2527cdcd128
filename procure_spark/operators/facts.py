"""Facts by pattern, with their provenance."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procure_spark import lexicons as L
from procure_spark.functions.text import blank, first_number
from procure_spark.operators.rollup import equivalents_policy
from procure_spark.operators.split import lines

AROUND = 80


def matches(text: Column, pattern: str) -> Column:
    """Array of struct(start, match) of a pattern's matches, starts from 1: match lengths and those of
    the parts between them add up to the places."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)
    lengths = lambda a, n: F.aggregate(F.slice(a, 1, n), F.lit(0), lambda x, y: x + F.length(y))
    return F.transform(found, lambda m, i: F.struct((lengths(gaps, i + 1) + lengths(found, i) + 1).alias("start"), m.alias("match")))


def extract_facts(df: DataFrame, group: str, file: str, text: str, status: str | None = None, rules: Sequence[tuple] = tuple(L.FACT_RULES), around: int = AROUND) -> DataFrame:
    """(group, file, topic, value_type, value_raw, value_num, day_kind, fragment, confidence, status): a row for each
    match with a number, for each file's policy on equivalents, and for each unreadable file. day_kind: of a term in days, whether they
    are working or calendar days, or just days; null of other facts."""
    readable = df.filter(F.col(status) == "success") if status else df
    body = blank(F.col(text))
    out = []
    for topic, kind, confidence, pattern, number, *days in rules:
        rx = f"(?U){pattern}"
        rows = readable.select(group, file, body.alias("__t"), F.explode(matches(F.lower(body), rx)).alias("m"))
        raw = F.trim(F.regexp_extract(F.col("m.match"), rx, number))
        rows = rows.select(
            group, file, F.lit(topic).alias("topic"), F.lit(kind).alias("value_type"), raw.alias("value_raw"), first_number(raw).alias("value_num"),
            (F.coalesce(F.nullif(F.regexp_extract("m.match", rx, days[0]), F.lit("")), F.lit(L.PLAIN_DAYS)) if days else F.lit(None).cast("string")).alias("day_kind"),
            F.substring(F.col("__t"), F.greatest(F.lit(1), F.col("m.start") - around), F.length("m.match") + around + F.least(F.lit(around), F.col("m.start") - 1)).alias("fragment"),
            F.lit(confidence).alias("confidence"), F.lit("ok").alias("status"),
        )
        out.append(rows.filter("value_num is not null"))
    none = F.lit(None).cast("string")
    policy = equivalents_policy(readable, text).filter("policy != 'none'")
    out.append(policy.select(group, file, F.lit("equivalents").alias("topic"), F.lit("policy").alias("value_type"), F.col("policy").alias("value_raw"), F.lit(None).cast("double").alias("value_num"), none.alias("day_kind"), none.alias("fragment"), F.col("confidence"), F.lit("ok").alias("status")))
    if status:
        bad = df.filter(F.col(status) != "success")
        out.append(bad.select(group, file, F.lit("file_status").alias("topic"), F.lit("status").alias("value_type"), F.col(status).alias("value_raw"), F.lit(None).cast("double").alias("value_num"), none.alias("day_kind"), none.alias("fragment"), F.lit("low").alias("confidence"), F.lit("ocr_failed").alias("status")))
    facts = out[0]
    for rows in out[1:]:
        facts = facts.unionByName(rows)
    return facts


def table_facts(tables: DataFrame, group: str, file: str, table: str, items: Sequence[str] = tuple(L.ITEM_WORDS), quantities: Sequence[str] = tuple(L.QUANTITY_WORDS), rows: int = 5) -> DataFrame:
    """A fact, as above, for each table whose first line names an item and a quantity: its first lines below."""
    own = lines(F.col(table))
    head = F.lower(F.get(own, F.lit(0)))
    named = [reduce(lambda a, b: a | b, [F.contains(head, F.lit(w)) for w in words]) for words in (items, quantities)]
    found = tables.filter(named[0] & named[1] & (F.size(own) > 1))
    none = F.lit(None).cast("string")
    return found.select(
        group, file, F.lit("items_quantities").alias("topic"), F.lit("table_extract").alias("value_type"), F.array_join(F.slice(own, 2, rows), "\n").alias("value_raw"), F.lit(None).cast("double").alias("value_num"),
        none.alias("day_kind"), none.alias("fragment"), F.lit("medium").alias("confidence"), F.lit("ok").alias("status"),
    )
