"""Unions, upserts and deletes as rewrites of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procure_spark.functions.text import is_blank


def combine_results(local: DataFrame, external: DataFrame, mode: str = "both") -> DataFrame:
    """Rows with their source, of one side or both; total is the number of all."""
    sides = {"local": local.withColumn("source", F.lit("local")), "ai": external.withColumn("source", F.lit("external"))}
    rows = sides["local"].unionByName(sides["ai"]) if mode == "both" else sides[mode]
    return rows.withColumn("total", rows.agg(F.count("*")).scalar())


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def keep_available(selection: DataFrame, files: DataFrame) -> DataFrame:
    return selection.intersect(files.select(*selection.columns))


def union_evolving(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union by name; columns that one side lacks are null there."""
    return a.unionByName(b, allowMissingColumns=True)


def one_each(df: DataFrame, key: str, order: Sequence[str] = ()) -> DataFrame:
    """A row for each key, the first in order; of rows that are equal in it the one of the smaller values."""
    others = [c for c in df.columns if c != key and c not in order]
    row = F.min(F.struct(*[F.col(c).alias(f"__{i}") for i, c in enumerate([*order, *others])]))
    return df.groupBy(key).agg(row.alias("__row")).select(*[F.col(key) if c == key else F.col(f"__row.__{[*order, *others].index(c)}").alias(c) for c in df.columns])


def upsert(cur: DataFrame, new: DataFrame, key: str, seq: str, fallback: Sequence[str] = (), defaults: dict[str, object] | None = None) -> DataFrame:
    """cur with new's rows written over by key: of several new rows the first holds; ``fallback``
    columns keep what is stored, or else the default, where the new value is blank. change tells
    created, updated and kept rows."""
    cols, defaults = cur.columns, defaults or {}
    batch = one_each(new.filter(~is_blank(F.col(key).cast("string"))), key, [seq] if seq != key else [])
    both = cur.alias("c").join(batch.alias("n"), F.col(f"c.{key}") == F.col(f"n.{key}"), "full_outer")
    has = F.col(f"n.{key}").isNotNull()

    def value(c: str) -> Column:
        if c == key:
            return F.coalesce(f"n.{key}", f"c.{key}")
        if c in fallback:
            told = F.when(~is_blank(F.col(f"n.{c}").cast("string")), F.col(f"n.{c}"))
            return F.coalesce(told, F.col(f"c.{c}"), *([F.lit(defaults[c])] if c in defaults else []))
        return F.when(has, F.col(f"n.{c}")).otherwise(F.col(f"c.{c}"))

    change = F.when(~has, "kept").when(F.col(f"c.{key}").isNull(), "created").otherwise("updated")
    return both.select(*[value(c).alias(c) for c in cols], change.alias("change"))


def split_valid(df: DataFrame, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with all required values, and the rest."""
    bad = F.lit(False)
    for c in required:
        bad = bad | is_blank(F.col(c).cast("string"))
    return df.filter(~bad), df.filter(bad)


def needs_download(df: DataFrame, key: str, url: str, old_url: str, n_files: str, forced: str | None = None, is_new: str | None = None) -> DataFrame:
    """df with needs_download: forced, or a link that is new, changed or has brought no file."""
    has = ~is_blank(F.col(url))
    why = F.coalesce(F.col(n_files), F.lit(0)) == 0
    why = why | ~F.col(url).eqNullSafe(F.col(old_url))
    why = why | F.col(is_new) if is_new else why
    need = has & why
    return df.withColumn("needs_download", F.coalesce(F.col(forced), F.lit(False)) | need if forced else need)


def delete_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")


def mark_seen(ledger: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """ledger and the ids that it lacks."""
    return ledger.unionByName(one_each(ids, key).join(ledger.select(key), key, "left_anti").select(*ledger.columns))
