"""Tables in buckets of rows by key, of which an upsert writes a new version of those buckets alone that it touches.

A version is a folder of its own (``bucket=3/version=17``), so readers of the last one see all of an upsert or nothing of
it, and an upsert that is run again under its number reads what it read before and writes over what it wrote: a replayed
batch changes nothing. Old versions stay until they are deleted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

BUCKETS = 64


def bucket(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def read_version(spark: SparkSession, path: str, schema: T.StructType, before: int | None = None, only: list[int] | None = None) -> DataFrame:
    """The last version (under ``before``) of each bucket; no rows where nothing was written yet."""
    parts = T.StructType([*schema, T.StructField("bucket", T.IntegerType()), T.StructField("version", T.LongType())])
    try:
        stored = spark.read.schema(parts).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    if before is not None:
        stored = stored.filter(F.col("version") < before)
    if only is not None:
        stored = stored.filter(F.col("bucket").isin(only))
    # A row for each bucket, of which there is a fixed number; as constants they prune the folders that are read.
    last = stored.groupBy("bucket").agg(F.max("version").alias("version")).collect()
    here = F.lit(False)
    for r in last:
        here = here | ((F.col("bucket") == r["bucket"]) & (F.col("version") == r["version"]))
    return stored.filter(here).drop("bucket", "version")


def upsert_version(spark: SparkSession, path: str, new: DataFrame, key: str, merge: Callable[[DataFrame, DataFrame], DataFrame], schema: T.StructType, version: int, buckets: int = BUCKETS) -> None:
    """merge(stored rows of the touched buckets, new) as the version ``version`` of these buckets."""
    touched = [r["b"] for r in new.select(bucket(key, buckets).alias("b")).distinct().collect()]  # at most ``buckets``
    if not touched:
        return
    merged = merge(read_version(spark, path, schema, version, touched), new).select(*schema.names)
    rows = merged.withColumns({"bucket": bucket(key, buckets), "version": F.lit(version).cast("long")})
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(path)
