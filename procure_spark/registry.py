"""Queries over the driver's tables and the SQL that they are held against."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with SQL for the same rows."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``. Where that is unset,
    as in tests on one machine, a temporary folder is set; on a cluster it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def spread(df: DataFrame, tasks: int = 4) -> DataFrame:
    """df dealt out to ``tasks`` tasks a core, where rows cost much more than their bytes tell: a file of some megabytes
    is one task else, however many rows are in it."""
    session = df.sparkSession
    return df.repartition(max(int(session.conf.get("spark.sql.shuffle.partitions")), tasks * session.sparkContext.defaultParallelism))


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again, so that its lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
