"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procure_spark.functions.text import blank


def list_package(spark: SparkSession, root: str) -> DataFrame:
    """(path, tender, name, size, ext) of the files in a folder per tender; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"))
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    return files.select("path", F.element_at(parts, -2).alias("tender"), name.alias("name"), "size", F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("ext"))


def load_catalog(spark: SparkSession, path: str, specs: str = "specs") -> DataFrame:
    """A catalog in Parquet or JSON; missing specs are an empty map."""
    df = spark.read.json(path) if path.rstrip("/").endswith(("json", "jsonl")) else spark.read.parquet(path)
    empty = F.create_map().cast("map<string,string>")
    return df.withColumn(specs, F.coalesce(F.col(specs).cast("map<string,string>"), empty) if specs in df.columns else empty)


def load_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored pages (url, html)."""
    return spark.read.parquet(path).select("url", "html")


def export_catalog(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_reports(df: DataFrame, path: str, tender: str = "tender_id", status: str = "status", report: str = "report", least: int = 300) -> None:
    """Reports of finished analyses that say more than ``least`` characters, a folder per tender."""
    told = df.filter(F.col(status).isin("success", "partial") & (F.length(F.trim(blank(F.col(report)))) > least))
    told.write.mode("overwrite").partitionBy(tender).parquet(path)
