"""Connected components of a link table, as Spark joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procure_spark.llm.common import written


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v) -> (u, v, m): m is the least of u and the v's of u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return edges.join(least, F.col("u") == F.col("w")).select("u", "v", "m")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """links (a, b) of any orderable type -> (node, label): the least node that each linked node
    reaches. Large and small stars in turn, until nothing changes; each round is written, and a
    node with any number of links is aggregated before it is joined."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    edges, before = written(edges, name), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        stars = _with_least(large)
        small = stars.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(stars.select("u", F.col("m").alias("v"))).filter("u != v")
        edges = written(small.distinct(), name)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    labels = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())
