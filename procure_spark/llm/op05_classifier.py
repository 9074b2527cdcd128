"""Quality classifier by a sparse rule ensemble.

Trees are grown on text statistics of labelled documents; every path from a root to a node is a rule,
a conjunction of thresholds; a logistic regression under an L1 penalty keeps few of them; the kept
rules and their weights become one Spark column expression, with which all documents are scored.

Training uses at most ``sample`` labelled documents (the bound of the fit, documented here): those with the
smallest hash of their id, a row each. Scores use statistics of the text alone.

Defined cases: null and empty texts have zero statistics and the score of those; null labels are left
out; of repeated labels of one document the largest counts, of rows that share an id the text of least hash is
learnt from; a null id has no label and is not held out; repeated rows are scored alike; if all labels are equal, or there are
none, the score is the share of label 1 (0.5 without labels); other columns of the documents pass
through, except those named ``score`` and ``predicted``, which are replaced.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procure_spark.llm.common import table, written
from procure_spark.llm.text_stats import SHARES, share_stats

SAMPLE, TREES, DEPTH, PENALTY, THRESHOLD, SEED = 12_000, 24, 3, 0.002, 0.7, 5

#: A condition: statistic, whether the rule needs it at most (else over) the threshold, threshold.
Condition = tuple[str, bool, float]


def tree_rules(debug: str, names: list[str]) -> list[tuple[Condition, ...]]:
    """The conjunctions on the paths to all nodes but the root, from a tree's printed form."""
    rules, path = [], []
    for depth, kind, feature, sign, value in re.findall(r"^( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)", debug, re.M):
        level = len(depth)
        path = [(d, c) for d, c in path if d < level] + [(level, (names[int(feature)], sign == "<=", float(value)))]
        rules.append(tuple(sorted({c for _, c in path})))
    return rules


def rule_column(rule: tuple[Condition, ...], stats: str) -> Column:
    """1.0 where all conditions hold, else 0.0."""
    held = F.lit(True)
    for name, at_most, value in rule:
        c = F.col(f"{stats}.{name}")
        held = held & (c <= value if at_most else c > value)
    return held.cast("double")


def fit(labelled: DataFrame, trees=TREES, depth=DEPTH, penalty=PENALTY, seed=SEED) -> tuple[float, list[tuple[tuple[Condition, ...], float]]]:
    """labelled: (stats struct of SHARES, label double), bounded. (intercept, [(rule, weight)])."""
    flat = labelled.select("label", *[F.col("stats")[c].alias(c) for c in SHARES])
    share, n = flat.agg(F.avg("label"), F.count("*")).first()
    if not n or share in (0.0, 1.0):
        return _logit(0.5 if not n else share), []
    data = VectorAssembler(inputCols=list(SHARES), outputCol="features").transform(flat)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, minInstancesPerNode=8, subsamplingRate=0.7, seed=seed).fit(data)
    rules = sorted({r for t in forest.trees for r in tree_rules(t.toDebugString, list(SHARES))})
    held = labelled.select("label", *[rule_column(r, "stats").alias(f"r{i}") for i, r in enumerate(rules)])
    data = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(held).select("label", "features")
    model = LogisticRegression(elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=60).fit(data)
    return float(model.intercept), [(r, w) for r, w in zip(rules, model.coefficients.toArray().tolist(), strict=True) if w]


def _logit(p: float) -> float:
    return math.log(min(max(p, 1e-9), 1 - 1e-9) / (1 - min(max(p, 1e-9), 1 - 1e-9)))


def compile_score(intercept: float, weighted: list[tuple[tuple[Condition, ...], float]], stats: str = "stats") -> Column:
    """The ensemble as one column expression over a struct of statistics."""
    total = F.lit(float(intercept))
    for rule, weight in weighted:
        total = total + F.lit(float(weight)) * rule_column(rule, stats)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def training_rows(docs: DataFrame, labels: DataFrame, sample=SAMPLE, keep: Column | None = None) -> DataFrame:
    """(stats, label) of at most ``sample`` labelled documents; keep: which labels may be learnt from."""
    labels = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    labels = labels.filter(keep) if keep is not None else labels
    labels = labels.groupBy("doc_id").agg(F.max("quality").cast("double").alias("label"))
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # sample ids at most
    # Rows that share an id are one to learn from: that of the least text hash.
    rows = rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("label").alias("label"))
    return rows.repartition(max(8, sample // 1000)).select(share_stats(F.col("text")).alias("stats"), "label")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample=SAMPLE):
    rows = written(training_rows(docs, labels, sample, ~held_out()), "op5-training")
    return fit(rows)


def score(docs: DataFrame, model, text_col="text", threshold=THRESHOLD) -> DataFrame:
    """docs with score and predicted (1 from the threshold on)."""
    scored = docs.withColumn("__stats", share_stats(F.col(text_col))).withColumn("score", compile_score(*model, stats="__stats"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int")).drop("__stats")


def op5_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
