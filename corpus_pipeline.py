"""From raw documents to training sequences: each stage's result is written and read as the next one's docs.

Every stage gives an empty result for an empty table, treats whole texts, and takes rows as they come: repeated
rows are documents each for itself unless a stage says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procure_spark.llm import op01_secrets, op02_pieces, op05_classifier, op07_neardup, op09_mixing
from procure_spark.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, learnt from the labelled ones among them, doesn't reject. Null and empty
    texts have the score of zero statistics; a score on the threshold passes."""
    model = op05_classifier.learn(docs, table(spark, sf_dir, "labels"))
    return op05_classifier.score(docs, model).filter("predicted = 1").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by a similarity of 0.8 or more: that of the least id. Null and
    empty texts are linked with nothing and stay; rows that share an id stay or go together if they are linked."""
    return op07_neardup.drop_near_duplicates(docs, percent=80, chunks=12)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the reported spans of their texts masked; null texts stay null."""
    return op01_secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass of the curriculum over a document, in training order; a pass that the mix
    takes less than half of is left out. Documents without a word have no pass; a null source is one of its
    own, the last."""
    return op09_mixing.mix(docs).filter("2 * words >= size").select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every text, fewer if it has fewer; a null text has the empty one."""
    return op02_pieces.sample(docs.select("doc_id", "text"), keep_text=False)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_dedup),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixing),
    ("SentencePiece encoding and decoding", pieces),
]

#: A trained model and sampled segmentations are out of SQL's reach; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
