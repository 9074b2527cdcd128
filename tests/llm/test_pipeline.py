"""The pipeline against its stages, run on one small set of documents."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from procure_spark.llm import op01_secrets, op02_pieces


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and (name == corpus_pipeline.STAGES[-1][0] or out.columns == docs.columns)


def test_stages_keep_nulls_ties_and_repeats(spark, tmp_path):
    word = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    rows = [(1, word(1), "en", None, 1), (1, word(1), "en", None, 1), (2, word(1) + " more", None, "a", 2), (None, word(3), "en", "a", 3), (4, None, "en", "a", None), (5, "", "en", "a", 0), (6, "long " * 50_000, "en", "b", 6)]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash")).withColumn("class", F.lit("clash"))
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted((r["doc_id"] for r in df.collect()), key=str)
    assert stages["quality classifier"](spark, docs, str(tmp_path)).columns == docs.columns
    assert ids(stages["MinHash near-dedup"](spark, docs, str(tmp_path))) == [1, 1, 4, 5, 6, None]
    assert ids(stages["secret scans"](spark, docs, str(tmp_path))) == [1, 1, 2, 4, 5, 6, None]
    assert set(ids(stages["mixing sources to target weights"](spark, docs, str(tmp_path)))) <= {1, 2, 6, None}
    pieces = stages["SentencePiece encoding and decoding"](spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in pieces} == {1, 2, 4, 5, 6, None} and all(r["round_trip"] for r in pieces)


def test_stages_and_run(spark, tmp_path):
    rng = random.Random(8)
    prose = lambda: " ".join(rng.choice(["river", "bridge", "stone", "valley", "morning", "quiet", "under", "the"]) + str(rng.randrange(500)) for _ in range(60)) + "."
    junk = lambda: " ".join(rng.choice(["###", "$$$!!", "|||"]) for _ in range(60))
    texts = [prose() if i % 4 else junk() for i in range(300)]
    texts[5] = texts[1]
    texts[9] = "token = abcdefgh1234 " + texts[9]
    texts[299] = None
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(280)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r["doc_id"]: r.asDict() for r in docs.collect()}
    good = {i for i in range(299) if i % 4}
    assert set(kept["quality classifier"]) - {299} == good
    assert set(kept["MinHash near-dedup"]) == set(kept["quality classifier"]) - {5}
    masked = kept["secret scans"][9]
    assert masked["text"].startswith("[assign]") and masked["n_chars"] == len(masked["text"])
    assert not any(op01_secrets.base_parts(r["text"] or "") for r in kept["secret scans"].values())
    final = kept["SentencePiece encoding and decoding"]
    assert set(final) == set(kept["mixing sources to target weights"]) and all(r["round_trip"] for r in final.values())
    table = op02_pieces.vocabulary()["table"]
    assert all(op02_pieces.decode_ids(r["ids"], table) == (kept["secret scans"][i]["text"] or "") for i, r in final.items())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
