"""Hard negatives against brute force in plain integers."""

import math
import random

from pyspark.sql import functions as F

from procure_spark.llm import op12_negatives as N

SCHEMA = "id long, label long, v array<double>"


def brute(rows, positives=5, negatives=10):
    whole = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows]
    out = []
    for a in {(i, label, tuple(v)) for i, label, v in whole if i % 100 == 0}:
        scored = [(-sum(x * y for x, y in zip(a[2], v, strict=True)), i, label) for i, label, v in whole if i != a[0] and len(v) == len(a[2])]
        for s, p, _ in sorted(x for x in scored if x[2] == a[1])[:positives]:
            fit = sorted((-n, i) for n, i, label in ((-x, i, label) for x, i, label in scored) if label != a[1] and 30 * -s <= 100 * n <= 90 * -s)
            out += [(a[0], p, rank, i, -s, -n) for rank, (n, i) in enumerate(fit[:negatives], 1)]
    return sorted(out)


def make(rng, n=700, dim=8, labels=4):
    rows = []
    for i in range(n):
        label = rng.randrange(labels)
        v = [rng.gauss(1.0 if d == label else 0.3, 0.6) for d in range(dim)]
        rows.append((i, label, v))
    return rows


def mine(spark, rows, **sizes):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(map(tuple, N.hard_negatives(df, df.filter("id % 100 = 0"), **sizes).collect()))


def test_blocks_equal_brute_force(spark, monkeypatch):
    rows = make(random.Random(1))
    # Copies of one vector under many ids and labels, ties, zero vectors, other lengths, repeated rows.
    rows += [(1000 + i, i % 4, rows[3][2]) for i in range(60)] + [(1100, 1, [0.0] * 8), (1200, 2, [1.0] * 3), (1201, 2, [2.0] * 3), (1202, 3, [1.5] * 3), rows[5], rows[100]]
    wanted = brute(rows)
    monkeypatch.setattr(N, "STEP", 16)
    monkeypatch.setattr(N, "RUN", 2)
    assert mine(spark, rows, block=64, anchor_block=3) == wanted
    assert len(wanted) > 300


def test_lists_end_early():
    # Of clustered vectors a walk looks at a part of the list only, and finds what a whole one does.
    rng = N.np.random.default_rng(2)
    centres = rng.normal(size=(20, 16)) * 300
    vectors = N.np.floor(N.np.repeat(centres, 200, 0) + rng.normal(size=(4000, 16)) * 10)
    anchors, ids = vectors[:20], N.np.arange(4000)
    score, of = N.np.full((20, 1, 5), N.NONE), N.np.full((20, 1, 5), -N.NONE)
    told = {}
    everything = lambda members, cand: N.np.ones((len(members), len(cand)), bool)
    N.walk(anchors, vectors, N.np.full((20, 1), N.NONE), N.np.full((20, 1), -N.NONE), everything, ids, score, of, told)
    full = anchors @ vectors.T
    for i in range(20):
        best = sorted(zip(-full[i], ids, strict=True))[:5]
        assert [(-s, n) for s, n in best] == list(zip(score[i, 0], of[i, 0], strict=True))
    assert told["products"] < 0.3 * 20 * 4000


def test_large_products_are_exact(spark):
    rng = random.Random(4)
    rows = [(i, i % 2, [float(rng.randrange(2**19)) + rng.choice([0, 2**-8]) for _ in range(4)]) for i in range(130)]
    assert mine(spark, rows) == brute(rows)


def test_query_and_defined_cases(spark, tmp_path):
    rows = make(random.Random(5), 400)
    nan = float("nan")
    odd = [(500, None, [1.0] * 8), (None, 1, [1.0] * 8), (600, 1, None), (700, 1, []), (800, 1, [nan] * 8), (900, 1, [None] * 8), (901, 1, [float("inf")] * 8)]
    df = spark.createDataFrame([(i, v, label, "x") for i, label, v in rows + odd], "vec_id long, embedding array<double>, label int, score string")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = N.op12_shared_list_negatives(spark, str(tmp_path))
    moved = [(i, (label + 1) % 10 if i % 7 == 0 else label, v) for i, label, v in rows]
    assert sorted(map(tuple, got.collect())) == brute(moved)
    assert dict(got.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}
    df.limit(0).write.parquet(str(tmp_path / "none" / "embeddings.parquet"))
    assert N.op12_shared_list_negatives(spark, str(tmp_path / "none")).count() == 0
    alone = spark.createDataFrame([(100, 1, [1.0])], SCHEMA)
    assert N.hard_negatives(alone, alone).count() == 0 and N.usable(df.withColumn("v", F.lit(1)), "vec_id", "embedding", "label").count() == 400
