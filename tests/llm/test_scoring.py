"""Quality classifier (5), outliers (6) and top-k search (8)."""

import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from procure_spark.llm import op05_classifier as quality
from procure_spark.llm import op06_outliers as outliers
from procure_spark.llm import op08_topk as topk
from procure_spark.llm import text_stats


def junk(rng):
    return " ".join(rng.choice(["###", "BUY!!", "x|y", "$$$"]) for _ in range(rng.randrange(5, 60)))


def prose(rng):
    return " ".join(rng.choice(["the", "river", "went", "slowly", "under", "an", "old", "bridge,"]) + str(rng.choice(["", "s", "ly"])) for _ in range(rng.randrange(20, 90))) + "."


def test_rule_ensemble_learns_held_out_labels(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng) if i % 3 else junk(rng), int(i % 3 > 0)) for i in range(900)] + [(900, None, None), (901, "", 1), (902, "word " * 40_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(4)
    docs = df.select("doc_id", "text").withColumn("score", F.lit("clash"))
    model = quality.learn(docs, df.select("doc_id", "quality").unionByName(df.select("doc_id", F.lit(None).cast("int").alias("quality"))), sample=600)
    assert model[1]
    got = {r["doc_id"]: r for r in quality.score(docs, model).withColumn("held_out", quality.held_out()).collect()}
    assert len(got) == 903 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert [i for i in got if got[i]["held_out"]] and all(got[i]["held_out"] for i in held)
    assert sum(got[i]["predicted"] == int(i % 3 > 0) for i in held) / len(held) > 0.97
    # The compiled column equals the rules read one by one.
    text = rows[1][1]
    stats = dict(zip(text_stats.SHARES, text_stats.shares(text), strict=True))
    total = model[0] + sum(w for rule, w in model[1] if all((stats[n] <= v) == low for n, low, v in rule))
    assert math.isclose(got[1]["score"], 1 / (1 + math.exp(-total)), rel_tol=1e-9)


def test_no_or_equal_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = quality.learn(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.score(docs, none).first()["score"] == 0.5
    ones = quality.learn(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert quality.score(docs, ones).first()["predicted"] == 1


def brute_stats(text):
    import re

    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    seen, dups = [], 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dups += line in seen
            seen.append(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered)


def test_base_counts_equal_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice(["a", "b", " ", "\n", "#", "\x0b", "\x85", "\xa0", "é", "a b a b "]) for _ in range(rng.randrange(80)))
        b = text_stats.basic(text)
        assert (b["n_words"], b["word_chars"], b["n_symbols"], b["n_dup_lines"], b["n_repeat_words"]) == brute_stats(text)


def test_chi_squared():
    assert abs(outliers.chi2_quantile(0.95, 5) - 11.0705) < 1e-3 and abs(outliers.chi2_cdf(4.351, 5) - 0.5) < 1e-3


def test_outliers_go_and_the_rest_stays(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    clean = [" ".join(word() for _ in range(rng.randrange(60, 400))) for _ in range(500)]
    odd = [" ".join(word().upper() + "!!###" for _ in range(100)) for _ in range(30)]
    rows = [(i, t, "en", "a") for i, t in enumerate(clean + odd)] + [(1000, None, None, None), (1001, "short", "en", "b"), (1001, "short", "en", "b"), (1002, " ".join(word() for _ in range(80)), "fr", None)]
    got = outliers.judge(spark.createDataFrame(rows, "doc_id int, text string, lang string, source string").withColumn("kept", F.lit("clash")).repartition(3)).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and all(by[i]["kept"] for i in range(500)) and not any(by[i]["kept"] for i in range(500, 530))
    assert by[1000]["base_failed"] and not by[1000]["kept"] and by[1001]["base_failed"] and by[1002]["kept"]
    assert outliers.judge(spark.createDataFrame([], "doc_id int, text string, lang string, source string")).count() == 0


def test_estimated_covariance_decides(spark):
    rng = random.Random(7)
    text = lambda upper, symbols: " ".join(rng.sample(["Ab"] * upper + ["#b"] * symbols + ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(300 - upper - symbols)], 300))
    draw = lambda: rng.randrange(8, 60)
    rows = [(i, text(k, k + rng.randrange(-2, 3)), "en", "agree") for i in range(300) for k in [draw()]]
    rows += [(300 + i, text(draw(), draw()), "en", "free") for i in range(300)] + [(600 + i, text(20, 0), "en", "constant") for i in range(300)]
    # The same text in each group: usual by each statistic alone in two of them.
    probe = text(58, 8)
    rows += [(1000, probe, "en", "agree"), (1001, probe, "en", "free"), (1002, probe, "en", "constant"), (1003, text(20, 1), "en", "constant")]
    got = {r["doc_id"]: r["kept"] for r in outliers.judge(spark.createDataFrame(rows, "doc_id int, text string, lang string, source string")).collect()}
    assert [got[i] for i in range(1000, 1004)] == [False, True, False, True]
    assert sum(got[i] for i in range(900)) >= 895


ROWS = "grp string, up string, x array<double>, g array<double>"


def row(grp, up, x):
    return grp, up, [float(v) for v in x], [0.0] * outliers.D


def test_mcd_resists_contamination(spark):
    rng = np.random.default_rng(4)
    good, bad = rng.normal(0, 3, (2000, outliers.D)), rng.normal(40, 1, (300, outliers.D))
    f = outliers.fit(spark.createDataFrame([row("g", None, x) for x in np.vstack([good, bad])], ROWS)).first()
    diagonal = [x for x, (i, j) in zip(f["i"], outliers.PAIRS, strict=True) if i == j]
    assert all(abs(x) < 0.4 for x in f["m"]) and all(0.6 < x * 9 < 1.6 for x in diagonal)


def test_fits_equal_the_least_determinant_of_all_subsets(spark):
    rng, n, h, d = np.random.default_rng(8), 14, 11, outliers.D
    groups = {}
    for g in range(3):
        x = rng.normal(0, 1, (n, d)) @ rng.normal(0, 1, (d, d))
        x[: n - h] += 60 * rng.normal(0, 1, (n - h, d) if g else d)  # a cluster of outliers, or each on its own
        groups[f"g{g}"] = x
    fits = {r["grp"]: r for r in outliers.fit(spark.createDataFrame([row(g, None, r) for g, x in groups.items() for r in x], ROWS), cover=h / n).collect()}
    for g, x in groups.items():
        subsets = [list(s) for s in itertools.combinations(range(n), h)]
        least = min(subsets, key=lambda s: np.linalg.slogdet(np.cov(x[s].T))[1])
        assert fits[g]["n"] == h and np.allclose(fits[g]["m"], x[least].mean(axis=0), atol=1e-6), g


def test_small_groups_lean_on_their_language(spark):
    rng, d = np.random.default_rng(9), outliers.D
    rows = [row("l", None, x) for x in rng.normal(0, 2, (1500, d))] + [row("l-few", "l", x) for x in rng.normal(1, 0.01, (3, d))] + [row("l-many", "l", x) for x in rng.normal(1, 5, (1500, d))]
    f = {r["grp"]: r for r in outliers.fit(spark.createDataFrame(rows, ROWS)).collect()}
    assert set(f) == {"l", "l-few", "l-many"}
    assert all(0.5 * f["l"]["v"][i] < f["l-few"]["v"][i] < 1.1 * f["l"]["v"][i] and abs(f["l-few"]["m"][i]) < 0.4 for i in range(d))
    assert all(15 < f["l-many"]["v"][i] < 40 and 0.5 < f["l-many"]["m"][i] < 1.5 for i in range(d))


def test_constant_groups_ties_and_long_texts(spark):
    same = "alpha beta gamma delta " * 3 + " ".join(f"w{i}" for i in range(90))
    rows = [(i, same, "en", "s") for i in range(60)] + [(100, " ".join(f"word{i}" for i in range(60_000)), "en", "long"), (101, same, None, None), (101, same, None, None)]
    got = {r["doc_id"]: r for r in outliers.judge(spark.createDataFrame(rows, "doc_id int, text string, lang string, source string")).collect()}
    assert all(got[i]["kept"] and got[i]["distance"] < 1 for i in range(60)) and got[101]["kept"] and got[100]["n_words"] == 60_000


def test_outlier_query(spark, tmp_path):
    rng = random.Random(13)
    rows = [(i, " ".join(f"{rng.choice('abc')}{rng.randrange(99)}" for _ in range(rng.randrange(30, 90))), rng.choice(["en", None]), f"s{i % 4}") for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = outliers.op6_robust_outliers(spark, str(tmp_path))
    wanted = {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"}
    assert {k: v for k, v in got.dtypes if k in wanted} == wanted
    for r in got.collect():
        counts = brute_stats(rows[r["doc_id"]][1])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts
        assert r["base_failed"] == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0]) and not (r["base_failed"] and r["kept"])


def test_quality_query(spark, tmp_path):
    rng = random.Random(14)
    texts = [prose(rng) if i % 3 else junk(rng) for i in range(400)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(380)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got = quality.op5_rule_ensemble(spark, str(tmp_path))
    assert dict(got.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    rows = got.collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 400 and sum(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held) / len(held) > 0.95


def brute_top(vectors, k):
    whole = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in whole:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_top_k_equals_brute_force(spark):
    rng = random.Random(5)
    same = [rng.gauss(0, 1) for _ in range(20)]
    vectors = [(i, same if i % 3 == 0 else [rng.gauss(0, 1) * (i % 7) for _ in range(20)]) for i in range(400)]
    vectors += [(400, None), (450, [None] * 20), (451, [float("nan")] * 20), (452, [float("inf")] * 20), (500, [1.0, 2.0]), (501, [3.0, 1.0]), (None, same), (550, [])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash")).repartition(5)
    rows = topk.usable(df, "vec_id", "embedding")
    got = topk.top_k(rows.filter("id % 50 = 0"), rows, block=64, query_block=5)
    assert sorted(map(tuple, got.collect())) == brute_top(vectors, 5)
    none = rows.limit(0)
    assert topk.top_k(none, none).count() == 0


def test_large_components_are_exact(spark):
    vectors = [(0, [1.0, 2.0]), (50, [2.0, 1.0]), (51, [2e12, 1.0]), (52, [2e12, 1.0 + 2**-8]), (53, [3e8, -3e8]), (100, [-3.0, 5.0])]
    rows = topk.usable(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    got = topk.top_k(rows.filter("id % 50 = 0"), rows).collect()
    whole = {i: [math.floor(256 * x) for x in v] for i, v in vectors}
    wanted = []
    for q in (0, 50, 100):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)[:5]
        wanted += [(q, r, i, -x) for r, (x, i) in enumerate(best, 1)]
    assert sorted(map(tuple, got)) == sorted(wanted) and [w[2] for w in wanted if w[1] == 1] == [52, 52, 0]
    huge = topk.usable(spark.createDataFrame([(0, [1e13]), (1, [1e13])], "vec_id long, embedding array<double>"), "vec_id", "embedding")
    with pytest.raises(Exception, match="beyond the range of long"):
        topk.top_k(huge, huge).collect()


def test_bounds_drop_most_candidates_of_structured_vectors():
    rng = np.random.default_rng(10)
    steps = np.cumsum(rng.normal(0, 1, (4000, 64)), axis=1)  # smooth vectors, as of time series
    v = np.floor(256 * steps)
    q, told = v[::50], {}
    best = topk.search(np.arange(0, 4000, 50), q, np.arange(4000), v, 5, told=told)
    assert len(best) == 400 and told[1] >= told[4] >= told[16] >= told[32] and told[16] < 0.35 * told["pairs"]
    score = q @ v.T
    score[np.arange(80), np.arange(0, 4000, 50)] = -np.inf
    assert [x[2] for x in best] == [int(x) for row in score for x in sorted(row, reverse=True)[:5]]


def test_bounds_hold():
    rng = np.random.default_rng(6)
    q, v = rng.integers(-500, 500, (5, 64)), rng.integers(-500, 500, (300, 64))
    for parts in topk.RESOLUTIONS:
        bound = np.hstack(topk.segments(q, parts)) @ np.hstack(topk.segments(v, parts)).T
        assert (bound + 1e-6 >= q @ v.T).all()


def test_training_has_one_row_per_id(spark):
    # An id that thousands of rows share is one document to learn from, and a null id is on a side.
    docs = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("some words "), "id").alias("text")).unionByName(spark.createDataFrame([(8, "others"), (None, "none")], "doc_id long, text string"))
    labels = spark.createDataFrame([(7, 1), (7, 0), (8, 0), (9, 1)], "doc_id long, quality int")
    rows = quality.training_rows(docs, labels, 10).collect()
    assert len(rows) == 2 and sorted(r["label"] for r in rows) == [0.0, 1.0]
    assert quality.training_rows(docs, labels, 1).count() <= 1
    told = {r["doc_id"]: r["h"] for r in docs.select("doc_id", quality.held_out().alias("h")).distinct().collect()}
    assert told[None] is False and None not in told.values()
