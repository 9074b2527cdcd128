"""Groups that hold nearly all rows, against plain Python."""

import random

from pyspark.sql import functions as F

from procure_spark.operators import match, select, split


def fold(local, external):
    seen, out = [t.strip().lower() for t in local], []
    for s, t in sorted(external):
        t = t.strip().lower()
        if not any(t[:15] in k or k[:15] in t for k in seen):
            seen.append(t)
            out.append((s, t))
    return out


def sources(spark, local, external):
    df = lambda rows: spark.createDataFrame(rows, "q int, s long, title string")
    ours, theirs = df([(1, None, t) for t in local]), df([(1, s, t) for s, t in external])
    return sorted((r["s"], r["title"].strip().lower()) for r in match.dedup_sources(ours, theirs, "q", "title", "s").collect())


def test_titles_equal_a_fold(spark):
    rng = random.Random(1)
    title = lambda: " ".join(rng.choice(["tar", "Roll", "felt", "12", "mm", "roofing", "x"]) for _ in range(rng.randrange(1, 7)))
    for n in (40, 150):
        external = [(i, title() + rng.choice(["", " ", "ed"])) for i in range(n)]
        local = [title() for _ in range(3)]
        assert sources(spark, local, external) == fold(local, external)
    # A blank title is held by every other one; without any title before it, it is kept alone.
    assert sources(spark, [], [(1, " "), (2, "felt")]) == [(1, "")] and sources(spark, ["roll"], [(1, ""), (2, "felt")]) == [(2, "felt")]
    nulls = spark.createDataFrame([(None, 1, "felt"), (None, 2, "felt roll"), (3, 2, "felt")], "q int, s long, title string")
    assert sorted(map(str, (tuple(r) for r in match.dedup_sources(nulls.limit(0), nulls, "q", "title", "s").collect()))) == ["(3, 2, 'felt')", "(None, 1, 'felt')"]


def test_a_group_of_100000_titles(spark):
    # A third begins alike, so that all pairs of them would resemble each other; others are found in one another.
    rows = spark.range(100_000).select(
        F.lit(1).alias("q"), F.col("id").alias("s"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("the same beginning "), F.col("id"))).otherwise(F.concat(F.lit("t"), F.sha2(F.col("id").cast("string"), 256))).alias("title"),
    )
    kept = match.dedup_sources(rows.limit(0), rows, "q", "title", "s")
    assert kept.count() == 1 + 66_666 and kept.filter("s % 3 = 0").first()["s"] == 0


def greedy(rows, budget):
    used, out = 0, {}
    for order, key, n in sorted(rows):
        out[key] = None if used + n <= budget else "over_budget"
        used += n if used + n <= budget else 0
    return out


def test_budget_equals_a_fold(spark):
    rng = random.Random(2)
    for most in (40, 400):
        rows = [(rng.randrange(20), i, rng.choice([0, rng.randrange(most), 200 - i])) for i in range(190)]
        df = spark.createDataFrame(rows, "o int, k int, n int").withColumn("g", F.lit("one"))
        got = {r["k"]: r["reason"] for r in select.take_budget_greedy(df, ["g"], "k", ["o"], "n", 700).collect()}
        assert got == greedy(rows, 700)
    # One row is taken and one dropped in each step.
    rows = [(0, i, 1 if i % 2 == 0 else 100 - i // 2) for i in range(60)]
    got = {r["k"]: r["reason"] for r in select.take_budget_greedy(spark.createDataFrame(rows, "o int, k int, n int").withColumn("g", F.lit(1)), ["g"], "k", ["o"], "n", 100).collect()}
    assert got == greedy(rows, 100)


def test_a_group_of_a_million_rows(spark):
    df = spark.range(1_000_000).select(F.lit("one").alias("g"), F.col("id").alias("k"), (F.xxhash64("id") % 50 + 60).alias("n"))
    got = select.take_budget_greedy(df, ["g"], "k", ["k"], "n", 4_000_000)
    assert got.count() == 1_000_000
    used = got.filter("reason is null").join(df, ["g", "k"]).agg(F.sum("n")).first()[0]
    assert 4_000_000 - 110 <= used <= 4_000_000


def test_a_text_of_20_mb_is_packed(spark):
    line = "x" * 39
    long = spark.range(1).select(F.array_join(F.array_repeat(F.lit(line), 500_000), "\n").alias("text"))
    got = split.pack_paragraphs(long).agg(F.count("*"), F.max("pos"), F.min(F.length("piece")), F.max(F.length("piece")), F.sum(F.length("piece"))).first()
    assert tuple(got) == (-(-500_000 // 35), -(-500_000 // 35) - 1, (500_000 % 35) * 40 - 1, 1399, 500_000 * 40 - -(-500_000 // 35))
