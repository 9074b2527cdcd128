"""What reviews found wrong."""

import pytest
from pyspark.sql import functions as F

from procure_spark.functions import text as T
from procure_spark.operators import match, rules, select
from procure_spark.plans import jobs
from procure_spark.sources.html import Page, page_specs


def test_equal_general_requirements(spark):
    items = spark.createDataFrame([(1, ["a", "r2"])], "d int, cs array<string>")
    reqs = spark.createDataFrame([(1, 1, "r1"), (1, 2, "r1"), (1, 3, "r2"), (1, 4, "r3")], "d int, i int, r string")
    got = lambda **k: match.attach_general(items, reqs, "d", "cs", "r", "i", **k).first()["cs"]
    assert got() == ["a", "r2", "r1", "r1", "r3"]
    assert got(once=True, most=3) == ["a", "r2", "r1", "r3"]


def test_references_that_are_cut():
    page = Page("<h1 title='?a=1&copy=2&amp;b'>a &amp; &quot;b&#33;&#x21; &ampx; &foo; c&am &copy d&amp</h1>")
    assert page.text(page.elements[0]) == 'a & "b!! &ampx; &foo; c&am &copy d&amp'
    assert page.elements[0]["attrs"]["title"] == "?a=1&copy=2&b"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("score", [lambda c: rules.fragment_relevance(c, F.lit("spec")), rules.requirement_score, rules.has_product_signals])
def test_texts_are_normalized_once(spark, score):
    df = spark.createDataFrame([("Мембрана  5 мм: толщина",)], "t string").select(score(F.col("t")).alias("s"))
    assert 1 <= plan(df).count(r"regexp_replace(") <= 2 and df.first()["s"] > 0


def test_blocks_are_scored_before_they_are_rows(spark):
    docs = spark.createDataFrame([("t", "a", "the one\n\nnone\n\nthe two"), ("t", "b", "the three")], "g string, n string, t string")
    found = jobs.matching_text(docs, "g", "n", "t", 1000, 3500, [("spec", [""])], [("any", ["the"], 1)], ["spec"])
    assert found.first()["matching_text"] == "the one\n\nthe two\n\nthe three" and found.first()["blocks"] == 3
    parts = jobs._matching_parts(docs, "g", "n", "t", 3500, [("spec", [""])], [("any", ["the"], 1)], ["spec"])
    assert [r["pos"] for r in parts.orderBy("n", "pos").collect()] == [0, 2, 0] and plan(parts).count("substring(lambda") == 1


def test_a_prefix_by_parts(spark):
    rows = spark.range(5000).select((F.col("id") % 2).alias("g"), "id", (F.xxhash64("id") % 50 + 50).alias("n"))
    whole, parts = (select.take_budget_prefix(rows, ["g"], [F.desc("n"), F.col("id")], F.col("n"), 9000, by) for by in ((), ["id"]))
    assert whole.count() > 100 and sorted(whole.collect()) == sorted(parts.select(whole.columns).collect())


def test_a_line_is_looked_at_once(spark):
    docs = spark.createDataFrame([(1, "Спецификация\nКирпич М1 | прочность не менее 100 | 5 упак")], "d int, text string")
    found = jobs.extract_requirements(docs, "d")
    assert found.first()["quantity"] == "5" and plan(found).count("окпд2") <= 2
    parts = spark.createDataFrame([("a | мембрана 5 мм |",)], "t string").select(T.clean_query(F.col("t")).alias("q"))
    assert parts.first()["q"] == "мембрана 5 мм" and plan(parts).count("trim(") <= 6


def test_alternatives_by_first_letters():
    assert T.any_pattern([r"\bшт", r"\bраз"]) == r"(?U)(?=[рш])\b(?:шт|раз)"
    assert T.any_pattern([r"\bшт|раз"]) == r"(?U)\bшт|раз" and T.any_pattern(["a", "b"]) == "(?U)a|b"


def test_pages_and_reports_are_dealt_out(spark):
    pages = spark.range(100).select(F.col("id").cast("string").alias("url"), F.lit("<li>a: b</li>").alias("html")).coalesce(1)
    assert page_specs(pages).rdd.getNumPartitions() >= 16 and page_specs(pages).count() == 100
    report = spark.createDataFrame([("x\n## 1. y | z\n| 1 | 2 |",)], "t string").select(T.repair_report(F.col("t")).alias("t"))
    assert plan(report).count("## ") <= 3 and report.first()["t"].endswith("x\n## 1. y\n| z |\n| --- |\n| 1 | 2 |")


def test_shared_offers_meet_queries_once(spark):
    words = ["tar", "roll", "felt", "12", "roofing"]
    rows = [(i, i % 3, f"{words[i % 5]} {words[i * 7 % 4]} {words[i // 3 % 5]}{' ' * (i % 2)}") for i in range(90)]
    offers = spark.createDataFrame([(*r, r[0] % 100) for r in rows] + [(90, None, "tar", 1)], "k int, g int, title string, points int")
    asked = spark.createDataFrame([(i, i % 4) for i in range(12)] + [(12, None)], "q int, g int")
    local = spark.createDataFrame([(i, words[i % 5] + " roll") for i in range(9)], "q int, title string")
    plain = match.dedup_sources(local, offers.join(asked, "g").drop("g"), "q", "title", "k").select("q", "k", "title", "points")
    shared = match.dedup_shared_sources(local, asked, offers, "q", ["g"], "title", "k").select("q", "k", "title", "points")
    assert sorted(plain.collect()) == sorted(shared.collect()) and plain.count() > 20


def test_rows_made_for_a_search_follow_its_texts(spark, monkeypatch):
    # 3,000 parts of 12 texts, 1,000 queries of 4: what is written on the way holds no row per pair of a query and an offer.
    parts = spark.range(3000).select(F.col("id").alias("k"), F.concat(F.lit("roofing felt "), F.col("id") % 12).alias("title"), F.concat(F.lit("kind "), F.col("id") % 3).alias("kind"), (F.col("id") % 2).alias("g"))
    asked = spark.range(1000).select(F.col("id").alias("q"), F.concat(F.lit("felt a"), F.col("id") % 4).alias("query"), (F.col("id") % 2).alias("g"))
    offers = parts.select("g", "k", F.concat("kind", F.lit(" offered "), F.col("k") % 12).alias("title"), F.lit(1).alias("analog_score"))
    sizes, real = {}, match.written

    def counted(df, name):
        found = real(df, name)
        sizes[name] = max(sizes.get(name, 0), found.count())
        return found

    monkeypatch.setattr(match, "written", counted)
    found = jobs.match_analogs(asked, parts, offers, "q", "query", "k", "title", ["title", "kind"], 5, by=["g"]).select("q", "k", "title", "analog_score", "source", "rank")
    rows = {q: sorted((r["rank"], r["k"], r["title"], r["source"]) for r in found.filter(F.col("q") == q).collect()) for q in (0, 1)}
    assert sizes["search-texts"] == 12 * 5 and sizes["shared-offers"] == 12 and sizes["j03-titles"] < 100
    plain = jobs.match_analogs(asked, parts, offers.join(asked.select("q", "g"), "g").drop("g"), "q", "query", "k", "title", ["title", "kind"], 5).filter("q < 2")
    assert rows == {q: sorted((r["rank"], r["k"], r["title"], r["source"]) for r in plain.filter(F.col("q") == q).collect()) for q in (0, 1)} and len(rows[0]) == 8
