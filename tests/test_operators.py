"""Golden rows of the row-producing operators and jobs."""

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from procure_spark.operators import facts, match, merge, rollup, rules, select, split, upsert
from procure_spark.plans import jobs
from procure_spark.sources import html, tables
from procure_spark.sources.versions import read_version


def test_markdown_tables_pad_rows(spark):
    df = spark.createDataFrame([(1, "x\n| a | b |\n|---|---|\n| 1 |\ny\n| z |")], "id int, text string")
    got = split.markdown_tables(df).orderBy("table_no", "row_no").select("table_no", "row_no", "cells").collect()
    assert [tuple(r) for r in got] == [(1, 1, ["a", "b"]), (1, 2, ["1", ""]), (2, 1, ["z"])]


def test_blocks_are_repacked_by_lines(spark):
    text = "короткий\n\n" + "\n".join(["я" * 30] * 5)
    got = split.split_blocks(spark.createDataFrame([(text,)], "text string"), large=100, repack=70).select("block").collect()
    assert [len(r[0]) for r in got] == [8, 61, 61, 30]


def test_sections_of_a_text(spark):
    rows = [(1, i, t) for i, t in enumerate(["вступление", "Спецификация", "кирпич", "штраф", "проект договора", "конец"])]
    df = spark.createDataFrame(rows, "d int, i int, t string")
    from procure_spark import lexicons as L

    got = select.select_sections(df, ["d"], ["i"], "t", *(f"(?U){'|'.join(p)}" for p in (L.SECTION_STARTS, L.SECTION_ENDS, L.EXCLUDED_SECTIONS)))
    assert [r["i"] for r in got.orderBy("i").collect()] == [1, 2, 4]


def test_facts_with_provenance(spark):
    docs = [("t", "a.docx", "success", "НМЦК: 1 200 000,50 руб. Аванс составляет 30 %. Оплата в течение 15 рабочих дней. Поставка эквивалента допускается."), ("t", "b.docx", "error", None)]
    got = facts.extract_facts(spark.createDataFrame(docs, "g string, f string, s string, t string"), "g", "f", "t", "s").collect()
    by = {r["value_type"]: r for r in got}
    assert by["nmcc"]["value_num"] == 1200000.5 and by["nmcc"]["fragment"].startswith("НМЦК")
    assert by["advance_percent"]["value_num"] == 30.0 and by["payment_days"]["value_num"] == 15.0
    assert by["policy"]["value_raw"] == "allowed" and by["status"]["value_raw"] == "error"


def test_match_offsets_equal_a_regex_walk(spark):
    import re

    text = "аб12 в3, 456 г"
    got = spark.createDataFrame([(text,)], "t string").select(facts.matches(F.col("t"), r"(\d+)")).first()[0]
    assert [(m["start"] - 1, m["match"]) for m in got] == [(m.start(), m[0]) for m in re.finditer(r"\d+", text)]


def test_contradicting_terms_conflict(spark):
    rows = [("t", 1, "nmcc_prices", "100", "high", "ok"), ("t", 2, "nmcc_prices", "200", "high", "ok"), ("t", 3, "payment", "Аванс", "low", "ok"), ("t", 4, "payment", "аванс 2", "high", "conflict")]
    got = {r["topic"]: r for r in merge.reconcile(spark.createDataFrame(rows, "g string, seq int, topic string, value_raw string, confidence string, status string"), "g", ["nmcc_prices", "payment", "subject"]).collect()}
    assert got["nmcc_prices"]["merge_mode"] == "conflict" and got["nmcc_prices"]["values"] == ["100", "200"]
    assert got["payment"]["values"] == ["аванс 2", "Аванс"] and got["payment"]["conflict_flag"]
    assert got["subject"]["merge_mode"] == "not_found" and got["subject"]["values"] == []


def test_greedy_budget_skips_and_goes_on(spark):
    rows = [("t", i, n, why) for i, n, why in [(1, 60, None), (2, 50, None), (3, 40, None), (4, 5, "archive"), (5, 1, None)]]
    got = select.take_budget_greedy(spark.createDataFrame(rows, "g string, k int, n int, w string"), ["g"], "k", ["k"], "n", 100, F.col("w"))
    assert {r["k"]: r["reason"] for r in got.collect()} == {1: None, 2: "over_budget", 3: None, 4: "archive", 5: "over_budget"}


def test_upsert_keeps_blank_descriptions_and_first_rows(spark):
    cur = spark.createDataFrame([("u1", "A", "old")], "url string, title string, description string")
    new = spark.createDataFrame([("u1", "B", ""), ("u2", "C", "c"), ("u2", "D", "d"), ("", "E", "e"), (None, "F", "f")], cur.schema)
    got = {r["url"]: tuple(r)[1:] for r in upsert.upsert(cur, new, "url", "title", ["description"]).collect()}
    assert got == {"u1": ("B", "old", "updated"), "u2": ("C", "c", "created")}


def test_shadowed_documents(spark):
    df = spark.createDataFrame([("t", "A.doc"), ("t", "a.docx"), ("u", "a.doc")], "g string, n string")
    assert sorted(map(tuple, match.drop_shadowed(df, "g", "n").select("g", "n").collect())) == [("t", "a.docx"), ("u", "a.doc")]


def test_triple_check_verdicts(spark):
    req = spark.createDataFrame([("a", ">=", 5.0), ("b", "<=", 5.0), ("c", "=", 5.0), ("d", ">=", 5.0)], "item string, comparator string, value double")
    claim = spark.createDataFrame([("a", 6.0), ("b", 6.0), ("c", 5.0)], "item string, value double")
    real = spark.createDataFrame([("a", 4.0), ("c", 5.0)], "item string, value double")
    got = match.triple_check(req, claim, real, ["item"])
    assert {r["item"]: r["verdict"] for r in got.collect()} == {"a": "FAKE", "b": "FAIL", "c": "OK", "d": "MISSING"}
    assert match.triple_score(got.withColumn("t", F.lit(1)), ["t"]).first()["score"] == 25.0


def test_analog_scores(spark):
    rows = [("техноэласт эпп 4,0 мм", "Техноэласт ЭПП 4,2 мм", "Кровля", {"толщина": "4,2 мм"}), ("техноэласт эпп", "Мастика ХПП", "Кровля", {})]
    got = match.score_analogs(spark.createDataFrame(rows, "q string, t string, c string, s map<string,string>"), "q", None, "t", "c", specs="s").collect()
    assert got[0]["analog_score"] == 30 + 25 + 18 and "close thickness" in got[0]["reasons"]
    assert got[1]["analog_score"] == 0 and "other mark" in got[1]["reasons"]


def test_rules(spark):
    df = spark.createDataFrame([("Техноэласт ЭПП рулон 10 м2",), ("оплата в течение 10 дней",), ("",), ("Кирпич",)], "t string")
    assert [r[0] for r in df.select(rules.has_product_signals(F.col("t"))).collect()] == [True, False, False, False]
    assert [r[0] for r in df.select(rules.fragment_type(F.col("t"))).collect()] == ["OTHER", "CONTRACT_TERMS", "OTHER", "OTHER"]
    assert [r[0] for r in df.select(rules.is_material_name(F.col("t"))).collect()] == [True, False, False, True]
    chars = spark.createDataFrame([(["Толщина 4 мм", "просто", "толщина 4 мм", "не менее 5"],)], "a array<string>")
    assert chars.select(rules.characteristics(F.col("a"))).first()[0] == ["Толщина 4 мм", "не менее 5"]


def test_reports(spark):
    text = "## 0. Карточка\n| а |\n## 1. Риски\nтекст\n| т |\nещё\n## 2. Конец" + "x" * 500
    df = spark.createDataFrame([(text,), ("мало",)], "r string")
    got = rollup.validate_reports(df, "r", ["## 0. Карточка", "## 1. Риски"], ["## 0. Карточка"]).collect()
    assert [r["report_status"] for r in got] == ["success", "error"]
    assert rollup.report_summary(df, "r", "## 1. Риски", "## 2. Конец").first()["summary"] == "текст\nещё"


TITLE = "# Юридическое заключение по тендеру"


def test_reports_are_repaired(spark):
    from procure_spark.functions import text as T

    rows = [
        (None, f"{TITLE}\n\nОтчет не сформирован."), (" \r\n", f"{TITLE}\n\nОтчет не сформирован."), ("текст", f"{TITLE}\n\nтекст"),
        (f"мусор {TITLE}\n\n\n\nа ## 1. Риски | х | у |\n| 1 || 2\nконец", f"{TITLE}\n\nмусор\n{TITLE}\n\nа\n## 1. Риски\n| х | у |\n| --- | --- |\n| 1 | 2 |\nконец"),
        (f"x{TITLE}\nа\n{TITLE}\nб## Краткое резюме", f"{TITLE}\n\nа\nб\n## Краткое резюме"),
        (f"{TITLE}\n| a | b |\n|---|:---:|\n|1|2|\n\n| одна |", f"{TITLE}\n| a | b |\n| --- | :---: |\n| 1 | 2 |\n\n| одна |\n| --- |"),
    ]
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string").select("i", T.repair_report(F.col("t")).alias("r")).collect()
    assert {r["i"]: r["r"] for r in got} == {i: w for i, (_, w) in enumerate(rows)}


def test_sources_are_united(spark):
    from procure_spark.functions import text as T

    rows = [("a.docx", " 1 ", "spec", "x" * 600), ("A.DOCX", "1", "Spec", "X" * 600), (None, "2", "spec", " "), (None, None, None, "б  в"), ("b", None, None, None)]
    schema = "s array<struct<file:string,page_or_sheet:string,fragment_type:string,evidence:string>>"
    got = [r[0] for r in spark.createDataFrame([(rows,), (None,), ([],)], schema).select(T.distinct_sources(F.col("s"))).collect()]
    assert [tuple(x) for x in got[0]] == [("a.docx", "1", "spec", "x" * 500), ("", "", "", "б в"), ("b", "", "", "")] and got[1] == got[2] == []


def test_requirement_extraction(spark):
    text = "Вступление\nТехническое задание\nКирпич красный | 1 200 | шт | прочность не менее 100\nМастика битумная 20 кг\nСертификат обязателен\nПроект договора\nШтраф 1 %"
    docs = spark.createDataFrame([("d", text)], "doc string, text string")
    got = {r["position_name"]: r for r in jobs.extract_requirements(docs, "doc").collect()}
    brick = got["Кирпич красный"]
    assert brick["quantity"] is not None or brick["confidence"] == 0.74
    assert "прочность не менее 100" in brick["characteristics"] and "Сертификат обязателен" in brick["characteristics"]
    assert got["Мастика битумная 20 кг"]["quantity"] == "20" and got["Мастика битумная 20 кг"]["confidence"] == 0.76


def test_pages(spark):
    product = "<body><div class='breadcrumb'><a>Главная</a><a>Кровля</a><a>Рулон</a></div><h1>Техноэласт</h1><p>120,50 р./м2 РОЗН</p><table><tr><td>Толщина</td><td>4 мм</td></tr><tr><td>Масса</td><td>5</td></tr></table><div class='description'>Описание</div></body>"
    found = html.page_products(spark.createDataFrame([("https://a.ru/p", product)], "url string, html string")).first()
    assert (found["title"], found["category"], found["price"], found["description"]) == ("Техноэласт", "Кровля / Рулон", 120.5, "Описание")
    assert found["specs"] == {"Толщина": "4 мм", "Масса": "5"}
    card = "<div class='search-registry-entry-block'><a href='/epz/order/notice/ea44/view/common-info.html?regNumber=0123'>Поставка кирпича</a><a href='/x/printForm/view.html?regNumber=0123'>п</a><div>Начальная цена 1 000,00 ₽ Окончание подачи заявок 05.03.2024</div></div>"
    notice = html.page_notices(spark.createDataFrame([("https://z.ru/s", card)], "url string, html string")).first()
    assert (notice["reg"], notice["ntype"], notice["title"], notice["price"], notice["deadline"]) == ("0123", "ea44", "Поставка кирпича", "1 000,00", "05.03.2024")
    files = "<a href='/filestore/x?uid=1' title='тз.docx'>скачать</a><a href='/filestore/y?uid=1'>ещё</a><a href='/filestore/x.sig?uid=1'>подпись</a>"
    links = html.page_attachments(spark.createDataFrame([("https://z.ru/d", files)], "url string, html string"))
    paired = match.with_signatures(links, "uid", "kind", "href").collect()
    assert len(paired) == 1 and paired[0]["signature"].endswith(".sig?uid=1")


def test_long_tables_and_selectors(spark):
    page = html.Page("<div class='a'><p id='x'>1<b>2</b></p><div class='a b'><p>3</p></div></div><p>4</p><div class='a'><p>5<br>6")
    texts = lambda selector: [page.text(e) for e in page.select(selector)]
    assert texts("p") == ["12", "3", "4", "56"] and texts(".a p") == ["12", "3", "56"] and texts("div.a.b p") == ["3"]
    assert texts("#x b") == ["2"] and texts(".a .a p") == ["3"] and texts(".c p") == [] and page.all("p", within=page.select(".b")[0])[0]["at"] == 4
    rows = "".join(f"<tr><td>k{i}:</td><td>v{i}</td><td>x</td></tr>" for i in range(50_000))
    found = html.page_specs(spark.createDataFrame([("u", f"<table>{rows}</table>"), ("none", "<p>x</p>"), ("null", None)], "url string, html string")).collect()
    assert len(found) == 1 and len(found[0]["specs"]) == 50_000 and found[0]["specs"]["k49999"] == "v49999"
    felt = "<body><div class='breadcrumb'><a>Рулонные</a></div><h1>Рубероид</h1><p>10 р./м2</p></body>"
    kinds = [(r["title"], r["material_type"], r["specs"]) for r in html.page_products(spark.createDataFrame([("u", felt), ("v", "<h1>Лак</h1>")], "url string, html string")).collect()]
    assert sorted(kinds) == [("Лак", "Гидроизоляция", None), ("Рубероид", "Рулонный", None)]


def test_tenders_are_stored_once(spark, tmp_path):
    path, row = str(tmp_path / "crm"), ("1", "a", 1.0, "", None, None, None, "44-ФЗ", "", "")
    schema = StructType.fromDDL(jobs.CRM)
    stored = lambda: sorted(map(tuple, read_version(spark, path, schema).collect()))
    rejected = jobs.store_tenders(spark.createDataFrame([row, ("2", " ", *row[2:]), (None, "x", *row[2:])], schema), path, 1)
    assert rejected.count() == 2 and stored() == [("1", "a", 1.0, "", "Found", "Low", "РФ", "44-ФЗ", "", "")]
    jobs.store_tenders(spark.createDataFrame([("1", "b", 2.0, "", "Won", None, None, "44-ФЗ", "", ""), ("3", "c", *row[2:])], schema), path, 2)
    after = [("1", "b", 2.0, "", "Won", "Low", "РФ", "44-ФЗ", "", ""), ("3", "c", 1.0, "", "Found", "Low", "РФ", "44-ФЗ", "", "")]
    assert stored() == after
    jobs.store_tenders(spark.createDataFrame([("1", "b", 2.0, *row[3:]), ("3", "c", *row[2:])], schema), path, 3)
    assert stored() == after


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "t1").mkdir()
    (tmp_path / "t1" / "A.PDF").write_bytes(b"12345")
    got = tables.list_package(spark, str(tmp_path)).first()
    assert (got["tender"], got["name"], got["size"], got["ext"]) == ("t1", "A.PDF", 5, "pdf")
    reports = spark.createDataFrame([("t1", "success", "x" * 400), ("t2", "success", "x"), ("t3", "error", "x" * 400)], "tender_id string, status string, report string")
    tables.write_reports(reports, str(tmp_path / "r"))
    assert [r["tender_id"] for r in spark.read.parquet(str(tmp_path / "r")).collect()] == ["t1"]
    tables.export_catalog(reports, str(tmp_path / "j.json"))
    assert tables.load_catalog(spark, str(tmp_path / "j.json")).first()["specs"] == {}
