"""Domain functions over texts built from the driver's tables, sources, jobs and streams."""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procure_spark.functions import text as T
from procure_spark.operators import facts, match, merge, rules
from procure_spark.operators.rollup import report_summary
from procure_spark.operators.split import markdown_tables, table_preview
from procure_spark.plans.jobs import matching_text
from procure_spark.queries.text import BLOCKS
from procure_spark.registry import query, read, shared_dir, spread
from procure_spark.sources.html import page_products
from procure_spark.sources.tables import load_pages
from procure_spark.streaming.jobs import stream_job_progress, stream_new_notices


@query("SELECT url, html FROM pages")
def s03_load_pages(spark: SparkSession, d: str) -> DataFrame:
    return load_pages(spark, f"{d}/pages.parquet")


def by_key(*variants: Column | str) -> Column:
    """The variant that a part's key picks."""
    k = F.col("p_partkey") % len(variants)
    out = F.when(k == 0, variants[0])
    for i, v in enumerate(variants[1:], 1):
        out = out.when(k == i, v)
    return out


def said(*parts: str | Column) -> Column:
    """Parts put together; strings that name a column of part are columns."""
    return F.concat(*[p if isinstance(p, Column) else F.col(p).cast("string") if p in ("p_partkey", "p_name", "p_size", "p_brand", "p_type") else F.lit(p) for p in parts])


@query("SELECT p_partkey, (CASE p_partkey % 5 WHEN 0 THEN 10 * p_size + 0.5 WHEN 1 THEN p_size WHEN 2 THEN 0 WHEN 3 THEN p_size ELSE p_size + 0.25 END)::DOUBLE AS price FROM part")
def c02_catalog_price(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size")
    text = by_key(F.concat(F.lit("1 р./шт "), n * 10, F.lit(",5 р./м2 РОЗН")), said("цена ", "p_size", " р./шт, опт 3 р./м2"), said("p_size", " руб"), said("p_size", " р./м2 РОЗН"), said("2 р./м 3 шт ", "p_size", ".25 Р./кг розн"))
    return read(spark, d, "part").select("p_partkey", T.catalog_price(text).alias("price"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN '***' ELSE p_name END AS query FROM part")
def c06_clean_query(spark: SparkSession, d: str) -> DataFrame:
    raw = by_key(said("Наименование | ", "p_name", " (шт)* ГОСТ 12-", "p_partkey", " | a.docx |"), said("p_name", " (2,5 кг)"), said("/", "p_name", " ТУ 5774-003 "), said("p_name", " (не указано)*"), F.lit("***"))
    return read(spark, d, "part").select("p_partkey", T.clean_query(raw).alias("query"))


@query("SELECT p_partkey, p_name || CASE p_partkey % 4 WHEN 0 THEN ' сталь' WHEN 3 THEN ' брус' ELSE '' END AS query FROM part")
def c08_norm_query(spark: SparkSession, d: str) -> DataFrame:
    raw = by_key(said("p_partkey", ". ", "p_name", " | сталь или эквивалент тз.docx стр. 3"), said("p_name", " аналог"), said("3.1) ", "p_name", " - "), said("p_name", "|брус"))
    return read(spark, d, "part").select("p_partkey", T.norm_query(raw).alias("query"))


@query("SELECT p_partkey, p_name AS name FROM part")
def c09_norm_name(spark: SparkSession, d: str) -> DataFrame:
    raw = by_key(said("p_partkey", ") ", "p_name", " или эквивалент, цена ", F.col("p_retailprice")), said("p_name", " количество 5 шт"), said("Эквивалент ", "p_name"), said("12 ", "p_name", ";"), said("p_name", " : ОКПД2 23.99\nещё"))
    return read(spark, d, "part").select("p_partkey", T.norm_name(raw).alias("name"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 2 THEN '1234.5' WHEN 3 THEN NULL ELSE p_size::VARCHAR END AS quantity,
 CASE p_partkey % 6 WHEN 0 THEN 'шт' WHEN 1 THEN 'м2' WHEN 2 THEN 'кг' WHEN 3 THEN NULL ELSE 'мм' END AS unit FROM part""")
def c11_qty_unit(spark: SparkSession, d: str) -> DataFrame:
    raw = by_key(said("p_name", " ", "p_size", " шт"), said("p_name", " ", "p_size", "м2"), said("p_name", " 1 234,5 кг"), said("p_name", " ", "p_size"), said("p_name", " не менее ", "p_size", " мм"), said("№ ", "p_size", " мм и 7 шт"))
    return read(spark, d, "part").select("p_partkey", T.qty_unit(raw).alias("q")).select("p_partkey", "q.quantity", "q.unit")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size / 10 WHEN 1 THEN p_size + 0.5 END::DOUBLE AS thickness, CASE WHEN p_partkey % 4 IN (0, 2) THEN -p_size END::DOUBLE AS flexibility,
 CASE p_partkey % 4 WHEN 1 THEN 4.5 WHEN 3 THEN p_size END::DOUBLE AS mass FROM part""")
def c12_measure(spark: SparkSession, d: str) -> DataFrame:
    tenth = F.regexp_replace((F.col("p_size") / 10).cast("string"), "\\.", ",")
    raw = by_key(said("Толщина: ", tenth, " мм; гибкость -", "p_size", " °C"), said("лист ", "p_size", ".5 мм, 4,5 кг/м2"), said("гибкость не выше -", "p_size"), said("Масса ", "p_size", " и всё"))
    return read(spark, d, "part").select("p_partkey", *[T.measure(raw, m).alias(m) for m in ("thickness", "flexibility", "mass")])


@query(r"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^a-zа-я0-9.,+\-]+', ' ', 'g'), '[^a-zа-я0-9]+'), lambda w: w IN ('the', 'of', 'und')))), ',') AS marks FROM documents""")
def c13_marks(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.array_join(T.marks(F.col("text"), ["the", "of", "und"]), ",").alias("marks"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || '_a.docx' WHEN 1 THEN 'a_b_' || p_name WHEN 2 THEN 'тз.docx' ELSE substr(repeat(p_name || 'x', 30), 1, 180) END AS name FROM part")
def c21_repair_filename(spark: SparkSession, d: str) -> DataFrame:
    misread = "тз".encode().decode("latin-1")
    raw = by_key(said("p_name", "?a.docx. "), said(" a/b:", "p_name"), F.lit(f"{misread}.docx"), F.repeat(said("p_name", "x"), 30))
    return read(spark, d, "part").select("p_partkey", T.repair_filename(raw).alias("name"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'тз ' || p_name || '+.pdf' WHEN 1 THEN 'смета ' || p_size || '.xls' WHEN 2 THEN 'тз_' || p_name WHEN 3 THEN p_name || '_b.doc' END AS name FROM part""")
def c38_disposition_filename(spark: SparkSession, d: str) -> DataFrame:
    """Headers whose names are encoded, read as latin-1 from windows-1251 and from UTF-8, plain, and missing."""
    windows, utf8 = "смета".encode("cp1251").decode("latin-1"), "тз".encode().decode("latin-1")
    header = by_key(
        F.concat(F.lit("attachment; filename=\"x.pdf\"; FILENAME* = UTF-8''%D1%82%D0%B7%20"), F.replace("p_name", F.lit(" "), F.lit("%20")), F.lit("+.pdf;a")),
        F.concat(F.lit(f'attachment; filename="{windows} '), "p_size", F.lit('.xls"')), F.concat(F.lit(f"inline;filename={utf8}/"), "p_name"),
        F.concat(F.lit("filename*=UTF-8''%zz; filename = "), "p_name", F.lit("?b.doc .")), F.lit("inline"),
    )
    return read(spark, d, "part").select("p_partkey", T.disposition_filename(header).alias("name"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN p_brand END AS customer, CASE p_partkey % 3 WHEN 0 THEN p_size || ',50' WHEN 1 THEN '1 ' || (100 + p_size) END AS price,
 CASE p_partkey % 3 WHEN 0 THEN '05.03.2024' WHEN 1 THEN '05.03.2024 10:00' ELSE '01.01.2024' END AS deadline FROM part""")
def c28_card_fields(spark: SparkSession, d: str) -> DataFrame:
    body = by_key(
        said("Заказчик: ", "p_brand", " Начальная цена ", "p_size", ",50 ₽ Окончание подачи заявок 05.03.2024 Размещено 01.01.2024"),
        said("заказчик ", "p_brand", " Окончание подачи заявок 05.03.2024 10:00 Начальная цена\n1 ", (F.col("p_size") + 100).cast("string"), " руб."),
        said("Заказчик: Начальная цена ", "p_size", " Размещено 01.01.2024"),
    )
    stops = ["Начальная цена", "Окончание подачи заявок", "Размещено"]
    return read(spark, d, "part").select("p_partkey", T.labelled_field(body, ["Заказчик"], stops).alias("customer"), T.card_price(body, ["Начальная цена"], stops).alias("price"), T.card_deadline(body, ["Окончание подачи заявок"], stops).alias("deadline"))


@query("""SELECT p_partkey, p_name || CASE p_partkey % 3 WHEN 0 THEN ' | толщина ' || p_size || ' мм; масса ' || p_size WHEN 1 THEN '' ELSE ' | длина 1; длина 2; длина 3; длина 4' END AS query FROM part""")
def c32_compose_query(spark: SparkSession, d: str) -> DataFrame:
    chars = by_key(F.array(said("толщина ", "p_size", " мм"), F.lit("цена 5"), said("масса ", "p_size")), F.array(F.lit("цена 5")), F.array(*[F.lit(f"длина {i}") for i in range(1, 7)]))
    return read(spark, d, "part").select("p_partkey", T.compose_query(F.col("p_name"), chars).alias("query"))


@query("SELECT p_partkey, p_name || CASE p_partkey % 4 WHEN 1 THEN ' тз' WHEN 2 THEN chr(10) || chr(10) || 'x' ELSE '' END AS plain FROM part")
def c34_strip_artifacts(spark: SparkSession, d: str) -> DataFrame:
    raw = by_key(said("[FILE: тз] ", "p_name", " стр. 4\n=== ФАЙЛ: x"), said("p_name", " тз.pdf"), said("p_name", "\n\n\n\nx"), said("--- СТРАНИЦА/ЛИСТ: ", "p_size", "\n[CRM_DESCRIPTION_FALLBACK]", "p_name"))
    return read(spark, d, "part").select("p_partkey", T.strip_artifacts(raw).alias("plain"))


@query("""SELECT p_partkey, 1 AS table_no, r AS row_no, CASE r WHEN 1 THEN 'name|size|brand' ELSE p_name || '|' || p_size || '|' END AS cells FROM part, (VALUES (1), (2)) x(r)
UNION ALL SELECT p_partkey, 2, 1, p_brand || '|' FROM part WHERE p_partkey % 2 = 1 UNION ALL SELECT p_partkey, 2, 2, p_size || '|' || p_type FROM part WHERE p_partkey % 2 = 1""")
def x04_markdown_tables(spark: SparkSession, d: str) -> DataFrame:
    one = ("intro\n| name | size | brand |\n|---|:-:|---|\n| ", "p_name", " | ", "p_size", " |\nend")
    text = by_key(said(*one), said(*one, "\n\n  | ", "p_brand", "\n|", "p_size", "|  ", "p_type", "|"))
    t = markdown_tables(read(spark, d, "part").select("p_partkey", text.alias("text")))
    return t.select("p_partkey", F.col("table_no").cast("int").alias("table_no"), "row_no", F.array_join("cells", "|").alias("cells"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '| ' || p_name || ' | ' || p_size || ' |' WHEN 2 THEN array_to_string(list_transform(range(5), lambda i: '| ' || p_name || ' | ' || i || ' |'), chr(10)) END AS preview FROM part""")
def x16_table_preview(spark: SparkSession, d: str) -> DataFrame:
    text = by_key(
        said("text\n| Наименование | Количество |\n| ", "p_name", " | ", "p_size", " |"), said("| Наименование | Цена |\n| ", "p_name", " | 1 |"),
        said("| № |\n| НАИМЕНОВАНИЕ | количество |", *[x for i in range(7) for x in ("\n| ", "p_name", f" | {i} |")]),
    )
    t = table_preview(read(spark, d, "part").select("p_partkey", text.alias("text")), ["наименование"], ["количество"])
    return t.select("p_partkey", F.array_join("preview", "\n").alias("preview"))


#: Contract texts of parts by key, and the facts in them: (group, topic, value_type, value_num, confidence).
FACT_SQL = """WITH p AS (SELECT p_partkey AS g, p_partkey % 3 AS k, p_size AS n FROM part)
SELECT g, 'nmcc' AS value_type, (1000 * n + 0.5)::DOUBLE AS value_num, 'high' AS confidence FROM p WHERE k = 0 UNION ALL SELECT g, 'nmcc', (2000000 + n)::DOUBLE, 'high' FROM p WHERE k = 1
UNION ALL SELECT g, 'advance_percent', n::DOUBLE, 'medium' FROM p WHERE k = 0 UNION ALL SELECT g, 'penalty_percent', 0.1, 'medium' FROM p WHERE k < 2 UNION ALL SELECT g, 'penalty_percent', n::DOUBLE, 'medium' FROM p WHERE k = 1
UNION ALL SELECT g, 'payment_days', n::DOUBLE, 'high' FROM p WHERE k < 2 UNION ALL SELECT g, 'policy', NULL, 'high' FROM p WHERE k = 0 AND n % 2 = 0 UNION ALL SELECT g, 'policy', NULL, 'medium' FROM p WHERE k = 1"""


def contract_text() -> Column:
    return by_key(
        F.concat(F.lit("НМЦК: "), F.col("p_size") * 1000, F.lit(",5 руб. Аванс "), "p_size", F.lit(" %. Пени 0,1 %. Оплата в течение "), "p_size", F.lit(" рабочих дней."), F.when(F.col("p_size") % 2 == 0, " Без эквивалента.").otherwise("")),
        F.concat(F.lit("Начальная (максимальная) цена контракта - "), F.col("p_size") + 2000000, F.lit(" ₽. Аванс не предусмотрен. Штраф 0,1 % от цены. Неустойка равна "), "p_size", F.lit("%. Оплата товара в течение "), "p_size", F.lit(" дней. Аналог возможен.")),
        F.lit("НМЦК не указана руб. Оплата по факту."),
    )


@query(FACT_SQL)
def f01_extract_facts(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "part").select(F.col("p_partkey").alias("g"), F.lit("a").alias("f"), contract_text().alias("t"))
    return facts.extract_facts(docs, "g", "f", "t").select("g", "value_type", "value_num", "confidence")


@query(r"""SELECT doc_id, CASE WHEN t = '' THEN 0 ELSE (CASE WHEN contains(t, 'the') THEN 4 ELSE 0 END) - 2 * (contains(t, 'haha')::INT) - (CASE WHEN length(t) < 20 THEN 2 ELSE 0 END) + (CASE WHEN contains(t, ':') AND contains(t, 'the') THEN 3 ELSE 0 END) END AS score
FROM (SELECT doc_id, lower(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g')) AS t FROM documents)""")
def p05_requirement_score(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", rules.requirement_score(F.col("text"), ["the"], ["haha"], ["the"]).alias("score"))


@query("SELECT p_partkey, p_partkey % 5 IN (0, 4) AS spec, p_partkey % 5 IN (1, 2) AS noise FROM part")
def p08_line_predicates(spark: SparkSession, d: str) -> DataFrame:
    line = by_key(said("мембрана толщина ", "p_size", " мм"), said("протокол ", "p_partkey"), said("p_name", " стр. 12"), said("просто ", "p_name"), said("Наименование: ", "p_name"))
    return read(spark, d, "part").select("p_partkey", rules.is_spec_line(line).alias("spec"), rules.is_noise_line(line).alias("noise"))


@query("""SELECT l_orderkey, count(*) AS links, count(*) FILTER (WHERE l_linenumber % 2 = 0) AS signed FROM lineitem GROUP BY 1""")
def j12_with_signatures(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select("l_orderkey", F.monotonically_increasing_id().alias("i"), "l_linenumber")
    files = rows.select("l_orderkey", F.concat_ws(":", "l_orderkey", "i").alias("uid"), F.lit("file").alias("kind"), F.lit("f").alias("href"))
    signs = rows.filter("l_linenumber % 2 = 0").select("l_orderkey", F.concat_ws(":", "l_orderkey", "i").alias("uid"), F.lit("signature").alias("kind"), F.lit("s").alias("href"))
    return match.with_signatures(files.unionByName(signs), "uid", "kind", "href").groupBy("l_orderkey").agg(F.count("*").alias("links"), F.count("signature").alias("signed"))


@query("""WITH s AS (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem) SELECT l_orderkey, l_returnflag FROM s WHERE NOT (l_returnflag = 'R' AND l_orderkey IN (SELECT l_orderkey FROM s WHERE l_returnflag = 'A'))""")
def j06_drop_shadowed(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("l_returnflag") == "R", "x.doc").when(F.col("l_returnflag") == "A", "X.docx").otherwise("n.pdf")
    files = read(spark, d, "lineitem").select("l_orderkey", "l_returnflag", name.alias("name")).distinct()
    return match.drop_shadowed(files, "l_orderkey", "name").select("l_orderkey", "l_returnflag")


@query("""
WITH g AS (SELECT o_orderkey AS doc, list('r' || l_linenumber || '-' || l_partkey ORDER BY l_linenumber, l_partkey)[1:12] AS rs FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1)
SELECT o_orderkey, array_to_string(CASE WHEN o_orderkey % 2 = 0 AND g.rs IS NOT NULL THEN list_concat(['a'], rs) WHEN o_orderkey % 2 = 0 THEN ['a'] ELSE ['a', 'b', 'c'] END, ',') AS chars, o_orderkey % 2 = 0 AND g.rs IS NOT NULL AS general_applied FROM orders LEFT JOIN g ON doc = o_orderkey""")
def j13_attach_general(spark: SparkSession, d: str) -> DataFrame:
    chars = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("a"))).otherwise(F.array(*[F.lit(x) for x in "abc"]))
    items = read(spark, d, "orders").select("o_orderkey", chars.alias("chars"))
    reqs = read(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.struct("l_linenumber", "l_partkey").alias("seq"), F.concat(F.lit("r"), "l_linenumber", F.lit("-"), "l_partkey").alias("req"))
    return match.attach_general(items, reqs, "o_orderkey", "chars", "req", "seq").select("o_orderkey", F.array_join("chars", ",").alias("chars"), "general_applied")


@query("""
WITH r AS (SELECT l_orderkey, l_returnflag, l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS seq, l_quantity, l_linestatus, l_discount FROM lineitem)
SELECT l_orderkey, l_returnflag, min(seq) AS first_seq, arg_min(l_quantity::VARCHAR, struct_pack(a := seq, b := l_quantity::VARCHAR)) AS quantity, max(l_discount) AS confidence, CASE WHEN count(DISTINCT l_linestatus) > 1 THEN 'mixed' ELSE min(l_linestatus) END AS extraction_mode FROM r GROUP BY ALL""")
def a03_merge_requirements(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select(
        "l_orderkey", "l_returnflag", F.expr("l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey % 1000 as seq"), F.lit("n").alias("position_name"), F.col("l_quantity").cast("string").alias("quantity"), F.lit("шт").alias("unit"),
        F.array("l_linestatus").alias("characteristics"), F.col("l_discount").alias("confidence"), F.lit("f").alias("source_fragment"), F.col("l_linestatus").alias("extraction_mode"),
    )
    return merge.merge_requirements(rows, ["l_orderkey", "l_returnflag"], "seq").select("l_orderkey", "l_returnflag", "first_seq", "quantity", "confidence", "extraction_mode")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'body ' || p_name WHEN 1 THEN 'a' || chr(10) || p_name WHEN 2 THEN '' ELSE substr(repeat(p_name, 200), 1, 1200) END AS summary FROM part")
def a20_report_summary(spark: SparkSession, d: str) -> DataFrame:
    text = by_key(
        said("## 0\n| t |\n## 1. Риски\n| row |\nbody ", "p_name", "\n## 2. x"), said("## 1. Риски\n\na\n  | row |\n", "p_name", "\n| last |"), said("## 0. ", "p_name", "\n## 2. x"), F.concat(F.lit("## 1. Риски\n"), F.repeat(F.col("p_name"), 200)),
    )
    return report_summary(read(spark, d, "part").select("p_partkey", text.alias("r")), "r", "## 1. Риски", "## 2.").select("p_partkey", "summary")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '# Юридическое заключение по тендеру' || chr(10) || chr(10) || p_name WHEN 1 THEN '# Юридическое заключение по тендеру' || chr(10) || chr(10) || 'a' || chr(10) || '## 1. ' || p_name || chr(10) || '| x | ' || p_size || ' |' || chr(10) || '| --- | --- |'
 WHEN 2 THEN '# Юридическое заключение по тендеру' || chr(10) || chr(10) || p_name || chr(10) || 'b' ELSE '# Юридическое заключение по тендеру' || chr(10) || chr(10) || 'Отчет не сформирован.' END AS report FROM part""")
def c36_repair_report(spark: SparkSession, d: str) -> DataFrame:
    title = "# Юридическое заключение по тендеру"
    raw = by_key(said("\n", "p_name", "\r\n"), said("a## 1. ", "p_name", " | x || ", "p_size", " |"), said(f"old {title}\n", "p_name", f"\n{title}\n\n\nb"), F.lit(None).cast("string"))
    return spread(read(spark, d, "part").select("p_partkey", raw.alias("raw"))).select("p_partkey", T.repair_report(F.col("raw")).alias("report"))


@query("""SELECT p_partkey, p_brand || ':' || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'стр. ' || p_size END || ':' || p_name || CASE WHEN p_partkey % 3 = 0 THEN '|::' || p_type ELSE '' END AS sources FROM part""")
def c37_distinct_sources(spark: SparkSession, d: str) -> DataFrame:
    page = F.when(F.col("p_partkey") % 2 == 1, said(" стр.  ", "p_size"))
    one = lambda f, p, e: F.struct(f.alias("file"), p.alias("page_or_sheet"), F.lit("spec").alias("fragment_type"), e.alias("evidence"))
    none = F.lit(None).cast("string")
    found = F.array(one(F.col("p_brand"), page, F.col("p_name")), one(F.upper("p_brand"), page, F.upper("p_name")), one(F.lit(" "), page, none), one(none, none, F.when(F.col("p_partkey") % 3 == 0, F.col("p_type"))))
    told = F.transform(T.distinct_sources(found), lambda s: F.concat_ws(":", s["file"], s["page_or_sheet"], s["evidence"]))
    return read(spark, d, "part").select("p_partkey", F.array_join(told, "|").alias("sources"))


@query(f"""WITH {BLOCKS.format(text="text")},
g AS (SELECT source, doc_id::VARCHAR AS name, row_number() OVER (PARTITION BY doc_id ORDER BY i, p) AS pos, substr(b, 1, 3500) AS block FROM blocks JOIN documents USING (doc_id)),
s AS (SELECT *, 3 + contains(lower(block), 'the')::INT AS score FROM g),
u AS (SELECT *, sum(length(block)) OVER (PARTITION BY source ORDER BY score DESC, name, pos ROWS UNBOUNDED PRECEDING) AS used FROM s WHERE score >= 4)
SELECT source, count(*) AS blocks, sha256(string_agg(block, chr(10) || chr(10) ORDER BY score DESC, name, pos)) AS matching_text FROM u WHERE used <= 10000 GROUP BY 1""")
def q03_matching_text(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("source", F.col("doc_id").cast("string").alias("name"), "text")
    m = matching_text(docs, "source", "name", "text", 10000, 3500, [("spec", [""])], [("any", ["the"], 1)], ["spec"])
    return m.select("source", "blocks", F.sha2("matching_text", 256).alias("matching_text"))


def run_stream(spark: SparkSession, d: str, build, mode: str) -> DataFrame:
    """The result of a stream over the events' file, in a folder of its own."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    events = spark.readStream.schema(read(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    stream = build(events)
    if mode == "append":
        stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    else:
        write = lambda df, _: df.write.mode("overwrite").parquet(f"{path}/out")
        stream.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")


@query("SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE value > 99)")
def t01_stream_new_notices(spark: SparkSession, d: str) -> DataFrame:
    ledger = read(spark, d, "events").filter("value > 99").select("user_id").distinct()
    return run_stream(spark, d, lambda e: stream_new_notices(e, ledger, "user_id", "ts"), "append").select("user_id")


@query("SELECT user_id % 20 AS job, user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY ALL")
def t03_stream_job_progress(spark: SparkSession, d: str) -> DataFrame:
    return run_stream(spark, d, lambda e: stream_job_progress(e.withColumn("job", F.col("user_id") % 20), "job", "user_id", "event_id", "event_type"), "complete")


@query(r"""WITH t AS (SELECT url, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS h FROM pages)
SELECT url, regexp_replace(trim(replace(replace(replace(replace(regexp_replace(h, '<[^>]*>', '', 'g'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')), '\s+', ' ', 'g') AS title FROM t WHERE h <> ''""")
def x14_page_products(spark: SparkSession, d: str) -> DataFrame:
    return page_products(read(spark, d, "pages")).select("url", "title")
