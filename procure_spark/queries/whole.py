"""Sources, sinks, pages, streams and whole jobs, over texts and pages built from the driver's tables."""

import uuid
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from procure_spark import lexicons as L
from procure_spark.functions import text as T
from procure_spark.operators import facts, rules
from procure_spark.operators.split import page_links
from procure_spark.plans import jobs
from procure_spark.queries.more import by_key, contract_text, run_stream, said
from procure_spark.queries.text import BLOCKS
from procure_spark.registry import query, read, shared_dir, written
from procure_spark.sources import html, tables
from procure_spark.sources.versions import read_version
from procure_spark.streaming.jobs import job_progress_sink, stream_ttl_dedup, ttl_openings


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT 'o_orderstatus=' || o_orderstatus AS tender, 'json' AS ext, count(*) AS rows, 1 AS files FROM orders GROUP BY 1")
def s01_list_package(spark: SparkSession, d: str) -> DataFrame:
    """A folder per order status, as Spark writes it, listed and read again."""
    path = _folder(spark, "s01")
    orders = read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    # A file for each status, as many as there are folders to list. Each is written as rows come in, without a sort by folders.
    for (status,) in orders.select("o_orderstatus").distinct().collect():
        folder = "__HIVE_DEFAULT_PARTITION__" if status is None else quote(status, safe="")
        orders.filter(F.col("o_orderstatus").eqNullSafe(F.lit(status))).select("o_orderkey").repartition(1).write.json(f"{path}/o_orderstatus={folder}")
    files = tables.list_package(spark, path).filter("size > 0 and ext = 'json'").groupBy("tender", "ext").agg(F.count("*").cast("int").alias("files"))
    rows = spark.read.json(path).groupBy(F.concat(F.lit("o_orderstatus="), "o_orderstatus").alias("tender")).agg(F.count("*").alias("rows"))
    return files.join(rows, "tender")


def _specs() -> Column:
    return F.when(F.col("p_partkey") % 3 != 0, F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string")))


@query("SELECT p_partkey, p_name, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'brand: ' || p_brand || ' ; size: ' || p_size END AS specs FROM part")
def s02_load_catalog(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "s02")
    read(spark, d, "part").select("p_partkey", "p_name", _specs().alias("specs")).write.parquet(path)
    return tables.load_catalog(spark, path).select("p_partkey", "p_name", T.flatten_specs(F.col("specs")).alias("specs"))


@query("SELECT p_partkey, p_name, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END AS brand FROM part")
def s04_export_catalog(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "s04") + ".json"
    tables.export_catalog(read(spark, d, "part").select("p_partkey", "p_name", _specs().alias("specs")), path)
    return spark.read.schema("p_partkey long, p_name string, specs map<string,string>").json(path).select("p_partkey", "p_name", F.col("specs")["brand"].alias("brand"))


@query("SELECT source, doc_id FROM documents WHERE doc_id % 3 > 0 AND length(trim(text)) > 300")
def s05_write_reports(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "s05")
    status = F.element_at(F.array(*[F.lit(x) for x in ("error", "success", "partial")]), (F.col("doc_id") % 3 + 1).cast("int"))
    tables.write_reports(read(spark, d, "documents").select("source", "doc_id", "text", status.alias("status")), path, "source", "status", "text")
    return spark.read.parquet(path).select(F.col("source").cast("string").alias("source"), "doc_id")


@query("""SELECT doc_id, CASE WHEN doc_id % 6 = 5 THEN 'empty' WHEN doc_id % 6 = 4 THEN 'html' WHEN (CASE doc_id % 6 WHEN 0 THEN 4 WHEN 1 THEN 4 WHEN 2 THEN 8 ELSE 0 END) + octet_length(encode(coalesce(text, ''))) < 100 THEN 'too_small'
 WHEN doc_id % 6 = 1 THEN 'mismatch' ELSE 'ok' END AS audit FROM documents""")
def c22_audit_signature(spark: SparkSession, d: str) -> DataFrame:
    k, body = F.col("doc_id") % 6, F.coalesce("text", F.lit("")).cast("binary")
    start = lambda x: F.concat(F.unhex(F.lit(x)), body)
    content = F.when(k == 0, start("25504446")).when(k == 1, start("504B0304")).when(k == 2, start("D0CF11E0A1B11AE1")).when(k == 3, body).when(k == 4, F.concat(F.lit("\n <!DOCTYPE html>").cast("binary"), body)).otherwise(F.lit(b""))
    name = F.element_at(F.array(*[F.lit(x) for x in ("a.PDF", "b.pdf", "c.doc", "d.txt", "e.docx", "f.zip")]), (k + 1).cast("int"))
    return read(spark, d, "documents").select("doc_id", T.audit_signature(content, name).alias("audit"))


KINDS = [
    ("application/pdf", ".pdf"), ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".docx"), ("application/MSWord; x=1", ".doc"),
    ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", ".xlsx"), ("application/vnd.ms-excel", ".xls"), ("application/x-zip", ".zip"), ("text/plain", ""), ("", ""),
]


@query(f"SELECT p_partkey, CASE p_partkey % {len(KINDS)} {' '.join(f'WHEN {i} THEN {e!r}' for i, (_, e) in enumerate(KINDS))} END AS ext FROM part")
def c23_ext_from_ctype(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", T.ext_from_ctype(by_key(*[F.lit(t) for t, _ in KINDS])).alias("ext"))


OPENINGS = """WITH RECURSIVE o AS (SELECT user_id, event_type, min(ts) AS ts FROM events GROUP BY user_id, event_type
  UNION ALL SELECT e.user_id, e.event_type, min(e.ts) FROM o JOIN events e ON e.user_id = o.user_id AND e.event_type = o.event_type AND e.ts >= o.ts + INTERVAL 1 HOUR GROUP BY e.user_id, e.event_type)
SELECT user_id, event_type, ts FROM o"""


@query(f"{OPENINGS} WHERE epoch_ms(ts) < (SELECT epoch_ms(max(ts)) FROM events) - 600000")
def t02_stream_ttl_dedup(spark: SparkSession, d: str) -> DataFrame:
    """What the stream tells once the watermark, ten minutes behind the last event, has passed it."""
    return run_stream(spark, d, lambda e: stream_ttl_dedup(e, ["user_id", "event_type"], "ts"), "append").select("user_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query(OPENINGS)
def t04_ttl_openings(spark: SparkSession, d: str) -> DataFrame:
    return ttl_openings(read(spark, d, "events"), ["user_id", "event_type"], "ts").select("user_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("""WITH l AS (SELECT user_id % 20 AS job, user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY ALL)
SELECT *, CASE WHEN bool_and(event_type IN ('purchase', 'click')) OVER (PARTITION BY job) THEN 'completed' ELSE 'running' END AS status FROM l""")
def t05_job_completion(spark: SparkSession, d: str) -> DataFrame:
    """The table of jobs after the events have come in three batches."""
    path = _folder(spark, "t05")
    events = read(spark, d, "events").select((F.col("user_id") % 20).alias("job"), "user_id", "event_id", "event_type")
    events.repartitionByRange(3, "event_id").write.parquet(f"{path}/in")
    table = T_.StructType([*events.schema, T_.StructField("status", T_.StringType())])
    sink = job_progress_sink(f"{path}/jobs", table, "job", "user_id", "event_id", "event_type", ["purchase", "click"])
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return read_version(spark, f"{path}/jobs", table)


LINKS = r"""WITH a AS (SELECT url, unnest(regexp_extract_all(coalesce(html, ''), '(?i)<a\b[^>]*?\bhref\s*=\s*["'']([^"''#]+)["''#]', 1)) AS h FROM pages),
b AS (SELECT url, CASE WHEN regexp_matches(h, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN h WHEN starts_with(h, '//') THEN regexp_extract(url, '^([a-zA-Z]+:)', 1) || h WHEN starts_with(h, '/') THEN regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) || h
  ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '([^/:])/[^/]*$', '\1') || '/' || h END AS h FROM a),
c AS (SELECT url, h, regexp_extract(h, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1) AS s, replace(regexp_extract(h, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1), 'www.', '') AS host, regexp_replace(regexp_extract(h, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS p,
  list_filter(string_split(regexp_extract(h, '[?]([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_') AND lower(string_split(x, '=')[1]) NOT IN ('gclid', 'fbclid', 'yclid')) AS q FROM b
  WHERE NOT regexp_matches(lower(h), '\.(jpg|jpeg|png|svg|ico|webp|css|js|pdf|zip)$'))"""


@query(LINKS + """ SELECT DISTINCT url, s || '://' || host || p || CASE WHEN len(q) > 0 THEN '?' || array_to_string(list_transform(q, lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END), '&') ELSE '' END AS link FROM c""")
def x10_page_links(spark: SparkSession, d: str) -> DataFrame:
    return page_links(read(spark, d, "pages"), "")


def spec_page() -> Column:
    """Pages whose specs stand in a table, a definition list, or list items; some have none."""
    return by_key(
        said("<table><tr><td>size</td><td>", "p_size", "</td></tr><tr><th>x</th></tr><tr><td> brand </td><td><b>", "p_brand", "</b></td></tr><tr><td>size</td><td>last &amp; best</td></tr></table><ul><li>a: b</li></ul>"),
        said("<dl><dt>size</dt><dd>", "p_size", " </dd><dt>type</dt><dd>", "p_type", "</dd></dl>"), said("<ul><li>size: ", "p_size", ": x</li><li>none</li></ul>"), said("<p>", "p_name", "</p>"),
    )


@query("""SELECT p_partkey::VARCHAR AS url, CASE p_partkey % 4 WHEN 0 THEN 'brand: ' || p_brand || ' ; size: last & best' WHEN 1 THEN 'size: ' || p_size || ' ; type: ' || p_type ELSE 'size: ' || p_size || ': x' END AS specs FROM part WHERE p_partkey % 4 < 3""")
def x11_page_specs(spark: SparkSession, d: str) -> DataFrame:
    pages = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("url"), spec_page().alias("html"))
    return html.page_specs(pages).select("url", T.flatten_specs(F.col("specs")).alias("specs"))


@query("""SELECT 'https://z.ru/d/' || p_partkey AS url, 'https://z.ru/filestore/x?uid=' || p_partkey AS href, 'file' AS kind, p_partkey::VARCHAR AS uid, 'тз.docx' AS name FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT 'https://z.ru/d/' || p_partkey, 'https://z.ru/filestore/x.sig?uid=' || p_partkey, 'signature', p_partkey::VARCHAR, 'подпись' FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT 'https://z.ru/d/' || p_partkey, 'https://z.ru/d/download/' || p_size, 'file', NULL, p_name FROM part WHERE p_partkey % 2 = 1""")
def x12_page_attachments(spark: SparkSession, d: str) -> DataFrame:
    body = by_key(
        said("<a href='/filestore/x?uid=", "p_partkey", "' title='тз.docx'>скачать</a><a href='/filestore/y?uid=", "p_partkey", "'>ещё</a><a href='/filestore/x.sig?uid=", "p_partkey", "'>подпись</a><a href='/plain'>x</a>"),
        said("<a href='download/", "p_size", "'>", "p_name", "</a><a href='download/", "p_size", "'>again</a>"),
    )
    return html.page_attachments(read(spark, d, "part").select(F.concat(F.lit("https://z.ru/d/"), "p_partkey").alias("url"), body.alias("html")))


def cards(k: Column, key: Column) -> Column:
    """A result page of two cards: a notice by key, and one of which only a technical link is found, or none."""
    link = F.when(k == 0, "/epz/order/notice/ea44/view/common-info.html?regNumber=").when(k == 1, "/epz/order/notice/notice223/documents.html?noticeInfoId=").otherwise("/epz/plan.html?x=")
    money = F.when(k == 0, "Начальная цена 1 000,00 ₽ Окончание подачи заявок 05.03.2024").when(k == 1, "Окончание подачи заявок 06.03.2024 09:00 Размещено 01.01.2024").otherwise("")
    return F.concat(
        F.lit("<div class='x search-registry-entry-block'><a href='"), link, key, F.lit("'>Поставка "), key, F.lit("</a><a href='/x/printForm/view.html?regNumber="), key, F.lit("'>п</a><div>"), money,
        F.lit("</div></div><div class='search-registry-entry-block'><a href='/x/printForm/view.html?regNumber=1'>п</a></div>"),
    )


NOTICES = """SELECT 'https://z.ru/s/' || o_orderkey AS url, CASE o_orderkey % 3 WHEN 1 THEN '223-' ELSE '' END || o_custkey AS reg, CASE o_orderkey % 3 WHEN 0 THEN 'ea44' WHEN 1 THEN 'notice223' END AS ntype, 'Поставка ' || o_custkey AS title,
 'https://z.ru' || CASE o_orderkey % 3 WHEN 0 THEN '/epz/order/notice/ea44/view/common-info.html?regNumber=' ELSE '/epz/order/notice/notice223/documents.html?noticeInfoId=' END || o_custkey AS href,
 CASE o_orderkey % 3 WHEN 0 THEN '1 000,00' END AS price, CASE o_orderkey % 3 WHEN 0 THEN '05.03.2024' ELSE '06.03.2024 09:00' END AS deadline FROM orders WHERE o_orderkey % 3 < 2"""


def _result_pages(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select(F.concat(F.lit("https://z.ru/s/"), "o_orderkey").alias("url"), cards(F.col("o_orderkey") % 3, F.col("o_custkey").cast("string")).alias("html"))


@query(NOTICES)
def x13_page_notices(spark: SparkSession, d: str) -> DataFrame:
    return html.page_notices(_result_pages(spark, d)).drop("card")


@query("SELECT p_partkey, p_partkey % 6 IN (1, 2, 3) AS signals FROM part")
def p03_has_product_signals(spark: SparkSession, d: str) -> DataFrame:
    text = by_key(said("Мастика ", "p_name"), said("мастика, толщина ", "p_name"), said("рубероид ЭПП ", "p_name"), said("Лента ", "p_size", " мм"), said("рулон ", "p_size", " "), said("p_name", " эппx"))
    return read(spark, d, "part").select("p_partkey", rules.has_product_signals(text).alias("signals"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 10 WHEN 1 THEN -1 WHEN 2 THEN 7 WHEN 3 THEN 4 ELSE 0 END AS score FROM part")
def p06_section_score(spark: SparkSession, d: str) -> DataFrame:
    text = by_key(said("Спецификация: кирпич, толщина ", "p_size"), said("Спецификация; штраф ", "p_size"), said("кирпич | прочность"), said("количество | 5"), said("p_size"))
    return read(spark, d, "part").select("p_partkey", rules.section_score(text).alias("score"))


@query("""SELECT p_partkey, p_partkey % 6 IN (0, 1, 5) AS material, p_partkey % 6 = 2 AS excluded, p_partkey % 6 IN (3, 5) AS general FROM part""")
def p09_name_predicates(spark: SparkSession, d: str) -> DataFrame:
    line = by_key(said("Кирпич ", "p_name"), said("ХПП-", "p_size", "АБ"), said("Порядок оплаты: ", "p_name"), said("Сертификат ", "p_name"), said("12 ", "p_size"), said("продукция с гарантийный срок ", "p_size"))
    return read(spark, d, "part").select("p_partkey", rules.is_material_name(line).alias("material"), rules.is_excluded(line).alias("excluded"), rules.is_general_req(line).alias("general"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Толщина ' || p_size || '|не менее ' || p_size WHEN 1 THEN p_size || ' мм|цвет' ELSE '' END AS found FROM part""")
def p10_characteristics(spark: SparkSession, d: str) -> DataFrame:
    rows = by_key(F.array(said("Толщина ", "p_size"), F.lit("просто"), said("толщина ", "p_size"), said("не менее ", "p_size")), F.array(said("p_size", " мм"), F.lit("цвет"), F.lit("менее")), F.array(said("p_size"), F.lit("мм"), F.lit("")))
    return read(spark, d, "part").select("p_partkey", F.array_join(rules.characteristics(rows), "|").alias("found"))


@query("""SELECT p_partkey AS g, 'file_status' AS topic, CASE p_partkey % 4 WHEN 0 THEN 'error' ELSE 'ocr' END AS value_raw, 'low' AS confidence, 'ocr_failed' AS status FROM part WHERE p_partkey % 4 < 2""")
def f06_file_status(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "part").select(F.col("p_partkey").alias("g"), F.lit("a").alias("f"), by_key(F.lit("error"), F.lit("ocr"), F.lit("success"), F.lit("success")).alias("s"), contract_text().alias("t"))
    return facts.extract_facts(docs, "g", "f", "t", "s").filter("topic = 'file_status'").select("g", "topic", "value_raw", "confidence", "status")


def _order_text(spark: SparkSession, d: str, *lines: Column, head: str, tail: str) -> DataFrame:
    """A document per order: a head, lines of each item in order, a tail."""
    rows = read(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", F.array(*lines).alias("ls")).alias("x"))
    body = F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["ls"])), "\n")
    return rows.groupBy("l_orderkey").agg(F.concat(F.lit(head), body, F.lit(tail)).alias("text"))


ITEMS = """WITH i AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS seq, l_partkey % 5 AS m, l_partkey % 2 AS k, l_quantity::INT AS q FROM lineitem)"""


@query(ITEMS + """, n AS (SELECT *, CASE k WHEN 0 THEN 'Кирпич М' || m ELSE 'Труба ' || m || 'х ' || q || ' шт' END AS name FROM i),
g AS (SELECT l_orderkey, name, min(seq) AS s, arg_min(CASE WHEN k = 0 AND seq % 2 = 0 THEN NULL ELSE q END, CASE WHEN k = 0 AND seq % 2 = 0 THEN NULL ELSE seq END) AS q, max(CASE WHEN k = 1 THEN 0.76 WHEN seq % 2 = 0 THEN 0.74 ELSE 0.86 END) AS confidence, k FROM n GROUP BY l_orderkey, name, k)
SELECT l_orderkey, name AS position_name, q::VARCHAR AS quantity, CASE WHEN q IS NOT NULL THEN CASE k WHEN 0 THEN 'упак' ELSE 'шт' END END AS unit, CASE k WHEN 0 THEN 'прочность не менее 100;Сертификат обязателен' ELSE 'Сертификат обязателен' END AS characteristics,
 confidence::DOUBLE AS confidence, CASE k WHEN 0 THEN 'parametric' ELSE 'inline' END AS extraction_mode FROM g""")
def q01_extract_requirements(spark: SparkSession, d: str) -> DataFrame:
    m, q = (F.col("l_partkey") % 5).cast("string"), F.col("l_quantity").cast("int").cast("string")
    i = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    numbered = read(spark, d, "lineitem").withColumn("i", i)
    line = F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("Кирпич М"), m, F.lit(" | прочность не менее 100 | "), F.when(F.col("i") % 2 == 0, "много").otherwise(F.concat(q, F.lit(" упак"))))).otherwise(F.concat(F.lit("Труба "), m, F.lit("х "), q, F.lit(" шт")))
    rows = numbered.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("t")))), lambda x: x["t"]), "\n").alias("body"))
    docs = rows.select("l_orderkey", F.concat(F.lit("Кирпич до раздела 5 шт\nТехническое задание\n"), "body", F.lit("\nСертификат обязателен\nПроект договора\nТруба после 7 шт")).alias("text"))
    found = jobs.extract_requirements(docs, "l_orderkey")
    return found.select("l_orderkey", "position_name", "quantity", "unit", F.array_join("characteristics", ";").alias("characteristics"), "confidence", "extraction_mode")


@query(ITEMS + """, n AS (SELECT l_orderkey, 'Мембрана ' || m || 'х ' || q || ' шт' AS name, min(seq) AS s, any_value(q) AS q FROM i WHERE k = 0 GROUP BY ALL)
SELECT l_orderkey, name, q::VARCHAR AS quantity, 'шт' AS unit, name AS search_query, row_number() OVER (PARTITION BY l_orderkey ORDER BY s)::INT AS number FROM n""")
def q02_extract_positions(spark: SparkSession, d: str) -> DataFrame:
    m, q = (F.col("l_partkey") % 5).cast("string"), F.col("l_quantity").cast("int").cast("string")
    line = F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("Мембрана "), m, F.lit("х "), q, F.lit(" шт"))).otherwise(F.concat(F.lit("Оплата "), q, F.lit(" шт")))
    docs = _order_text(spark, d, line, head="Вводная часть\n", tail="\nдлинная строка без меры")
    found = jobs.extract_positions(docs, "l_orderkey").withColumn("number", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("seq")))
    return found.select("l_orderkey", "name", "quantity", "unit", "search_query", "number")


@query("""WITH c AS (SELECT 'https://a.ru/p/' || p_partkey AS url, p_brand AS title, 'old ' || p_size AS description FROM part WHERE p_partkey % 3 <> 0),
n AS (SELECT 'https://a.ru/p/' || p_partkey AS url, p_name AS title, CASE WHEN p_partkey % 4 = 0 THEN 'new ' || p_size ELSE '' END AS description FROM part WHERE p_partkey % 2 = 0)
SELECT coalesce(n.url, c.url) AS url, coalesce(n.title, c.title) AS title, coalesce(nullif(n.description, ''), c.description) AS description, CASE WHEN n.url IS NULL THEN 'kept' WHEN c.url IS NULL THEN 'created' ELSE 'updated' END AS change FROM c FULL JOIN n ON c.url = n.url""")
def q05_catalog_from_pages(spark: SparkSession, d: str) -> DataFrame:
    """Even parts have product pages, odd ones pages without a price; a third of all isn't in the catalog yet."""
    p = read(spark, d, "part")
    told = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("<div class='description'>new "), "p_size", F.lit("</div>"))).otherwise("")
    page = F.concat(F.lit("<body><h1>"), "p_name", F.lit("</h1>"), F.when(F.col("p_partkey") % 2 == 0, "<p>10 р./м2</p>").otherwise(""), told, F.lit("<table>"), F.repeat(F.lit("<tr><td>a</td><td>b</td></tr>"), 3), F.lit("</table></body>"))
    pages = p.select(F.concat(F.lit("https://www.a.ru/p/"), "p_partkey", F.lit("/?utm_source=x")).alias("url"), page.alias("html"))
    current = p.filter("p_partkey % 3 <> 0").select(F.concat(F.lit("https://a.ru/p/"), "p_partkey").alias("url"), F.col("p_brand").alias("title"), F.concat(F.lit("old "), "p_size").alias("description"))
    return jobs.catalog_from_pages(pages, current, "a.ru")


@query(f"""WITH n AS ({NOTICES}), f AS (SELECT reg, arg_min(title, struct_pack(a := -length(title), b := url)) AS title, max(price) AS price, arg_min(href, url) AS href, min(url) AS url, count(*) AS merged,
 arg_min(deadline, struct_pack(a := -length(deadline), b := url)) AS deadline FROM n GROUP BY reg) SELECT *, reg IN (SELECT c_custkey::VARCHAR FROM customer WHERE c_custkey % 4 = 0) AS seen FROM f""")
def q06_notices_from_pages(spark: SparkSession, d: str) -> DataFrame:
    ledger = read(spark, d, "customer").filter("c_custkey % 4 = 0").select(F.col("c_custkey").cast("string").alias("reg"))
    return jobs.notices_from_pages(_result_pages(spark, d), ledger)


@query(f"""WITH n AS ({NOTICES}), f AS (SELECT reg, arg_min(title, struct_pack(a := -length(title), b := url)) AS title, max(price) AS price, arg_min(href, url) AS href, arg_min(deadline, struct_pack(a := -length(deadline), b := url)) AS deadline FROM n GROUP BY reg),
c AS (SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 5 > 0 THEN c_name ELSE ' ' END AS title, 'Won' AS status, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS region FROM customer),
k AS (SELECT * FROM c WHERE trim(title) <> '')
SELECT coalesce(reg, id) AS id, coalesce(f.title, k.title) AS title, CASE WHEN reg IS NULL THEN 1.5 WHEN price IS NULL THEN 0 ELSE 1000 END::DOUBLE AS initial_price, coalesce(deadline, '') AS deadline, coalesce(k.status, 'Found') AS status, coalesce(k.region, 'РФ') AS region,
  CASE WHEN starts_with(reg, '223-') THEN '223-ФЗ' ELSE '44-ФЗ' END AS law_type, 'stored' AS kind FROM f FULL JOIN k ON f.reg = k.id
UNION ALL SELECT id, title, 1.5, '', status, region, '44-ФЗ', 'rejected' FROM c WHERE trim(title) = ''""")
def q09_crm_from_pages(spark: SparkSession, d: str) -> DataFrame:
    """Customers as stored tenders (a fifth of them without a title), notices written over them, twice; what is stored and what isn't."""
    path = _folder(spark, "q09")
    nothing = F.lit(None).cast("string")
    title, region = F.when(F.col("c_custkey") % 5 > 0, F.col("c_name")).otherwise(" "), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment"))
    first = read(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), title.alias("title"), F.lit(1.5).alias("initial_price"), F.lit("").alias("deadline"), F.lit("Won").alias("status"), nothing.alias("risk_level"),
        region.alias("region"), F.lit("44-ФЗ").alias("law_type"), F.lit("").alias("url"), F.lit("").alias("ntype"),
    )
    rejected = jobs.store_tenders(first, path, 1)
    ledger = read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("reg"))
    found = written(jobs.notices_from_pages(_result_pages(spark, d), ledger), "notices")
    for version in (2, 3):
        rejected = rejected.unionByName(jobs.crm_from_notices(found, path, version))
    stored = read_version(spark, path, T_.StructType.fromDDL(jobs.CRM))
    rows = stored.withColumn("kind", F.lit("stored")).unionByName(rejected.withColumn("kind", F.lit("rejected")))
    return rows.select("id", "title", "initial_price", "deadline", "status", "region", "law_type", "kind")


def layouts() -> Column:
    """Product pages of each layout: rows of divs, a marked table among others, rows of three cells, features, none."""
    return by_key(
        said("<h1>a</h1><table><tr><td>no</td><td>x</td></tr></table><div class='a table_dop-info'><div class='table-row'><div class='table-cell'>size:</div><div class='table-cell b'>", "p_size", "</div></div><div class='table-row'>brand: ", "p_brand", "</div></div>"),
        said("<table><tr><td>no</td><td>x</td></tr></table><table class='specs'><tr><td>size</td><td>", "p_size", "</td><td>mm</td></tr><tr><td>empty</td><td></td></tr></table>"),
        said("<div class='table-row'>no: x</div><table><tr><td><b>brand</b>:</td><td>", "p_brand", "</td><td>z</td></tr><tr><th>type: ", "p_type", "</th></tr></table>"),
        said("<ul class='product-features'><li>size: ", "p_size", "</li><li>plain</li></ul><ul><li>no: x</li></ul>"), said("<p>", "p_name", "</p>"),
    )


@query("""SELECT p_partkey::VARCHAR AS url, CASE p_partkey % 5 WHEN 0 THEN 'size: ' || p_size || ' ; brand: ' || p_brand WHEN 1 THEN 'size: ' || p_size WHEN 2 THEN 'brand: ' || p_brand || ' ; type: ' || p_type ELSE 'size: ' || p_size END AS specs FROM part WHERE p_partkey % 5 < 4""")
def x17_spec_layouts(spark: SparkSession, d: str) -> DataFrame:
    pages = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("url"), layouts().alias("html"))
    return html.page_specs(pages).select("url", T.flatten_specs(F.col("specs")).alias("specs"))


TENDER_TOPICS = ("nmcc_prices", "payment", "liability", "equivalents")


@query("""WITH p AS (SELECT p_size AS g, p_partkey AS f, p_partkey % 3 AS k, p_size AS n FROM part),
one AS (SELECT g, 'nmcc_prices' AS topic, CASE k WHEN 0 THEN (1000 * n)::VARCHAR || ',5' ELSE (2000000 + n)::VARCHAR END AS v, 20 AS w, f FROM p WHERE k < 2
 UNION ALL SELECT g, 'equivalents', CASE k WHEN 0 THEN 'forbidden' ELSE 'allowed' END, CASE k WHEN 0 THEN 20 ELSE 15 END, f FROM p WHERE k = 1 OR (k = 0 AND n % 2 = 0)),
s AS (SELECT g, topic, v, sum(w) AS w FROM one GROUP BY ALL),
r AS (SELECT g, topic, list(v ORDER BY w DESC, v) AS vs, list(w ORDER BY w DESC, v) AS ws FROM s GROUP BY ALL)
SELECT g, topic, CASE WHEN len(vs) = 1 THEN 'agree' WHEN ws[1] >= 2 * ws[2] THEN 'select' ELSE 'conflict' END AS merge_mode, CASE WHEN len(vs) > 1 AND ws[1] < 2 * ws[2] THEN array_to_string(list_sort(vs), '|') ELSE vs[1] END AS "values" FROM r
UNION ALL SELECT g, 'payment', 'aggregate', array_to_string(list_sort(list(DISTINCT n::VARCHAR)), '|') FROM p WHERE k < 2 GROUP BY g
UNION ALL SELECT g, 'liability', 'aggregate', array_to_string(list_sort(list_distinct(flatten(list(CASE k WHEN 0 THEN ['0,1'] ELSE ['0,1', n::VARCHAR] END)))), '|') FROM p WHERE k < 2 GROUP BY g""")
def q08_tender_facts(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "part").select(F.col("p_size").alias("g"), F.col("p_partkey").alias("f"), contract_text().alias("t"))
    found = jobs.tender_facts(docs, "g", "f", "t").filter(F.col("topic").isin(*TENDER_TOPICS) & (F.col("merge_mode") != "not_found"))
    return found.select("g", "topic", "merge_mode", F.array_join(F.array_sort("values"), "|").alias("values"))


@query("""SELECT p_partkey AS g, p_size::DOUBLE AS days, CASE p_partkey % 3 WHEN 0 THEN 'рабочих' WHEN 1 THEN 'календарных' ELSE 'дней' END AS day_kind FROM part""")
def f04_payment_days(spark: SparkSession, d: str) -> DataFrame:
    text = by_key(*[said("Оплата поставки — в течение ", "p_size", kind) for kind in (" РАБОЧИХ дней. Аванс 5 %", "  календарных дней", " дней")])
    docs = read(spark, d, "part").select(F.col("p_partkey").alias("g"), F.lit("a").alias("f"), text.alias("t"))
    return facts.extract_facts(docs, "g", "f", "t").filter("value_type = 'payment_days'").select("g", F.col("value_num").alias("days"), "day_kind")


@query("""WITH t AS (SELECT p_size AS g, p_name || ' | ' || p_partkey AS v FROM part WHERE p_partkey % 3 < 2)
SELECT g, array_to_string(list_sort(list(DISTINCT v)), ';') AS "values" FROM t GROUP BY g""")
def q08_facts_of_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables that list items (two thirds of them) beside contracts' texts."""
    docs = read(spark, d, "part").select(F.col("p_size").alias("g"), F.col("p_partkey").alias("f"), contract_text().alias("t"))
    head = by_key(F.lit("№ | Наименование товара | Кол-во"), F.lit("  Виды работ | Объем"), F.lit("Наименование | Цена"))
    tables_ = read(spark, d, "part").select(F.col("p_size").alias("g"), F.col("p_partkey").alias("f"), F.concat(head, F.lit("\n\n "), "p_name", F.lit(" | "), "p_partkey", F.lit(" \n")).alias("table"))
    found = jobs.tender_facts(docs, "g", "f", "t", tables=tables_).filter("topic = 'items_quantities' and merge_mode != 'not_found'")
    return found.select("g", F.array_join(F.array_sort("values"), ";").alias("values"))


@query(f"""WITH {BLOCKS.format(text="text")}, w AS (SELECT source, doc_id, text, CASE WHEN doc_id % 5 = 0 THEN 'error' WHEN doc_id % 5 = 1 THEN NULL ELSE 'success' END AS status FROM documents),
ok AS (SELECT * FROM w WHERE status = 'success' AND trim(coalesce(text, '')) <> ''),
b AS (SELECT DISTINCT source, doc_id FROM ok JOIN blocks USING (doc_id) WHERE contains(lower(substr(b, 1, 3500)), 'the'))
SELECT source AS tender, doc_id::VARCHAR AS filename, coalesce(status, 'empty') AS status, '{L.NO_TEXT}' AS message FROM w WHERE (source, doc_id) NOT IN (SELECT source, doc_id FROM ok)
UNION ALL SELECT source, doc_id::VARCHAR, 'no_relevant_fragments', '{L.NO_FRAGMENTS.replace("{role}", "spec")}' FROM ok WHERE (source, doc_id) NOT IN (SELECT source, doc_id FROM b)
UNION ALL SELECT n_name, '{L.DESCRIPTION_NAME}', 'warning', '{L.ONLY_DESCRIPTION}' FROM nation WHERE n_nationkey % 2 = 0
UNION ALL SELECT n_name, 'text', 'text', '{L.DESCRIPTION_MARK}' || chr(10) || 'about ' || n_name FROM nation WHERE n_nationkey % 2 = 0""")
def q03_matching_package(spark: SparkSession, d: str) -> DataFrame:
    """Sources as tenders with documents (two fifths of which weren't read), nations as tenders without any, half of them described."""
    k = F.col("doc_id") % 5
    docs = read(spark, d, "documents").select(F.col("source").alias("tender"), F.col("doc_id").cast("string").alias("name"), "text", F.when(k == 0, "error").when(k > 1, "success").alias("status"))
    nations = read(spark, d, "nation").select(F.col("n_name").alias("tender"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit(" about "), "n_name", F.lit(" "))).otherwise(" ").alias("about"))
    tenders = docs.select("tender").distinct().withColumn("about", F.lit("x")).unionByName(nations)
    texts, warnings = jobs.matching_package(tenders, docs, "tender", "about", "name", "text", "status", 10000, 3500, [("spec", [""])], [("any", ["the"], 1)], ["spec"])
    alone = texts.join(nations.select("tender"), "tender", "left_semi").select("tender", F.lit("text").alias("filename"), F.lit("text").alias("status"), F.col("matching_text").alias("message"))
    return warnings.unionByName(alone)


@query(f"""WITH RECURSIVE w AS (SELECT source, doc_id, CASE WHEN doc_id % 7 = 3 THEN doc_id || '.zip' WHEN doc_id % 2 = 0 THEN 'spec' || doc_id ELSE 'x' || doc_id END AS name, CASE WHEN doc_id % 11 = 5 THEN 'error' ELSE 'success' END AS status, text,
  regexp_replace(regexp_replace(regexp_replace(replace(coalesce(text, ''), chr(160), ' '), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS clean FROM documents),
r AS (SELECT *, CASE WHEN starts_with(name, 'spec') THEN 1 ELSE 10 END AS priority, '=== FILE: ' || name || ' | DOC_CLASS_HINT: ' || CASE WHEN starts_with(name, 'spec') THEN 'main' ELSE 'other' END || ' | PRIORITY: ' || CASE WHEN starts_with(name, 'spec') THEN 1 ELSE 10 END
  || ' | STATUS: ' || status || ' | TEXT_LEN: ' || length(coalesce(text, '')) || ' ===' || chr(10) || '--- PAGE_OR_SHEET: 1 | FRAGMENT_TYPE_HINT: ' || CASE WHEN contains(lower(clean), 'haha') THEN 'GENERAL' ELSE 'OTHER' END || ' ---' || chr(10) || '[TEXT]' || chr(10) || clean || chr(10) AS body FROM w),
o AS (SELECT *, length(body) AS n, row_number() OVER (PARTITION BY source ORDER BY priority, doc_id) AS i FROM r WHERE status = 'success' AND NOT ends_with(name, '.zip')),
f AS (SELECT source, doc_id, i, n <= 20000 AS ok, CASE WHEN n <= 20000 THEN n ELSE 0 END AS used FROM o WHERE i = 1
 UNION ALL SELECT o.source, o.doc_id, o.i, f.used + o.n <= 20000, CASE WHEN f.used + o.n <= 20000 THEN f.used + o.n ELSE f.used END FROM f JOIN o ON o.source = f.source AND o.i = f.i + 1),
t AS (SELECT r.*, length(body) AS n, ok, CASE WHEN ends_with(name, '.zip') THEN '{L.ARCHIVE_REASON}' WHEN status <> 'success' THEN 'status_error' WHEN NOT ok THEN '{L.SIZE_REASON}' END AS reason FROM r LEFT JOIN f USING (source, doc_id))
SELECT source, sha256(coalesce(trim(string_agg(body, chr(10) || chr(10) ORDER BY priority, doc_id) FILTER (reason IS NULL), ' ' || chr(10)), '')) AS block, count(*) FILTER (reason IS NULL) AS documents_count, coalesce(sum(n) FILTER (reason IS NULL), 0)::BIGINT AS total_chars,
 coalesce(string_agg(name, ',' ORDER BY priority, doc_id) FILTER (reason IS NULL), '') AS included, coalesce(string_agg(name || ':' || reason, ',' ORDER BY priority, doc_id) FILTER (reason <> '{L.ARCHIVE_REASON}'), '') AS skipped,
 coalesce(string_agg(name, ',' ORDER BY priority, doc_id) FILTER (reason = '{L.ARCHIVE_REASON}'), '') AS archives FROM t GROUP BY source""")
def q04_packet_block(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    name = F.when(k % 7 == 3, F.concat(k.cast("string"), F.lit(".zip"))).when(k % 2 == 0, F.concat(F.lit("spec"), k.cast("string"))).otherwise(F.concat(F.lit("x"), k.cast("string")))
    docs = read(spark, d, "documents").select("source", "doc_id", name.alias("name"), "text", F.when(k % 11 == 5, "error").otherwise("success").alias("status"))
    found = jobs.packet_block(docs, "source", "doc_id", "name", "text", "status", 20000, [(["spec"], None, 1, "main")], [("GENERAL", ["haha"])])
    skipped = F.transform("skipped_files", lambda x: F.concat_ws(":", x["filename"], x["reason"]))
    return found.select("source", F.sha2("block", 256).alias("block"), "documents_count", "total_chars", F.array_join("included_files", ",").alias("included"), F.array_join(skipped, ",").alias("skipped"), F.array_join("archives_skipped", ",").alias("archives"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE contains(lower(o_orderpriority), 'h') AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def p17_filter_with_documents(spark: SparkSession, d: str) -> DataFrame:
    files = read(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return rules.filter_tenders(read(spark, d, "orders"), "H", ["o_orderpriority"], files=files, key="o_orderkey", has_files=True, by_price="o_totalprice").select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, CASE WHEN p_partkey % 6 IN (0, 2, 4) THEN 'ok' ELSE 'mismatch' END AS audit FROM part")
def c39_audit_declared(spark: SparkSession, d: str) -> DataFrame:
    """Files whose names tell no kind, by the types that are declared."""
    types = by_key(*[F.lit(t) for t in ("application/PDF", "application/pdf", "application/msword", "application/zip", "text/plain", "application/vnd.openxmlformats-officedocument.wordprocessingml.document")])
    start = F.unhex(F.when(F.col("p_partkey") % 2 == 0, F.when(F.col("p_partkey") % 6 == 0, "25504446").otherwise("D0CF11E0A1B11AE1")).otherwise("FFD8FFE0"))
    return read(spark, d, "part").select("p_partkey", T.audit_signature(F.concat(start, F.repeat(F.col("p_name"), 40).cast("binary")), said("p_name", ".bin"), declared=types).alias("audit"))


@query("""WITH n AS (SELECT l_orderkey, count(DISTINCT CASE l_partkey % 2 WHEN 0 THEN 'a' || l_partkey % 5 ELSE 'b' || l_partkey % 5 || ' ' || l_quantity::INT END) AS n FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN l_orderkey % 2 = 0 THEN 0 ELSE n END AS positions, CASE WHEN l_orderkey % 2 = 0 THEN 'none' ELSE 'fine' END AS warning FROM n""")
def q01_requirement_warnings(spark: SparkSession, d: str) -> DataFrame:
    """Odd orders' documents name positions, even ones' don't."""
    m, line = F.col("l_partkey") % 5, F.col("l_quantity").cast("int")
    named = F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("Кирпич М"), m, F.lit(" | 1 | шт"))).otherwise(F.concat(F.lit("Труба "), m, F.lit("х "), line, F.lit(" шт")))
    docs = _order_text(spark, d, F.when(F.col("l_orderkey") % 2 == 1, named).otherwise("слова"), head="Техническое задание\n", tail="\n")
    found = jobs.requirement_warnings(docs, jobs.extract_requirements(docs, "l_orderkey"), "l_orderkey")
    return found.select("l_orderkey", "positions", F.when(F.col("warning") == L.NO_POSITIONS, "none").when(F.col("warning") == L.MANY_POSITIONS, "many").otherwise("fine").alias("warning"))
