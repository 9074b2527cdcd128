"""Column functions and splitters."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procure_spark.functions import text as T
from procure_spark.operators import split as X
from procure_spark.registry import query, read

PRICE = "case o_orderkey % 4 when 0 then replace(printf('%.2f', o_totalprice), '.', ',') when 1 then printf('%.2f', o_totalprice) || ' руб' when 2 then '1.' || replace(printf('%.2f', o_totalprice), '.', ',') else 'нет' end"


@query(f"""
WITH t AS (SELECT o_orderkey, {PRICE} AS raw FROM orders)
SELECT o_orderkey, raw, CASE o_orderkey % 4 WHEN 0 THEN replace(raw, ',', '.')::DOUBLE WHEN 1 THEN replace(raw, ' руб', '')::DOUBLE
  WHEN 2 THEN replace(replace(raw, '.', ''), ',', '.')::DOUBLE ELSE 0.0 END AS price FROM t""")
def c01_parse_price(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "orders").select("o_orderkey", F.expr(PRICE).alias("raw"))
    return t.withColumn("price", T.parse_price(F.col("raw")))


@query(r"""
WITH t AS (SELECT doc_id, replace(regexp_extract(regexp_replace(coalesce(text, ''), '[\s\x{00A0}]+', '', 'g'), '([0-9]+[.,0-9]*)', 1), ',', '.') AS n FROM documents)
SELECT doc_id, try_cast(nullif(n, '') AS DOUBLE) AS number FROM t""")
def c03_first_number(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", T.first_number(F.col("text")).alias("number"))


@query(r"""
SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(160), ' '), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS multi,
  sha256(lower(regexp_replace(regexp_replace(replace(text, chr(160), ' '), '\s+', ' ', 'g'), '^ | $', '', 'g'))) AS low FROM documents""")
def c04_norm_text(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.sha2(T.norm_text(F.col("text")), 256).alias("multi"), F.sha2(T.norm_text(F.col("text"), "lower"), 256).alias("low"))


@query(r"""
WITH t AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(lower(replace(text, chr(160), ' ')), '[^a-zа-я0-9.,+\-]+', ' ', 'g')), ' '),
  lambda x: length(x) >= 2 AND x NOT IN ('the', 'of', 'and')) AS w FROM documents)
SELECT doc_id, len(w)::INT AS n, sha256(array_to_string(w, ' ')) AS tokens FROM t""")
def c05_tokens(spark: SparkSession, d: str) -> DataFrame:
    w = T.tokens(F.col("text"), ["the", "of", "and"])
    return read(spark, d, "documents").select("doc_id", w.alias("w")).select("doc_id", F.size("w").alias("n"), F.sha2(F.array_join("w", " "), 256).alias("tokens"))


@query(r"""
SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(lower(p_name || ' 12/' || p_type), '[\s,;/()]+'),
  lambda k: length(k) > 2 AND k NOT IN ('steel') AND NOT regexp_matches(k, '^[0-9]+$'))[1:5], '|') AS keywords FROM part""")
def c07_query_keywords(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    return p.select("p_partkey", F.array_join(T.query_keywords(F.concat("p_name", F.lit(" 12/"), "p_type"), ["steel"]), "|").alias("keywords"))


@query(r"""SELECT p_partkey, trim(regexp_replace(lower(p_name || ' - ' || p_brand), '[^\w]+', ' ', 'g')) AS key FROM part""")
def c10_dedup_key(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", T.dedup_key(F.concat("p_name", F.lit(" - "), "p_brand")).alias("key"))


LAW = """SELECT o_orderkey, case when o_orderkey % 3 = 0 then '223-' || o_orderkey else cast(o_orderkey as varchar(20)) end AS reg,
  case when o_orderkey % 5 = 0 then 'ea44' else '' end AS ntype, case when o_orderkey % 7 = 0 then 'https://commercial.example' else '' end AS url,
  case when o_orderkey % 11 = 0 then '44-ФЗ' else '' end AS explicit FROM orders"""


@query(f"""WITH t AS ({LAW}) SELECT o_orderkey, CASE WHEN explicit = '44-ФЗ' THEN explicit WHEN starts_with(reg, '223-') THEN '223-ФЗ'
  WHEN contains(url, 'commercial') THEN 'Коммерч.' ELSE '44-ФЗ' END AS law FROM t""")
def c14_law_type(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "orders").selectExpr(*LAW_COLUMNS)
    return t.select("o_orderkey", T.law_type(F.col("reg"), F.col("ntype"), F.col("url"), F.lit(""), F.col("explicit")).alias("law"))


LAW_COLUMNS = [
    "o_orderkey", "case when o_orderkey % 3 = 0 then concat('223-', o_orderkey) else cast(o_orderkey as string) end as reg", "case when o_orderkey % 5 = 0 then 'ea44' else '' end as ntype",
    "case when o_orderkey % 7 = 0 then 'https://commercial.example' else '' end as url", "case when o_orderkey % 11 = 0 then '44-ФЗ' else '' end as explicit",
]


@query(f"""WITH t AS ({LAW}) SELECT o_orderkey, CASE WHEN url <> '' THEN url
  WHEN starts_with(reg, '223-') THEN 'https://zakupki.gov.ru/epz/order/notice/notice223/documents.html?noticeInfoId=' || substr(reg, 5)
  WHEN ntype <> '' THEN 'https://zakupki.gov.ru/epz/order/notice/ea44/view/documents.html?regNumber=' || reg ELSE '' END AS docs_url FROM t""")
def c15_docs_url(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "orders").selectExpr(*LAW_COLUMNS)
    return t.select("o_orderkey", T.docs_url(F.col("url"), F.col("reg"), F.col("ntype")).alias("docs_url"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS deadline FROM orders""")
def c16_deadline_date(spark: SparkSession, d: str) -> DataFrame:
    raw = F.expr("case o_orderkey % 3 when 0 then date_format(o_orderdate, 'dd.MM.yyyy HH:mm') when 1 then date_format(o_orderdate, 'yyyy-MM-dd') else '-' end")
    return read(spark, d, "orders").select("o_orderkey", T.deadline_date(raw).cast("string").alias("deadline"))


@query(r"""SELECT page_id, regexp_extract(url, '[?&]regNumber=([0-9]+)', 1) AS reg FROM (SELECT page_id, url || '?regNumber=' || (10000000000 + page_id) AS url FROM pages)""")
def c17_registry_key(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", T.registry_key(F.concat("url", F.lit("?regNumber="), F.col("page_id") + 10000000000)).alias("reg"))


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 100 ELSE 10 END AS rank FROM pages""")
def c18_href_rank(spark: SparkSession, d: str) -> DataFrame:
    tail = F.element_at(F.array(*[F.lit(x) for x in ("/common-info.html", "/documents.html", "/contract-info.html", "/plan.html", "/else")]), (F.col("page_id") % 5 + 1).cast("int"))
    return read(spark, d, "pages").select("page_id", T.href_rank(F.concat(F.lit("https://h.example/n"), tail)).alias("rank"))


@query(r"""
WITH t AS (SELECT page_id, regexp_extract(url, '^([a-zA-Z]+)://', 1) AS s, replace(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1), 'www.', '') AS h,
  regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS p,
  list_filter(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_') AND lower(string_split(x, '=')[1]) NOT IN ('gclid', 'fbclid', 'yclid', 'city')) AS q FROM pages)
SELECT page_id, s || '://' || h || p || '?' || array_to_string(list_append(list_transform(q, lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END), 'city=1'), '&') AS url FROM t""")
def c19_canonical_url(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", T.canonical_url(F.col("url"), force=("city", "1")).alias("url"))


@query(r"""SELECT page_id, ends_with(replace(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1), 'www.', ''), 'example.com') AND NOT regexp_matches(lower(url), '\.(jpg|jpeg|png|svg|ico|webp|css|js|pdf|zip)$') AS allowed FROM pages""")
def c20_allowed_url(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", T.allowed_url(F.col("url"), "example.com").alias("allowed"))


@query(r"""SELECT conv_id, turn, sha256(regexp_replace(regexp_replace(regexp_replace('# ' || text || chr(10) || '**b** _c_', '\*\*|\*|__|_', '', 'g'), '#+\s+', '', 'g'), '^\s+|\s+$', '', 'g')) AS plain FROM conversations""")
def c24_strip_markdown(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("# "), "text", F.lit("\n**b** _c_"))
    return read(spark, d, "conversations").select("conv_id", "turn", F.sha2(T.strip_markdown(text), 256).alias("plain"))


@query("""SELECT event_id, CAST(props->>'k' AS INT) AS k FROM events""")
def c25_parse_json_lenient(spark: SparkSession, d: str) -> DataFrame:
    fenced = F.concat(F.lit("```json\n"), F.regexp_replace("props", "\\}$", ",}"), F.lit("\n```"))
    return read(spark, d, "events").select("event_id", T.parse_json_lenient(fenced, "k int")["k"].alias("k"))


@query("""SELECT p_partkey, 'brand: ' || p_brand || ' ; size: ' || p_size AS specs FROM part""")
def c26_flatten_specs(spark: SparkSession, d: str) -> DataFrame:
    specs = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"))
    return read(spark, d, "part").select("p_partkey", T.flatten_specs(specs).alias("specs"))


@query("""SELECT p_partkey, string_split(p_type || ' / ' || p_brand, ' / ')[1] AS senior FROM part""")
def c29_senior_category(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", T.senior_category(F.concat("p_type", F.lit(" / "), "p_brand")).alias("senior"))


@query("""SELECT p_partkey, CASE WHEN 2 * p_size >= 90 THEN 'excellent' WHEN 2 * p_size >= 70 THEN 'good' WHEN 2 * p_size >= 50 THEN 'fair' ELSE 'weak' END AS band, 2 * p_size > 80 AS equivalent FROM part""")
def c30_match_band(spark: SparkSession, d: str) -> DataFrame:
    score = F.col("p_size") * 2
    return read(spark, d, "part").select("p_partkey", T.match_band(score).alias("band"), T.is_equivalent(score).alias("equivalent"))


@query(r"""SELECT p_partkey, length(trim(p_name)) < 10 OR (NOT regexp_matches(p_name, '[0-9a-zA-Z]') AND len(list_filter(regexp_split_to_array(trim(p_name), '\s+'), lambda w: w <> '')) < 3) AS generic FROM part""")
def c31_is_generic_query(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", T.is_generic_query(F.col("p_name")).alias("generic"))


@query("""SELECT doc_id, CASE WHEN contains(source, '1') THEN 1 WHEN contains(source, '2') THEN 2 ELSE 10 END AS priority, CASE WHEN contains(source, '1') THEN 'one' WHEN contains(source, '2') THEN 'two' ELSE 'other' END AS class FROM documents""")
def c33_doc_priority(spark: SparkSession, d: str) -> DataFrame:
    p = T.doc_priority(F.col("source"), [(["1"], None, 1, "one"), (["2"], None, 2, "two")])
    return read(spark, d, "documents").select("doc_id", p["priority"].alias("priority"), p["class"].alias("class"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'O' WHEN 'O' THEN 'F' ELSE 'F' END AS ahead, CASE o_orderstatus WHEN 'F' THEN 'O' ELSE 'P' END AS back FROM orders""")
def c35_step_status(spark: SparkSession, d: str) -> DataFrame:
    order = ["P", "O", "F"]
    return read(spark, d, "orders").select("o_orderkey", T.step_status(F.col("o_orderstatus"), True, order).alias("ahead"), T.step_status(F.col("o_orderstatus"), False, order).alias("back"))


#: Blocks between blank lines, those over 5,000 characters packed anew by lines: (doc_id, i, p, b), ordered by i, p.
BLOCKS = r"""RECURSIVE raw AS (SELECT doc_id, i, trim(x) AS b FROM (SELECT doc_id, unnest(regexp_split_to_array(t, '\n\s*\n')) AS x, generate_subscripts(regexp_split_to_array(t, '\n\s*\n'), 1) AS i FROM (SELECT doc_id, {text} AS t FROM documents)) WHERE trim(x) <> ''),
l AS (SELECT doc_id, i, x, row_number() OVER (PARTITION BY doc_id, i ORDER BY j) AS r FROM (SELECT doc_id, i, unnest(string_split(b, chr(10))) AS x, generate_subscripts(string_split(b, chr(10)), 1) AS j FROM raw WHERE length(b) > 5000) WHERE trim(x) <> ''),
f AS (SELECT doc_id, i, r, x, 0 AS p, length(x) AS n FROM l WHERE r = 1
  UNION ALL SELECT l.doc_id, l.i, l.r, l.x, CASE WHEN f.n + 1 + length(l.x) <= 2500 THEN f.p ELSE f.p + 1 END, CASE WHEN f.n + 1 + length(l.x) <= 2500 THEN f.n + 1 + length(l.x) ELSE length(l.x) END
  FROM f JOIN l ON l.doc_id = f.doc_id AND l.i = f.i AND l.r = f.r + 1),
blocks AS (SELECT doc_id, i, 0 AS p, b FROM raw WHERE length(b) <= 5000 UNION ALL SELECT doc_id, i, p, string_agg(x, chr(10) ORDER BY r) FROM f GROUP BY ALL)"""


@query(f"""WITH {BLOCKS.format(text="CASE WHEN doc_id % 2 = 0 THEN text ELSE replace(text, chr(10), chr(10) || chr(10)) END")}
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, p) - 1)::INT AS pos, sha256(b) AS block FROM blocks""")
def x01_split_blocks(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return X.split_blocks(read(spark, d, "documents").select("doc_id", text.alias("text"))).select("doc_id", "pos", F.sha2("block", 256).alias("block"))


@query(r"""SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS pos, sha256(trim(x)) AS line FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(x) <> ''""")
def x02_split_lines(spark: SparkSession, d: str) -> DataFrame:
    return X.split_lines(read(spark, d, "documents").select("doc_id", "text")).select("doc_id", "pos", F.sha2("line", 256).alias("line"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
c AS (SELECT doc_id, i, list_filter(list_transform(string_split(trim(x), '|'), lambda c: trim(regexp_replace(c, '^\s*[•·*–-]+\s*', ''))), lambda c: c <> '') AS cells FROM l WHERE trim(x) <> '' AND length(trim(x)) - length(replace(trim(x), '|', '')) >= 2)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS pos, len(cells)::INT AS n, sha256(array_to_string(cells, '|')) AS cells FROM c WHERE len(cells) >= 3""")
def x03_pipe_rows(spark: SparkSession, d: str) -> DataFrame:
    return X.pipe_rows(read(spark, d, "documents").select("doc_id", "text")).select("doc_id", "pos", F.size("cells").alias("n"), F.sha2(F.array_join("cells", "|"), 256).alias("cells"))


@query(r"""
WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations)
SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1)::INT AS pos, sha256(trim(regexp_replace(trim(x), '^(?:[-*•]|[0-9]+[.)])\s+', ''))) AS item
FROM l WHERE trim(x) <> '' AND NOT regexp_matches(trim(x), '^[|#]') AND trim(regexp_replace(trim(x), '^(?:[-*•]|[0-9]+[.)])\s+', '')) <> ''""")
def x05_markdown_list(spark: SparkSession, d: str) -> DataFrame:
    return X.markdown_list(read(spark, d, "conversations")).select("conv_id", "turn", "pos", F.sha2("item", 256).alias("item"))


@query("""
WITH n AS (SELECT doc_id, text, CASE WHEN length(text) <= 1000 THEN 1 ELSE ceil((length(text) - 1000) / 900.0)::INT + 1 END AS n FROM documents),
c AS (SELECT doc_id, unnest(range(n)) AS pos, text FROM n)
SELECT doc_id, pos::INT AS pos, sha256(trim(substr(text, pos * 900 + 1, 1000))) AS chunk FROM c WHERE trim(substr(text, pos * 900 + 1, 1000)) <> ''""")
def x06_chunk_chars(spark: SparkSession, d: str) -> DataFrame:
    return X.chunk_chars(read(spark, d, "documents").select("doc_id", "text"), 1000, 100).select("doc_id", "pos", F.sha2("chunk", 256).alias("chunk"))


@query("""
WITH RECURSIVE l AS (SELECT doc_id, trim(x) AS x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(x) <> ''),
f AS (SELECT doc_id, r, x, 0 AS pos, length(x) AS n FROM l WHERE r = 1
  UNION ALL SELECT l.doc_id, l.r, l.x, CASE WHEN f.n + 1 + length(l.x) <= 1400 THEN f.pos ELSE f.pos + 1 END, CASE WHEN f.n + 1 + length(l.x) <= 1400 THEN f.n + 1 + length(l.x) ELSE length(l.x) END
  FROM f JOIN l ON l.doc_id = f.doc_id AND l.r = f.r + 1)
SELECT doc_id, pos::INT AS pos, sha256(string_agg(x, chr(10) ORDER BY r)) AS piece FROM f GROUP BY doc_id, pos""")
def x07_pack_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return X.pack_paragraphs(read(spark, d, "documents").select("doc_id", "text")).select("doc_id", "pos", F.sha2("piece", 256).alias("piece"))


@query(r"""
WITH l AS (SELECT doc_id, trim(x) AS x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(x) <> ''),
s AS (SELECT *, sum(CASE WHEN regexp_matches(x, '^(The|La|Die) ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY r) AS section FROM l)
SELECT doc_id, section::BIGINT AS section, sha256(string_agg(x, chr(10) ORDER BY r)) AS body FROM s GROUP BY ALL""")
def x08_split_sections(spark: SparkSession, d: str) -> DataFrame:
    return X.split_sections(read(spark, d, "documents"), "doc_id", "^(The|La|Die) ").select("doc_id", "section", F.sha2("body", 256).alias("body"))


@query("""SELECT p_partkey, (i - 1)::INT AS pos, trim(x) AS query FROM (SELECT p_partkey, unnest(string_split(p_name || ', ' || p_type, ',')) AS x, generate_subscripts(string_split(p_name || ', ' || p_type, ','), 1) AS i FROM part) WHERE trim(x) <> ''""")
def x09_explode_queries(spark: SparkSession, d: str) -> DataFrame:
    return X.explode_queries(read(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit(", "), "p_type").alias("q")), "q").select("p_partkey", "pos", "query")


@query(r"""
SELECT page_id, CASE WHEN len(regexp_extract_all(html, '(?i)<li\b')) >= 8 OR len(regexp_extract_all(html, '(?is)<h[2-4]\b[^>]*>\s*<a\b')) >= 6 THEN 'listing'
  WHEN regexp_matches(html, '(?i)<h1\b') AND regexp_matches(html, '(?i)<li\b') AND (len(regexp_extract_all(html, '(?i)<tr\b')) >= 3 OR regexp_matches(html, '(?i)<p\b')) THEN 'product' ELSE 'other' END AS page_class
FROM (SELECT page_id, coalesce(html, '') AS html FROM pages)""")
def x15_classify_pages(spark: SparkSession, d: str) -> DataFrame:
    return X.classify_pages(read(spark, d, "pages"), carts="(?!)", price=r"(?i)<li\b", sales="(?!)", marker=r"(?i)<p\b").select("page_id", "page_class")
