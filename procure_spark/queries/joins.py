"""Search, matching and joins."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procure_spark.functions.text import query_keywords
from procure_spark.operators import match as J
from procure_spark.plans.jobs import build_packet, match_analogs
from procure_spark.registry import query, read


def _queries(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """Parts whose key is divisible by 50 ask for parts like them, among all: the query set of a search."""
    return read(spark, d, "part").filter("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query_id"), F.concat_ws(" ", "p_name", "p_type").alias("query"), query_keywords(F.concat_ws(" ", "p_name", "p_type")).alias("keywords"), *more)


SEARCH = r"""
q AS (SELECT DISTINCT p_partkey AS query_id, unnest(list_filter(regexp_split_to_array(lower(p_name || ' ' || p_type), '[\s,;/()]+'), lambda k: length(k) > 2 AND NOT regexp_matches(k, '^[0-9]+$'))[1:5]) AS w FROM part WHERE p_partkey % 50 = 0),
h AS (SELECT query_id, p_partkey, sum(3 * contains(lower(p_name), w)::INT + contains(lower(p_type), w)::INT) AS score FROM q JOIN part ON contains(lower(p_name || chr(10) || p_type || chr(10) || p_brand), w) GROUP BY ALL),
s AS (SELECT query_id, p_partkey, score::BIGINT AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, p_partkey)::INT AS rank FROM h)"""


@query(f"WITH {SEARCH} SELECT * FROM s WHERE rank <= 10")
def j01_search_catalog(spark: SparkSession, d: str) -> DataFrame:
    return J.search_catalog(_queries(spark, d), read(spark, d, "part"), "query_id", "keywords", "p_partkey", "p_name", ["p_name", "p_type", "p_brand"], 10, "p_type")


@query(f"""WITH {SEARCH}, a AS (SELECT s.query_id, s.p_partkey, lower(p.p_name) AS title, lower(q.p_name) AS asked, lower(p.p_name || ' ' || p.p_brand) AS head, trim(regexp_replace(lower(p.p_name || ' ' || p.p_brand || ' ' || p.p_type), '[^a-z0-9.,+\\-]+', ' ', 'g')) AS whole,
 list_distinct(list_filter(string_split(trim(regexp_replace(lower(q.p_name), '[^a-z0-9.,+\\-]+', ' ', 'g')), ' '), lambda x: length(x) >= 2)) AS ws FROM s JOIN part p ON p.p_partkey = s.p_partkey JOIN part q ON q.p_partkey = s.query_id WHERE rank <= 10),
b AS (SELECT *, trim(regexp_replace(title, '[^a-z0-9.,+\\-]+', ' ', 'g')) AS t, trim(regexp_replace(asked, '[^a-z0-9.,+\\-]+', ' ', 'g')) AS k, trim(regexp_replace(head, '[^a-z0-9.,+\\-]+', ' ', 'g')) AS h FROM a)
SELECT query_id, p_partkey, ((CASE WHEN contains(t, k) THEN 60 ELSE 0 END) + least(40, 10 * len(list_filter(ws, lambda x: contains(h, x)))) + least(20, 4 * len(list_filter(ws, lambda x: contains(whole, x) AND NOT contains(h, x)))))::INT AS analog_score FROM b""")
def j02_score_analogs(spark: SparkSession, d: str) -> DataFrame:
    q = _queries(spark, d)
    asked = read(spark, d, "part").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("asked"))
    hits = J.search_catalog(q, read(spark, d, "part"), "query_id", "keywords", "p_partkey", "p_name", ["p_name", "p_type", "p_brand"], 10, "p_type")
    pairs = hits.join(read(spark, d, "part"), "p_partkey").join(asked, "query_id")
    return J.score_analogs(pairs, "asked", None, "p_name", "p_brand", None, "p_type").select("query_id", "p_partkey", "analog_score")


@query("""
WITH RECURSIVE l AS (SELECT p_size AS q, list(lower(trim(p_name))) AS seen FROM part WHERE p_partkey % 3 = 0 GROUP BY 1),
e AS (SELECT p_size AS q, p_partkey AS s, lower(trim(p_name)) AS t, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS i FROM part WHERE p_partkey % 3 <> 0),
f AS (SELECT e.q, e.s, 1 AS i, coalesce(l.seen, []) AS before, e.t FROM e LEFT JOIN l ON l.q = e.q WHERE e.i = 1
 UNION ALL SELECT e.q, e.s, e.i::INT, CASE WHEN len(list_filter(f.before, lambda k: contains(k, substr(f.t, 1, 15)) OR contains(f.t, substr(k, 1, 15)))) > 0 THEN f.before ELSE list_append(f.before, f.t) END, e.t FROM f JOIN e ON e.q = f.q AND e.i = f.i + 1)
SELECT q, s FROM f WHERE len(list_filter(before, lambda k: contains(k, substr(t, 1, 15)) OR contains(t, substr(k, 1, 15)))) = 0""")
def j03_dedup_sources(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select(F.col("p_size").alias("q"), F.col("p_partkey").alias("s"), F.col("p_name").alias("title"))
    return J.dedup_sources(p.filter("s % 3 = 0"), p.filter("s % 3 <> 0"), "q", "title", "s").select("q", "s")


@query("""SELECT event_id, user_id, user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase') AS seen FROM events""")
def j04_flag_seen(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return J.flag_seen(e.select("event_id", "user_id"), e.filter("event_type = 'purchase'"), "user_id").select("event_id", "user_id", "seen")


@query("""
WITH s AS (SELECT DISTINCT o_orderkey AS g, CASE WHEN o_orderkey % 3 = 0 THEN 'N' ELSE 'R' END AS name FROM orders WHERE o_orderkey % 2 = 0), f AS (SELECT DISTINCT l_orderkey AS g, l_returnflag AS name FROM lineitem)
SELECT s.g, s.name, CASE WHEN f.g IS NULL THEN 'skipped_not_found' ELSE 'selected' END AS status FROM s LEFT JOIN f ON f.g = s.g AND f.name = s.name UNION ALL SELECT DISTINCT g, NULL, 'error' FROM f WHERE g NOT IN (SELECT g FROM s)""")
def j05_resolve_selection(spark: SparkSession, d: str) -> DataFrame:
    sel = read(spark, d, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("g"), F.when(F.col("o_orderkey") % 3 == 0, "N").otherwise("R").alias("name"))
    return J.resolve_selection(sel, read(spark, d, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_returnflag").alias("name")), "g", "name")


@query("""SELECT c_custkey, 'old' AS status FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT DISTINCT o_custkey, 'Found' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)""")
def j07_merge_new(spark: SparkSession, d: str) -> DataFrame:
    crm = read(spark, d, "customer").filter("c_custkey % 3 = 0").select("c_custkey", F.lit("old").alias("status"))
    return J.merge_new(crm, read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("""SELECT c_custkey, n_name AS responsible FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""")
def j08_with_responsible(spark: SparkSession, d: str) -> DataFrame:
    return J.with_responsible(read(spark, d, "customer"), read(spark, d, "nation"), "c_nationkey", "n_nationkey", "n_name").select("c_custkey", "responsible")


@query("""
WITH r AS (SELECT p_partkey AS item, p_size::DOUBLE AS required FROM part), c AS (SELECT l_partkey AS item, max(l_quantity) AS claimed, min(l_quantity) AS observed FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
v AS (SELECT item, CASE WHEN claimed IS NULL THEN 'MISSING' WHEN claimed < required THEN 'FAIL' WHEN observed < required THEN 'FAKE' ELSE 'OK' END AS verdict FROM r LEFT JOIN c USING (item))
SELECT verdict, count(*) AS n FROM v GROUP BY 1""")
def j09_triple_check(spark: SparkSession, d: str) -> DataFrame:
    req = read(spark, d, "part").select(F.col("p_partkey").alias("item"), F.lit(">=").alias("comparator"), F.col("p_size").cast("double").alias("value"))
    lines = read(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("item"))
    checked = J.triple_check(req, lines.agg(F.max("l_quantity").alias("value")), lines.agg(F.min("l_quantity").alias("value")), ["item"])
    return checked.groupBy("verdict").agg(F.count("*").alias("n"))


@query("""
WITH p AS (SELECT l_orderkey, count(*) AS files, bool_or(l_returnflag = 'R') AS r, bool_or(l_returnflag = 'A') AS a, bool_or(l_returnflag = 'N') AS n FROM lineitem GROUP BY 1)
SELECT l_orderkey, files, concat_ws(',', CASE WHEN NOT a THEN 'fa' END, CASE WHEN NOT n THEN 'fn' END, CASE WHEN NOT r THEN 'fr' END) AS missing, CASE WHEN NOT r OR NOT n THEN 'failed' WHEN NOT a THEN 'warning' ELSE 'passed' END AS overall FROM p""")
def j10_check_package(spark: SparkSession, d: str) -> DataFrame:
    forms = [("fr", "^r$", True), ("fa", "^a$", False), ("fn", "^n$", True)]
    return J.check_package(read(spark, d, "lineitem"), forms, "l_orderkey", "l_returnflag").withColumn("missing", F.array_join("missing", ","))


@query("""
SELECT strftime(x.day, '%Y-%m-%d') AS day, (day(x.day) - 1 + isodow(DATE '1995-03-01') - 1)::INT AS cell, count(o_orderkey) AS due, min(o_orderkey) AS first_key
FROM range(DATE '1995-03-01', DATE '1995-04-01', INTERVAL 1 DAY) x(day) LEFT JOIN orders ON o_orderdate::DATE = x.day::DATE GROUP BY x.day""")
def j11_month_calendar(spark: SparkSession, d: str) -> DataFrame:
    return J.month_calendar(read(spark, d, "orders"), "o_orderdate", 1995, 3, "o_orderkey").withColumn("day", F.col("day").cast("string"))


@query("""SELECT doc_id, quality::VARCHAR AS value FROM labels UNION ALL SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def j14_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("value"))
    return J.with_fallback(docs, read(spark, d, "documents").select("doc_id", F.col("lang").alias("value")), "doc_id")


@query("""SELECT DISTINCT url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)""")
def j15_next_frontier(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "pages")
    return J.next_frontier(p, p.filter("page_id % 3 = 0"), "url")


#: Categories and title words of the rows that a search may find.
LISTED = ["#1", "#2", "ring", "bolt"]


@query(f"""WITH RECURSIVE eligible AS (SELECT * FROM part WHERE p_size > 3 AND ({' OR '.join(f"contains(lower(p_brand), '{w}') OR contains(lower(p_name), '{w}')" for w in LISTED)})),
{SEARCH.replace('JOIN part ON', 'JOIN eligible part ON')}, a AS (SELECT s.query_id, s.p_partkey, p.p_name, trim(regexp_replace(lower(p.p_name), '[^a-z0-9.,+\\-]+', ' ', 'g')) AS t, trim(regexp_replace(lower(p.p_name || ' ' || p.p_brand), '[^a-z0-9.,+\\-]+', ' ', 'g')) AS h,
 trim(regexp_replace(lower(p.p_name || ' ' || p.p_brand || ' ' || p.p_type), '[^a-z0-9.,+\\-]+', ' ', 'g')) AS whole, trim(regexp_replace(lower(q.p_name || ' ' || q.p_type), '[^a-z0-9.,+\\-]+', ' ', 'g')) AS k FROM s JOIN part p ON p.p_partkey = s.p_partkey JOIN part q ON q.p_partkey = s.query_id WHERE rank <= 5),
b AS (SELECT *, list_distinct(list_filter(string_split(k, ' '), lambda x: length(x) >= 2)) AS ws FROM a),
c AS (SELECT query_id, p_partkey, p_name AS title, ((CASE WHEN contains(t, k) THEN 60 ELSE 0 END) + least(40, 10 * len(list_filter(ws, lambda x: contains(h, x)))) + least(20, 4 * len(list_filter(ws, lambda x: contains(whole, x) AND NOT contains(h, x)))))::INT AS analog_score FROM b),
l AS (SELECT query_id, list(lower(trim(title))) AS seen FROM c GROUP BY 1),
e AS (SELECT o.p_partkey AS query_id, p.p_partkey, p.p_name || ' ' || lower(p.p_type) AS title, (p.p_partkey % 100)::INT AS analog_score, row_number() OVER (PARTITION BY o.p_partkey ORDER BY p.p_partkey) AS i FROM part o JOIN part p ON p.p_size = o.p_size AND p.p_type = o.p_type WHERE o.p_partkey % 50 = 0),
f AS (SELECT e.query_id, e.p_partkey, e.title, e.analog_score, 1 AS i, coalesce(l.seen, []) AS before FROM e LEFT JOIN l ON l.query_id = e.query_id WHERE e.i = 1
 UNION ALL SELECT e.query_id, e.p_partkey, e.title, e.analog_score, e.i::INT, CASE WHEN len(list_filter(f.before, lambda k: contains(k, substr(f.title, 1, 15)) OR contains(f.title, substr(k, 1, 15)))) > 0 THEN f.before ELSE list_append(f.before, f.title) END FROM f JOIN e ON e.query_id = f.query_id AND e.i = f.i + 1),
r AS (SELECT *, 'local' AS source FROM c UNION ALL SELECT query_id, p_partkey, title, analog_score, 'external' FROM f WHERE len(list_filter(before, lambda k: contains(k, substr(f.title, 1, 15)) OR contains(f.title, substr(k, 1, 15)))) = 0)
SELECT *, CASE WHEN analog_score >= 90 THEN 'excellent' WHEN analog_score >= 70 THEN 'good' WHEN analog_score >= 50 THEN 'fair' ELSE 'weak' END AS band, row_number() OVER (PARTITION BY query_id ORDER BY analog_score DESC, p_partkey, source DESC)::INT AS rank FROM r""")
def q07_match_analogs(spark: SparkSession, d: str) -> DataFrame:
    """Parts of the query set against eligible parts, with external offers: all parts of the asked part's size and type, under a longer title."""
    part = read(spark, d, "part")
    asked = _queries(spark, d, "p_size", "p_type")
    offers = part.select("p_size", "p_type", "p_partkey", F.concat_ws(" ", "p_name", F.lower("p_type")).alias("title"), (F.col("p_partkey") % 100).cast("int").alias("analog_score"))
    catalog = part.withColumn("open", F.col("p_size") > 3)
    found = match_analogs(asked, catalog, offers, "query_id", "query", "p_partkey", "p_name", ["p_name", "p_type", "p_brand"], 5, whitelist=LISTED, searchable="open", by=["p_size", "p_type"], category="p_brand", description="p_type")
    return found.select("query_id", "p_partkey", "title", "analog_score", "source", "band", "rank")


@query("""
WITH RECURSIVE r AS (SELECT source, doc_id, CASE WHEN contains(lang, 'e') THEN 1 ELSE 10 END AS priority, length(text) AS n FROM documents WHERE length(text) > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY priority, doc_id) AS i FROM r),
f AS (SELECT source, doc_id, priority, n, i, n <= 40000 AS ok, CASE WHEN n <= 40000 THEN n ELSE 0 END AS used FROM o WHERE i = 1
 UNION ALL SELECT o.source, o.doc_id, o.priority, o.n, o.i, f.used + o.n <= 40000, CASE WHEN f.used + o.n <= 40000 THEN f.used + o.n ELSE f.used END FROM f JOIN o ON o.source = f.source AND o.i = f.i + 1)
SELECT source, doc_id, priority, CASE WHEN NOT ok THEN 'over_budget' END AS reason FROM f UNION ALL SELECT source, doc_id, CASE WHEN contains(lang, 'e') THEN 1 ELSE 10 END, 'empty' FROM documents WHERE coalesce(length(text), 0) = 0""")
def q04_build_packet(spark: SparkSession, d: str) -> DataFrame:
    return build_packet(read(spark, d, "documents"), "source", "doc_id", "lang", "text", budget=40000, rule=[(["e"], None, 1, "e")]).select("source", "doc_id", "priority", "reason")
