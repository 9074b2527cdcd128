"""Merges, rollups, selection, unions and upserts."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procure_spark import lexicons as L
from procure_spark.operators import merge as A
from procure_spark.operators import rollup as R
from procure_spark.operators import select as W
from procure_spark.operators import upsert as M
from procure_spark.registry import query, read


@query("""
WITH r AS (SELECT user_id, event_id, event_type, props, row_number() OVER (PARTITION BY user_id ORDER BY length(event_type) DESC, event_id) AS a,
  row_number() OVER (PARTITION BY user_id ORDER BY length(props) DESC, event_id) AS b, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS c, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, max(event_type) FILTER (WHERE a = 1) AS event_type, max(props) FILTER (WHERE b = 1) AS props, max(event_id) FILTER (WHERE c = 1) AS event_id, max(n) AS merged FROM r GROUP BY user_id""")
def a01_merge_notices(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").withColumn("seq", F.col("event_id"))
    return A.merge_notices(e, "user_id", "seq", ["event_type", "props"], first_of_all=["event_id"])


@query("""
WITH r AS (SELECT l_orderkey, l_returnflag, l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS l_linenumber, l_quantity, l_linestatus, l_discount > 0.05 AS off FROM lineitem),
m AS (SELECT l_orderkey, l_returnflag, min(l_linenumber) AS first_seq, arg_min(l_quantity, struct_pack(a := l_linenumber, b := l_quantity)) AS l_quantity, bool_or(off) AS off, count(*) - 1 AS duplicates FROM r GROUP BY ALL),
s AS (SELECT l_orderkey, l_returnflag, string_agg(l_linestatus, ',' ORDER BY f, l_linestatus) AS statuses FROM (SELECT l_orderkey, l_returnflag, l_linestatus, min(l_linenumber) AS f FROM r GROUP BY ALL) GROUP BY ALL)
SELECT l_orderkey, l_returnflag, first_seq, l_quantity, statuses, off, duplicates, row_number() OVER (PARTITION BY l_orderkey ORDER BY first_seq, l_returnflag)::INT AS number FROM m JOIN s USING (l_orderkey, l_returnflag)""")
def a02_merge_positions(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_returnflag", F.expr("l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey % 1000 as l_linenumber"), "l_quantity", F.array("l_linestatus").alias("statuses"), (F.col("l_discount") > 0.05).alias("off"))
    m = A.merge_positions(rows, ["l_orderkey", "l_returnflag"], "l_linenumber", ["l_quantity"], ["statuses"], ["off"])
    return m.withColumn("statuses", F.array_join("statuses", ","))


FACTS = """SELECT user_id, event_id, CASE event_id % 2 WHEN 0 THEN 'nmcc_prices' ELSE 'payment' END AS topic, event_type AS value_raw,
  CASE event_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, CASE event_id % 7 WHEN 0 THEN 'partial' WHEN 1 THEN 'bad' WHEN 2 THEN 'conflict' ELSE 'ok' END AS status"""
WEIGHT = "10 + CASE confidence WHEN 'high' THEN 10 WHEN 'medium' THEN 5 ELSE 1 END - CASE status WHEN 'partial' THEN 3 ELSE 0 END"


def _facts(spark: SparkSession, d: str) -> DataFrame:
    read(spark, d, "events").createOrReplaceTempView("procure_events")
    return spark.sql(FACTS + " FROM procure_events").withColumnRenamed("event_id", "seq")


VOTES = f"""WITH f AS ({FACTS} FROM events), g AS (SELECT *, {WEIGHT} AS w FROM f WHERE status <> 'bad'),
v AS (SELECT user_id, value_raw, sum(w) AS w, min(event_id) AS s FROM g WHERE topic = 'nmcc_prices' GROUP BY ALL),
o AS (SELECT user_id, list(value_raw ORDER BY w DESC, s, value_raw) AS vs, list(w ORDER BY w DESC, s, value_raw) AS ws FROM v GROUP BY ALL),
m AS (SELECT user_id, vs, CASE WHEN len(vs) = 1 THEN 'agree' WHEN ws[1] >= 2 * ws[2] THEN 'select' ELSE 'conflict' END AS mode FROM o)"""


@query(VOTES + """ SELECT user_id, mode AS merge_mode, CASE WHEN mode <> 'conflict' THEN vs[1] END AS final_value, array_to_string(vs[1:5], ',') AS variants, mode = 'conflict' AS conflict_flag FROM m""")
def a04_merge_select(spark: SparkSession, d: str) -> DataFrame:
    f = _facts(spark, d).filter("status <> 'bad' and topic = 'nmcc_prices'").withColumn("w", A.fact_weight(F.col("confidence"), F.col("status")))
    return A.merge_select(f, ["user_id"], "value_raw", "w", "seq").withColumn("variants", F.array_join("variants", ","))


LISTS = f""", p AS (SELECT user_id, value_raw, max(w) AS w, arg_min(event_id, struct_pack(a := -w, b := event_id)) AS s, bool_or(status = 'conflict') AS c FROM g WHERE topic = 'payment' GROUP BY ALL),
l AS (SELECT user_id, list(value_raw ORDER BY w DESC, s, value_raw) AS vs, bool_or(c) AS c FROM p GROUP BY ALL)"""


@query(VOTES + LISTS + """ SELECT user_id, array_to_string(vs, ',') AS "values", c AS conflict_flag FROM l""")
def a05_merge_aggregate(spark: SparkSession, d: str) -> DataFrame:
    f = _facts(spark, d).filter("status <> 'bad' and topic = 'payment'").withColumn("w", A.fact_weight(F.col("confidence"), F.col("status")))
    return A.merge_aggregate(f, ["user_id"], "value_raw", "w", "seq", "status").withColumn("values", F.array_join("values", ","))


@query(VOTES + LISTS + """, t AS (SELECT user_id, topic FROM (SELECT DISTINCT user_id FROM events), (VALUES ('nmcc_prices'), ('payment'), ('subject')) x(topic))
SELECT t.user_id, topic, coalesce(CASE topic WHEN 'nmcc_prices' THEN m.mode WHEN 'payment' THEN CASE WHEN l.vs IS NOT NULL THEN 'aggregate' END END, 'not_found') AS merge_mode,
 coalesce(CASE topic WHEN 'nmcc_prices' THEN CASE WHEN m.mode = 'conflict' THEN array_to_string(m.vs[1:5], ',') ELSE m.vs[1] END WHEN 'payment' THEN array_to_string(l.vs, ',') END, '') AS "values",
 coalesce(CASE topic WHEN 'nmcc_prices' THEN m.mode = 'conflict' WHEN 'payment' THEN l.c END, false) AS conflict_flag
FROM t LEFT JOIN m ON m.user_id = t.user_id LEFT JOIN l ON l.user_id = t.user_id""")
def a06_reconcile(spark: SparkSession, d: str) -> DataFrame:
    return A.reconcile(_facts(spark, d), "user_id", ["nmcc_prices", "payment", "subject"]).withColumn("values", F.array_join("values", ","))


@query("""
WITH l AS (SELECT doc_id, trim(x) AS x, i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(x) <> ''),
f AS (SELECT doc_id, arg_min(x, i) AS x, min(i) AS i FROM l GROUP BY doc_id, lower(x))
SELECT doc_id, count(*)::INT AS n, sha256(string_agg(x, chr(10) ORDER BY i)) AS lines FROM f GROUP BY doc_id""")
def a07_ordered_distinct(spark: SparkSession, d: str) -> DataFrame:
    from procure_spark.operators.split import split_lines

    v = A.ordered_distinct(split_lines(read(spark, d, "documents").select("doc_id", "text")), ["doc_id"], "line", "pos")
    return v.select("doc_id", F.size("values").alias("n"), F.sha2(F.array_join("values", "\n"), 256).alias("lines"))


@query("""
WITH s AS (SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS amount FROM orders GROUP BY 1), o AS (SELECT * FROM (VALUES ('P', 0), ('O', 1), ('W', 2)) x(status, place))
SELECT coalesce(o.status, s.status) AS status, coalesce(place, 3) AS place, coalesce(n, 0) AS n, coalesce(amount, 0.0)::DOUBLE AS amount FROM o FULL JOIN s ON o.status = s.status""")
def a08_funnel(spark: SparkSession, d: str) -> DataFrame:
    return R.funnel(read(spark, d, "orders"), "o_orderstatus", "o_totalprice", ["P", "O", "W"])


@query("""
SELECT count(*) FILTER (WHERE o_orderstatus = 'O') AS active, round(100.0 * count(*) FILTER (WHERE o_orderstatus = 'F') / nullif(count(*) FILTER (WHERE o_orderstatus IN ('F', 'P')), 0), 2)::DOUBLE AS win_rate,
 round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2) AS active_amount, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS high_risk, count(*) FILTER (WHERE o_orderstatus = 'F') AS contracts FROM orders""")
def a09_kpis(spark: SparkSession, d: str) -> DataFrame:
    return R.kpis(read(spark, d, "orders"), "o_orderstatus", "o_totalprice", "o_orderpriority", ["O"], ["F"], ["P"], ["1-URGENT"])


@query("""
SELECT w.weekday::INT AS weekday, count(o_orderkey) AS found, coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END), 0)::BIGINT AS won
FROM range(7) w(weekday) LEFT JOIN orders ON isodow(o_orderdate) - 1 = w.weekday GROUP BY 1""")
def a10_weekday_activity(spark: SparkSession, d: str) -> DataFrame:
    return R.weekday_activity(read(spark, d, "orders"), "o_orderdate", F.col("o_orderstatus") == "F")


@query("""SELECT p_brand AS senior, count(*) AS n, array_to_string(list_sort(list(DISTINCT p_name)), '|') AS titles FROM part GROUP BY 1""")
def a11_catalog_groups(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").withColumn("category", F.concat("p_brand", F.lit(" / "), "p_type"))
    return R.catalog_groups(p, "category", "p_name").withColumn("titles", F.array_join("titles", "|"))


@query("""
SELECT source, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'fr') AS fr, count(*) AS fragments, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1""")
def a12_fragment_stats(spark: SparkSession, d: str) -> DataFrame:
    return R.fragment_stats(read(spark, d, "documents"), ["source"], "lang", ["en", "fr"], "text")


@query("""
SELECT conv_id, count(*) AS files, count(*) FILTER (WHERE role = 'assistant') AS success, count(*) FILTER (WHERE role <> 'assistant') AS failed, count(*) FILTER (WHERE length(text) < 100) AS archives,
 coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS chars, bool_or(role <> 'assistant' OR length(text) < 100) AS degraded FROM conversations GROUP BY 1""")
def a13_packet_stats(spark: SparkSession, d: str) -> DataFrame:
    return R.packet_stats(read(spark, d, "conversations"), "conv_id", "role", "text", ["assistant"], F.length("text") < 100)


@query("""
SELECT l_orderkey, count(*) AS positions, count(*) FILTER (WHERE l_returnflag <> 'N') AS with_quantity, count(*) FILTER (WHERE l_linestatus <> 'O') AS with_unit, count(*) FILTER (WHERE l_linenumber > 2) AS with_characteristics,
 count(*) FILTER (WHERE l_returnflag <> 'N') + count(*) FILTER (WHERE l_linenumber > 2) = 0 AS degraded FROM lineitem GROUP BY 1""")
def a14_quality_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").withColumn("n", F.greatest(F.lit(0), F.col("l_linenumber") - 2))
    return R.quality_summary(rows, ["l_orderkey"], "l_returnflag", "l_linestatus", "n", ["n", "o"])


@query("""
SELECT conv_id, count(*) AS files, count(*) FILTER (role = 'assistant') AS success, count(*) FILTER (role <> 'assistant') AS failed, 0::BIGINT AS archives, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS chars, bool_or(role <> 'assistant') AS degraded,
 coalesce(sum(len(string_split(text, chr(10)))) FILTER (role = 'assistant'), 0)::BIGINT AS pages, coalesce(sum(length(text) - length(replace(text, '.', ''))) FILTER (role = 'assistant'), 0)::BIGINT AS tables FROM conversations GROUP BY 1""")
def a22_packet_pages(spark: SparkSession, d: str) -> DataFrame:
    """Lines stand for pages, full stops for tables."""
    dots = F.length("text") - F.length(F.replace("text", F.lit("."), F.lit("")))
    return R.packet_stats(read(spark, d, "conversations"), "conv_id", "role", "text", ["assistant"], pages=F.size(F.split("text", "\n")), tables=dots)


@query(f"""
SELECT l_orderkey, count(*) AS positions, count(*) FILTER (l_returnflag <> 'N') AS with_quantity, count(*) FILTER (l_linestatus <> 'O') AS with_unit, count(*) FILTER (l_linenumber > 2) AS with_characteristics, bool_or(l_quantity > 49) AS archives_blocking,
 count(*) FILTER (l_returnflag <> 'N') + count(*) FILTER (l_linenumber > 2) = 0 OR bool_or(l_quantity > 49) AS degraded,
 concat_ws(';', CASE WHEN bool_and(l_linenumber <= 2) THEN '{L.NO_CHARACTERISTICS}' END, CASE WHEN bool_and(l_returnflag = 'N') THEN '{L.NO_QUANTITIES}' END) AS warnings FROM lineitem GROUP BY 1""")
def a23_quality_warnings(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").withColumn("n", F.greatest(F.lit(0), F.col("l_linenumber") - 2))
    found = R.quality_summary(rows, ["l_orderkey"], "l_returnflag", "l_linestatus", "n", ["n", "o"], F.col("l_quantity") > 49)
    return found.withColumn("warnings", F.array_join("warnings", ";"))


@query("""
WITH p AS (SELECT user_id, list_sort(list(DISTINCT event_type) FILTER (WHERE event_id % 4 <> 0)) AS ok, list_sort(list(DISTINCT event_type) FILTER (WHERE event_id % 4 = 0)) AS bad, bool_or(value > 95) AS c, max(event_id % 1000) AS n FROM events GROUP BY 1)
SELECT user_id, coalesce(array_to_string(ok, ','), '') AS succeeded, coalesce(array_to_string(bad, ','), '') AS failed, CASE WHEN coalesce(len(ok), 0) = 0 THEN 'error' WHEN c OR n <= 300 OR coalesce(len(bad), 0) > 0 THEN 'partial' ELSE 'success' END AS outcome FROM p""")
def a15_package_outcome(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").withColumns({"status": F.when(F.col("event_id") % 4 != 0, "success").otherwise("error"), "critical": F.col("value") > 95, "chars": F.col("event_id") % 1000})
    return R.package_outcome(e, "user_id", "event_type", "status", "critical", "chars").withColumns({"succeeded": F.array_join("succeeded", ","), "failed": F.array_join("failed", ",")})


@query("""
WITH l AS (SELECT user_id % 20 AS job, user_id, arg_max(event_type, event_id) AS s FROM events GROUP BY ALL)
SELECT job, count(*) AS tenders, count(*) FILTER (WHERE s IN ('purchase', 'click')) AS done, CASE WHEN bool_and(s IN ('purchase', 'click')) THEN 'completed' ELSE 'running' END AS status FROM l GROUP BY 1""")
def a16_job_status(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").withColumn("job", F.col("user_id") % 20)
    return R.job_status(e, "job", "user_id", "event_id", "event_type", ["purchase", "click"])


@query("""
WITH s AS (SELECT l_orderkey, count(*) AS f FROM lineitem WHERE l_linenumber = 3 OR l_returnflag = 'R' GROUP BY 1)
SELECT count(*) AS tenders, sum(f)::BIGINT AS files, round(sum(o_totalprice), 2) AS amount FROM s JOIN orders ON o_orderkey = l_orderkey""")
def a17_selection_totals(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "lineitem").filter("l_linenumber = 3 or l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.selection_totals(s, read(spark, d, "orders"), "o_orderkey", "o_totalprice")


@query("""WITH p AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)
SELECT sum(n)::BIGINT AS raw, count(*) AS unique_keys, (sum(n) - count(*))::BIGINT AS removed, count(*) FILTER (WHERE n > 1) AS duplicated FROM p""")
def a18_dedup_stats(spark: SparkSession, d: str) -> DataFrame:
    return R.dedup_stats(read(spark, d, "events"), "user_id")


@query("""
WITH t AS (SELECT doc_id, coalesce(text, '') AS r FROM documents),
m AS (SELECT doc_id, r, (NOT contains(r, ' the '))::INT + (NOT contains(r, ' and '))::INT + (NOT contains(r, ' of '))::INT AS missing, CASE WHEN contains(r, 'The') THEN contains(string_split(substr(r, instr(r, 'The') + 3), '##')[1], '|') ELSE false END AS tabled,
 (length(r) - length(replace(r, ' on ', ''))) / 4.0 AS marks FROM t)
SELECT doc_id, missing AS missing_headers, CASE WHEN length(r) < 500 THEN 'error' WHEN NOT tabled OR missing > 1 OR marks >= 2.4 THEN 'partial' ELSE 'success' END AS report_status FROM m""")
def a19_validate_reports(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "documents").select("doc_id", "text")
    return R.validate_reports(t, "text", [" the ", " and ", " of "], ["The"], " on ", 500, 1).select("doc_id", "missing_headers", "report_status")


@query(f"""WITH f AS ({FACTS} FROM events), p AS (SELECT user_id, topic, string_agg(value_raw, ',' ORDER BY event_id) AS vs FROM f WHERE status IN ('ok', 'partial') GROUP BY ALL)
SELECT user_id, string_agg(topic || '=' || vs, ';' ORDER BY topic) AS facts FROM p GROUP BY 1""")
def a21_facts_by_topic(spark: SparkSession, d: str) -> DataFrame:
    entry = lambda e: F.concat(e["key"], F.lit("="), F.array_join(F.transform(e["value"], lambda f: f["value_raw"]), ","))
    return A.facts_by_topic(_facts(spark, d), "user_id").select("user_id", F.array_join(F.transform(F.map_entries("facts"), entry), ";").alias("facts"))


@query("""SELECT source, doc_id, used FROM (SELECT source, doc_id, sum(length(text)) OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM documents) WHERE used <= 20000""")
def w02_budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "documents").select("source", "doc_id", F.length("text").alias("n"))
    return W.take_budget_prefix(t, ["source"], [F.desc("n"), F.col("doc_id")], F.col("n"), 20000).select("source", "doc_id", "used")


@query("""
WITH RECURSIVE r AS (SELECT source, doc_id, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY lang, doc_id) AS i FROM documents WHERE lang <> 'es'),
f AS (SELECT source, doc_id, i, n <= 20000 AS ok, CASE WHEN n <= 20000 THEN n ELSE 0 END AS used FROM r WHERE i = 1
 UNION ALL SELECT r.source, r.doc_id, r.i, f.used + r.n <= 20000, CASE WHEN f.used + r.n <= 20000 THEN f.used + r.n ELSE f.used END FROM f JOIN r ON r.source = f.source AND r.i = f.i + 1)
SELECT source, doc_id, CASE WHEN NOT ok THEN 'over_budget' END AS reason FROM f UNION ALL SELECT source, doc_id, 'archive' FROM documents WHERE lang = 'es'""")
def w03_budget_greedy(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "documents").select("source", "doc_id", "lang", F.length("text").alias("n"))
    return W.take_budget_greedy(t, ["source"], "doc_id", ["lang"], "n", 20000, F.when(F.col("lang") == "es", "archive"))


@query(r"""
WITH s AS (SELECT conv_id, turn, lower(text) AS t FROM conversations),
m AS (SELECT *, CASE WHEN regexp_matches(t, '\bfrom\b') THEN 0 WHEN regexp_matches(t, '\bthat\b') THEN 1 END AS st FROM s),
c AS (SELECT *, coalesce(last_value(st IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS carried FROM m)
SELECT conv_id, turn FROM c WHERE (regexp_matches(t, '\bthat\b') OR carried = 1) AND NOT regexp_matches(t, '\bvon\b')""")
def w04_select_sections(spark: SparkSession, d: str) -> DataFrame:
    return W.select_sections(read(spark, d, "conversations"), ["conv_id"], ["turn"], "text", r"\bthat\b", r"\bfrom\b", r"\bvon\b").select("conv_id", "turn")


@query("""
WITH l AS (SELECT doc_id, i, contains(x, 'The') AS f FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(x) <> ''),
n AS (SELECT doc_id, (row_number() OVER w - 1)::INT AS pos, f OR coalesce(lag(f) OVER w, false) OR coalesce(lead(f) OVER w, false) AS near FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, pos FROM n WHERE near""")
def w05_with_neighbours(spark: SparkSession, d: str) -> DataFrame:
    from procure_spark.operators.split import split_lines

    ls = split_lines(read(spark, d, "documents").select("doc_id", "text"))
    return W.with_neighbours(ls, ["doc_id"], ["pos"], F.contains("line", F.lit("The"))).select("doc_id", "pos")


@query("""SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber)::INT AS number FROM lineitem""")
def w06_renumber(spark: SparkSession, d: str) -> DataFrame:
    return W.renumber(read(spark, d, "lineitem"), ["l_orderkey"], ["l_shipdate", "l_linenumber"]).select("l_orderkey", "l_linenumber", "number")


@query("""SELECT o_orderkey, o_orderdate, CASE WHEN o_orderpriority = '1-URGENT' THEN 'high' ELSE 'normal' END AS urgency FROM orders WHERE o_orderdate IS NOT NULL ORDER BY o_orderdate, o_orderkey LIMIT 5""")
def w07_deadline_notices(spark: SparkSession, d: str) -> DataFrame:
    return W.deadline_notices(read(spark, d, "orders"), "o_orderdate", "o_orderkey", "o_orderpriority", 5, ["1-URGENT"]).select("o_orderkey", "o_orderdate", "urgency")


@query("""
WITH a AS (SELECT p_partkey, p_name, 'local' AS source FROM part WHERE p_size < 25 UNION ALL SELECT p_partkey, p_name, 'external' FROM part WHERE p_size > 20) SELECT *, count(*) OVER () AS total FROM a""")
def u01_combine_results(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select("p_partkey", "p_name", "p_size")
    return M.combine_results(p.filter("p_size < 25").drop("p_size"), p.filter("p_size > 20").drop("p_size"))


@query("""SELECT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 0 UNION SELECT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal < 100""")
def u02_union_distinct(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    cols = ["c_nationkey", "c_mktsegment"]
    return M.union_distinct(c.filter("c_acctbal > 0").select(*cols), c.filter("c_acctbal < 100").select(*cols))


@query("""SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'""")
def u03_keep_available(spark: SparkSession, d: str) -> DataFrame:
    files = read(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return M.keep_available(read(spark, d, "orders").filter("o_totalprice > 100000").select("o_orderkey"), files)


@query("""SELECT p_partkey, p_name, p_brand FROM part WHERE p_size < 25 UNION ALL SELECT p_partkey, p_name, NULL FROM part WHERE p_size >= 25""")
def u04_union_evolving(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    return M.union_evolving(p.filter("p_size < 25").select("p_partkey", "p_name", "p_brand"), p.filter("p_size >= 25").select("p_partkey", "p_name"))


@query("""
WITH c AS (SELECT p_partkey, p_name, p_brand FROM part WHERE p_partkey % 3 <> 0), n AS (SELECT p_partkey, upper(p_name) AS p_name, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'new' END AS p_brand FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0)
SELECT coalesce(n.p_partkey, c.p_partkey) AS p_partkey, CASE WHEN n.p_partkey IS NOT NULL THEN n.p_name ELSE c.p_name END AS p_name, coalesce(nullif(n.p_brand, ''), c.p_brand) AS p_brand,
 CASE WHEN n.p_partkey IS NULL THEN 'kept' WHEN c.p_partkey IS NULL THEN 'created' ELSE 'updated' END AS change FROM c FULL JOIN n ON c.p_partkey = n.p_partkey""")
def m01_upsert_products(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    new = p.filter("p_partkey % 2 = 0 or p_partkey % 3 = 0").select("p_partkey", F.upper("p_name").alias("p_name"), F.when(F.col("p_partkey") % 2 == 0, "").otherwise("new").alias("p_brand"))
    return M.upsert(p.filter("p_partkey % 3 <> 0").select("p_partkey", "p_name", "p_brand"), new, "p_partkey", "p_name", ["p_brand"])


@query("""
WITH c AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 <> 1), n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'U' END AS o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 1)
SELECT coalesce(n.o_orderkey, c.o_orderkey) AS o_orderkey, coalesce(nullif(n.o_orderstatus, ''), c.o_orderstatus, 'Found') AS o_orderstatus, CASE WHEN n.o_orderkey IS NOT NULL THEN n.o_totalprice ELSE c.o_totalprice END AS o_totalprice,
 CASE WHEN n.o_orderkey IS NULL THEN 'kept' WHEN c.o_orderkey IS NULL THEN 'created' ELSE 'updated' END AS change FROM c FULL JOIN n ON c.o_orderkey = n.o_orderkey""")
def m02_upsert_tenders(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.filter("o_orderkey % 2 = 0 or o_orderkey % 3 = 1").withColumns({"o_orderstatus": F.when(F.col("o_orderkey") % 5 == 0, "").otherwise("U"), "o_totalprice": F.col("o_totalprice") + 1})
    return M.upsert(o.filter("o_orderkey % 3 <> 1"), new, "o_orderkey", "o_orderkey", ["o_orderstatus"], {"o_orderstatus": "Found"})


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN true WHEN o_orderkey % 7 = 0 THEN false ELSE coalesce(n, 0) = 0 OR o_orderkey % 5 = 0 END AS needs_download
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey""")
def m03_needs_download(spark: SparkSession, d: str) -> DataFrame:
    files = read(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    k = F.col("o_orderkey")
    o = read(spark, d, "orders").select("o_orderkey").join(files, "o_orderkey", "left").withColumns({"url": F.when(k % 7 == 0, "").otherwise("u"), "old": F.when(k % 5 == 0, "v").otherwise("u"), "forced": k % 11 == 0})
    return M.needs_download(o, "o_orderkey", "url", "old", "n", "forced").select("o_orderkey", "needs_download")


@query("""SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)""")
def m04_delete_keys(spark: SparkSession, d: str) -> DataFrame:
    gone = read(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return M.delete_keys(read(spark, d, "part").select("p_partkey", "p_name"), gone, "p_partkey")


@query("""SELECT DISTINCT user_id FROM events""")
def m05_mark_seen(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return M.mark_seen(e.filter("event_type = 'click'").select("user_id").distinct(), e.select("user_id"), "user_id")
