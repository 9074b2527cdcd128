"""Predicates, scores and sources."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procure_spark.operators import rules as P
from procure_spark.operators.rollup import equivalents_policy
from procure_spark.registry import query, read

WORDS = {"first": ["the", "der"], "second": ["of", "la "], "third": ["and", "que"]}
COUNT = {t: " + ".join(f"contains(t, '{w}')::INT" for w in ws) for t, ws in WORDS.items()}


@query("""SELECT doc_id, CASE WHEN contains(t, 'without') OR contains(t, 'haha') THEN 'forbidden' WHEN contains(t, 'the') THEN 'allowed' ELSE 'none' END AS policy,
 CASE WHEN contains(t, 'without') OR contains(t, 'haha') THEN 'high' WHEN contains(t, 'the') THEN 'medium' END AS confidence FROM (SELECT doc_id, lower(text) AS t FROM documents)""")
def f05_equivalents_policy(spark: SparkSession, d: str) -> DataFrame:
    return equivalents_policy(read(spark, d, "documents").select("doc_id", "text"), "text", ["without", "haha"], ["the"]).select("doc_id", "policy", "confidence")


@query("""SELECT doc_id, CASE WHEN contains(t, 'haha') THEN 'GENERAL' WHEN contains(t, 'tiontion') THEN 'SPEC' WHEN contains(t, '|') AND regexp_matches(t, '\\bof\\b') THEN 'ROW' ELSE 'OTHER' END AS kind FROM (SELECT doc_id, lower(text) AS t FROM documents)""")
def p01_fragment_type(spark: SparkSession, d: str) -> DataFrame:
    kind = P.fragment_type(F.col("text"), [("GENERAL", ["haha"]), ("SPEC", ["tiontion"])], row_class="ROW", row_words=r"\bof\b")
    return read(spark, d, "documents").select("doc_id", kind.alias("kind"))


@query("""SELECT doc_id, CASE WHEN contains(t, 'src1') THEN 'one' WHEN contains(t, 'tiontion') THEN 'two' ELSE 'other' END AS role FROM (SELECT doc_id, lower(source || ' ' || substr(text, 1, 12000)) AS t FROM documents)""")
def p02_doc_role(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", P.doc_role(F.col("source"), F.col("text"), [("one", ["src1"]), ("two", ["tiontion"])]).alias("role"))


@query("""SELECT doc_id, CASE WHEN t = '' THEN 0 ELSE (CASE WHEN contains(t, 'tiontion') THEN 4 ELSE 0 END) - 2 * (contains(t, 'haha')::INT + contains(t, 'shsh')::INT) + (CASE WHEN regexp_matches(t, '[0-9]{3}') THEN 2 ELSE 0 END)
 - (CASE WHEN length(t) < 25 THEN 2 ELSE 0 END) + (CASE WHEN lang = 'en' THEN 3 ELSE 0 END) END AS score
FROM (SELECT doc_id, lang, lower(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^ | $', '', 'g')) AS t FROM documents)""")
def p04_fragment_relevance(spark: SparkSession, d: str) -> DataFrame:
    rules = [("any", ["tiontion"], 4), ("count", ["haha", "shsh"], -2), ("regex", "[0-9]{3}", 2), ("under", 25, -2)]
    return read(spark, d, "documents").select("doc_id", P.fragment_relevance(F.col("text"), F.col("lang"), rules, ["en"]).alias("score"))


@query(f"""SELECT doc_id, topic, score FROM (SELECT doc_id, unnest(['first', 'second', 'third']) AS topic, unnest([{', '.join(COUNT.values())}]) AS score FROM (SELECT doc_id, lower(text) AS t FROM documents))""")
def p11_topic_scores(spark: SparkSession, d: str) -> DataFrame:
    return P.topic_scores(read(spark, d, "documents").select("doc_id", "text"), "text", WORDS).select("doc_id", "topic", "score")


@query(f"""
WITH s AS (SELECT source, doc_id, unnest([0, 1, 2]) AS topic, unnest([{', '.join(COUNT.values())}]) AS score FROM (SELECT source, doc_id, lower(text) AS t FROM documents)),
b AS (SELECT source, doc_id, topic, row_number() OVER (PARTITION BY source, topic ORDER BY score DESC, doc_id) AS r FROM s WHERE score > 0),
f AS (SELECT source, doc_id, min(topic * 10 + r) AS first FROM b WHERE r <= 2 GROUP BY ALL),
c AS (SELECT d.source, d.doc_id, first, count(*) OVER (PARTITION BY d.source) AS n, count(first) OVER (PARTITION BY d.source) AS found, row_number() OVER (PARTITION BY d.source ORDER BY first NULLS LAST, d.doc_id)::INT AS place
  FROM documents d LEFT JOIN f ON f.source = d.source AND f.doc_id = d.doc_id)
SELECT source, doc_id, place FROM c WHERE place <= 18 AND (first IS NOT NULL OR found < least(8, n))""")
def w01_select_context(spark: SparkSession, d: str) -> DataFrame:
    return P.select_context(read(spark, d, "documents"), "text", "doc_id", WORDS, "source")


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE contains(o_orderkey::VARCHAR, '12') AND o_orderstatus = 'O'""")
def p12_filter_tenders(spark: SparkSession, d: str) -> DataFrame:
    return P.filter_tenders(read(spark, d, "orders"), "12", ["o_orderkey"], "O", "o_orderstatus").select("o_orderkey", "o_totalprice")


@query("""(SELECT 'customer' AS kind, c_custkey::VARCHAR AS id, c_name AS title FROM customer WHERE contains(lower(c_name), '11') OR contains(c_custkey::VARCHAR, '11') ORDER BY c_custkey LIMIT 5)
UNION ALL (SELECT 'part', p_partkey::VARCHAR, p_name FROM part WHERE contains(lower(p_name), '11') OR contains(p_partkey::VARCHAR, '11') ORDER BY p_partkey LIMIT 5)""")
def p13_global_search(spark: SparkSession, d: str) -> DataFrame:
    return P.global_search({"customer": (read(spark, d, "customer"), "c_custkey", "c_name"), "part": (read(spark, d, "part"), "p_partkey", "p_name")}, "11")


@query("""SELECT p_partkey FROM part WHERE (contains(lower(p_brand), '#1') OR contains(lower(p_name), '#1') OR contains(lower(p_brand), '2') OR contains(lower(p_name), '2')) AND p_size > 10 AND contains(lower(p_brand), '#')""")
def p14_eligible(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").withColumn("s", F.col("p_size") > 10)
    return P.eligible(p, "p_name", "p_brand", ["#1", "2"], "s", "#").select("p_partkey")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <= 2 AND lower(l_returnflag) = 'n' THEN 'degraded' ELSE 'ok' END AS quality FROM lineitem""")
def p15_item_quality(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").withColumn("chars", F.when(F.col("l_linenumber") > 2, F.array("l_linestatus")))
    return P.item_quality(rows, "chars", "l_returnflag", ["n"]).select("l_orderkey", "l_linenumber", "quality")


@query("""SELECT o_orderkey FROM orders WHERE o_totalprice > 200000""")
def p16_selected(spark: SparkSession, d: str) -> DataFrame:
    return P.selected(read(spark, d, "orders").withColumn("f", F.col("o_totalprice") > 200000), "f").select("o_orderkey")


@query("""SELECT doc_id, 3 * (contains(t, 'tion') OR contains(t, 'ung'))::INT + 2 * (contains(t, 'ing') OR contains(t, 'que'))::INT >= 4 AS signals FROM (SELECT doc_id, lower(text) AS t FROM documents)""")
def p03_signals_of_documents(spark: SparkSession, d: str) -> DataFrame:
    """Product signals of whole texts: words of either list alone don't reach the threshold, both together do."""
    return read(spark, d, "documents").select("doc_id", P.has_product_signals(F.col("text"), ["tion", "ung"], ["ing", "que"]).alias("signals"))


@query("""SELECT doc_id, 5 * regexp_matches(t, 'th[ei]|d[ie]r')::INT + 3 * contains(t, 'tion')::INT + 2 * contains(t, 'ing')::INT + 2 * contains(t, '|')::INT - 6 * regexp_matches(t, 'ha{1}ha|[0-9]{6}')::INT AS score FROM (SELECT doc_id, lower(text) AS t FROM documents)""")
def p06_score_of_documents(spark: SparkSession, d: str) -> DataFrame:
    """Section scores of whole texts, with every rule of the score but the quantity word in play."""
    return read(spark, d, "documents").select("doc_id", P.section_score(F.col("text"), ["th[ei]", "d[ie]r"], ["ha{1}ha", "[0-9]{6}"], ["tion"], ["ing"]).alias("score"))


@query("""SELECT doc_id, contains(t, 'ction') OR contains(t, 'mente') AS material, regexp_matches(t, 'ha{1}ha|[0-9]{6}') AS excluded, contains(t, 'ment') AS general FROM (SELECT doc_id, lower(text) AS t FROM documents)""")
def p09_predicates_of_documents(spark: SparkSession, d: str) -> DataFrame:
    text = F.lower("text")  # names in capitals are what p09_name_predicates has
    return read(spark, d, "documents").select("doc_id", P.is_material_name(text, ["ction", "mente"]).alias("material"), P.is_excluded(text, ["ha{1}ha", "[0-9]{6}"]).alias("excluded"), P.is_general_req(text, ["ment"]).alias("general"))


@query("""
WITH s AS (SELECT doc_id, string_split(replace(text, 'of', 'толщина'), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM s),
f AS (SELECT doc_id, lower(line) AS low, arg_min(line, i) AS line, min(i) AS i FROM l WHERE contains(lower(line), 'толщина') GROUP BY 1, 2),
g AS (SELECT doc_id, count(*) AS n, md5(string_agg(line, '|' ORDER BY i)) AS digest FROM f GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0)::INT AS n, coalesce(digest, md5('')) AS digest FROM documents d LEFT JOIN g USING (doc_id)""")
def p10_lines_of_documents(spark: SparkSession, d: str) -> DataFrame:
    """Characteristic lines of whole texts in which a word is replaced by a term of the list: each line once, in order."""
    lines = P.characteristics(F.split(F.replace("text", F.lit("of"), F.lit("толщина")), "\n"))
    found = read(spark, d, "documents").select("doc_id", F.coalesce(lines, F.array().cast("array<string>")).alias("lines"))
    return found.select("doc_id", F.size("lines").alias("n"), F.md5(F.array_join("lines", "|")).alias("digest"))
