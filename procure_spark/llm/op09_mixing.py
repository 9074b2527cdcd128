"""Mixing sources to target weights by a time-varying curriculum, in DataFrame functions only.

Each source has a weight schedule over training time t in [0, 1], a line
``w(t) = weight * (1 + slope * (2t - 1))`` whose integral is the source's weight. Token targets
come from the integrals; the cumulative demand ``D(t) = target * (t + slope * (t² - t))`` is
inverted in closed form to give every pass over every document its training position
(``scheduled``). ``mix`` sorts passes by position, ``arranged`` documents by their first one.

A source's documents are in the order of a digest of id and text, so that neither rows that share an
id nor rows without one stand together. Rows that are equal in both do; where there are more than ``AT_ONCE``
of them, they are dealt into parts of about as many (``copies_apart``), so that they aren't one task's work.

Defined cases: a null text has size 0 and takes nothing, so it has no position; a null source is a
source of its own, last in order; repeated rows are documents of their own, next to each other; an
empty table gives an empty result; other columns pass through ``mix`` and ``arranged`` untouched,
except those named like their outputs, which they replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from procure_spark.llm.common import WORD, table, written

#: Weights that repeat over the sources in code-point order, the slope of each weight's schedule
#: (over -1 and under 1: sources of weight 5 early, those of weight 1 late), most passes.
WEIGHTS, SLOPES, PASSES = (5, 2, 1), (-0.5, 0.0, 0.5), 3

#: Hexadecimal digits of the digest that tell a source's parts, whose sizes are added up apart, so that
#: no source is one task's work: 4,096 parts.
PART_DIGITS = 3

#: Rows equal in source, id and text that may share a part.
AT_ONCE = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, slopes=SLOPES, passes=PASSES) -> DataFrame:
    """(source, part, part_size) -> (source, source_size, weight, slope, target).

    The level l with sum(min(passes * size, l * weight)) = sum of sizes is found on the sources
    sorted by passes * size / weight: sums before a row say which level would fill the rest. The
    sources are the only rows here, one each, after aggregation.
    """
    per = sizes.groupBy("source").agg(F.sum("part_size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    i = (F.row_number().over(order) - 1) % len(weights)
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), i.cast("int") + 1)
    per = per.select("source", "source_size", pick([int(w) for w in weights]).cast("long").alias("weight"), pick([float(s) for s in slopes]).alias("slope"))
    cap = F.col("source_size") * passes
    ranked = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = ranked.rowsBetween(Window.unboundedPreceding, -1), ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0).cast("long"))
    level = (total("source_size", every) - total(cap, before)).cast("double") / (total("weight", every) - total("weight", before)).cast("double")
    per = per.select("*", level.alias("level"), cap.cast("double").alias("cap"))
    # A source is capped where its cap lies under the level that the sources from it on would share;
    # levels rise over the capped sources and fall after the first that isn't, whose level holds.
    full = F.col("cap") < F.col("level") * F.col("weight")
    per = per.select("*", F.max(F.when(~full, F.col("level"))).over(every).alias("shared"))
    return per.select("source", "source_size", "weight", "slope", F.when(full, F.col("cap")).otherwise(F.col("shared") * F.col("weight")).alias("target"))


def copies_apart(own: DataFrame) -> DataFrame:
    """own with ``__part`` cut where more than ``AT_ONCE`` rows are equal in source and digest: into what is
    before them, themselves in parts of about ``AT_ONCE``, and what is after, in the order of digests.

    They are counted with sums on the map side. Where there are any, rows are written once with what deals
    them out, as equal rows differ in nothing that could; as they are of one size, their order changes no sum.
    """
    counts = own.groupBy("__source", "__part", "__digest").agg(F.count("*").alias("n")).filter(F.col("n") > AT_ONCE)
    many = written(counts.select("__source", "__part", "__digest", F.ceil(F.col("n") / AT_ONCE).alias("cuts")), "op9-copies")
    if many.isEmpty():
        return own
    rows = written(own.withColumn("__deal", F.xxhash64(F.monotonically_increasing_id())), "op9-rows")
    cuts = many.groupBy(F.col("__source").alias("__s"), F.col("__part").alias("__p")).agg(F.sort_array(F.collect_list(F.struct("__digest", "cuts"))).alias("__many"))
    rows = rows.join(cuts, rows["__source"].eqNullSafe(cuts["__s"]) & (rows["__part"] == cuts["__p"]), "left")
    before = F.size(F.filter("__many", lambda m: m["__digest"] < F.col("__digest")))
    own_cuts = F.get(F.filter("__many", lambda m: m["__digest"] == F.col("__digest")), 0)["cuts"]
    step = 2 * before + F.when(own_cuts.isNull(), 0).otherwise(1)
    number = lambda n: F.lpad(n.cast("string"), 12, "0")
    cut = F.concat_ws("-", "__part", number(step), number(F.pmod("__deal", F.coalesce(own_cuts, F.lit(1).cast("long")))))
    return rows.withColumn("__part", F.when(F.col("__many").isNull(), F.col("__part")).otherwise(cut)).drop("__s", "__p", "__many", "__deal")


def place(df: DataFrame, text_col="text", id_col="doc_id", source_col="source", keep_text=True, **how) -> DataFrame:
    """df with size, source_size, target, slope and ``begins`` (size of what stands before the
    document in its source's order). Without ``keep_text`` the text goes, and what is left is written once,
    so that texts are read once.

    A pass takes documents in that order until the target is met, so the last document of the last
    pass may give a part of its words only.
    """
    digest = F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    own = df.drop("size", "source_size", "target", "slope", "begins")
    own = own.withColumns({"size": word_count(F.col(text_col)), "__source": F.col(source_col), "__digest": digest}).withColumn("__part", F.substring("__digest", 1, PART_DIGITS))
    own = copies_apart(own if keep_text else written(own.drop(text_col), "op9-sizes"))
    parts = own.groupBy(F.col("__source").alias("source"), F.col("__part").alias("part")).agg(F.sum("size").alias("part_size"))
    targets = source_targets(parts, **how)
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("part_begins", F.coalesce(F.sum("part_size").over(before), F.lit(0).cast("long")))
    starts = starts.join(targets, starts["source"].eqNullSafe(targets["source"])).select(
        starts["source"].alias("__s"), F.col("part").alias("__p"), "part_begins", "source_size", "target", "slope"
    )
    joined = own.join(starts, own["__source"].eqNullSafe(starts["__s"]) & (own["__part"] == starts["__p"]))
    within = Window.partitionBy("__s", "__p").orderBy("__digest", id_col).rowsBetween(Window.unboundedPreceding, -1)
    joined = joined.withColumn("begins", F.col("part_begins") + F.coalesce(F.sum("size").over(within), F.lit(0).cast("long")))
    return joined.drop("__source", "__part", "__s", "__p", "part_begins", "__digest")


def scheduled(df: DataFrame, text_col="text", id_col="doc_id", source_col="source", **how) -> DataFrame:
    """``place`` with ``schedule``: an array of (pass, words, position), of the passes that take words of
    the document. D(t) = target * ((1 - slope) * t + slope * t²), inverted at the pass's middle word."""
    placed = place(df.drop("schedule"), text_col, id_col, source_col, **how)
    goal, s = F.floor(F.col("target") + 0.5), F.col("slope")

    def one(k: Column) -> Column:
        start = F.col("begins") + F.col("source_size") * k
        words = F.greatest(F.lit(0), F.least(F.col("size"), goal - start)).cast("long")
        share = (start + words / 2) / F.nullif(F.col("target"), F.lit(0.0))
        t = F.when(s == 0, share).otherwise((s - 1 + F.sqrt((1 - s) * (1 - s) + 4 * s * share)) / (2 * s))
        return F.struct(k.alias("pass"), words.alias("words"), t.alias("position"))

    every = F.transform(F.sequence(F.lit(0), F.lit(how.get("passes", PASSES) - 1)), one)
    return placed.withColumn("schedule", F.filter(every, lambda p: p["words"] > 0))


def sorted_by(rows: DataFrame, keys: list[str], partitions: int | None) -> DataFrame:
    rows = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    return rows.sortWithinPartitions(*keys)


def mix(df: DataFrame, text_col="text", id_col="doc_id", source_col="source", partitions: int | None = None, **how) -> DataFrame:
    """One row for each pass over each document that the mix takes, range-sorted by training
    ``position`` in [0, 1]; ``pass`` from 0; ``words`` that this pass takes."""
    rows = scheduled(df.drop("pass", "words", "position"), text_col, id_col, source_col, **how)
    return sorted_by(rows.select("*", F.inline("schedule")).drop("schedule"), ["position", id_col, "pass"], partitions)


def arranged(df: DataFrame, text_col="text", id_col="doc_id", source_col="source", partitions: int | None = None, **how) -> DataFrame:
    """Every document once, range-sorted by the position of its first pass (null, and first, if it has none):
    ``taken``, words that the mix takes, repeats counted; ``passes``, how often it comes; ``position``."""
    rows = scheduled(df.drop("taken", "passes", "position"), text_col, id_col, source_col, **how)
    taken = F.aggregate("schedule", F.lit(0).cast("long"), lambda a, p: a + p["words"])
    rows = rows.withColumns({"taken": taken, "passes": F.size("schedule"), "position": F.array_min(F.transform("schedule", lambda p: p["position"]))})
    return sorted_by(rows.drop("schedule"), ["position", id_col], partitions)


def op9_curriculum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return arranged(docs, keep_text=False).select("doc_id", "size", "source_size", "target", "taken", "passes", F.round("position", 9).alias("position"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS digest,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS i,
         (CASE i WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::BIGINT AS weight, (CASE i WHEN 0 THEN -0.5 WHEN 1 THEN 0.0 ELSE 0.5 END)::DOUBLE AS s
  FROM sized GROUP BY source),
level AS (
  SELECT *, 3 * source_size AS cap,
         (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER w, 0))::DOUBLE
         / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS level
  FROM per WINDOW w AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (
  SELECT source, source_size, s, CASE WHEN cap < level * weight THEN cap::DOUBLE
         ELSE (max(level) FILTER (WHERE NOT cap < level * weight) OVER ()) * weight END AS target
  FROM level),
placed AS (
  SELECT t.doc_id, t.size, g.source_size, g.target, g.s, floor(g.target + 0.5)::BIGINT AS words,
         coalesce(sum(t.size) OVER (PARTITION BY t.source ORDER BY t.digest, t.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begins
  FROM sized t JOIN goal g ON t.source IS NOT DISTINCT FROM g.source),
passes AS (
  SELECT *, greatest(0, least(size, words - begins))::BIGINT AS w0, greatest(0, least(size, words - source_size - begins))::BIGINT AS w1,
         greatest(0, least(size, words - 2 * source_size - begins))::BIGINT AS w2, (begins + w0 / 2) / target AS share
  FROM placed)
SELECT doc_id, size, source_size, target, w0 + w1 + w2 AS taken, (w0 > 0)::INT + (w1 > 0)::INT + (w2 > 0)::INT AS passes,
       CASE WHEN w0 > 0 THEN round(CASE WHEN s = 0 THEN share ELSE (s - 1 + sqrt((1 - s) * (1 - s) + 4 * s * share)) / (2 * s) END, 9) END AS position
FROM passes
"""
