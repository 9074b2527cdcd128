"""Rollups over tenders, packages, positions, jobs and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procure_spark import lexicons as L
from procure_spark.functions.text import any_of, blank, senior_category


def funnel(df: DataFrame, status: str, amount: str, order: Sequence[str]) -> DataFrame:
    """Count and sum per status in its order; statuses without rows and unlisted ones are there too."""
    spine = df.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(s) for s in order])).alias("place", "status"))
    sums = df.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"), F.round(F.sum(amount), 2).alias("amount"))
    j = spine.join(sums, "status", "full_outer")
    return j.select("status", F.coalesce("place", F.lit(len(order))).alias("place"), F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("amount", F.lit(0.0)).alias("amount"))


def kpis(df: DataFrame, status: str, amount: str, risk: str, active: Sequence[str], won: Sequence[str], lost: Sequence[str], high: Sequence[str]) -> DataFrame:
    count = lambda c: F.sum(c.cast("long"))
    is_active, is_won, is_lost = (F.col(status).isin(*x) for x in (active, won, lost))
    return df.agg(
        count(is_active).alias("active"),
        F.round(100 * count(is_won) / F.nullif(count(is_won | is_lost), F.lit(0)), 2).alias("win_rate"),
        F.round(F.sum(F.when(is_active, F.col(amount))), 2).alias("active_amount"),
        count(F.col(risk).isin(*high)).alias("high_risk"),
        count(is_won).alias("contracts"),
    )


def weekday_activity(df: DataFrame, day: str, won: Column) -> DataFrame:
    """Found and won per weekday, Monday 0; all seven are there."""
    sums = df.groupBy(F.weekday(day).alias("weekday")).agg(F.count("*").alias("found"), F.sum(won.cast("long")).alias("won"))
    spine = df.sparkSession.range(7).select(F.col("id").cast("int").alias("weekday"))
    zero = F.lit(0).cast("long")
    return spine.join(F.broadcast(sums), "weekday", "left").select("weekday", F.coalesce("found", zero).alias("found"), F.coalesce("won", zero).alias("won"))  # seven rows


def catalog_groups(df: DataFrame, category: str, title: str, separator: str = " / ") -> DataFrame:
    return df.groupBy(senior_category(F.col(category), separator).alias("senior")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(title)).alias("titles"))


def fragment_stats(df: DataFrame, keys: Sequence[str], kind: str, kinds: Sequence[str], text: str) -> DataFrame:
    """Fragments per kind, with all and their characters."""
    return df.groupBy(*keys).agg(*[F.sum((F.col(kind) == k).cast("long")).alias(k.lower()) for k in kinds], F.count("*").alias("fragments"), F.sum(F.length(blank(F.col(text)))).alias("chars"))


def packet_stats(df: DataFrame, group: str, status: str, text: str, success: Sequence[str] = ("success",), archive: Column | None = None, pages: Column | None = None, tables: Column | None = None) -> DataFrame:
    """A packet's files, and the characters of those that were read; with the numbers of each file's pages or tables also those."""
    ok = F.col(status).isin(*success)
    archives = archive if archive is not None else F.lit(False)
    n = lambda c: F.sum(c.cast("long"))
    return df.groupBy(group).agg(
        F.count("*").alias("files"), n(ok).alias("success"), n(~ok).alias("failed"), n(archives).alias("archives"), F.sum(F.when(ok, F.length(blank(F.col(text)))).otherwise(0)).alias("chars"), (n(~ok) + n(archives) > 0).alias("degraded"),
        *[F.coalesce(F.sum(F.when(ok, c)), F.lit(0)).cast("long").alias(name) for name, c in (("pages", pages), ("tables", tables)) if c is not None],
    )


def quality_summary(df: DataFrame, group: Sequence[str], quantity: str, unit: str, n_characteristics: str, blanks: Sequence[str] = tuple(L.BLANK_VALUES), archive: Column | None = None) -> DataFrame:
    """How many positions have what; degraded if none has a quantity or characteristics. archive: whether a row comes of a packet whose
    archives were skipped, which degrades it too; then with warnings."""
    real = lambda c: ~F.lower(F.trim(blank(F.col(c).cast("string")))).isin(*blanks)
    n = lambda c: F.sum(c.cast("long"))
    some = F.coalesce(F.col(n_characteristics), F.lit(0)) > 0
    degraded = n(real(quantity)) + n(some) == 0
    more = []
    if archive is not None:
        blocked = F.bool_or(archive)
        degraded = degraded | blocked
        more = [blocked.alias("archives_blocking"), F.array_compact(F.array(F.when(n(some) == 0, F.lit(L.NO_CHARACTERISTICS)), F.when(n(real(quantity)) == 0, F.lit(L.NO_QUANTITIES)))).alias("warnings")]
    return df.groupBy(*group).agg(F.count("*").alias("positions"), n(real(quantity)).alias("with_quantity"), n(real(unit)).alias("with_unit"), n(some).alias("with_characteristics"), degraded.alias("degraded"), *more)


def package_outcome(df: DataFrame, group: str, name: str, status: str, critical: str, report_chars: str, least: int = 300) -> DataFrame:
    """success, partial (a critical flag, a failed file, or a short report), or error (no readable file)."""
    ok = F.col(status) == "success"
    agg = df.groupBy(group).agg(F.array_sort(F.collect_set(F.when(ok, F.col(name)))).alias("succeeded"), F.array_sort(F.collect_set(F.when(~ok, F.col(name)))).alias("failed"), F.bool_or(critical).alias("c"), F.max(report_chars).alias("n"))
    outcome = F.when(F.size("succeeded") == 0, "error").when(F.col("c") | (F.col("n") <= least) | (F.size("failed") > 0), "partial").otherwise("success")
    return agg.select(group, "succeeded", "failed", outcome.alias("outcome"))


def job_status(df: DataFrame, job: str, tender: str, seq: str, status: str, terminal: Sequence[str]) -> DataFrame:
    """Per job its tenders, how many have ended by their latest status, and whether all have."""
    last = df.groupBy(job, tender).agg(F.max_by(status, seq).alias("s"))
    done = F.sum(F.col("s").isin(*terminal).cast("long"))
    return last.groupBy(job).agg(F.count("*").alias("tenders"), done.alias("done"), F.when(done == F.count("*"), "completed").otherwise("running").alias("status"))


def selection_totals(selection: DataFrame, tenders: DataFrame, key: str, amount: str) -> DataFrame:
    picked = selection.groupBy(key).agg(F.count("*").alias("files"))
    return picked.join(tenders.select(key, amount), key).agg(F.count("*").alias("tenders"), F.sum("files").alias("files"), F.round(F.sum(amount), 2).alias("amount"))


def dedup_stats(df: DataFrame, key: str) -> DataFrame:
    per = df.groupBy(key).agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("raw"), F.count("*").alias("unique_keys"), (F.sum("n") - F.count("*")).alias("removed"), F.sum((F.col("n") > 1).cast("long")).alias("duplicated"))


def validate_reports(df: DataFrame, report: str, headers: Sequence[str] = tuple(L.REPORT_HEADERS), tables: Sequence[str] = tuple(L.REPORT_TABLES), missing_mark: str = "Не найдено в ТД", least: int = 500, most_missing: int = 2, share: float = 0.8) -> DataFrame:
    """df with missing_headers and report_status: error if short; partial without one of the section
    tables, with too many missing headers, or where marks of missing facts abound; else success."""
    text = blank(F.col(report))
    missing = sum((F.when(F.contains(text, F.lit(h)), 0).otherwise(1) for h in headers), F.lit(0))
    tabled = F.lit(True)
    for t in tables:
        body = F.substring_index(F.substr(text, F.instr(text, t) + len(t)), "##", 1)
        tabled = tabled & F.contains(text, F.lit(t)) & F.contains(body, F.lit("|"))
    marks = (F.length(text) - F.length(F.replace(text, F.lit(missing_mark), F.lit("")))) / len(missing_mark)
    status = F.when(F.length(text) < least, "error").when(~tabled | (missing > most_missing) | (marks >= len(headers) * share), "partial").otherwise("success")
    return df.withColumns({"missing_headers": missing, "report_status": status})


def report_summary(df: DataFrame, report: str, start: str, end: str, most: int = 1200) -> DataFrame:
    """df with summary: the section between two headings, table rows left out."""
    body = F.regexp_extract(blank(F.col(report)), rf"(?s)\Q{start}\E(.*?)(?:\Q{end}\E|$)", 1)
    return df.withColumn("summary", F.substring(F.regexp_replace(F.regexp_replace(body, r"(?m)^[ \t]*\|.*$\n?", ""), r"^\s+|\s+$", ""), 1, most))


def equivalents_policy(df: DataFrame, text: str, forbidden: Sequence[str] = tuple(L.FORBIDDEN_EQUIVALENTS), stems: Sequence[str] = tuple(L.EQUIVALENT_STEMS)) -> DataFrame:
    """df with policy (forbidden, allowed or none) and its confidence."""
    low = F.lower(blank(F.col(text)))
    no, any_ = any_of(low, forbidden), any_of(low, stems)
    return df.withColumns({"policy": F.when(no, "forbidden").when(any_, "allowed").otherwise("none"), "confidence": F.when(no, "high").when(any_, "medium")})
