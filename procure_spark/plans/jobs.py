"""Jobs composed of the operators."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from procure_spark import lexicons as L
from procure_spark.functions import text as T
from procure_spark.operators import facts, match, merge, rules, select, split, upsert
from procure_spark.registry import spread, written
from procure_spark.sources import versions


def match_analogs(requirements: DataFrame, catalog: DataFrame, external: DataFrame | None, query_id: str, query: str, key: str, title: str, searched: Sequence[str], n: int = 10, stop: Sequence[str] = tuple(L.KEYWORD_STOPWORDS), whitelist: Sequence[str] | None = None, searchable: str | None = None, mode: str = "both", by: Sequence[str] | None = None, **columns) -> DataFrame:
    """Requirements to ranked catalog rows: cleaned queries, search among eligible rows (with a whitelist: those of a listed category, and
    searchable ones), weighted score, band; external results (query_id, key, title, analog_score) that no kept title resembles are
    added in the mode ``both``. With ``by``, external results belong to all requirements that equal them in these columns, in
    place of a query_id."""
    asked = requirements.withColumn("__clean", T.clean_query(F.col(query))).withColumn("__keywords", T.query_keywords(F.col("__clean"), stop))
    if whitelist is not None:
        catalog = rules.eligible(catalog, title, columns.get("category") or title, whitelist, searchable)
    hits = match.search_catalog(asked, catalog, query_id, "__keywords", key, title, searched, n, columns.get("description"))
    hits = written(hits.join(asked.select(query_id, F.col("__clean").alias("_clean")), query_id).select(query_id, "_clean", key), "analog-hits")
    pairs = spread(hits.select("_clean", key).distinct().join(catalog, key))  # equal queries are scored once
    scored = match.score_analogs(pairs, "_clean", None, title, **columns).select("_clean", key, F.col(title).alias("title"), "analog_score", "reasons")
    scored = hits.join(scored, ["_clean", key]).drop("_clean")
    rows = scored.withColumn("source", F.lit("local"))
    if external is not None and mode == "both":
        rows = scored = written(rows, "analogs")  # read for the titles and for the result
        if by is None:
            new = match.dedup_sources(scored, external, query_id, "title", key)
        else:
            new = match.dedup_shared_sources(scored, requirements.select(query_id, *by), external, query_id, by, "title", key)
        new = new.select(query_id, key, "title", "analog_score")
        rows = rows.unionByName(new.withColumns({"source": F.lit("external"), "reasons": F.array().cast("array<string>")}))
    order = Window.partitionBy(query_id).orderBy(F.desc("analog_score"), key, F.desc("source"))
    return rows.withColumns({"band": T.match_band(F.col("analog_score")), "rank": F.row_number().over(order)})


def extract_requirements(docs: DataFrame, doc: str, text: str = "text") -> DataFrame:
    """Documents to requirement positions: lines inside of specification sections, table rows and inline
    lines with a material's name, merged by name, general requirements attached."""
    rows = split.split_lines(docs.select(doc, text), text).select(doc, "pos", "line")
    inside = select.select_sections(rows, [doc], ["pos"], "line", *(T.any_pattern(p) for p in (L.SECTION_STARTS, L.SECTION_ENDS, L.EXCLUDED_SECTIONS)))

    def item(parts: Column, cells: Column, name: Column, qty: Column) -> Column:
        table, has = F.size(parts) >= 3, qty["quantity"].isNotNull()
        confidence = F.when(table, F.when(has, 0.86).otherwise(0.74)).otherwise(F.when(has, 0.76).otherwise(0.62))
        chars = rules.characteristics(F.filter(cells, lambda c: c != name))
        return F.struct(
            T.dedup_key(name).alias("key"), name.alias("position_name"), qty["quantity"].alias("quantity"), qty["unit"].alias("unit"), chars.alias("characteristics"), confidence.alias("confidence"),
            F.when(table, "parametric").otherwise("inline").alias("extraction_mode"),
        )

    # One item or none of a line, each of its parts computed once.
    line = F.col("line")
    named = lambda cells: T.norm_name(F.try_element_at(F.filter(cells, lambda c: rules.is_material_name(c)), F.lit(1)))
    fits = lambda name: (F.length(name) > 2) & ~rules.is_general_req(line)
    items_of = lambda parts, cells: T.once(named(cells), lambda name: F.when(fits(name), F.array(T.once(T.qty_unit(line), lambda qty: item(parts, cells, name, qty)))))
    cut = lambda parts: F.when(F.size(parts) >= 3, F.filter(F.transform(parts, lambda c: F.trim(c)), lambda c: c != "")).otherwise(F.array(line))
    one = T.once(F.split(line, "\\|"), lambda parts: T.once(cut(parts), lambda cells: items_of(parts, cells)))
    items = inside.select(doc, F.col("pos").alias("seq"), line.alias("source_fragment"), F.inline_outer(one)).filter("position_name is not null")
    merged = merge.merge_requirements(items, [doc, "key"], "seq")
    general = rows.filter(rules.is_general_req(F.col("line"))).select(doc, F.col("pos").alias("seq"), F.col("line").alias("requirement"))
    full = match.attach_general(merged, general, doc, "characteristics", "requirement", "seq", once=True)
    full = full.filter((F.length("position_name") >= 4) & ~rules.is_excluded(F.col("position_name")))
    return full.withColumn("search_query", T.compose_query(F.col("position_name"), F.col("characteristics")))


def requirement_warnings(docs: DataFrame, items: DataFrame, doc: str, most: int = 50) -> DataFrame:
    """(doc, positions, warning): of each document how many positions were found, with a warning if there are none or more than are likely."""
    counts = items.groupBy(doc).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    return docs.select(doc).distinct().join(counts, doc, "left").select(doc, n.alias("positions"), F.when(n == 0, L.NO_POSITIONS).when(n > most, L.MANY_POSITIONS).alias("warning"))


def extract_positions(docs: DataFrame, doc: str, text: str = "text") -> DataFrame:
    """Specification lines as positions: quantity and unit cut out of the name; each name once."""
    rows = split.split_lines(docs.select(doc, text), text).filter(rules.is_spec_line(F.col("line")))
    rows = rows.withColumn("qty", T.qty_unit(F.col("line"))).select(doc, F.col("pos").alias("seq"), F.col("line").alias("name"), F.col("qty.quantity").alias("quantity"), F.col("qty.unit").alias("unit"), T.norm_query(T.clean_query(F.col("line"))).alias("search_query"))
    first = Window.partitionBy(doc, T.dedup_key(F.col("search_query"))).orderBy("seq")
    return rows.withColumn("__r", F.row_number().over(first)).filter("__r = 1").drop("__r")


def _matching_parts(docs: DataFrame, tender: str, name: str, text: str, block: int, roles, relevance, spec_roles) -> DataFrame:
    """Relevant blocks of documents with their score."""
    roled = docs.select(tender, name, text, rules.doc_role(F.col(name), F.col(text), roles).alias("role"))
    # A block's score is computed once, before blocks become rows.
    part = lambda b, i: T.once(F.substring(b, 1, block), lambda x: F.struct(i.alias("pos"), x.alias("block"), rules.fragment_relevance(x, F.col("role"), relevance, spec_roles).alias("score")))
    good = F.filter(F.transform(split.blocks(F.col(text)), part), lambda x: x["score"] >= rules.relevance_threshold(F.col("role"), spec_roles))
    return roled.select(tender, name, "role", F.inline_outer(good)).filter("pos is not null")


def matching_text(docs: DataFrame, tender: str, name: str, text: str, budget: int = 24000, block: int = 3500, roles=L.DOC_ROLES, relevance=rules.RELEVANCE, spec_roles=rules.SPEC_ROLES) -> DataFrame:
    """(tender, matching_text): of each tender's fragments the most relevant, up to the budget."""
    parts = _matching_parts(docs, tender, name, text, block, roles, relevance, spec_roles)
    kept = select.take_budget_prefix(parts, [tender], [F.desc("score"), F.col(name), F.col("pos")], F.length("block"), budget, [name, "pos"])
    texts = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), name, "pos", "block"))), lambda x: x["block"])
    return kept.groupBy(tender).agg(F.array_join(texts, "\n\n").alias("matching_text"), F.count("*").alias("blocks"))


def matching_package(tenders: DataFrame, docs: DataFrame, tender: str, description: str, name: str, text: str, status: str, budget: int = 24000, block: int = 3500, roles=L.DOC_ROLES, relevance=rules.RELEVANCE, spec_roles=rules.SPEC_ROLES) -> tuple[DataFrame, DataFrame]:
    """((tender, matching_text, blocks), (tender, filename, status, message)): each tender's matching text, or where it has no
    documents at all its description; and a warning for each document that couldn't be read or has nothing relevant, and for each
    tender of which only the description is used."""
    has_text = ~T.is_blank(F.col(text))
    readable = docs.filter((F.col(status) == "success") & has_text)
    found = matching_text(readable, tender, name, text, budget, block, roles, relevance, spec_roles)
    alone = tenders.join(docs.select(tender).distinct(), tender, "left_anti").filter(~T.is_blank(F.col(description)))
    fallback = alone.select(tender, F.concat(F.lit(L.DESCRIPTION_MARK + "\n"), F.trim(description)).alias("matching_text"), F.lit(1).cast("long").alias("blocks"))
    failed = docs.filter(~((F.col(status) == "success") & has_text) | F.col(status).isNull())
    warn = lambda df, file, kind, message: df.select(tender, file.alias("filename"), kind.alias("status"), message.alias("message"))
    kind = F.when(T.is_blank(F.col(status)), "empty").otherwise(F.col(status))
    role = rules.doc_role(F.col(name), F.col(text), roles)
    relevant = _matching_parts(readable, tender, name, text, block, roles, relevance, spec_roles).select(tender, name).distinct()
    before, after = L.NO_FRAGMENTS.split("{role}")
    useless = warn(readable.join(relevant, [tender, name], "left_anti"), F.col(name), F.lit("no_relevant_fragments"), F.concat(F.lit(before), role, F.lit(after)))
    warnings = warn(failed, F.col(name), kind, F.lit(L.NO_TEXT)).unionByName(useless).unionByName(warn(alone, F.lit(L.DESCRIPTION_NAME), F.lit("warning"), F.lit(L.ONLY_DESCRIPTION)))
    return found.unionByName(fallback), warnings


def build_packet(docs: DataFrame, tender: str, key: str, name: str, text: str, status: str | None = None, budget: int = 400000, rule=L.GOODS_PRIORITY) -> DataFrame:
    """(tender, key, priority, class, reason): which documents a packet takes, in order of priority, and why
    others are left out. Texts stay where they are; they join by key."""
    p = T.doc_priority(F.col(name), rule)
    rows = docs.select(tender, key, p["priority"].alias("priority"), p["class"].alias("class"), F.length(T.blank(F.col(text))).alias("n"), *([F.col(status).alias("status")] if status else []))
    why = F.when(F.col("n") == 0, "empty")
    why = F.when(F.col("status") != "success", F.col("status")).otherwise(why) if status else why
    taken = select.take_budget_greedy(rows, [tender], key, ["priority"], "n", budget, why)
    return rows.select(tender, key, "priority", "class", "n").join(taken, [tender, key])


def _filled(form: str, **values: Column) -> Column:
    """A form's text with columns in its places."""
    parts = re.split(r"\{(\w+)\}", form)
    return F.concat(*[values[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def packet_block(docs: DataFrame, tender: str, key: str, name: str, text: str, status: str, budget: int = 400000, rule=L.GOODS_PRIORITY, fragments=L.FRAGMENT_TYPES) -> DataFrame:
    """(tender, block, documents_count, total_chars, included_files, skipped_files, archives_skipped): a tender's documents as one text,
    each under a head that tells what it is, by priority and key, as far as the budget of characters goes. Archives and documents that
    couldn't be read are left out, with the reason. A text is rendered where it is read; budgets see sizes alone, and only what is
    taken is put together, so that no row holds more than the budget."""
    p, clean = T.doc_priority(F.col(name), rule), T.norm_text(F.col(text))
    head = _filled(L.FILE_HEAD, name=T.blank(F.col(name)), kind=p["class"], priority=p["priority"], status=F.col(status), length=F.length(T.blank(F.col(text))))
    page = _filled(L.PAGE_HEAD, kind=rules.fragment_type(clean, fragments))
    rendered = F.concat(head, F.lit("\n"), page, F.lit(f"\n{L.TEXT_MARK}\n"), clean, F.lit("\n"))
    rows = docs.select(tender, key, name, p["priority"].alias("priority"), F.length(rendered).alias("n"), F.col(status).alias("status"), rendered.alias("rendered"))
    why = F.when(F.lower(T.blank(F.col(name))).rlike(rf"\.({'|'.join(L.ARCHIVES)})$"), L.ARCHIVE_REASON).when(F.col("status") != "success", F.concat(F.lit("status_"), F.col("status")))
    taken = select.take_budget_greedy(rows.drop("rendered"), [tender], key, ["priority"], "n", budget, why)
    told = rows.join(taken, [tender, key]).withColumn("reason", F.when(F.col("reason") == "over_budget", L.SIZE_REASON).otherwise(F.col("reason")))
    good, archive = F.col("reason").isNull(), F.col("reason") == L.ARCHIVE_REASON
    in_order = lambda when, value: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("priority", key, value.alias("v"))))), lambda x: x["v"])
    return told.groupBy(tender).agg(
        F.trim(F.array_join(in_order(good, F.col("rendered")), "\n\n"), F.lit(" \n")).alias("block"), F.count(F.when(good, 1)).alias("documents_count"), F.coalesce(F.sum(F.when(good, F.col("n"))), F.lit(0)).cast("long").alias("total_chars"),
        in_order(good, F.col(name)).alias("included_files"), in_order(~good & ~archive, F.struct(F.col(name).alias("filename"), "reason")).alias("skipped_files"), in_order(archive, F.col(name)).alias("archives_skipped"),
    )


def catalog_from_pages(pages: DataFrame, current: DataFrame, domain: str, **rules_of_pages) -> DataFrame:
    """Product pages as catalog rows, written over the current ones by canonical link."""
    from procure_spark.sources.html import page_products

    found = split.classify_pages(pages, **rules_of_pages).filter("page_class = 'product'")
    rows = page_products(found).withColumn("url", T.canonical_url(F.col("url"), domain))
    return upsert.upsert(current, rows.select(*current.columns), "url", "title", ["description"])


def notices_from_pages(pages: DataFrame, ledger: DataFrame, key: str = "reg") -> DataFrame:
    """Result pages as merged notices, each with whether it was seen."""
    from procure_spark.sources.html import page_notices

    found = page_notices(pages).withColumn("seq", F.struct("url", "card"))
    one = merge.merge_notices(found.filter(f"{key} is not null"), key, "seq", ["title", "price", "deadline"], ["href"], ["url"])
    return match.flag_seen(one, ledger, key)


#: The columns of the CRM's tenders.
CRM = "id string, title string, initial_price double, deadline string, status string, risk_level string, region string, law_type string, url string, ntype string"

#: What a new tender has where nothing is told of it.
CRM_DEFAULTS = {"status": "Found", "risk_level": "Low", "region": "РФ"}


def store_tenders(tenders: DataFrame, path: str, version: int, defaults: dict[str, str] = CRM_DEFAULTS) -> DataFrame:
    """Writes tenders (of the CRM's columns) over those stored at ``path`` by id, where only the buckets that they touch are written anew;
    status, risk and region stay what they are where nothing new is told. The rows that are returned have no id or no title, and
    aren't stored."""
    good, rejected = upsert.split_valid(tenders, ["id", "title"])
    merge_rows = lambda old, new: upsert.upsert(old, new.select(*old.columns), "id", "title", list(defaults), defaults)
    versions.upsert_version(tenders.sparkSession, path, good, "id", merge_rows, StructType.fromDDL(CRM), version)
    return rejected


def crm_from_pages(pages: DataFrame, ledger: DataFrame, path: str, version: int) -> DataFrame:
    """Result pages as merged notices in the CRM at ``path``; returns the notices that it rejects."""
    return crm_from_notices(written(notices_from_pages(pages, ledger), "notices"), path, version)


def crm_from_notices(found: DataFrame, path: str, version: int) -> DataFrame:
    """Merged notices in the CRM at ``path``; returns those that it rejects. They are read for the buckets, the rows and the rejects, so
    they should be a table that is stored."""
    nothing = F.lit(None).cast("string")
    kind = T.law_type(F.col("reg"), nothing, F.col("href"), nothing, nothing)
    tenders = found.select(
        F.trim("reg").alias("id"), F.trim(T.blank(F.col("title"))).alias("title"), T.parse_price(F.col("price")).alias("initial_price"), T.blank(F.col("deadline")).alias("deadline"),
        *[nothing.alias(c) for c in CRM_DEFAULTS], kind.alias("law_type"), T.blank(F.col("href")).alias("url"), F.lit("").alias("ntype"),
    )
    return store_tenders(tenders, path, version)


def tender_facts(docs: DataFrame, tender: str, file: str, text: str, status: str | None = None, tables: DataFrame | None = None, table: str = "table") -> DataFrame:
    """Facts by pattern, and of tables (tender, file, table) that list items, reconciled to a row per tender and topic."""
    found = facts.extract_facts(docs, tender, file, text, status)
    if tables is not None:
        found = found.unionByName(facts.table_facts(tables, tender, file, table))
    order = Window.partitionBy(tender).orderBy(file, "topic", "value_type", "value_raw")
    return merge.reconcile(found.withColumn("seq", F.row_number().over(order)), tender)
