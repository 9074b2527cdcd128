"""Predicates, classifiers and scores as column expressions compiled from rule lists.

A score is a sum over rules (kind, terms, weight): ``any`` adds the weight if any term is contained,
``count`` once for each contained term, ``regex`` if the pattern fits, ``under`` if the text is shorter.
Texts are lower-cased first.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procure_spark import lexicons as L
from procure_spark.functions.text import any_of, any_pattern, blank, count_of, is_blank, norm_text, once

# Patterns look at a letter or digit before they look at words' bounds, which cost more.
MARK = rf"(?U)(?=[{''.join(sorted({m[0] for m in L.MARKS}))}])\b({'|'.join(L.MARKS)})\b"
NUMBER_UNIT = r"(?U)(?=\d)\b\d+(?:[.,]\d+)?\s*(мм|м2|м²|м|кг|л|шт|рулон)\b"
LINE_UNIT = rf"(?U)(?=\d)\b\d+(?:[.,]\d+)?\s*({L.LINE_UNITS})\b"
FILE_NAME = r"(?U)\.(docx?|pdf|xlsx?|xls)\b"
PAGE_REF = r"(?U)(?=с)\bстр\.?\s*\d+\b"

RELEVANCE = [("any", L.RELEVANT_TERMS, 4), ("regex", MARK, 4), ("regex", NUMBER_UNIT, 2), ("count", L.IRRELEVANT_TERMS, -2), ("regex", FILE_NAME, -3), ("regex", PAGE_REF, -2), ("under", 25, -2)]


def score_text(low: Column, rules: Sequence[tuple]) -> Column:
    """The sum of what the rules give a lower-case text; 0 for a blank one."""
    return once(low, lambda x: _score(x, rules))


def _score(low: Column, rules: Sequence[tuple]) -> Column:
    total = F.lit(0)
    for kind, terms, weight in rules:
        if kind == "count":
            total = total + count_of(low, terms) * weight
            continue
        hit = any_of(low, terms) if kind == "any" else low.rlike(terms) if kind == "regex" else F.length(low) < terms
        total = total + F.when(hit, weight).otherwise(0)
    return F.when(is_blank(low), 0).otherwise(total)


def classify(low: Column, classes: Sequence[tuple[str, Sequence[str]]], other: str = "other") -> Column:
    """The first class of which a term is contained."""
    return once(low, lambda x: reduce(lambda c, k: c.when(any_of(x, k[1]), k[0]), classes, F.when(F.lit(False), "")).otherwise(other))


def fragment_type(col: Column, lex=L.FRAGMENT_TYPES, other: str = "OTHER", row_class: str = "GOODS_SPEC", row_words: str = r"(?U)\b(товар|материал|характерист|кол-во|количество|ед\.?\s*изм)\b") -> Column:
    without = lambda low: F.when(F.contains(low, F.lit("|")) & low.rlike(row_words), row_class).otherwise(other)
    return once(F.lower(blank(col)), lambda low: once(classify(low, lex, ""), lambda kind: F.when(kind != "", kind).otherwise(without(low))))


def has_product_signals(col: Column, material=L.MATERIAL_TERMS, technical=L.TECHNICAL_TERMS, least: int = 4) -> Column:
    return _product_signals(norm_text(col, "lower"), material, technical, least)


def _product_signals(low: Column, material=L.MATERIAL_TERMS, technical=L.TECHNICAL_TERMS, least: int = 4) -> Column:
    """has_product_signals of a text that is normal already."""
    return score_text(low, [("any", material, 3), ("any", technical, 2), ("regex", MARK, 4), ("regex", NUMBER_UNIT, 2)]) >= least


def doc_role(name: Column, text: Column, lex=L.DOC_ROLES, seen: int = 12000) -> Column:
    """A document's role by its name and the start of its text; contracts that sell goods are mixed."""
    def role(body: Column, whole: Column, kind: Column) -> Column:
        return (
            F.when(whole == "", "other")
            .when(kind == "contract", F.when(_product_signals(body), "contract_mixed").otherwise("contract_legal"))
            .when(kind != "", kind)
            .when(has_product_signals(whole), "mixed")
            .otherwise("other")
        )

    of = lambda body: once(F.trim(F.concat_ws(" ", norm_text(name, "lower"), body)), lambda whole: once(classify(whole, lex, ""), lambda kind: role(body, whole, kind)))
    return once(norm_text(F.substring(blank(text), 1, seen), "lower"), of)


SPEC_ROLES = ("tender_spec", "contract_mixed", "mixed")


def fragment_relevance(text: Column, role: Column, rules=RELEVANCE, spec_roles=SPEC_ROLES) -> Column:
    score = lambda low: F.when(low == "", 0).otherwise(score_text(low, rules) + F.when(role.isin(*spec_roles), 3).otherwise(0) + F.when(_product_signals(low), 3).otherwise(0))
    return once(norm_text(text, "lower"), score)


def relevance_threshold(role: Column, spec_roles=SPEC_ROLES, spec: int = 4, other: int = 7) -> Column:
    return F.when(role.isin(*spec_roles), spec).otherwise(other)


def requirement_score(col: Column, positive=L.REQUIREMENT_TERMS, negative=L.PROCESS_TERMS, colon=L.COLON_TERMS) -> Column:
    return once(norm_text(col, "lower"), lambda low: _requirement_score(low, positive, negative, colon))


def _requirement_score(low: Column, positive, negative, colon) -> Column:
    named = F.contains(low, F.lit(":")) & any_of(low, colon)
    cited = F.contains(low, F.lit("|")) & low.rlike(FILE_NAME)
    base = score_text(low, [("any", positive, 4), ("regex", LINE_UNIT, 3), ("count", negative, -2), ("under", 20, -2)])
    return F.when(low == "", 0).otherwise(base + F.when(named, 3).otherwise(0) - F.when(cited, 4).otherwise(0))


def section_score(col: Column, starts=L.SECTION_STARTS, excluded=L.EXCLUDED_SECTIONS, material=L.MATERIAL_HINTS, spec=L.SPEC_KEYWORDS) -> Column:
    low = F.lower(blank(col))
    return score_text(
        low,
        [("regex", any_pattern(starts), 5), ("any", material, 3), ("any", spec, 2), ("regex", r"(?U)\bкол-?во\b|\bколичество\b", 2), ("any", ["|"], 2), ("regex", any_pattern(excluded), -6)],
    )


def is_spec_line(col: Column, positive=tuple(L.PRODUCT_LINE_TERMS), negative=tuple(L.SPEC_LINE_BARS)) -> Column:
    """Lines of eight and more characters that tell of a product and of no procedure."""
    return once(F.lower(F.trim(blank(col))), lambda low: (F.length(low) >= 8) & ~any_of(low, negative) & (any_of(low, positive) | low.rlike(LINE_UNIT)))


def is_noise_line(col: Column, noise=tuple(L.NOISE_TERMS), product=tuple(L.PRODUCT_LINE_TERMS)) -> Column:
    """Blank lines and those of procedures, files and pages; a line that tells of a product never is one."""
    is_noise = lambda low: (low == "") | (~(any_of(low, product) | low.rlike(LINE_UNIT)) & (any_of(low, noise) | low.rlike(FILE_NAME) | low.rlike(PAGE_REF)))
    return once(F.lower(F.trim(blank(col))), is_noise)


def is_material_name(col: Column, hints=tuple(L.MATERIAL_HINTS)) -> Column:
    exact = blank(col).rlike(r"(?U)(?=[А-ЯA-Zрлтуб])\b(?:[А-ЯA-Z]{2,}[ -]?[А-ЯA-Z0-9-]{2,}|[Рр]убемаст|[Лл]инокром|[Тт]ехноэласт|[Уу]нифлекс|[Бб]рит)\b")
    return once(F.lower(blank(col)), lambda low: any_of(low, hints) | low.rlike(r"(?U)(?=[мтп])\b(?:материал\b|товар\b|продукц)") | exact)


def is_excluded(col: Column, patterns=tuple(L.EXCLUDED_SECTIONS)) -> Column:
    return F.lower(blank(col)).rlike(any_pattern(patterns))


def is_general_req(col: Column, hints=tuple(L.GENERAL_REQUIREMENTS)) -> Column:
    return any_of(F.lower(blank(col)), hints)


def is_characteristic(col: Column, spec=tuple(L.SPEC_KEYWORDS)) -> Column:
    number = r"(?U)(?=\d)\b\d+(?:[.,]\d+)?\s*(мм|м|м2|м3|кг|г/м2|кг/м2|н/50\s*мм|°с|с0|в|квт|мпа)\b"
    return once(F.lower(blank(col)), lambda low: any_of(low, spec) | low.rlike(r"(?U)(?=н)\bне\s+(менее|более|выше|ниже)\b") | low.rlike(number))


def characteristics(lines: Column) -> Column:
    """Of an array of lines those that tell a characteristic, each once, in order."""
    kept = F.filter(lines, lambda x: is_characteristic(x))
    # Sorted, so that equal lines stand together: linear but for the sort, as arrays that a lambda names are evaluated for each element.
    ordered = F.array_sort(F.transform(kept, lambda x, i: F.struct(F.lower(x).alias("low"), i.alias("i"), x.alias("x"))))
    nothing = F.array(F.lit(None).cast("struct<low:string,i:int,x:string>"))
    first = lambda o: F.zip_with(o, F.concat(nothing, o), lambda a, b: F.when(a["low"].isNotNull() & ~a["low"].eqNullSafe(b["low"]), F.struct(a["i"].alias("i"), a["x"].alias("x"))))
    return F.transform(F.array_sort(F.array_compact(once(ordered, first))), lambda f: f["x"])


def topic_scores(df: DataFrame, text: str, topics: dict[str, list[str]] = L.TOPICS) -> DataFrame:
    """A row for each row and topic, with the number of the topic's words that the text contains."""
    low = F.lower(blank(F.col(text)))
    scores = F.array(*[F.struct(F.lit(i).alias("topic_no"), F.lit(t).alias("topic"), count_of(low, ws).alias("score")) for i, (t, ws) in enumerate(topics.items())])
    return df.select("*", F.inline(scores))


def select_context(df: DataFrame, text: str, order: str, topics: dict[str, list[str]] = L.TOPICS, group: str | None = None, per_topic: int = 2, cap: int = 18, least: int = 8) -> DataFrame:
    """(group, order): chunks for a context: the best of each topic in the topics' order; where that are
    too few, unused ones in their order up to the cap."""
    part = [group] if group else []
    lean = df.select(*part, order, text)
    best = topic_scores(lean, text, topics).filter("score > 0").withColumn("rank", F.row_number().over(Window.partitionBy(*part, "topic_no").orderBy(F.desc("score"), order))).filter(F.col("rank") <= per_topic)
    first = best.groupBy(*part, order).agg(F.min(F.struct("topic_no", "rank")).alias("first"))
    chosen = lean.select(*part, order).join(first, [*part, order], "left")
    everything = Window.partitionBy(*part)
    n, found = F.count("*").over(everything), F.count("first").over(everything)
    place = F.row_number().over(Window.partitionBy(*part).orderBy(F.col("first").asc_nulls_last(), order))
    placed = chosen.withColumns({"n": n, "found": found, "place": place})
    return placed.filter((F.col("place") <= cap) & (F.col("first").isNotNull() | (F.col("found") < F.least(F.lit(least), F.col("n"))))).select(*part, order, "place")


def filter_tenders(df: DataFrame, text: str = "", columns: Sequence[str] = (), law: str | None = None, law_col: str = "law_type", files: DataFrame | None = None, key: str = "id", has_files: bool | None = None, by_price: str | None = None) -> DataFrame:
    """Tenders of which a column contains the text in any case, and of the law; with has_files those of which ``files`` (by key) are
    there, or none; by_price: the column by which they are sorted, the dearest first."""
    found = df.filter(reduce(lambda a, b: a | b, [F.contains(F.lower(blank(F.col(c).cast("string"))), F.lit(text.lower())) for c in columns], F.lit(not columns or not text)))
    found = found.filter(F.col(law_col) == law) if law else found
    if has_files is not None:
        found = found.join(files.select(key).distinct(), key, "left_semi" if has_files else "left_anti")
    return found.orderBy(F.desc_nulls_last(by_price), key) if by_price else found


def global_search(kinds: dict[str, tuple[DataFrame, str, str]], query: str, most: int = 5, least: int = 2) -> DataFrame:
    """kinds: name -> (df, id column, title column). (kind, id, title), the first of each kind by id."""
    found = []
    for kind, (df, key, title) in kinds.items():
        rows = df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.col(title).cast("string").alias("title"), F.col(key).alias("__key"))
        hit = (F.contains(F.lower("title"), F.lit(query.lower())) | F.contains(F.lower("id"), F.lit(query.lower()))) & F.lit(len(query.strip()) >= least)
        found.append(rows.filter(hit).orderBy("__key").limit(most).drop("__key"))
    return reduce(DataFrame.unionByName, found)


def eligible(df: DataFrame, title: str, category: str, whitelist: Sequence[str] = tuple(L.CATEGORY_WHITELIST), searchable: str | None = None, user_category: str | None = None) -> DataFrame:
    """Catalog rows of a listed category (by category or title), searchable, of the asked category."""
    low = lambda c: F.lower(blank(F.col(c)))
    kept = df.filter(any_of(low(category), whitelist) | any_of(low(title), whitelist))
    kept = kept.filter(F.col(searchable)) if searchable else kept
    return kept.filter(F.contains(low(category), F.lit(user_category.lower()))) if user_category else kept


def item_quality(df: DataFrame, characteristics: str, quantity: str, blanks: Sequence[str] = tuple(L.BLANK_VALUES)) -> DataFrame:
    """df with quality: degraded where there are no characteristics and no real quantity, else ok."""
    none = F.coalesce(F.size(F.col(characteristics)), F.lit(0)) <= 0
    unreal = F.lower(F.trim(blank(F.col(quantity).cast("string")))).isin(*blanks)
    return df.withColumn("quality", F.when(none & unreal, "degraded").otherwise("ok"))


def selected(df: DataFrame, flag: str) -> DataFrame:
    return df.filter(F.coalesce(F.col(flag), F.lit(False)))
