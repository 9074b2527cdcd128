"""Column functions over text, numbers, dates, links and maps. All are JVM-side expressions.

Patterns see lower-cased text and start with ``(?U)``, so that word classes and boundaries know
Cyrillic. Blank and null mean the same unless a function says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from procure_spark import lexicons as L

NBSP = " "


def blank(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def once(col: Column, f: Callable[[Column], Column]) -> Column:
    """f of a column that is computed once, however often f names it."""
    return F.element_at(F.transform(F.array(col), f), 1)


def is_blank(col: Column) -> Column:
    return F.trim(blank(col)) == ""


def chain(col: Column, *steps: tuple[str, str]) -> Column:
    """Regular-expression replacements, one after the other."""
    return reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, col)


def any_of(col: Column, terms: Sequence[str]) -> Column:
    """Whether any of the terms is contained; col is lower case."""
    return once(col, lambda c: F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(c, t))) if terms else F.lit(False)


def any_pattern(patterns: Sequence[str]) -> str:
    """A pattern of alternatives. Where each is a word's beginning, letters that none begins with are passed without a look at words' bounds."""
    if all(p.startswith(r"\b") and p[2:4].isalpha() and "|" not in p for p in patterns):
        return rf"(?U)(?=[{''.join(sorted({p[2] for p in patterns}))}])\b(?:{'|'.join(p[2:] for p in patterns)})"
    return f"(?U){'|'.join(patterns)}"


def count_of(col: Column, terms: Sequence[str]) -> Column:
    """How many of the terms are contained."""
    return reduce(lambda a, b: a + b, [F.contains(col, F.lit(t)).cast("int") for t in terms], F.lit(0))


def first_match(col: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null without a match or if it is empty."""
    return once(F.regexp_extract(col, pattern, group), lambda m: F.when(m != "", m))


def parse_price(col: Column) -> Column:
    """Price text in Russian or English notation as double; 0.0 for blank and unparsable."""
    kept = F.regexp_replace(blank(col), r"[^0-9,.\-]", "")
    commas, dots = F.length(kept) - F.length(F.replace(kept, F.lit(","), F.lit(""))), F.length(kept) - F.length(F.replace(kept, F.lit("."), F.lit("")))
    comma_last = F.instr(F.reverse(kept), ",") < F.instr(F.reverse(kept), ".")
    no_commas = F.replace(kept, F.lit(","), F.lit(""))
    plain = (
        F.when((commas == 1) & (dots == 0), F.replace(kept, F.lit(","), F.lit(".")))
        .when((commas > 0) & (dots > 0) & comma_last, F.replace(F.replace(kept, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .otherwise(no_commas)
    )
    return F.coalesce(plain.try_cast("double"), F.lit(0.0))


def catalog_price(col: Column) -> Column:
    """The number before ``р./ ... РОЗН``, else the first one before ``р./``, else 0.0."""
    text = F.upper(F.replace(blank(col), F.lit(NBSP), F.lit(" ")))
    number = r"(?U)(\d+(?:[.,]\d+)?)\s*Р\./"
    found = F.coalesce(first_match(text, number + r"\S*\s*РОЗН"), first_match(text, number))
    return F.coalesce(F.replace(found, F.lit(","), F.lit(".")).try_cast("double"), F.lit(0.0))


def first_number(col: Column) -> Column:
    """The first number of a text without its spaces; null with none or with two separators."""
    joined = F.regexp_replace(blank(col), rf"[\s{NBSP}]+", "")
    return F.replace(first_match(joined, r"(\d+[.,\d]*)"), F.lit(","), F.lit(".")).try_cast("double")


def norm_text(col: Column, mode: str = "multi") -> Column:
    """mode: ``multi`` keeps line ends (two at most in a row), ``single`` none, ``lower`` none and no capitals."""
    text = F.replace(blank(col), F.lit(NBSP), F.lit(" "))
    if mode == "multi":
        return F.regexp_replace(chain(text, ("[ \\t]+", " "), ("\\n{3,}", "\n\n")), r"^\s+|\s+$", "")
    text = F.regexp_replace(F.regexp_replace(text, r"\s+", " "), "^ | $", "")
    return F.lower(text) if mode == "lower" else text


def words_text(col: Column, fold_yo: bool = False) -> Column:
    """Lower-case text of letters a-z and а-я, digits and ``. , + -`` alone."""
    text = F.lower(F.replace(blank(col), F.lit(NBSP), F.lit(" ")))
    text = F.replace(text, F.lit("ё"), F.lit("е")) if fold_yo else text
    return F.trim(F.regexp_replace(text, "[^a-zа-я0-9.,+\\-]+", " "))


def tokens(col: Column, stop: Sequence[str] = tuple(L.TOKEN_STOPWORDS), fold_yo: bool = False) -> Column:
    """Words of two and more characters that are no stopwords, repeats included."""
    stops = F.array(*[F.lit(s) for s in stop]) if stop else F.array().cast("array<string>")
    return F.filter(F.split(words_text(col, fold_yo), " "), lambda t: (F.length(t) >= 2) & ~F.array_contains(stops, t))


def clean_query(col: Column, field_names: Sequence[str] = tuple(L.FIELD_NAMES), units: Sequence[str] = tuple(L.PAREN_UNITS)) -> Column:
    """A search query without table cells, units, marks of missing values and standards; as it was if nothing is left."""
    return once(F.trim(blank(col)), lambda raw: _clean_query(raw, field_names, units))


def _clean_query(raw: Column, field_names: Sequence[str], units: Sequence[str]) -> Column:
    cells = F.transform(F.split(raw, "\\|"), lambda c: F.trim(c))
    names = F.array(*[F.lit(n) for n in field_names])
    useful = F.filter(cells, lambda c: (F.length(c) > 3) & ~F.array_contains(names, F.lower(c)) & ~F.lower(c).rlike(r"(?U)\.(docx|pdf|xlsx?|doc)\b|стр\.?\s*\d+"))
    # Of the longest cells the first: the greatest (length, -place).
    placed = F.transform(useful, lambda c, i: F.struct(F.length(c).alias("n"), (-i).alias("at"), c.alias("cell")))
    longest = F.when(F.contains(raw, F.lit("|")), F.array_max(placed)["cell"])
    query = F.coalesce(longest, raw)
    query = chain(
        query,
        (rf"(?iU)\(\s*({'|'.join(units)})\s*\)", ""),
        (r"(?iU)/?\s*\(\s*не\s+указано\s*\)\s*\*?", ""),
        (r"\*", ""),
        (r"^/+|/+$", ""),
        (r"(?iU)\s+ГОСТ\s+[\d\-]+", ""),
        (r"(?iU)\s+ТУ\s+[\d.\-]+", ""),
        (r"(?iU)\s*\(\s*\d+[.,]?\d*\s*(кг|г|л|м2|м|шт|рул)\s*\)", ""),
        (r"\s{2,}", " "),
        (r"^[\s]+|[\s]+$", ""),
        (r"^,+|,+$", ""),
        (r"^/+|/+$", ""),
    )
    return once(F.trim(query), lambda q: F.when(q == "", raw).otherwise(q))


def query_keywords(col: Column, stop: Sequence[str] = tuple(L.KEYWORD_STOPWORDS), most: int = 5) -> Column:
    """The first keywords of a cleaned query."""
    stops = F.array(*[F.lit(s) for s in stop])
    parts = F.split(F.lower(blank(col)), r"[\s,;/()]+")
    return F.slice(F.filter(parts, lambda k: (F.length(k) > 2) & ~F.array_contains(stops, k) & ~k.rlike(r"^[0-9]+$")), 1, most)


def norm_query(col: Column) -> Column:
    """A query without leading numbers, pipes, equivalents, page references and file names."""
    return chain(
        blank(col),
        (r"^[\d\s.)\-]+", ""),
        (r"\|", " "),
        (r"(?iU)\b(или эквивалент|эквивалент|аналог)\b", ""),
        (r"(?iU)\b(стр\.?|страница)\s*\d+\b", ""),
        (r"(?iU)\b\S+\.(doc|docx|pdf|xls|xlsx)\b", ""),
        (r"\s{2,}", " "),
        (r"^[ \-;,.]+|[ \-;,.]+$", ""),
    )


def norm_name(col: Column) -> Column:
    """A material's name up to price, quantity and code labels, without number and ``equivalent``."""
    return chain(
        norm_text(col),
        (r"^[0-9]+[.)]?\s*", ""),
        (r"(?isU)\b(ед\.?\s*изм\.?|кол-?во|количество|цена|стоимость|окпд2|код енс)\b.*$", ""),
        (r"(?iU)\bили\s+эквивалент\b", ""),
        (r"(?iU)\bэквивалент\b", ""),
        (r"\s{2,}", " "),
        (r"^[ ,;:\-]+|[ ,;:\-]+$", ""),
    )


def dedup_key(col: Column) -> Column:
    """Lower-case words with single spaces; punctuation parts words."""
    return F.trim(F.regexp_replace(F.lower(blank(col)), r"(?U)[^\w]+", " "))


def fact_key(topic: Column, value_type: Column, raw: Column, number: Column, items: Column | None = None) -> Column:
    """A key under which equal facts meet: by number, list, or text."""
    text = F.lower(F.trim(blank(raw)))
    key = F.when(number.isNotNull(), F.concat_ws(":", F.lit("num"), topic, value_type, number.cast("string")))
    if items is not None:
        key = key.when(items.isNotNull(), F.concat_ws(":", F.lit("list"), topic, F.array_join(F.array_sort(F.transform(items, lambda x: F.lower(F.trim(x)))), "|")))
    return key.when(value_type.isNotNull(), F.concat_ws(":", F.lit("raw"), topic, value_type, text)).otherwise(F.concat_ws(":", F.lit("str"), topic, text))


def qty_unit(col: Column, units: str = L.QUANTITY_UNITS) -> Column:
    """struct(quantity, unit) of the first number that a unit follows; nulls without one."""
    low = F.replace(F.lower(blank(col)), F.lit(","), F.lit("."))
    one = rf"(?U)(\d+(?:[ .]\d+)?(?:[.,]\d+)?)\s*({units})\b"
    two = r"(?U)(не менее\s+\d+(?:[.,]\d+)?)\s*(м2|м3|м|мм|кг|т|л|шт)\b"
    told = lambda x, p: F.struct(F.replace(F.regexp_extract(x, p, 1), F.lit(" "), F.lit("")).alias("quantity"), F.regexp_extract(x, p, 2).alias("unit"))
    return once(low, lambda x: F.when(x.rlike(one), told(x, one)).when(x.rlike(two), told(x, two)).otherwise(F.struct(F.lit(None).cast("string").alias("quantity"), F.lit(None).cast("string").alias("unit"))))


def measure(col: Column, name: str, patterns: dict[str, list[str]] = L.MEASURES) -> Column:
    """The first number of a labelled measure, its patterns tried in turn; a sign is kept."""
    low = F.replace(F.lower(blank(col)), F.lit(","), F.lit("."))
    return F.coalesce(*[first_match(low, f"(?U){p}").try_cast("double") for p in patterns[name]])


def marks(col: Column, lex: Sequence[str] = tuple(L.MARKS)) -> Column:
    """The distinct marks that stand in a text as words, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(words_text(col), F.lit(rf"(?U)\b({'|'.join(lex)})\b"), 1)))


def law_type(reg: Column, ntype: Column, url: Column, docs_url: Column, explicit: Column, kinds=("44-ФЗ", "223-ФЗ", "Коммерч."), stems=("коммер", "commercial")) -> Column:
    said = F.trim(blank(explicit))
    everything = F.lower(F.concat_ws(" ", *[blank(c) for c in (reg, ntype, url, docs_url)]))
    return (
        F.when(said.isin(*kinds), said)
        .when(F.startswith(blank(reg), F.lit("223-")) | F.contains(everything, F.lit("notice223")), kinds[1])
        .when(any_of(everything, stems), kinds[2])
        .otherwise(kinds[0])
    )


def docs_url(url: Column, reg: Column, ntype: Column, base: str = "https://zakupki.gov.ru/epz/order/notice") -> Column:
    """The documents' page of a notice: as given, or after its kind; blank if nothing tells."""
    url, reg, ntype = (F.trim(blank(c)) for c in (url, reg, ntype))
    number = F.trim(F.regexp_replace(reg, "^223-", ""))
    return (
        F.when(url != "", url)
        .when(F.startswith(reg, F.lit("223-")), F.when(number != "", F.concat(F.lit(f"{base}/notice223/documents.html?noticeInfoId="), number)).otherwise(""))
        .when((reg != "") & (ntype != ""), F.concat(F.lit(f"{base}/"), ntype, F.lit("/view/documents.html?regNumber="), reg))
        .otherwise("")
    )


def deadline_date(col: Column, formats: Sequence[str] = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")) -> Column:
    """The day of a deadline text: dd.mm.yyyy, times left out, or one of the formats; null otherwise."""
    text = F.trim(blank(col))
    dotted = first_match(text, r"(\d{2}\.\d{2}\.\d{4})")
    return F.coalesce(F.to_date(F.try_to_timestamp(dotted, F.lit("dd.MM.yyyy"))), *[F.to_date(F.try_to_timestamp(text, F.lit(f))) for f in formats])


def registry_key(href: Column) -> Column:
    """A notice's key from its link: regNumber, 223- with noticeInfoId, or a run of 11 to 19 digits."""
    href = blank(href)
    return F.coalesce(
        first_match(href, r"(?i)[?&]regNumber=([0-9]+)"),
        F.concat(F.lit("223-"), first_match(href, r"(?i)[?&]noticeInfoId=([0-9]+)")),
        first_match(href, r"(?<![0-9])([0-9]{11,19})(?![0-9])"),
    )


def notice_kind(href: Column, after: str = "notice") -> Column:
    """The path segment behind ``/notice/``."""
    return first_match(blank(href), rf"/{after}/([^/?#]+)/")


def href_rank(col: Column, rules=L.HREF_RANKS, technical: Sequence[str] = L.TECHNICAL_PARTS) -> Column:
    """How little a link tells of a notice: 0 is best, 10 unknown, 1000 technical."""
    path = F.lower(F.regexp_extract(blank(col), r"^(?:[a-zA-Z]+://[^/?#]*)?([^?#]*)", 1))
    rank = F.when(F.lit(False), 0)
    for need, bar, value in rules:
        fits = path.rlike(need)
        rank = rank.when(fits & ~F.contains(path, F.lit(bar)) if bar else fits, value)
    return rank.when(any_of(path, technical), 1000).otherwise(10)


def _parts(col: Column) -> tuple[Column, Column, Column, Column]:
    url = F.trim(blank(col))
    get = lambda g: F.regexp_extract(url, r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?", g)
    return get(1), get(2), get(3), get(4)


def canonical_url(col: Column, domain: str = "", drop: Sequence[str] = L.DROP_PARAMETERS, prefixes: Sequence[str] = ("utm_",), force: tuple[str, str] | None = None) -> Column:
    """https by default, no ``www.``, slash at the end, fragment, or tracking parameters; one forced parameter."""
    scheme, host, path, query = _parts(col)
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    key = lambda p: F.lower(F.substring_index(p, "=", 1))
    barred = [*drop, *([force[0].lower()] if force else [])]
    pairs = F.filter(pairs, lambda p: ~key(p).isin(*barred) & ~reduce(lambda a, b: a | b, [F.startswith(key(p), F.lit(x)) for x in prefixes], F.lit(False)))
    pairs = F.transform(pairs, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))))
    pairs = F.concat(pairs, F.array(F.lit(f"{force[0]}={force[1]}"))) if force else pairs
    tail = F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise("")
    whole = F.concat(
        F.when(scheme == "", "https").otherwise(scheme), F.lit("://"), F.replace(F.when(host == "", domain).otherwise(host), F.lit("www."), F.lit("")), F.regexp_replace(path, "/+$", ""), tail
    )
    return F.when(is_blank(col), F.lit("")).otherwise(whole)


def allowed_url(col: Column, domain: str, force: tuple[str, str] | None = None, assets: Sequence[str] = L.ASSETS) -> Column:
    """Whether a link is of the domain, no asset, and carries the forced parameter or none of its name."""
    _, host, _, query = _parts(col)
    host = F.replace(host, F.lit("www."), F.lit(""))
    fine = ~is_blank(col) & ((host == "") | F.endswith(host, F.lit(domain))) & ~F.lower(blank(col)).rlike(rf"\.({'|'.join(assets)})$")
    if force:
        value = F.regexp_extract(query, rf"(?i)(?:^|&){force[0]}=([^&]*)", 1)
        fine = fine & (~query.rlike(rf"(?i)(^|&){force[0]}=") | (value == force[1]))
    return fine


#: What windows-1251 reads where latin-1 reads the characters 128 to 255; one byte stands for none.
_LATIN = bytes(range(128, 256)).decode("latin-1").replace("\x98", "")
_CYRILLIC = bytes(b for b in range(128, 256) if b != 0x98).decode("cp1251")


def _reread(name: Column) -> Column:
    """A name whose bytes were read as latin-1: read as UTF-8, or else as windows-1251, where Cyrillic appears by it. Names that hold
    Cyrillic or other characters beyond latin-1 stay."""
    raw = F.encode(name, "ISO-8859-1").cast("string")
    utf8, cyrillic = F.try_validate_utf8(raw), "[а-яА-ЯёЁ]"
    windows = F.translate(F.replace(name, F.lit("\x98"), F.lit("")), _LATIN, _CYRILLIC)
    return F.when(name.rlike("[^\\x00-\\xff]"), name).when(utf8.rlike(cyrillic), utf8).when(windows.rlike(cyrillic), windows).otherwise(name)


def _safe_name(name: Column, most: int) -> Column:
    return F.substring(chain(name, (r'[\\/:*?"<>|\x00-\x1f]', "_"), (r"^[ .]+|[ .]+$", "")), 1, most)


def repair_filename(col: Column, most: int = 180) -> Column:
    """A file name fit for any file system; latin-1 readings of UTF-8 and windows-1251 are undone where Cyrillic appears."""
    return _safe_name(_reread(blank(col)), most)


def disposition_filename(col: Column, most: int = 180) -> Column:
    """The file name that a Content-Disposition header tells: ``filename*=UTF-8''…`` if it can be decoded, else ``filename=``
    repaired; null without either."""
    star = F.regexp_extract(col, r"(?i)filename\*\s*=\s*UTF-8''([^;]+)", 1)
    told = F.try_url_decode(F.replace(F.nullif(star, F.lit("")), F.lit("+"), F.lit("%2B")))
    plain = F.nullif(F.regexp_extract(col, r'(?i)filename\s*=\s*"?([^";]+)"?', 1), F.lit(""))
    return F.coalesce(_safe_name(told, most), F.when(plain.isNotNull(), repair_filename(F.trim(plain), most)))


def audit_signature(content: Column, name: Column, magic: dict[str, list[str]] = L.MAGIC, least: int = 100, declared: Column | None = None) -> Column:
    """ok, empty, html, too_small, or mismatch, from a file's first bytes and its name's extension, or where that tells
    no kind the content type that is declared."""
    start = F.hex(F.substring(content, 1, 8))
    head = F.lower(F.decode(F.substring(content, 1, 64), "ISO-8859-1"))  # any bytes: the cut may part a character
    ext = F.lower(F.regexp_extract(blank(name), r"\.([^.]+)$", 1))
    if declared is not None:
        ext = F.when(ext.isin(*magic), ext).otherwise(reduce(lambda c, k: c.when(F.contains(F.lower(blank(declared)), F.lit(k[0])), k[1]), L.DECLARED, F.when(F.lit(False), "")).otherwise(""))
    fits = reduce(lambda a, b: a | b, [(ext == e) & reduce(lambda x, y: x | y, [F.startswith(start, F.lit(m)) for m in ms]) for e, ms in magic.items()], ~ext.isin(*magic))
    return (
        F.when(content.isNull() | (F.octet_length(content) == 0), "empty")
        .when(blank(head).rlike(r"^\s*(<!doctype html|<html)"), "html")
        .when(F.octet_length(content) < least, "too_small")
        .when(~fits, "mismatch")
        .otherwise("ok")
    )


def ext_from_ctype(col: Column, kinds=L.CONTENT_TYPES) -> Column:
    low = F.lower(blank(col))
    return reduce(lambda c, k: c.when(F.contains(low, F.lit(k[0])), k[1]), kinds, F.when(F.lit(False), "")).otherwise("")


def strip_markdown(col: Column) -> Column:
    """Text without emphasis, heading marks, rules and runs of blank lines."""
    return F.regexp_replace(chain(blank(col), (r"\*\*|\*|__|_", ""), (r"#+\s+", ""), (r"(?m)^-{3,}\s*$", ""), (r"\n{3,}", "\n\n")), r"^\s+|\s+$", "")


def table_row(line: Column) -> Column:
    """A line of a pipe table: one pipe between cells and at both ends, cells trimmed."""
    inner = chain(line, (r"\|\|+", "|"), (r"^\s+|\s+$", ""), (r"^\|+|\|+$", ""))
    return F.concat(F.lit("| "), F.array_join(F.transform(F.split(inner, "\\|"), lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")), " | "), F.lit(" |"))


def repair_report(col: Column, title: str = L.REPORT_TITLE, empty: str = L.REPORT_EMPTY, sections: str = L.REPORT_SECTION) -> Column:
    """A report in Markdown: headings start lines, one title stands first, every pipe table has even rows and a
    separator below its first. A blank report is the title and a note."""
    repaired = once(_one_title(col, title, sections), _even_tables)
    return F.when(F.regexp_replace(blank(col), r"\s", "") == "", F.lit(f"{title}\n\n{empty}")).otherwise(repaired)


def _one_title(col: Column, title: str, sections: str) -> Column:
    """A report's text whose headings start lines and that begins with its title."""
    text = F.regexp_replace(F.replace(blank(col), F.lit("\r\n"), F.lit("\n")), r"^\s+|\s+$", "")
    words = title.lstrip("# ")
    text = F.regexp_replace(text, rf"(?U)(?<!\n)(##\s+(?:{sections})|#\s+\Q{words}\E)", "\n$1")
    # Of several titles the first; what stands before it goes.
    times = lambda x: (F.length(x) - F.length(F.replace(x, F.lit(title), F.lit("")))) / len(title)
    tail = lambda x: F.regexp_replace(F.substr(x, F.instr(x, title)), rf"(?:\n|^)\Q{title}\E\n*", "\n")
    text = once(text, lambda x: F.when(times(x) > 1, F.concat(F.lit(f"{title}\n\n"), F.regexp_replace(tail(x), r"^\s+|\s+$", ""))).otherwise(x))
    headed = lambda x: F.startswith(F.regexp_replace(x, r"^\s+", ""), F.lit(title))
    return once(text, lambda x: F.when(headed(x), x).otherwise(F.concat(F.lit(f"{title}\n\n"), F.regexp_replace(x, r"^\s+|\s+$", ""))))


def _even_tables(text: Column) -> Column:
    tabular = lambda x: F.contains(x, F.lit(" | ")) | x.rlike(r"^\s*\|") | (F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 2)
    # A heading and a table's first row in one line are two.
    rows = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"\s+$", ""))
    glued = lambda x: F.array(F.trim(F.substring_index(x, "|", 1)), F.substr(x, F.instr(x, "|")))
    rows = F.flatten(F.transform(rows, lambda x: F.when(tabular(x) & x.rlike(r"^\s*## "), glued(x)).otherwise(F.array(x))))
    rows = F.transform(rows, lambda x: once(tabular(x), lambda t: F.struct(t.alias("table"), F.when(t, table_row(x)).otherwise(x).alias("line"))))

    def whole(x: Column, before: Column, after: Column) -> Column:
        first = x["table"] & ~F.coalesce(before["table"], F.lit(False))
        ruled = F.coalesce(after["table"] & after["line"].rlike(r"^\|\s*:?-{3,}:?(?:\s*\|\s*:?-{3,}:?)+\s*\|$"), F.lit(False))
        rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(F.split(x["line"], "\\|")) - 2))
        return F.when(first & ~ruled, F.concat_ws("\n", x["line"], rule)).otherwise(x["line"])

    nothing = F.array(F.lit(None).cast("struct<table:boolean,line:string>"))
    before, after = lambda r: F.concat(nothing, F.slice(r, 1, F.size(r) - 1)), lambda r: F.concat(F.slice(r, 2, F.size(r)), nothing)
    row = lambda x, b, a: F.struct(x.alias("x"), b.alias("b"), a.alias("a"))
    near = lambda r: F.zip_with(F.zip_with(r, before(r), lambda x, b: F.struct(x.alias("x"), b.alias("b"))), after(r), lambda z, a: row(z["x"], z["b"], a))
    out = F.transform(once(rows, near), lambda z: whole(z["x"], z["b"], z["a"]))
    return chain(F.array_join(out, "\n"), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", ""))


def distinct_sources(col: Column, most: int = 500) -> Column:
    """An array of structs (file, page_or_sheet, fragment_type, evidence), each once whatever its case, at its
    first place; without such as name neither file nor evidence; evidence cut to ``most`` characters."""
    fields = ("file", "page_or_sheet", "fragment_type", "evidence")
    even = lambda x: chain(F.replace(blank(x), F.lit(NBSP), F.lit(" ")), (r"^\s+|\s+$", ""), (r"\s{2,}", " "))
    clean = F.transform(col, lambda s: F.struct(*[even(s[f]).alias(f) for f in fields]))
    told = F.filter(clean, lambda s: (s["file"] != "") | (s["evidence"] != ""))
    keys = F.transform(told, lambda s: F.array(*[F.lower(s[f]) for f in fields]))
    once = F.filter(told, lambda s, i: F.array_position(keys, F.array(*[F.lower(s[f]) for f in fields])) == i + 1)
    return F.coalesce(F.transform(once, lambda s: s.withField("evidence", F.substring(s["evidence"], 1, most))), F.array().cast("array<struct<file:string,page_or_sheet:string,fragment_type:string,evidence:string>>"))


def parse_json_lenient(col: Column, schema: str) -> Column:
    """JSON between the outermost braces, fences and commas before a closing brace left out."""
    body = F.regexp_extract(F.regexp_replace(blank(col), "```(?:json)?|﻿", ""), r"(?s)(\{.*\})", 1)
    return F.from_json(F.nullif(F.regexp_replace(body, r",\s*([}\]])", "$1"), F.lit("")), schema)


def flatten_specs(col: Column) -> Column:
    """``key: value`` pairs of a map, in its order, joined by `` ; ``; blank for none."""
    return blank(F.array_join(F.transform(F.map_entries(col), lambda e: F.concat(e["key"], F.lit(": "), blank(e["value"].cast("string")))), " ; "))


def labelled_field(col: Column, labels: Sequence[str], stops: Sequence[str]) -> Column:
    """Text behind the first label that has any, up to the next of the stop labels or the end."""
    ends = "|".join(f"\\Q{s}\\E" for s in stops)
    return F.coalesce(*[F.nullif(F.trim(F.regexp_replace(F.regexp_extract(blank(col), rf"(?isU)\Q{label}\E\s*:?\s*(.*?)(?={ends}|$)", 1), r"\s+", " ")), F.lit("")) for label in labels])


def card_price(col: Column, labels: Sequence[str], stops: Sequence[str]) -> Column:
    money = r"(?U)([\d\s.,]*\d)\s*(?:₽|руб)"
    field = labelled_field(col, labels, stops)
    return F.coalesce(F.trim(first_match(field, money)), F.trim(first_match(blank(col), money)))


def card_deadline(col: Column, labels: Sequence[str], stops: Sequence[str]) -> Column:
    day = r"(\d{2}\.\d{2}\.\d{4}(?:\s+\d{2}:\d{2})?)"
    return F.coalesce(first_match(labelled_field(col, labels, stops), day), first_match(blank(col), day))


def senior_category(col: Column, separator: str = " / ") -> Column:
    return F.substring_index(blank(col), separator, 1)


def category_path(crumbs: Column, title: Column, stop: Sequence[str] = (), separator: str = " / ") -> Column:
    """The last three crumbs that are neither stop crumbs nor the page's own title."""
    kept = F.filter(crumbs, lambda c: ~F.lower(c).isin(*[s.lower() for s in stop]) & (c != title) & (F.trim(c) != ""))
    return F.array_join(F.slice(kept, F.greatest(F.size(kept) - 2, F.lit(1)), 3), separator)


def match_band(score: Column) -> Column:
    return F.when(score >= 90, "excellent").when(score >= 70, "good").when(score >= 50, "fair").otherwise("weak")


def is_equivalent(score: Column, over: int = 80) -> Column:
    return score > over


def is_generic_query(col: Column) -> Column:
    """Short queries, and such of one or two words without digit or Latin letter."""
    text = F.trim(blank(col))
    return (F.length(text) < 10) | (~text.rlike("[0-9a-zA-Z]") & (F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) < 3))


def compose_query(name: Column, characteristics: Column, lex: Sequence[str] = tuple(L.KEY_CHARACTERISTICS), most: int = 4) -> Column:
    """A name, and behind a pipe its key characteristics."""
    key = F.slice(F.filter(characteristics, lambda c: any_of(F.lower(c), lex)), 1, most)
    whole = F.concat(norm_name(name), once(key, lambda k: F.when(F.size(k) > 0, F.concat(F.lit(" | "), F.array_join(k, "; "))).otherwise("")))
    return chain(whole, (r"\s{2,}", " "), (r"^[ |;]+|[ |;]+$", ""))


def doc_priority(col: Column, rules=L.GOODS_PRIORITY, other=(10, "other")) -> Column:
    """struct(priority, class) of a file name."""
    low = F.lower(blank(col))
    both = F.when(F.lit(False), F.struct(F.lit(0).alias("priority"), F.lit("").alias("class")))
    for terms, suffix, priority, kind in rules:
        both = both.when(low.rlike(suffix) if suffix else any_of(low, terms), F.struct(F.lit(priority).alias("priority"), F.lit(kind).alias("class")))
    return both.otherwise(F.struct(F.lit(other[0]).alias("priority"), F.lit(other[1]).alias("class")))


def strip_artifacts(col: Column) -> Column:
    """Text without the marks of files and pages that assembling put into it."""
    text = F.regexp_replace(F.regexp_replace(norm_text(col), r"(?iU)\[(FILE:[^\]]+|CRM_DESCRIPTION_FALLBACK)\]", " "), r"(?iU)(===\s*ФАЙЛ:|---\s*СТРАНИЦА/ЛИСТ:)[^\n]+", " ")
    return F.regexp_replace(chain(text, (r"(?iU)\.(docx?|pdf|xlsx?)\b", " "), (r"(?iU)\bстр\.?\s*\d+\b", " "), (r"\s+\|\s+", " | "), (r"\n{3,}", "\n\n")), r"^\s+|\s+$", "")


def step_status(col: Column, forward: bool, order: Sequence[str]) -> Column:
    """The next or previous status of an order, clamped to it; an unknown one stands before the first."""
    states = F.array(*[F.lit(s) for s in order])
    at = F.coalesce(F.array_position(states, col), F.lit(0)) + (1 if forward else -1)
    return F.element_at(states, F.greatest(F.lit(1), F.least(F.lit(len(order)), at)).cast("int"))
