"""Splitters: one row to many. Each keeps the row's other columns and adds a position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procure_spark.functions.text import allowed_url, blank, canonical_url


#: Pieces, or parts, of a part that is folded at once; levels of parts.
PART, LEVELS = 64, 3


def _parts(df: DataFrame, parts: Column, name: str) -> DataFrame:
    # Outer, since Spark would compute the parts once more to look for empty ones before it makes rows.
    return df.select("*", F.posexplode_outer(parts).alias("pos", name)).filter("pos is not null")


def packed(pieces: Column, limit: int, separator: str) -> Column:
    """An array's strings joined in order to strings of up to ``limit`` characters; a longer one stands
    alone. A fold over one row's pieces. What a fold holds is copied at each step, so pieces are folded by parts of ``PART``, these by parts of
    as many parts, and so on for ``LEVELS``: at each level what is done grows within a part only, and a very long text costs little
    more a piece than a short one."""
    state = lambda done, open_: F.struct(done.alias("done"), open_.alias("open"))
    nothing = F.array().cast("array<string>")
    once = lambda c, f: F.element_at(F.transform(F.array(c), f), 1)  # noqa: E731  c is computed once, whatever f does with it

    def add(acc: Column, piece: Column) -> Column:
        fits = F.length(acc["open"]) + len(separator) + F.length(piece) <= limit
        done = F.when(acc["open"].isNull() | fits, acc["done"]).otherwise(F.array_append(acc["done"], acc["open"]))
        return state(done, F.when(acc["open"].isNotNull() & fits, F.concat(acc["open"], F.lit(separator), piece)).otherwise(piece))

    def fold(level: int, open_: Column, own: Column) -> Column:
        if level == 0:
            return F.aggregate(own, state(nothing, open_), add)
        size = PART**level
        starts = F.when(F.size(own) > 0, F.sequence(F.lit(1), F.size(own), F.lit(size))).otherwise(F.array().cast("array<int>"))
        parts = F.transform(starts, lambda i: F.slice(own, i, size))
        step = lambda acc, part: once(fold(level - 1, acc["open"], part), lambda x: state(F.concat(acc["done"], x["done"]), x["open"]))
        return F.aggregate(parts, state(nothing, open_), step)

    ended = lambda x: F.when(x["open"].isNull(), x["done"]).otherwise(F.array_append(x["done"], x["open"]))
    return once(pieces, lambda own: once(fold(LEVELS, F.lit(None).cast("string"), own), ended))


def blocks(text: Column, large: int = 5000, repack: int = 2500) -> Column:
    """Blocks between blank lines, trimmed; those over ``large`` characters packed anew by lines."""
    found = F.filter(F.transform(F.split(blank(text), r"\n\s*\n"), lambda b: F.trim(b)), lambda b: b != "")
    return F.flatten(F.transform(found, lambda b: F.when(F.length(b) <= large, F.array(b)).otherwise(packed(F.filter(F.split(b, "\n"), lambda x: F.trim(x) != ""), repack, "\n"))))


def split_blocks(df: DataFrame, text: str = "text", large: int = 5000, repack: int = 2500) -> DataFrame:
    return _parts(df, blocks(F.col(text), large, repack), "block")


def lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(blank(text), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def split_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """Trimmed lines that aren't blank."""
    return _parts(df, lines(F.col(text)), "line")


def pipe_rows(df: DataFrame, text: str = "text", pipes: int = 2, cells: int = 3) -> DataFrame:
    """Cells of lines with at least ``pipes`` pipes; bullets and blank cells left out, short rows too."""
    tabular = F.filter(lines(F.col(text)), lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= pipes)
    rows = F.transform(tabular, lambda x: F.filter(F.transform(F.split(x, "\\|"), lambda c: F.trim(F.regexp_replace(c, r"^\s*[•·*–-]+\s*", ""))), lambda c: c != ""))
    return _parts(df, F.filter(rows, lambda r: F.size(r) >= cells), "cells")


def markdown_tables(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows of pipe tables: table number, row number, cells padded to the table's widest row."""
    numbered = df.withColumn("__row", F.monotonically_increasing_id())
    numbered = numbered.select("*", F.posexplode(F.split(blank(F.col(text)), "\n")).alias("line_no", "line"))
    line = F.trim("line")
    tabular = F.startswith(line, F.lit("|"))
    w = Window.partitionBy("__row").orderBy("line_no")
    begins = tabular & ~F.coalesce(F.lag(tabular).over(w), F.lit(False))
    rows = numbered.withColumns({"__t": tabular, "table_no": F.sum(begins.cast("int")).over(w)}).filter("__t")
    rows = rows.filter(~line.rlike(r"^\|[\s:|-]+\|?$")).withColumn("cells", F.transform(F.split(F.regexp_replace(line, r"^\||\|$", ""), "\\|"), lambda c: F.trim(c)))
    widest = F.max(F.size("cells")).over(Window.partitionBy("__row", "table_no"))
    place = F.row_number().over(Window.partitionBy("__row", "table_no").orderBy("line_no"))
    padded = F.concat("cells", F.array_repeat(F.lit(""), F.col("__w") - F.size("cells")))
    return rows.withColumns({"__w": widest, "row_no": place}).withColumn("cells", padded).drop("__row", "__t", "__w", "line", "line_no")


def markdown_list(df: DataFrame, text: str = "text") -> DataFrame:
    """Items of lists; other lines count as items unless they belong to a table or heading."""
    kept = F.filter(lines(F.col(text)), lambda x: ~x.rlike(r"^[|#]"))
    return _parts(df, F.filter(F.transform(kept, lambda x: F.trim(F.regexp_replace(x, r"^(?:[-*•]|\d+[.)])\s+", ""))), lambda x: x != ""), "item")


def chunk_chars(df: DataFrame, size: int = 12000, overlap: int = 1200, text: str = "text") -> DataFrame:
    """Chunks of ``size`` characters that overlap; trimmed, blank ones left out."""
    n, step = F.length(blank(F.col(text))), size - overlap
    count = F.when(n <= size, 1).otherwise(F.ceil((n - size) / step) + 1).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.trim(F.substring(blank(F.col(text)), i * step + 1, F.lit(size))))
    return _parts(df, cut, "chunk").filter("chunk != ''")


def pack_paragraphs(df: DataFrame, limit: int = 1400, text: str = "text", separator: str = "\n") -> DataFrame:
    """Paragraphs packed to pieces of up to ``limit`` characters, separators counted."""
    return _parts(df, packed(F.filter(F.transform(F.split(blank(F.col(text)), separator), lambda p: F.trim(p)), lambda p: p != ""), limit, separator), "piece")


def split_sections(df: DataFrame, key: str, pattern: str = r"(?iU)^\s*раздел\s+\d+", text: str = "text") -> DataFrame:
    """(key, section, body): lines up to the next one that the pattern fits; what stands before the
    first is section 0. key tells rows apart."""
    rows = split_lines(df.select(key, text), text)
    w = Window.partitionBy(key).orderBy("pos")
    rows = rows.withColumn("section", F.sum(F.col("line").rlike(pattern).cast("int")).over(w))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy(key, "section").agg(body.alias("body"))


def explode_queries(df: DataFrame, text: str) -> DataFrame:
    """A row for each of a query's comma-separated parts."""
    return _parts(df, F.filter(F.transform(F.split(blank(F.col(text)), ","), lambda x: F.trim(x)), lambda x: x != ""), "query")


def absolute_url(base: Column, href: Column) -> Column:
    """href as seen from a page."""
    host = F.regexp_extract(base, r"^([a-zA-Z]+://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?<=[^/:])/[^/]*$", "")
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(F.regexp_extract(base, r"^([a-zA-Z]+:)", 1), href))
        .when(F.startswith(href, F.lit("/")), F.concat(host, href))
        .otherwise(F.concat(folder, F.lit("/"), href))
    )


def page_links(df: DataFrame, domain: str, url: str = "url", html: str = "html", force: tuple[str, str] | None = None) -> DataFrame:
    """(url, link): a page's distinct links that are allowed, absolute and canonical."""
    hrefs = F.regexp_extract_all(blank(F.col(html)), F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"'#]+)["'#]"""), 1)
    found = df.select(F.col(url).alias("url"), F.explode(hrefs).alias("href"))
    found = found.withColumn("href", absolute_url(F.col("url"), F.col("href"))).filter(allowed_url(F.col("href"), domain, force))
    return found.select("url", canonical_url(F.col("href"), domain, force=force).alias("link")).distinct()


def classify_pages(df: DataFrame, html: str = "html", carts: str = r"(?i)в корзину|add to cart", price: str = r"(?i)\d[\d ]*(?:[.,]\d+)?\s*(?:р\.|₽|руб)", sales: str = r"(?iU)купить|цена", marker: str = r"(?iU)характеристики") -> DataFrame:
    """df with page_class: listing, product or other, by counts of buttons, prices and headings."""
    text = blank(F.col(html))
    count = lambda p: F.size(F.regexp_extract_all(text, F.lit(p), 0))
    n_carts, n_prices, n_heads = count(carts), count(price), count(r"(?is)<h[2-4]\b[^>]*>\s*<a\b")
    listing = (n_carts >= 3) | (n_prices >= 8) | (n_heads >= 6)
    proof = (count(r"(?i)<tr\b") >= 3) | text.rlike(marker) | (text.rlike(sales) & (n_carts <= 2))
    product = (count(r"(?i)<h1\b") >= 1) & (n_prices > 0) & proof
    return df.withColumn("page_class", F.when(listing, "listing").when(product, "product").otherwise("other"))


def table_preview(df: DataFrame, item_words: list[str], qty_words: list[str], text: str = "text", rows: int = 5) -> DataFrame:
    """The first data rows behind a header line that names an item and a quantity; null without one."""
    has = lambda x, words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(x), w))
    ls = F.filter(lines(F.col(text)), lambda x: F.contains(x, F.lit("|")))
    at = F.array_position(F.transform(ls, lambda x: has(x, item_words) & has(x, qty_words)), True)
    return df.withColumn("preview", F.when(at > 0, F.slice(ls, (at + 1).cast("int"), rows)))


