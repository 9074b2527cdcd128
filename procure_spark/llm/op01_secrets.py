"""Secret scans with multipart credential linking.

Base kinds (``assign``, ``access``, ``hex``) are reported wherever they stand. Weak parts (``id``:
a named account or client identifier; ``token``: a long word that mixes letters and digits;
``endpoint``: a URL, host with port, or IPv4 address) are each too common to report alone. An
interval join links them: parts are intervals of a text, stretched by ``reach`` code points on
either side, and a weak part is reported only if the stretched interval meets a complementary part
in the same scope (a run of lines without a blank one between). Complementary are secrets (assign,
hex, token) to identifiers and endpoints (access, id, endpoint) and the other way round; a ``token``
counts as a secret for an access key, id or endpoint, and those are then reported with it. Parts that
belong together stand apart from each other: a word inside a link, or an identifier's own value, is no
token (``weak_parts``), so that no part is linked with a piece of itself or of another identifier.

A text's parts never meet another text's, so the join is a sweep over one row's sorted intervals:
no shuffle, memory of one text, and a lost task is simply run again.

Defined cases: a null or empty text has no parts; repeated rows are scanned each for itself; texts
of any length are scanned whole; other columns pass through ``redact`` and ``scan`` untouched, except
those named like their output.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procure_spark.llm.common import table

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # of maximal runs those that are long enough
ID = re.compile(r"""(?i:user(?:name)?|login|account|client_?id|key_?id|access_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})""", re.ASCII)
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}", re.ASCII)
ENDPOINT = re.compile(r"\b(?:https?|ftp|ssh|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>|]+|\b(?:\d{1,3}\.){3}\d{1,3}(?::\d{2,5})?\b|(?<![\w.-])(?P<host>[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++):\d{2,5}\b", re.ASCII)
#: Of a host's labels none is longer than this, and the last is of letters.
LABEL, LAST_LABEL = 63, re.compile("[A-Za-z]{2,6}")

KINDS = ("assign", "access", "hex", "id", "token", "endpoint")
SECRET, OTHER = ("assign", "hex", "token"), ("access", "id", "endpoint")

#: Code points between parts that still belong together.
REACH = 300


def base_parts(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, by start, then kind as listed."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda p: (p[0], KINDS.index(p[2])))


def endpoints(text: str) -> list[tuple[int, int, str]]:
    def named(host: str) -> bool:
        labels = host.split(".")
        return max(map(len, labels)) <= LABEL and LAST_LABEL.fullmatch(labels[-1]) is not None

    return [(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text) if m["host"] is None or named(m["host"])]


def weak_parts(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Candidates that are reported only in company; none overlaps a base part, no token an id or endpoint."""
    found = endpoints(text) if "." in text or "://" in text else []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), "id") for m in ID.finditer(text)]
    found = apart(found, base)
    if base or found:
        tokens = [(m.start(), m.end(), "token") for m in TOKEN.finditer(text) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
        found += apart(tokens, sorted(base + found))
    return found


def apart(parts: list[tuple[int, int, str]], others: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Parts that overlap none of the others, which are sorted."""
    starts, ends = [p[0] for p in others], list(accumulate((p[1] for p in others), max))

    def free(part: tuple[int, int, str]) -> bool:
        i = bisect_left(starts, part[1])  # others that start before its end
        return i == 0 or ends[i - 1] <= part[0]

    return [p for p in parts if free(p)]


def linked(text: str, base: list[tuple[int, int, str]], reach: int = REACH) -> list[tuple[int, int, str]]:
    """All parts to report: the base ones, and weak ones that meet a complementary part."""
    weak = weak_parts(text, base)
    if not weak:
        return base
    breaks = [m.start() for m in re.finditer(r"\n[ \t\r]*\n", text)]
    sides = {}
    for kinds in (SECRET, OTHER):
        side = sorted((bisect_left(breaks, p[0]), p[0], p[1]) for p in base + weak if p[2] in kinds)
        sides[kinds] = side, _furthest(side)
    kept = list(base)
    for start, end, kind in weak:
        scope = bisect_left(breaks, start)
        side, furthest = sides[OTHER if kind in SECRET else SECRET]
        # The last complementary part that starts in reach; of those up to it in this scope, the end that lies furthest.
        i = bisect_left(side, (scope, end + reach + 1, 0)) - 1
        if i >= 0 and side[i][0] == scope and furthest[i] >= start - reach:
            kept.append((start, end, kind))
    return sorted(kept, key=lambda p: (p[0], KINDS.index(p[2])))


def _furthest(side: list[tuple[int, int, int]]) -> list[int]:
    out: list[int] = []
    for i, (scope, _, end) in enumerate(side):
        out.append(max(end, out[-1]) if i and side[i - 1][0] == scope else end)
    return out


def written_out(parts: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in parts)


def scan_column(text: Column, reach: int = REACH) -> Column:
    """struct(n_assign, n_access, n_hex, base_sha256, spans) of a text column."""

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def scan_batch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                text = text or ""
                base = base_parts(text)
                kinds = [p[2] for p in base]
                rows.append((*map(kinds.count, KINDS[:3]), hashlib.sha256(written_out(base).encode()).hexdigest(), written_out(linked(text, base, reach))))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return scan_batch(text)


def scan(df: DataFrame, text_col="text", reach: int = REACH) -> DataFrame:
    """df with n_assign, n_access, n_hex, base_sha256 and spans."""
    found = df.withColumn("__found", scan_column(F.col(text_col), reach))
    return found.withColumns({c: F.col("__found")[c] for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}).drop("__found")


def redact(df: DataFrame, text_col="text", reach: int = REACH, mask: str = "[{kind}]") -> DataFrame:
    """df with each reported span of the text replaced by its kind in brackets; overlapping spans
    become one, named after the first."""

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            if not text or not (parts := linked(text, base_parts(text), reach)):
                return text
            out, at = [], 0
            for start, end, kind in parts:
                if start >= at:
                    out += [text[at:start], mask.format(kind=kind)]
                at = max(at, end)
            return "".join([*out, text[at:]])

        return texts.map(one)

    return df.withColumn(text_col, masked(F.col(text_col)))


def op1_multipart_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
