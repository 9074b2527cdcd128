"""Statistics of a text that the quality operators share, over whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES, SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words in windows of ``width`` words that are found twice or more, the first included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[i:] for i in range(width)), strict=False))
    once: set = set()
    more = {w for w in windows if w in once or once.add(w)}
    if not more:
        return 0
    covered, to = 0, 0  # words before ``to`` are counted
    for i, w in enumerate(windows):
        if w in more:
            covered += i + width - max(i, to)
            to = i + width
    return covered


def dup_lines(text: str) -> tuple[int, int]:
    """Lines with a word; those of them that are equal to an earlier one."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines), len(lines) - len(set(lines))


def basic(text: str) -> dict[str, int]:
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines, dups = dup_lines(text)
    return {
        "n_words": len(words),
        "word_chars": len(text) - sum(map(text.count, SPACES)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_lines": lines,
        "n_dup_lines": dups,
        "n_repeat_words": repeated_words(words),
        "n_upper": len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        "n_marks": text.count("!") + text.count("?"),
    }


BASIC = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks")


def basic_stats(text: Column) -> Column:
    """struct of BASIC as longs; a null text is an empty one."""

    @F.pandas_udf(", ".join(f"{c} long" for c in BASIC))
    def stats(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([basic(t or "") for t in texts], columns=list(BASIC))

    return stats(text)


#: Shares of a text that the quality classifier's rules are about; all but the first two lie in [0, 1].
SHARES = (
    "log_words", "word_len", "long_words", "short_words", "distinct_words", "top_word", "repeats", "dup_lines",
    "upper", "digits", "symbols", "pipes", "marks", "stops", "non_ascii", "symbol_words", "upper_words", "line_words",
)

_CLASS = np.zeros((256, 7))
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>@^~{}[]\\_=+", b"|", b"!?", b".,;:", bytes(range(128, 256)))):
    _CLASS[list(_chars), _i] = 1


def shares(text: str) -> list[float]:
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(SHARES)
    chars = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _CLASS / len(data)
    lens = np.fromiter(map(len, words), np.int64, n)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines, dups = dup_lines(text)
    kinds = list(counts.items())
    symbols = sum(c for w, c in kinds if not w[-1:].isalnum() and w[-1] < 128 and w[-1] not in b".,;:!?")
    upper = sum(c for w, c in kinds if w.isupper())
    upper_share, digit_share, symbol_share, pipe_share, mark_share, stop_share, wide_share = map(float, chars)
    return [
        float(np.log1p(n)), float(lens.mean()), float((lens > 20).mean()), float((lens < 3).mean()), len(counts) / n, max(counts.values()) / n,
        repeated_words(words) / n, dups / max(1, lines), upper_share, digit_share, symbol_share, pipe_share, mark_share, stop_share, wide_share,
        symbols / n, upper / n, float(np.log1p(n / max(1, lines))),
    ]


def share_stats(text: Column) -> Column:
    """struct of SHARES as doubles; a null or empty text has zeros."""

    @F.pandas_udf(", ".join(f"{c} double" for c in SHARES))
    def stats(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([shares(t or "") for t in texts], columns=list(SHARES), dtype=float)

    return stats(text)
