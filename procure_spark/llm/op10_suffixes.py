"""Exact substring dedup over suffixes, sorted deep-shallow.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts earlier (in a smaller
doc_id, or earlier in the same document). So the suffixes that matter are those of which an equal
start of that length exists elsewhere, and they are found in three steps:

1. Every string of that length has an anchor, its gram of least hash: equal strings have equal
   anchors, so the anchor's hash spreads suffixes over tasks as a leading byte would, evenly. Strings
   of one anchor stand side by side in the text and are handled as one context, which has a hash of
   its own. An anchor found once only needs no sorting; of equal contexts all but the first go as a whole.
2. Contexts that share an anchor but differ as a whole (where a passage begins or ends) are cut out of
   their texts and their suffixes sorted: multikey quicksort, by eight bytes a step, to a shallow depth
   first; what is still tied there is put into blind tries, which compare a suffix once in full with
   one other. Suffixes that end in the same leaf are equal; all but the earliest mark their bytes.
3. Marks meet their texts again, and what is left of each is digested.

A group of contexts that many documents share is sorted in rounds. First its contexts are dealt into
blocks of about ``PART`` by their places; a block marks all but the earliest of its equal strings and
hands on the rest. These are dealt by their own hash, so that equal strings meet, and a string that is
still found in many blocks is dealt into fewer blocks again, until one is left (``rounds``). So no unit
that a task sorts grows with the number of documents that share a passage. Nor has a window
all rows of such an anchor: the most frequent anchors (``hottest``) are dealt by context and salt, and what
is left of them, few rows a context, meets in a second step. Hashes of contexts have 64 bits, on top of
equal 64-bit anchors; within sorted parts bytes are compared.

Defined cases: a null or empty text has no bytes; texts under ``LENGTH`` bytes lose nothing; rows that
share a doc_id are told apart by a 64-bit hash of their text and stand in its order, and equal rows count as one; a null doc_id is an id like
others, and the first; texts of any length are treated whole; an empty table gives an empty result;
other columns are left out by ``dedup_substrings``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from procure_spark.llm.common import table, written

LENGTH, GRAM = 100, 32
GRAMS = LENGTH - GRAM + 1

#: Bytes by which multikey quicksort sorts before blind tries take over; contexts sorted in one block.
SHALLOW, PART = 24, 2000

#: Strings, and bytes of contexts, that a task sorts at once.
AT_ONCE, BYTES = 200_000, 4_000_000

#: Stands for a null doc_id: the least long.
NO_ID = -(2**63)

#: Of the documents one in SAMPLED tells which anchors are hot: those of more than one in HOT rows, found
#: HOT_COUNT times and more there. Rows of a hot context are dealt to SALTS tasks.
SAMPLED, HOT, HOT_COUNT, SALTS = 64, 1000, 8, 1024

_random = np.random.default_rng(10)
_LETTERS = _random.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = int(_random.integers(0, 2**62)) * 2 + 1
_INDEX_BITS = 20
_PIECE = (1 << _INDEX_BITS) - LENGTH
_powers: dict[str, np.ndarray] = {}


def _power(name: str) -> np.ndarray:
    if name not in _powers:
        step = np.full((1 << _INDEX_BITS) + 1, _BASE if name == "up" else pow(_BASE, -1, 2**64), np.uint64)
        step[0] = 1
        _powers[name] = np.multiply.accumulate(step)
    return _powers[name]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA24BAED4963EE407)
    return h ^ (h >> np.uint64(32))


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, context hash, position, first string, last string) of a text's anchors.

    Strings (by start) first..last have the anchor; together all strings of the text have one each.
    """
    parts = [_anchors(np.frombuffer(data, np.uint8, min(len(data) - at, _PIECE + LENGTH - 1), at), at) for at in range(0, len(data) - LENGTH + 1, _PIECE)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 3


def _anchors(data: np.ndarray, offset: int):
    n, inverse = len(data), _power("down")
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_LETTERS[data] * _power("up")[:n], out=sums[1:])
    h = _mix((sums[GRAM:] - sums[:-GRAM]) * inverse[: n - GRAM + 1])
    # Least hash, leftmost, of every GRAMS grams: high bits of the hash over the index.
    low = np.uint64((1 << _INDEX_BITS) - 1)
    least, width = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1
    while width * 2 <= GRAMS:
        least, width = np.minimum(least[:-width], least[width:]), width * 2
    least = np.minimum(least[: len(h) - GRAMS + 1], least[GRAMS - width :])
    at = (least & low).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    last = np.concatenate([first[1:], [len(at)]]) - 1
    at = at[first]
    shape = (at - first).astype(np.uint64) * np.uint64(256) + (last - first).astype(np.uint64)
    context = _mix((sums[last + LENGTH] - sums[first]) * inverse[first] + _mix(shape + np.uint64(1)))
    return h[at], context, at + offset, first + offset, last + offset


def packed(at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Position, strings before the position and after the first, in one number."""
    return (at << 14) | ((at - first) << 7) | (last - first)


def unpacked(place: int) -> tuple[int, int]:
    """(first, last)."""
    first = (place >> 14) - (place >> 7 & 127)
    return first, first + (place & 127)


def anchor_rows(docs: DataFrame) -> DataFrame:
    """(doc, t, text) -> (h, c, doc, t, place); t is the hash of a text, which tells those of one id apart."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for doc, t, text in zip(b["doc"], b["t"], b["text"], strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                if len(data) >= LENGTH:
                    h, c, at, first, last = anchors(data)
                    found.append((h.view(np.int64), c.view(np.int64), np.full(len(h), doc), np.full(len(h), t), packed(at, first, last)))
                if len(found) >= 500:
                    yield frame(found)
                    found = []
            yield frame(found)

    def frame(found: list) -> pd.DataFrame:
        cols = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.empty(0, np.int64)] * 5
        return pd.DataFrame(dict(zip(("h", "c", "doc", "t", "place"), cols, strict=True)))

    return docs.mapInPandas(emit, "h long, c long, doc long, t long, place long")


def blind_trie(strings: list[bytes], members: list[int]) -> list[list[int]]:
    """Members by equal string, in the strings' order. Inner nodes know only the depth and the
    bytes at which their strings part; a string is compared in full with one leaf's alone."""
    root: list = [-1, strings[0], [members[0]]]  # leaf: [-1, string, members]; inner: [depth, kids, a leaf]
    for s, member in zip(strings[1:], members[1:], strict=True):
        node = root
        while node[0] >= 0:
            node = node[1].get(s[node[0]]) or node[2]
        if s == node[1]:
            node[2].append(member)
            continue
        depth = _common(s, node[1])
        leaf, above, node = [-1, s, [member]], None, root
        while 0 <= node[0] < depth:
            above, node = node, node[1][s[node[0]]]
        if node[0] == depth:
            node[1][s[depth]] = leaf
            continue
        other = node if node[0] < 0 else node[2]
        inner = [depth, {other[1][depth]: node, s[depth]: leaf}, other]
        if above is None:
            root = inner
        else:
            above[1][s[above[0]]] = inner
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node[0] < 0:
            out.append(node[2])
        else:
            stack += [node[1][k] for k in sorted(node[1], reverse=True)]
    return out


def _common(a: bytes, b: bytes) -> int:
    return len(a) - ((int.from_bytes(a) ^ int.from_bytes(b)).bit_length() + 7) // 8


def multikey_ties(data: bytes, starts: np.ndarray, depth: int = SHALLOW) -> list[np.ndarray]:
    """Groups of two and more indices of ``starts`` whose strings agree in their first ``depth`` bytes.

    Multikey quicksort by eight bytes at a time: in each round every segment is parted by its pivot into
    smaller, equal and greater strings, all segments at once; equal ones go on with their next bytes.
    Segments of one string are left, so that strings told apart from all others are sorted no further."""
    words = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), 8)
    index, at = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    begin = np.zeros(1, np.int64)  # of segments
    tied: list[np.ndarray] = []
    while len(index):
        size = np.diff(np.append(begin, len(index)))
        segment = np.repeat(np.arange(len(begin)), size)
        key = words[starts[index] + at].view(">u8").ravel().astype(np.uint64)
        pivot = key[begin + size // 2][segment]
        side = (key >= pivot).astype(np.int64) + (key > pivot)
        # Where strings go: behind those of smaller sides of their segment, and earlier ones of their own.
        part = segment * 3 + side
        count = np.bincount(part, minlength=3 * len(begin))
        order = np.argsort(part, kind="stable")
        index, at = index[order], at[order] + 8 * (side[order] == 1)
        begin = np.cumsum(count) - count
        ends, begin = (begin + count)[count > 1], begin[count > 1]
        # Equal to a depth: ties. Other segments of two and more go on.
        done = at[begin] >= depth
        tied += [index[i:j] for i, j in zip(begin[done].tolist(), ends[done].tolist(), strict=True)]
        begin, size = begin[~done], (ends - begin)[~done]
        kept = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        index, at, begin = index[kept], at[kept], np.cumsum(size) - size
    return tied


def equal_strings(data: bytes, starts: np.ndarray) -> list[list[int]]:
    """Groups of two and more indices of ``starts`` at which equal strings of LENGTH bytes begin, by
    deep-shallow sorting: multikey quicksort, and blind tries for what is still tied."""
    if not len(starts):
        return []
    out = []
    for group in multikey_ties(data, starts):
        strings = [data[i : i + LENGTH] for i in starts[group].tolist()]
        out += [x for x in blind_trie(strings, group.tolist()) if len(x) > 1]
    return out


def repeated(rows: list[tuple[int, int, int, bytes]], hand_on: bool) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, bytes]]]:
    """(doc, t, place, context) -> (doc, t, start) of strings that also start earlier, and if hand_on
    the others as (doc, t, place, string)."""
    docs, texts, places, starts, at = [], [], [], [], 0
    for doc, t, place, context in rows:
        first, last = unpacked(place)
        n = last - first + 1
        docs += [doc] * n
        texts += [t] * n
        places += range(first, first + n)
        starts += range(at, at + n)
        at += len(context)
    data, out, gone = b"".join(r[3] for r in rows), [], set()
    for group in equal_strings(data, np.array(starts, np.int64)):
        of = {i: (docs[i], texts[i], places[i]) for i in group}
        first = min(of.values())
        again = [i for i in group if of[i] != first]
        # Equal rows may stand in different blocks: the earliest is handed on once.
        gone.update(again, [i for i in group if of[i] == first][1:])
        out += [of[i] for i in again]
    left = [(docs[i], texts[i], places[i] << 14, data[starts[i] : starts[i] + LENGTH]) for i in range(len(docs)) if i not in gone] if hand_on else []
    return out, left


CONTEXTS = "h long, n long, doc long, t long, place long, context binary"


def sorted_units(contexts: DataFrame, hand_on: bool) -> DataFrame:
    """(unit, h, n, doc, t, place, context) -> (doc, t, start, end) of repeated bytes, and if hand_on
    also rows (h, n, doc, t, place, context) of the strings that are left, a context each."""

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        strings = size = 0

        def done(rows: list[tuple]) -> Iterator[pd.DataFrame]:
            runs: list[list[int]] = []
            if hand_on:  # unit by unit, as what is left belongs to one
                found = []
                for _, unit in groupby(rows, lambda r: r[0]):
                    unit = list(unit)
                    again, others = repeated([r[3:] for r in unit], True)
                    found += again
                    left = [(*unit[0][1:3], *x) for x in others]
                    for i in range(0, len(left), AT_ONCE // 20):
                        yield pd.DataFrame(left[i : i + AT_ONCE // 20], columns=["h", "n", "doc", "t", "place", "context"]).assign(start=None, end=None)
            else:
                found, _ = repeated([r[3:] for r in rows], False)
            for doc, t, start in sorted(found):
                if runs and runs[-1][:2] == [doc, t] and runs[-1][3] >= start:
                    runs[-1][3] = start + LENGTH
                else:
                    runs.append([doc, t, start, start + LENGTH])
            marks = pd.DataFrame(runs, columns=["doc", "t", "start", "end"])
            yield marks.assign(h=None, n=None, place=None, context=None) if hand_on else marks

        for b in batches:  # sorted by unit
            for row in b.itertuples(index=False, name=None):
                if (strings >= (AT_ONCE // 4 if hand_on else AT_ONCE) or size >= BYTES) and row[0] != held[-1][0]:
                    yield from done(held)
                    held, strings, size = [], 0, 0
                held.append(row)
                strings += (row[5] & 127) + 1
                size += len(row[6])
        if held:
            yield from done(held)

    ordered = contexts.repartition("unit").sortWithinPartitions("unit").select("unit", "h", "n", "doc", "t", "place", "context")
    return ordered.mapInPandas(sort, ("" if not hand_on else "h long, n long, place long, context binary, ") + "doc long, t long, start long, end long")


def rounds(most: int) -> list[int]:
    """Contexts that a block stands for, by round, where a group has most of them; the last is one block."""
    sizes = [PART]
    while sizes[-1] < most:
        sizes.append(sizes[-1] * PART)
    return sizes


def sorted_rounds(contexts: DataFrame, most: int) -> DataFrame:
    """(h, n, doc, t, place, context), groups of n -> (doc, t, start, end) of repeated bytes."""
    if most <= PART:
        return sorted_units(contexts.withColumn("unit", F.xxhash64("h")), False)
    contexts = written(contexts, "op10-contexts")
    marks = [sorted_units(contexts.filter(F.col("n") <= PART).withColumn("unit", F.xxhash64("h")), False)]
    # Equal rows have equal contexts, which no block would part.
    own, left = F.xxhash64("doc", "t", "place"), contexts.filter(F.col("n") > PART).distinct()
    for k, size in enumerate(rounds(most)):
        # From the second round on, rows are strings, up to GRAMS and more of a context, and dealt by what they are.
        parts = F.ceil(F.col("n") * (GRAMS if k else 1) / PART)
        of = F.pmod(F.xxhash64("context"), parts) if k else F.lit(0)
        block = F.pmod(own, F.ceil(F.col("n") / size))
        last = size >= most
        found = sorted_units(left.withColumn("unit", F.xxhash64("h", of, block)), not last)
        if last:
            marks.append(found)
        else:
            found = written(found, "op10-round")
            marks.append(found.filter("start is not null").select("doc", "t", "start", "end"))
            left = found.filter("start is null").select("h", "n", "doc", "t", "place", "context")
    out = marks[0]
    for m in marks[1:]:
        out = out.unionByName(m)
    return out


def cut_out(texts: DataFrame) -> DataFrame:
    """(doc, t, text, disputed: array of (place, h, n)) -> the contexts."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, t, text, disputed in zip(b["doc"], b["t"], b["text"], b["disputed"], strict=True):
                if disputed is None or not len(disputed):
                    continue
                data = (text or "").encode("utf-8", "surrogatepass")
                for d in disputed:
                    first, last = unpacked(d["place"])
                    rows.append((d["h"], d["n"], doc, t, d["place"], data[first : last + LENGTH]))
            yield pd.DataFrame(rows, columns=["h", "n", "doc", "t", "place", "context"])

    return texts.mapInPandas(cut, CONTEXTS)


def removed(texts: DataFrame) -> DataFrame:
    """(doc, text, runs: array of (start, end)) -> (doc_id, n_bytes, n_removed, n_spans, kept_bytes)."""

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text, runs in zip(b["text"], b["runs"], strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                left, spans, gone, at = [], 0, 0, 0
                to = -1  # the end of the last span
                for start, end in sorted((r["start"], r["end"]) for r in (() if runs is None else runs)):
                    if start > to:
                        left.append(data[at:start])
                        spans += 1
                        gone += end - start
                        at = to = end
                    elif end > to:
                        gone += end - to
                        at = to = end
                left.append(data[at:])
                rows.append((len(data), gone, spans, b"".join(left)))
            yield pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_bytes"]).assign(doc=b["doc"].array)

    left = texts.mapInPandas(remove, "doc long, n_bytes long, n_removed long, n_spans long, kept_bytes binary")
    return left.withColumnsRenamed({"doc": "doc_id"}).withColumn("doc_id", F.nullif(F.col("doc_id"), F.lit(NO_ID)))


def hottest(docs: DataFrame) -> list[int]:
    """The anchors that more than one in HOT of all rows have, as far as a share of the documents tells: few
    more than HOT numbers, by their definition, and no more than twice that. They are only dealt in another
    way; whether an anchor is among them changes no result."""
    docs = docs.select("doc", F.xxhash64("text").alias("t"), "text")
    sampled = docs.filter(F.pmod(F.xxhash64("doc", "t", F.lit(10)), F.lit(SAMPLED)) == 0)
    rows = (sampled.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / GRAMS * 2  # about: two anchors in GRAMS bytes
    counts = anchor_rows(sampled).groupBy("h").count().filter(F.col("count") >= max(HOT_COUNT, rows / HOT))
    return [r["h"] for r in counts.orderBy(F.desc("count"), "h").limit(2 * HOT).collect()]


def found_twice(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Anchors whose context has come before (doc, t, place), and those of different contexts of one anchor
    (doc, t, place, h, n), n of them."""
    hot = hottest(docs)
    rows = anchor_rows(docs).withColumn("hot", F.col("h").isin(hot) if hot else F.lit(False))
    # All rows of an anchor meet, but those of a hot one: there equal contexts do, and dealt by their text.
    spread = F.when(F.col("hot"), F.xxhash64("c", F.pmod(F.xxhash64("doc", "t"), F.lit(SALTS)))).otherwise(F.lit(0).cast("long"))
    by_anchor = Window.partitionBy("h", spread).orderBy("c", "doc", "t", "place")
    whole = by_anchor.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = lambda name: F.coalesce(F.lag(name).over(by_anchor) == F.col(name), F.lit(False))
    found = rows.select(
        "doc", "t", "place", "h", "c", "hot",
        F.count("*").over(whole).alias("n"),
        before("c").alias("again"),
        (before("c") & before("doc") & before("t") & before("place")).alias("same"),
        (F.first("c").over(whole) != F.last("c").over(whole)).alias("differ"),
    )
    # Equal rows have equal places; the first of them stands for all, as marks meet texts by id and hash.
    found = written(found.filter("not same and (again or differ or hot)").drop("same"), "op10-anchors")
    # Of a hot context at most SALTS rows are left that none of their own salt came before.
    firsts = found.filter("hot and not again")
    firsts = firsts.withColumn("again", F.row_number().over(Window.partitionBy("h", "c").orderBy("doc", "t", "place")) > 1)
    firsts = firsts.select("doc", "t", "place", "h", "again")
    firsts = written(firsts, "op10-firsts") if hot else firsts
    several = F.broadcast(firsts.filter("not again").groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"))  # a row for each of the hot ones at most
    again = found.filter("again").select("doc", "t", "place").unionByName(firsts.filter("again").select("doc", "t", "place"))
    differing = found.filter("not hot and not again").select("doc", "t", "place", "h", "n").unionByName(firsts.filter("not again").join(several, "h").select("doc", "t", "place", "h", "n"))
    return again, differing


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_bytes, n_removed, n_spans, kept_bytes)."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("t"), "text")
    again, differing = found_twice(docs)
    first = F.shiftright("place", 14) - F.shiftright("place", 7).bitwiseAND(127)
    resolved = again.select("doc", "t", first.alias("start"), (first + F.col("place").bitwiseAND(127) + LENGTH).alias("end"))
    disputed = differing.groupBy("doc", "t").agg(F.collect_list(F.struct("place", "h", "n")).alias("disputed"))
    # Both joins need the texts by id and hash, each its own marks alone; as both are left joins of the same
    # columns, Spark shuffles the texts once.
    sought = docs.join(disputed, ["doc", "t"], "left").select("doc", "t", "text", "disputed")
    most = differing.agg(F.max("n")).first()[0] or 0
    marked = resolved.unionByName(sorted_rounds(cut_out(sought), most))
    runs = marked.groupBy("doc", "t").agg(F.collect_list(F.struct("start", "end")).alias("runs"))
    final = docs.join(runs, ["doc", "t"], "left").select("doc", "text", "runs")
    return removed(final)


def op10_deep_shallow_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))
