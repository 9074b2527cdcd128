"""License scans: an exact set-similarity join of text blocks with license templates, in DataFrame functions only.

A template of n words meets a text block by block: 2n consecutive words from each multiple of n on, so that any
run of n words lies whole within a block. A block fits a template if it holds ``PERCENT`` of the template's
distinct words (containment). Every such block is found without comparing each block with each template:

1. Tokens have one global order, by how often all documents hold them, rare ones first (ties by code point).
   Tokens that no template has can be in no intersection; they are left out of the order.
2. Prefix filter: a template of t tokens of which ``need`` must be found shares one of its first
   ``t - need + 1`` tokens with every block that fits. Only words that are such a token lead to blocks, by an
   equi-join with the templates' prefixes.
3. Length filter: blocks of fewer words than ``need`` (at a text's end) are dropped before they are cut out.
4. Positional filter: the shared token's places in the two ordered token lists bound the intersection:
   what can stand before it in both, itself, and what can stand behind it in both.
5. The tokens of blocks that are left are intersected with the template's.

Long texts are cut into pieces of ``PIECE`` words, each with as many words around it as a block can reach, so
that a row that is exploded is of bounded size; no words are left out. Templates, their tokens' counts and prefixes
are a few hundred rows, by the template list, whatever the size of the documents.

Base phrases are places where a phrase's words stand consecutively. The score is the greatest containment found,
where a base phrase counts as a template that is found whole; 0 without any.

Defined cases: null and empty texts have no words, no labels and the score 0; first and last word are null without a
base phrase; rows are documents each for itself, and rows of equal id and text have equal results; a null doc_id
is an id like others; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import re
import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procure_spark.llm.common import table, written

PERCENT, PIECE = 90, 2048

#: What parts words: ASCII characters other than digits and lower-case letters (Java regex).
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

# Phrases and the labels that they stand for.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Notices of well-known licenses and the labels of those.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mit", "Released under the MIT License"),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]


def words(text: Column) -> Column:
    """A text's words, A-Z lower-cased."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(low, BETWEEN), lambda w: w != "")


def template_words(text: str) -> list[str]:
    return re.findall("[0-9a-z\\u0080-\\U0010ffff]+", text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))


def token_order(texts: DataFrame, tokens: Sequence[str]) -> list[str]:
    """The templates' tokens, those that the documents hold least often first."""
    found = texts.select(F.explode("words").alias("token")).filter(F.col("token").isin(list(tokens))).groupBy("token").count()
    counts = {r["token"]: r["count"] for r in found.collect()}  # of template tokens alone
    return sorted(tokens, key=lambda t: (counts.get(t, 0), t))


def prefix_index(spark: SparkSession, templates: Sequence[tuple[str, str]], order: Sequence[str], percent: int) -> DataFrame:
    """(token, at, label, n, need, tokens): each template under the tokens of its prefix, ``at`` from 1."""
    place, rows = {t: i for i, t in enumerate(order)}, []
    for label, text in templates:
        own = template_words(text)
        tokens = sorted(set(own), key=place.__getitem__)
        need = -(-percent * len(tokens) // 100)
        rows += [(tokens[i], i + 1, label, len(own), need, tokens) for i in range(len(tokens) - need + 1)]
    return spark.createDataFrame(rows, "token string, at int, label string, n int, need int, tokens array<string>")


def matches(texts: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, percent: int = PERCENT, piece: int = PIECE) -> DataFrame:
    """(doc_id, t, words) -> (doc_id, t, label, block, at_word, containment): every block that fits a template."""
    tokens = {w for _, text in templates for w in template_words(text)}
    order = token_order(texts, sorted(tokens))
    index = prefix_index(texts.sparkSession, templates, order, percent)
    reach = 2 * max(len(template_words(text)) for _, text in templates)
    prefixes = [r["token"] for r in index.select("token").distinct().collect()]
    # Pieces: words from ``first`` on, of which those at ``from`` to ``to`` are the piece's own.
    n = F.size("words")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(piece)), lambda a: F.struct(
        a.alias("from"), F.greatest(a - reach, F.lit(0)).alias("first"),
        F.slice("words", F.greatest(a - reach, F.lit(0)) + 1, F.least(a, F.lit(reach)) + piece + reach).alias("ws"),
    ))
    pieces = texts.select("doc_id", "t", n.alias("total"), F.explode(cut).alias("p")).select("doc_id", "t", "total", "p.*")
    at = F.transform("ws", lambda w, i: F.when(w.isin(prefixes), F.struct((i + F.col("first")).alias("pos"), w.alias("token"))))
    own = F.filter(at, lambda h: h.isNotNull() & (h["pos"] >= F.col("from")) & (h["pos"] < F.col("from") + piece))
    hits = pieces.withColumn("hits", own).filter(F.size("hits") > 0)
    hits = hits.select("doc_id", "t", "total", "first", "ws", F.explode("hits").alias("h")).select("doc_id", "t", "total", "first", "ws", "h.pos", "h.token")
    found = hits.join(F.broadcast(index), "token")  # rows by the template list alone
    k = F.floor(F.col("pos") / F.col("n")).cast("int")
    found = found.withColumn("block", F.explode(F.when(k > 0, F.array(k - 1, k)).otherwise(F.array(k))))
    start = F.col("block") * F.col("n")
    found = found.filter(F.least(2 * F.col("n"), F.col("total") - start) >= F.col("need"))
    held = F.array_intersect(F.array(*[F.lit(t) for t in order]), F.slice("ws", start - F.col("first") + 1, 2 * F.col("n")))
    found = found.select("doc_id", "t", "label", "block", start.alias("at_word"), "token", "at", "need", "tokens", held.alias("held"))
    j = F.array_position("held", F.col("token"))
    most = F.least(F.col("at"), j) + F.least(F.size("tokens") - F.col("at"), F.size("held") - j)
    found = found.filter(most >= F.col("need")).withColumn("both", F.size(F.array_intersect("tokens", "held"))).filter(F.col("both") >= F.col("need"))
    return found.select("doc_id", "t", "label", "block", "at_word", (F.col("both") / F.size("tokens")).alias("containment"))


def phrase_places(phrase: str) -> Column:
    """Words at which a phrase starts; single words are looked at only where the words hold it at all."""
    parts = phrase.split(" ")
    held = F.contains(F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")), F.lit(f" {phrase} "))

    def here(i: Column) -> Column:
        same = F.get("words", i) == parts[0]
        for k, w in enumerate(parts[1:], 1):
            same = same & (F.get("words", i + k) == w)
        return same

    return F.when(held, F.filter(F.sequence(F.lit(0), F.size("words") - 1), here)).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, percent: int = PERCENT, piece: int = PIECE) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)."""
    texts = docs.select("doc_id", F.xxhash64("text").alias("t"), words(F.col("text")).alias("words"))
    found = matches(texts, templates, percent, piece).groupBy("doc_id", "t").agg(F.collect_set("label").alias("own"), F.max("containment").alias("containment"))
    found = written(found.select(F.col("doc_id").alias("__id"), F.col("t").alias("__t"), "own", "containment"), "op13-found")
    places = {label: f"__{i}" for i, label in enumerate(PHRASES.values())}
    base = texts.withColumns({f"__{i}": phrase_places(p) for i, p in enumerate(PHRASES)})
    every = F.concat(*places.values())
    labels = F.array_compact(F.array(*[F.when(F.size(c) > 0, F.lit(label)) for label, c in sorted(places.items())]))
    base = base.select(
        "doc_id", "t", F.size("words").cast("long").alias("n_words"), F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"), labels.alias("of_base"),
    )
    rows = base.join(found, base["doc_id"].eqNullSafe(F.col("__id")) & (base["t"] == F.col("__t")), "left")
    both = F.array_sort(F.array_distinct(F.concat("of_base", F.coalesce("own", F.array().cast("array<string>")))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0)))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("of_base", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), score.alias("score"))


def op13_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _sql() -> str:
    places = [f"list_filter(range(len(w)), lambda i: {' AND '.join(f'w[i + {k + 1}] = {w!r}' for k, w in enumerate(p.split(' ')))})" for p in PHRASES]
    templates = ", ".join(f"({label!r}, {template_words(text)!r})" for label, text in TEMPLATES)
    labels = ", ".join(f"CASE WHEN len(p[{i}]) > 0 THEN {label!r} END" for label, i in sorted((label, i) for i, label in enumerate(PHRASES.values(), 1)))
    return f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
base AS (SELECT r, doc_id, len(w) AS n_words, [{', '.join(places)}] AS p FROM texts),
templates AS (SELECT label, words AS ws, len(words) AS n, list_distinct(words) AS tokens FROM (VALUES {templates}) AS v(label, words)),
blocks AS (SELECT r, label, tokens, w[k * n + 1 : k * n + 2 * n] AS b FROM texts, templates, unnest(range((len(w) + n - 1) // n)) AS u(k)),
fits AS (SELECT r, label, len(list_intersect(tokens, b)) AS hit, len(tokens) AS size FROM blocks),
own AS (SELECT r, list_distinct(list(label)) AS own, max(hit / size) AS containment FROM fits WHERE 100 * hit >= {PERCENT} * size GROUP BY r)
SELECT doc_id, n_words::BIGINT AS n_words, len(flatten(p))::BIGINT AS n_base, list_min(flatten(p))::BIGINT AS first_word, list_max(flatten(p))::BIGINT AS last_word,
 array_to_string(list_filter([{labels}], lambda x: x IS NOT NULL), ',') AS base_labels,
 array_to_string(list_sort(list_distinct(list_concat(list_filter([{labels}], lambda x: x IS NOT NULL), coalesce(own, [])))), ',') AS labels,
 CASE WHEN len(flatten(p)) > 0 THEN 1.0::DOUBLE ELSE coalesce(containment, 0)::DOUBLE END AS score
FROM base LEFT JOIN own USING (r)"""


SQL = _sql()
