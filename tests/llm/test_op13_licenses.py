"""License scans against brute force over every block."""

import random
import re

from pyspark.sql import functions as F

from procure_spark.llm import op13_licenses as L

SCHEMA = "doc_id long, text string"


def brute(text, templates=L.TEMPLATES, percent=L.PERCENT):
    ws = re.findall("[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = {label: [i for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()] for p, label in L.PHRASES.items()}
    own, most = set(), 0.0
    for label, template in templates:
        tw = L.template_words(template)
        n, tokens = len(tw), set(tw)
        for at in range(0, len(ws), n):
            share = len(tokens & set(ws[at : at + 2 * n])) / len(tokens)
            if 100 * len(tokens & set(ws[at : at + 2 * n])) >= percent * len(tokens):
                own.add(label)
                most = max(most, share)
    base, every = {b for b, x in places.items() if x}, sorted(i for x in places.values() for i in x)
    return (len(ws), len(every), every[0] if every else None, every[-1] if every else None, ",".join(sorted(base)), ",".join(sorted(base | own)), round(1.0 if base else most, 9))


def make(rng):
    filler = lambda n: " ".join(rng.choice(["the", "of", "license", "software", "é́t", "under", "any", "x1", "GNU", "Apache", "by", "cc"]) for _ in range(n))
    rows = []
    for i in range(120):
        label, text = rng.choice(L.TEMPLATES)
        ws = text.split(" ")
        hurt = " ".join(w for w in ws if rng.random() > rng.choice([0, 0, 0.05, 0.1, 0.2]))
        rows.append((i, rng.choice([f"{filler(rng.randrange(60))}\n{hurt}\n{filler(rng.randrange(60))}", filler(40), hurt.upper(), f"{hurt}.{hurt}"])))
    return rows + [(200, None), (201, ""), (202, "..."), (203, "CC-BY cc by CC BY"), (None, "MIT License"), (1, "gnu general public license"), (1, "gnu general public license"), (204, "mit  license x mit-license")]


def results(df):
    return sorted(((r["doc_id"], *tuple(r)[1:7], round(r["score"], 9)) for r in df.collect()), key=str)


def test_scan_equals_brute_force(spark):
    rows = make(random.Random(1))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("labels", F.lit("clash")).repartition(3)
    wanted = sorted(((i, *brute(t)) for i, t in rows), key=str)
    assert results(L.scan(df)) == wanted
    assert sum(r[6] != r[5] for r in wanted) > 20
    for percent in (60, 100):
        assert results(L.scan(df, percent=percent)) == sorted(((i, *brute(t, percent=percent)) for i, t in rows), key=str)


def test_pieces_leave_no_word_out(spark):
    rng = random.Random(2)
    rows = make(rng)
    rows.append((300, " ".join(t or "" for _, t in rows) * 3))
    df = spark.createDataFrame(rows, SCHEMA)
    assert results(L.scan(df, piece=7)) == results(L.scan(df)) == sorted(((i, *brute(t)) for i, t in rows), key=str)


def test_query_and_defined_cases(spark, tmp_path):
    spark.createDataFrame([(1, "Released under the MIT License. " + "word " * 300_000 + L.TEMPLATES[2][1]), (2, None)], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in L.op13_license_join(spark, str(tmp_path)).collect()}
    assert got[1]["labels"] == "bsd,mit" and got[1]["n_words"] > 300_000 and tuple(got[2])[1:] == (0, 0, None, None, "", "", 0.0)
    assert L.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rare_tokens_come_first(spark):
    texts = spark.createDataFrame([(1, "the the license gnu of of of")], SCHEMA).select(L.words(F.col("text")).alias("words"))
    assert L.token_order(texts, ["gnu", "license", "of", "the", "zeta"]) == ["zeta", "gnu", "license", "the", "of"]
    prefix = L.prefix_index(spark, [("x", "the gnu license of the")], ["gnu", "license", "the", "of"], 75).collect()
    assert [(r["token"], r["at"], r["need"], r["n"]) for r in prefix] == [("gnu", 1, 3, 5), ("license", 2, 3, 5)]
