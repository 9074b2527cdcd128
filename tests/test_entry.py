"""The driver's contract, and every query with SQL against DuckDB on the smallest tables."""

import importlib
import math
import os
import sys

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(SF):
        pytest.skip("the driver's tables are not here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle(spark, db, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    answer = db.execute(entry.oracle_sql()[name])
    names = [x[0] for x in answer.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert got == sorted(repr([plain(r[i]) for i in order]) for r in answer.fetchall())


def test_entry_runs(spark):
    if not os.path.isdir(SF):
        pytest.skip("the driver's tables are not here")
    assert entry.entry(spark).count() > 0


def test_without_the_corpus_folder(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("procure_spark.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "procure_spark.llm", None)
    fresh = importlib.reload(entry)
    assert not any(n.startswith("op") or n == "pipeline" for n in fresh.queries())
    monkeypatch.undo()
    importlib.reload(entry)
