"""Structure repair against exhaustive search and SQL's dynamic programming."""

import hashlib
import random
import zlib

import duckdb
from pyspark.sql import functions as F

from procure_spark.llm import op11_repair as R

SCHEMA = "conv_id long, turn long, role string, text string"


def exhaustive(turns):
    """The least (cost, edits) over all states, by the edits themselves, a turn at a time."""
    best = {0: (0, "")}

    def inserted(states):
        for _ in range(2):
            for q, (cost, edits) in list(states.items()):
                for r in "ua":
                    if r in R.NEXT[q]:
                        to, new = R.NEXT[q][r], (cost + 5, edits + "I")
                        states[to] = min(states.get(to, (10**9, "")), new)
        return states

    for t in turns:
        after = {}
        for q, (cost, edits) in inserted(dict(best)).items():
            options = [(q, cost + 2, "D")]
            if t != "x":
                own, more = " sua"[int(t) % 4], 5 * (int(t) >= 4)
                if own in R.NEXT[q]:
                    options.append((R.NEXT[q][own], cost + more, "K"))
                options += [(R.NEXT[q][r], cost + 1 + more, "R") for r in "ua" if r in R.NEXT[q]]
            for to, c, e in options:
                after[to] = min(after.get(to, (10**9, "")), (c, edits + e))
        best = after
    return min(v for q, v in inserted(dict(best)).items() if q in (0, 3))


def test_search_equals_exhaustive_search():
    rng = random.Random(1)
    for n in list(range(8)) * 40 + [20, 40, 90, 200]:
        turns = "".join(rng.choice("0123123567x") for _ in range(n))
        cost, edits = R.best_repair(turns)
        assert (cost, "".join(e for e, _ in edits)) == exhaustive(turns), turns


def test_stretches_change_no_result():
    rng = random.Random(2)
    for _ in range(60):
        turns = "".join(rng.choice("12323567x") for _ in range(rng.randrange(30)))
        assert R.best_repair(turns, 4) == R.best_repair(turns, 100)
    long = "".join(rng.choice("2323232367x1") for _ in range(3000))
    cost, edits = R.best_repair(long)
    assert sum(e != "I" for e, _ in edits) == len(long) and cost > 0


def rows(rng):
    out = []
    for c in range(60):
        for t in range(rng.randrange(9)):
            out.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", "assistant", "system", "tool", "", None]), rng.choice(["Yes.", "no", "", None, " \n", "What? ", "Well!"])))
    return out + [(None, 0, "user", "Hi."), (None, None, "assistant", "Hi."), (77, 3, "user", "a."), (77, 3, "assistant", "b."), (77, 3, "user", "a.")]


def test_query_equals_sql(spark, tmp_path):
    table = rows(random.Random(3))
    spark.createDataFrame(table, SCHEMA).withColumn("cost", F.lit("clash")).coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    got = R.op11_structure_repair(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    answer = con.execute(R.SQL)
    names = [x[0] for x in answer.description]
    assert names == got.columns
    found = sorted(map(tuple, got.collect()), key=str)
    assert found == sorted(answer.fetchall(), key=str) and len(found) == len({r[0] for r in table})


def test_damage_and_defined_cases(spark):
    kinds = {}
    for turn in range(400):
        kinds.setdefault(zlib.crc32(f"5:{turn}".encode()) % 20, turn)
    dropped, emptied, kept = kinds[0], kinds[1], kinds[9]
    got = {r["conv_id"]: r for r in R.repair_conversations(spark.createDataFrame([(5, dropped, "user", "Hi.")], SCHEMA)).collect()}
    assert tuple(got[5])[1:8] == (0, 0, 0, 0, 0, 0, "") and got[5]["repaired"] == []
    row = R.repair_conversations(spark.createDataFrame([(5, emptied, "user", "Hi."), (5, kept, "assistant", "Ok.")], SCHEMA)).first()
    assert row["blank"] == 1 and row["gaps"] == abs(kept - emptied) + 1 - 2
    plain = R.repair_conversations(spark.createDataFrame([(1, 0, "user", "Hi."), (1, 2, "assistant", "Ok"), (1, 3, "user", "Hi."), (1, 4, "user", "So?"), (1, 5, "assistant", "Fine.")], SCHEMA), damage=False).first()
    assert tuple(plain)[1:8] == (1, 0, 1, 1, 1, 6, "DDDKK") and plain["repaired"] == ["user:So?", "assistant:Fine."]
    assert R.repair_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
    long = R.repair_conversations(spark.createDataFrame([(1, 0, "user", "long " * 200_000 + "."), (1, 1, "assistant", "x.")], SCHEMA), damage=False).first()
    assert long["audit"] == "KK" and len(long["repaired"][0]) == 1_000_006


def test_digest_of_no_rows(spark, tmp_path):
    kinds = {zlib.crc32(f"8:{t}".encode()) % 20: t for t in range(400)}
    spark.createDataFrame([(8, kinds[0], "user", "Hi.")], SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    assert R.op11_structure_repair(spark, str(tmp_path)).first()["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
