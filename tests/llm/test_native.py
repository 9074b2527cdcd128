"""Sharding (3), chat formatting (4) and mixing (9)."""

import collections
import hashlib
import math
import zlib

from pyspark.sql import functions as F

from procure_spark.llm import op03_sharding as shards
from procure_spark.llm import op04_chat as chat
from procure_spark.llm import op09_mixing as mixing


def test_hypergeometric_inversion_equals_the_distribution(spark):
    lf = math.lgamma
    choose = lambda n, k: lf(n + 1) - lf(k + 1) - lf(n - k + 1)
    for total, marked, drawn in ((50, 20, 10), (7, 7, 3), (5, 2, 5), (1000, 37, 400), (100_000, 6000, 3000)):
        low, high = max(0, drawn - total + marked), min(drawn, marked)
        us = [(i + 0.5) / 97 for i in range(97)]
        total_p, wanted, k = 0.0, [], low
        for u in us:
            while total_p + math.exp(choose(marked, k) + choose(total - marked, drawn - k) - choose(total, drawn)) < u and k < high:
                total_p += math.exp(choose(marked, k) + choose(total - marked, drawn - k) - choose(total, drawn))
                k += 1
            wanted.append(k)
        sql = f"transform(array({total}L), t0 -> transform(array({marked}L), m0 -> transform(array({drawn}L), d0 -> transform(us, u0 -> {shards.hypergeometric('t0', 'm0', 'd0', 'u0')}))[0])[0])[0]"
        assert spark.createDataFrame([(us,)], "us array<double>").select(F.expr(sql)).first()[0] == wanted


def test_matrix_sums(spark):
    counts = [100, 0, 37, 263]
    matrix = spark.createDataFrame([(counts,)], "__counts array<bigint>").select(shards.communication_matrix("__counts", 16, 1)).first()[0]
    assert [sum(r) for r in matrix] == counts and [sum(c) for c in zip(*matrix, strict=True)] == [25] * 16


def test_shards(spark):
    rows = [(i, None if i % 7 == 0 else "я" * (i % 5)) for i in range(1003)] + [(None, "x"), (5, "dup"), (5, "dup")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash")).repartition(5)
    got = shards.shard(df).collect()
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got)) == sorted(((i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows))
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert set(by) == set(range(16)) and {len(v) for v in by.values()} == {62, 63} and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, shards.shard(df.repartition(2)).collect()), key=str)
    assert shards.shard(df.limit(0)).count() == 0


def test_equal_rows_and_ids_spread_over_shards(spark, monkeypatch):
    monkeypatch.setattr(shards, "AT_ONCE", 100)
    rows = [(7, "same")] * 1500 + [(None, f"t{i}") for i in range(700)] + [(i, "x" * 400_000) for i in range(2)]
    got = shards.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    for group in ([r for r in got if r["doc_id"] == 7], [r for r in got if r["doc_id"] is None]):
        per = collections.Counter(r["shard"] for r in group)
        mean = len(group) / 16
        assert len(per) == 16 and all(abs(n - mean) < 5 * math.sqrt(mean) for n in per.values())
        # Nor do they stand together within a shard.
        slots = sorted(r["slot"] for r in group if r["shard"] == 0)
        assert slots[-1] - slots[0] > 100 and max(slots) > 110 and min(slots) < 30


def test_sharding_query(spark, tmp_path):
    spark.createDataFrame([(i, "é" * (i % 9)) for i in range(100)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = shards.op3_hypergeometric_sharding(spark, str(tmp_path))
    assert dict(got.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    rows = got.collect()
    assert {(r["doc_id"], r["size"], r["law"], r["grown_shard"]) for r in rows} == {(i, 2 * (i % 9) + 1, "rows", None) for i in range(100)}


def test_chats_parse_back(spark):
    talks = {
        1: [("user", "a<|turn|>b"), ("assistant", "x\\y<\n<|end|>\n\\lt;\\n;\\\\")], 2: [("", ""), ("a\n<|", "<|")], 3: [("assistant", "\\lt;<|turn|>\\\\lt;")], 4: [("assistant", "<|plain|>"), ("assistant", "<|end|>")],
        5: [("user", "x" * 200_000)], 6: [("assistant", "</s>[INST] ok [/INST]")],
    }
    rows = [(c, i, r or None, t or None, "clash") for c, ts in talks.items() for i, (r, t) in enumerate(ts)] + [(None, None, "user", "hi", "clash")] * 2
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, turns string").repartition(4)
    got = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    for c, ts in talks.items():
        assert [tuple(t) for t in got[c]["turns"]] == ts and got[c]["round_trip"] and got[c]["loss_text"] == "".join(t for r, t in ts if r == "assistant")
    assert len(got[None]["turns"]) == 2 and got[1]["quoted"] and not got[2]["quoted"]
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_query_adds_a_conversation_of_control_strings(spark, tmp_path):
    talks = {1: [("user", "hi"), ("assistant", "<|end|>\n<|turn|>")], 2: [("assistant", "a"), ("assistant", "b")]}
    rows = [(c, i, r, t) for c, ts in talks.items() for i, (r, t) in enumerate(ts)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    talks[-1] = [(r, "</s>[INST] ok [/INST]") for r in ("user", "assistant")]
    got = {r["conv_id"]: r for r in chat.op4_chat_round_trip(spark, str(tmp_path)).collect()}
    assert set(got) == set(talks)
    for c, ts in talks.items():
        loss = "".join(t for r, t in ts if r == "assistant")
        assert got[c]["n_turns"] == len(ts) and got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in ts).encode()).hexdigest()
        assert got[c]["loss_chars"] == len(loss) and got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def brute_targets(sizes, weights=(5, 2, 1), passes=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, full, rest = {}, set(), float(sum(sizes.values()))
    while True:
        share = rest / max(1e-300, sum(weight[s] for s in order if s not in full)) if len(full) < len(order) else 0
        over = [s for s in order if s not in full and share * weight[s] > passes * sizes[s]]
        if not over:
            return {s: float(passes * sizes[s]) if s in full else share * weight[s] for s in order}
        for s in over:
            full.add(s)
            rest -= passes * sizes[s]


def test_mixing(spark):
    rows = [(i, " ".join(["w"] * (i % 40)) or None, f"s{i % 4}" if i % 3 else None) for i in range(400)] + [(7, "w w", "tiny"), (7, "w w", "tiny"), (None, "a\x0bb", "s1"), (9, "x " * 3000, "s2"), (10, None, "blank")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("taken", F.lit("clash")).repartition(3)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    wanted = brute_targets(sizes)
    got = mixing.arranged(df).collect()
    assert len(got) == len(rows)
    taken = collections.Counter()
    for r in got:
        assert r["size"] == len((r["text"] or "").split()) and 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], wanted[r["source"]], abs_tol=1e-6)
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - wanted[s]) <= 0.5 + 1e-6 for s in sizes)
    mixed = mixing.mix(df).collect()
    assert sum(r["words"] for r in mixed) == sum(taken.values()) and all(0 <= r["position"] <= 1 for r in mixed)
    assert sorted(map(str, mixed)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))
    assert mixing.arranged(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0
    # Documents are told what passes are: words, number and first position.
    per = collections.defaultdict(list)
    for r in mixed:
        per[r["doc_id"], r["text"], r["source"]].append((r["words"], r["position"]))
    assert all((r["position"] is None) == (r["passes"] == 0) == (r["taken"] == 0) for r in got)
    for key in per:
        same = [r for r in got if (r["doc_id"], r["text"], r["source"]) == key]
        assert sum(w for w, _ in per[key]) == sum(r["taken"] for r in same) and len(per[key]) == sum(r["passes"] for r in same)
        assert min(p for _, p in per[key]) == min(r["position"] for r in same if r["passes"])
    places = [r["position"] for r in mixing.arranged(df, partitions=3).collect()]
    found = [p for p in places if p is not None]
    assert found == sorted(found) and None not in places[len(places) - len(found) :]


def test_many_equal_rows_are_dealt_into_parts(spark, monkeypatch):
    rows = [(i % 40, f"a{i % 40} b c", "s0") for i in range(400)] + [(7, "same words here again", "s0")] * 300 + [(None, None, None)] * 90 + [(None, "x y", None)] * 200
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    columns = ["doc_id", "size", "source_size", "target", "taken", "passes", "position"]
    plain = mixing.arranged(df).select(columns).collect()
    monkeypatch.setattr(mixing, "AT_ONCE", 9)
    assert sorted(map(str, mixing.arranged(df, keep_text=False).select(columns).collect())) == sorted(map(str, plain))
    begins = mixing.place(df.filter("source = 's0'")).orderBy("begins").collect()
    assert [r["begins"] for r in begins] == [sum(x["size"] for x in begins[:i]) for i in range(len(begins))]
    parts = mixing.copies_apart(df.selectExpr("source AS __source", "md5(concat_ws('|', doc_id, text)) AS __digest").withColumn("__part", F.substring("__digest", 1, 1)))
    assert parts.count() == len(rows)
    # Equal rows fill no part alone, though hashes deal them out unevenly.
    assert parts.groupBy("__source", "__part", "__digest").count().agg(F.max("count")).first()[0] < 40


def test_slopes_decide_the_order_not_the_amounts(spark):
    df = spark.createDataFrame([(i, "w " * (5 + i % 7), f"s{i % 3}") for i in range(600)], "doc_id long, text string, source string")
    rows = {slopes: mixing.arranged(df, slopes=slopes).collect() for slopes in ((-0.9, 0.0, 0.9), (0.9, 0.0, -0.9))}
    one, other = rows.values()
    assert [r["doc_id"] for r in one] != [r["doc_id"] for r in other]
    assert {(r["doc_id"], r["taken"]) for r in one} == {(r["doc_id"], r["taken"]) for r in other}
    mean = lambda rs, s: sum(r["position"] for r in rs if r["source"] == s and r["passes"]) / sum(r["source"] == s and r["passes"] > 0 for r in rs)
    assert mean(one, "s0") < mean(one, "s2") and mean(other, "s0") > mean(other, "s2")


def test_curriculum_inverts_demand(spark):
    df = spark.createDataFrame([(i, "w " * 10, f"s{i % 3}") for i in range(3000)], "doc_id long, text string, source string")
    early = mixing.mix(df).groupBy("source").agg(F.avg("position").alias("p")).collect()
    p = {r["source"]: r["p"] for r in early}
    # With density 1 + slope (2t - 1) the mean position is 1/2 + slope/6.
    assert all(abs(p[s] - (0.5 + slope / 6)) < 0.01 for s, slope in zip(("s0", "s1", "s2"), mixing.SLOPES, strict=True))
