"""Streams over files, one file a batch, against the batch answer."""

import datetime as dt
import random

from procure_spark.operators import chains
from procure_spark.sources.versions import read_version
from procure_spark.streaming import jobs


def test_first_seen_notices(spark, tmp_path):
    schema = "reg string, ts timestamp, n int"
    day = lambda d: dt.datetime(2024, 1, d)
    ledger = spark.createDataFrame([("old",)], "reg string")
    one, two = _append(spark, tmp_path, ledger, schema, day)
    assert [r["reg"] for r in one] == ["a"] and [r["reg"] for r in two] == ["a", "b"]


def _append(spark, tmp_path, ledger, schema, day):
    found = []
    for i, rows in enumerate([[("a", day(1), 1), ("old", day(1), 2)], [("a", day(2), 3), ("b", day(2), 4)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = jobs.stream_new_notices(spark.readStream.schema(schema).json(str(tmp_path / "in")), ledger, "reg", "ts")
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        found.append(spark.read.parquet(str(tmp_path / "out")).orderBy("reg").collect())
    return found


AT = dt.datetime(2024, 1, 1)
EVENTS = "who string, ts timestamp"


def greedy(rows, ttl=3600):
    found, ends = [], {}
    for who, ts in sorted(rows, key=lambda r: r[1]):
        if who not in ends or ts >= ends[who]:
            found.append((who, ts))
            ends[who] = ts + dt.timedelta(seconds=ttl)
    return sorted(found)


def test_an_answer_lives_an_hour(spark, tmp_path):
    # The probes of the last round: five hours apart, in one batch and in two.
    rows = [("a", AT), ("a", AT + dt.timedelta(hours=5)), ("z", AT + dt.timedelta(hours=9))]
    for name, batches in (("one", [rows]), ("two", [rows[:1], rows[1:]])):
        assert streamed(spark, tmp_path / name, batches) == rows[:2]


def streamed(spark, path, batches):
    for rows in batches:
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(str(path / "in"))
        stream = jobs.stream_ttl_dedup(spark.readStream.schema(EVENTS).parquet(str(path / "in")), ["who"], "ts")
        stream.writeStream.format("parquet").option("path", str(path / "out")).option("checkpointLocation", str(path / "c")).trigger(availableNow=True).start().awaitTermination()
    return sorted((r["who"], r["ts"]) for r in spark.read.parquet(str(path / "out")).collect())


def test_stream_equals_batch_over_late_and_unordered_events(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), AT + dt.timedelta(seconds=60 * i + rng.randrange(-200, 200), microseconds=rng.randrange(10**6))) for i in range(600)]
    cuts = [rows[:150], rows[150:400], rows[400:] + [("a", AT)]]  # the last event comes long behind the watermark
    last = max(ts for _, ts in rows) - dt.timedelta(minutes=10)
    wanted = [r for r in greedy(rows) if r[1] < last.replace(microsecond=last.microsecond // 1000 * 1000)]
    assert streamed(spark, tmp_path, cuts) == wanted and len(wanted) > 20
    batch = jobs.ttl_openings(spark.createDataFrame(rows + [("a", None), (None, AT)], EVENTS), ["who"], "ts").collect()
    assert sorted(((r["who"], r["ts"]) for r in batch), key=str) == sorted([*greedy(rows), (None, AT)], key=str)


def test_long_chains_and_stretches(spark):
    # A content that never rests: one chain of 500 openings, with stretches of the axis shorter and longer than it.
    rng = random.Random(2)
    rows = [(0, i * 7 + rng.randrange(7)) for i in range(5000)] + [(1, 5), (1, 5), (2, 0), (2, 10**6), (2, 10**6 + 69)]
    wanted, ends = [], {}
    for g, at in sorted(set(rows)):
        if at >= ends.get(g, at):
            wanted.append((g, at))
            ends[g] = at + 70
    df = spark.createDataFrame(rows, "g int, at long")
    for stretch in (70, 1000, None):
        assert sorted(map(tuple, chains.openings(df, ["g"], "at", 70, stretch).collect())) == wanted
    assert chains.openings(df.limit(0), ["g"], "at", 70).count() == 0


def test_progress_and_completion(spark, tmp_path):
    schema = "job int, tender int, seq int, stage string"
    rows = [(1, 1, 1, "read"), (1, 1, 2, "read"), (1, 2, 3, "done"), (2, 1, 4, "done")]
    spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    jobs.stream_job_progress(stream, "job", "tender", "seq", "stage").writeStream.format("memory").queryName("progress").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.table("progress").collect())) == [(1, 1, "read", 2), (1, 2, "done", 3), (2, 1, "done", 4)]
    table, path = spark.createDataFrame([], f"{schema}, status string").schema, str(tmp_path / "jobs")
    sink = jobs.job_progress_sink(path, table, "job", "tender", "seq", "stage", ["done"])
    state = lambda: sorted(map(tuple, read_version(spark, path, table).collect()))
    assert state() == []
    sink(spark.createDataFrame(rows, schema), 0)
    first = [(1, 1, 2, "read", "running"), (1, 2, 3, "done", "running"), (2, 1, 4, "done", "completed")]
    assert state() == first
    more = spark.createDataFrame([(1, 1, 5, "done"), (1, 2, 1, "read")], schema)
    for _ in range(2):  # the batch comes again under its number
        sink(more, 1)
        assert state() == [(1, 1, 5, "done", "completed"), (1, 2, 3, "done", "completed"), first[2]]
    sink(more.limit(0), 2)
    assert len(state()) == 3 and len(list((tmp_path / "jobs").glob("bucket=*/version=1"))) == 1


def test_contents_share_states_and_keep_types(spark, tmp_path):
    schema = "n long, s string, d timestamp, x double, ts timestamp"
    rng = random.Random(3)
    at = lambda: AT + dt.timedelta(seconds=rng.randrange(20_000), microseconds=rng.randrange(10**6))
    odd = [(None, None, None, None), (None, "", AT, float("nan")), (2**53 + 1, " \"\\", AT + dt.timedelta(microseconds=7), 0.1), (2**53, "null", dt.datetime(1850, 1, 1, 1, 2, 3, 456789), None)]
    rows = [(*c, at()) for c in odd for _ in range(20)] + [(i, "x", AT, 1.0, at()) for i in range(3000)] + [(-1, "end", AT, 1.0, AT + dt.timedelta(days=2))]
    events = spark.createDataFrame(rows, schema)
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    content = ["n", "s", "d", "x"]
    stream = jobs.stream_ttl_dedup(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), content, "ts")
    run = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    wanted = jobs.ttl_openings(events, content, "ts").filter("n is null or n <> -1").select(stream.columns)
    found = spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))
    assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect())) and found.count() > 3004 and stream.schema == wanted.schema
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress) <= jobs.GROUPS
