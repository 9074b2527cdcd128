"""Structured Streaming jobs. Event times are timestamps; sources that bring TIMESTAMP_NTZ are cast."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procure_spark.operators.chains import openings
from procure_spark.sources.versions import upsert_version


def stream_new_notices(events: DataFrame, ledger: DataFrame, key: str, ts: str, delay: str = "60 days") -> DataFrame:
    """First appearances by key that the ledger doesn't hold; keys are forgotten when the watermark has
    passed them, so state stays bounded."""
    new = events.withColumn(ts, F.col(ts).cast("timestamp")).join(ledger.select(key), key, "left_anti")
    return new.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def content_hash(content: Sequence[str]) -> Column:
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in content]))


def ttl_openings(events: DataFrame, content: Sequence[str], ts: str, ttl_s: int = 3600) -> DataFrame:
    """(content, content_hash, ts): the events that find no stored answer. A content's first event stores one for the time to
    live; the first event at or after its end stores the next. The batch twin of ``stream_ttl_dedup``."""
    rows = events.select(*content, F.unix_micros(F.col(ts).cast("timestamp")).alias(ts))
    return openings(rows, content, ts, ttl_s * 10**6).withColumns({ts: F.timestamp_micros(ts), "content_hash": content_hash(content)})


#: Groups of contents that share a state. A running stream keeps the number that it began with.
GROUPS = 1024

#: So that all times come back as they were.
JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def stream_ttl_dedup(events: DataFrame, content: Sequence[str], ts: str, ttl_s: int = 3600, delay: str = "10 minutes", groups: int = GROUPS) -> DataFrame:
    """Events that find no stored answer, as ``ttl_openings`` tells them, from a stream whose events come in any order within
    ``delay``: a content's events wait until the watermark has passed them and are then taken in the order of their times. State
    is the end of the stored answer and the times that wait; a content with neither is forgotten. Events without a time, and
    those that come behind the watermark, are left out.

    Contents are dealt by hash into ``groups``, each with one state, since a call of Python costs more than many events. A batch
    that touches a group writes the state of its contents anew; a task has one group's contents and times in memory."""
    rows = events.select(*content, F.col(ts).cast("timestamp").alias(ts)).filter(F.col(ts).isNotNull()).withWatermark(ts, delay)
    schema = T.StructType([rows.schema[c] for c in content])
    # As one text contents keep their nulls and types on the way through pandas.
    rows = rows.select(ts, F.unix_micros(ts).alias("__us"), F.to_json(F.struct(*content), {"ignoreNullFields": "false", **JSON}).alias("__content"))
    rows = rows.withColumn("__group", F.pmod(F.xxhash64("__content"), F.lit(groups)))
    ttl = ttl_s * 10**6

    def take(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = {c: (ends, list(waiting)) for c, ends, waiting in zip(*state.get, strict=True)} if state.exists else {}
        passed = state.getCurrentWatermarkMs()
        for b in batches:
            for c, at in zip(b["__content"].tolist(), b["__us"].tolist(), strict=True):
                held.setdefault(c, (None, []))[1].append(at)
        opened, kept, times = [], [], []
        for c, (ends, waiting) in held.items():
            waiting.sort()
            done = 0
            for at in waiting:
                if at // 1000 >= passed:
                    break
                if ends is None or at >= ends:
                    opened.append((c, at))
                    ends = at + ttl
                done += 1
            waiting = waiting[done:]
            ends = ends if ends is not None and ends // 1000 >= passed else None
            if waiting or ends is not None:
                kept.append((c, ends, waiting))
                times.append(max(passed, waiting[0] // 1000 if waiting else ends // 1000))
        if kept:
            state.update(tuple(map(list, zip(*kept, strict=True))))
            state.setTimeoutTimestamp(min(times))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(opened, columns=["__content", "__us"])

    found = rows.groupBy("__group").applyInPandasWithState(take, "__content string, __us long", "contents array<string>, ends array<long>, waiting array<array<long>>", "append", "EventTimeTimeout")
    found = found.select(F.from_json("__content", schema, {"mode": "FAILFAST", **JSON}).alias("__c"), "__us").select("__c.*", F.timestamp_micros("__us").alias(ts))
    return found.select(*content, content_hash(content).alias("content_hash"), ts)


def stream_job_progress(events: DataFrame, job: str, tender: str, seq: str, stage: str) -> DataFrame:
    """The latest stage of each tender of each job (update or complete mode)."""
    return events.groupBy(job, tender).agg(F.max_by(stage, seq).alias(stage), F.max(seq).alias(seq))


def job_progress_sink(path: str, schema: T.StructType, job: str, tender: str, seq: str, stage: str, terminal: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: writes each batch of events into the table of latest stages at ``path``, whose status says of each job
    whether all its tenders have ended. Jobs that a batch doesn't touch aren't written; a batch that comes again under its number
    leaves the table as it was. schema: of job, tender, seq, stage and status, as the table holds them."""

    def merged(old: DataFrame, new: DataFrame) -> DataFrame:
        rows = old.select(job, tender, seq, stage).unionByName(new.select(job, tender, seq, stage))
        last = rows.groupBy(job, tender).agg(F.max(seq).alias(seq), F.max_by(stage, seq).alias(stage))
        ended = F.min(F.coalesce(F.col(stage).isin(*terminal), F.lit(False))).over(Window.partitionBy(job))
        return last.withColumn("status", F.when(ended, "completed").otherwise("running"))

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # read for its buckets and its rows
        upsert_version(batch.sparkSession, path, batch, job, merged, schema, number)
        batch.unpersist()

    return write
