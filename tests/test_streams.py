"""Streaming rules on shuffled micro-batches give what their batch forms give, and idle keys leave no state."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cutoffs.streaming import rules

T0 = datetime(2025, 10, 25, 12)


@pytest.fixture()
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def streamed(spark, at, parts, schema, make):
    """Runs make over parts, each a micro-batch; (rows, rows of state left)."""
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    q = make(stream).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(make(stream).schema).parquet(f"{at}/out").collect(), q.lastProgress.stateOperators[0].numRowsTotal


def test_rate_limit_of_shuffled_micro_batches_is_the_batch_form(rocks, tmp_path):
    rng = random.Random(1)
    hits = sorted({(rng.randrange(3), T0 + timedelta(seconds=rng.randrange(0, 4000, 5), microseconds=rng.randrange(10**6))) for _ in range(900)})
    rng.shuffle(hits)
    end = [(k, T0 + timedelta(days=2, hours=k)) for k in (50, 51)]  # the watermark passes all hits, then the first of these
    batch = rocks.createDataFrame(hits, "key bigint, ts timestamp")
    want = {(r["key"], r["ts"]): r["allowed"] for r in rules.rate_limit(batch).collect()}
    got, left = streamed(rocks, str(tmp_path), [hits[:300], hits[300:600], hits[600:], end[:1], end[1:]], "key bigint, ts timestamp", lambda s: rules.rate_limit_stream(s, late="2 hours"))
    seen = {(r["key"], r["ts"]): r["allowed"] for r in got if r["key"] < 50}
    assert seen == want and sum(want.values()) < len(want)
    assert left <= 2 * 2  # the two last keys, with their timers; the others are gone


def test_rate_limits_of_many_keys_share_states(rocks, tmp_path):
    rng = random.Random(4)
    big = (1 << 60) + 1
    hits = sorted({(rng.choice([None, big, *range(60)]), T0 + timedelta(seconds=rng.randrange(0, 300, 5), microseconds=rng.randrange(10**6))) for _ in range(3000)}, key=str)
    rng.shuffle(hits)
    end = [(100, T0 + timedelta(days=2)), (101, T0 + timedelta(days=4))]
    batch = rocks.createDataFrame(hits, "key bigint, ts timestamp")
    want = {(r["key"], r["ts"]): r["allowed"] for r in rules.rate_limit(batch, limit=2).collect()}
    make = lambda s: rules.rate_limit_stream(s, limit=2, late="2 hours", buckets=5)
    for part in (hits[:1500], hits[1500:], end[:1]):
        rocks.createDataFrame(part, "key bigint, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = rocks.readStream.schema("key bigint, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = make(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    most = max(p.stateOperators[0].numRowsTotal for p in q.recentProgress)
    assert most <= 2 * (5 + 2)  # 62 states and their timers before
    got = {(r["key"], r["ts"]): r["allowed"] for r in rocks.read.schema(make(stream).schema).parquet(f"{tmp_path}/out").collect()}
    assert got == want and 0 < sum(want.values()) < len(want)


def test_daily_cap_of_shuffled_micro_batches_is_the_batch_form(rocks, tmp_path):
    rng = random.Random(2)
    events = [(i, T0 + timedelta(minutes=rng.randrange(0, 4000))) for i in range(500)] + [(1000 + i, T0 + timedelta(minutes=7)) for i in range(80)]
    rng.shuffle(events)
    last = [(9999, T0 + timedelta(days=9))]
    batch = rocks.createDataFrame(events, "event_id bigint, ts timestamp")
    want = {r["event_id"]: r["allowed"] for r in rules.daily_cap(batch, 50).collect()}
    got, left = streamed(rocks, str(tmp_path), [events[:200], events[200:450], events[450:], last], "event_id bigint, ts timestamp", lambda s: rules.daily_cap_stream(s, 50, "4 days"))
    assert len(got) == len(want) and {r["event_id"]: r["allowed"] for r in got} == want
    assert left <= 2
