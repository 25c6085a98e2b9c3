"""Event rules as Structured Streaming, with batch forms: rate limit, daily cap, first write wins, field reports, season."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import accumulate
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

LIMIT, SPAN_S, DAILY = 8, 60.0, 300
#: Keys of a rate limit lie together in so many states.
BUCKETS = 4096


def accepted(times: list[float], kept: list[float], limit: int = LIMIT, span: float = SPAN_S) -> tuple[list[bool], list[float]]:
    """Which hits pass a limit of accepted hits in the last `span` seconds, and the accepted times still in the span."""
    flags = []
    for t in times:
        kept = [x for x in kept if t - x < span]
        flags.append(len(kept) < limit)
        if flags[-1]:
            kept.append(t)
    return flags, kept


def rate_limit(events: DataFrame, key: str = "key", ts: str = "ts", limit: int = LIMIT, span: float = SPAN_S) -> DataFrame:
    """Batch form: events with `allowed`. Only accepted hits count, so the rule is a fold over each key's hits in time.

    Keys go to tasks and are sorted there; a task reads its rows as a stream and holds no more than the accepted times of
    the current key's last `span` seconds, however many hits the key has. Hits at one time are ordered by a hash of the row.
    """
    t = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    e = events.withColumns({"_k": F.xxhash64(key), "_t": t, "_id": F.xxhash64(*events.columns)})
    e = e.repartition(key).sortWithinPartitions("_k", key, "_t", "_id")
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema], "allowed boolean"])
    at, names = events.columns.index(key), events.columns

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept = object(), []
        for batch in batches:
            flags = []
            for k, x in zip(batch.column(at).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True):
                if k != now:
                    now, kept = k, []
                ok, kept = accepted([x], kept, limit, span)
                flags += ok
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(flags, pa.bool_())], names=[*names, "allowed"])

    return e.mapInArrow(fold, schema)


class RateLimiter(StatefulProcessor):
    """Streaming form in event time: hits wait until the watermark has passed them, so that their order of arrival is no matter.

    The state of a bucket of keys is, for each key, its waiting hits and the accepted times of the last span. A timer at the
    first waiting hit decides those that the watermark has passed; a timer at the end of a key's span drops what is left of
    it, so that idle keys leave no state. Calls, states and timers are for buckets, as each takes far longer than its hits.
    """

    def __init__(self, limit: int = LIMIT, span: float = SPAN_S):
        self.limit, self.span = limit, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # times in microseconds; waits and keeps: how many of them belong to each key
        self.state = handle.getValueState("hits", "keys array<bigint>, waits array<bigint>, keeps array<bigint>, waiting array<bigint>, kept array<bigint>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self._held()
        for frame in rows:
            for k, t in zip(frame["key"].tolist(), pd.DatetimeIndex(frame["ts"]).as_unit("us").asi8.tolist(), strict=True):
                held.setdefault(k, ([], []))[0].append(t)
        for waiting, _ in held.values():
            waiting.sort()
        self._hold(held)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed, span = timerValues.getCurrentWatermarkInMs() * 1000, int(self.span * 1e6)
        held, keys, times, allowed = {}, [], [], []
        for k, (waiting, kept) in self._held().items():
            ready = waiting[: bisect_right(waiting, passed)]
            flags, kept = accepted(ready, kept, self.limit, span)
            rest, kept = waiting[len(ready) :], [t for t in kept if passed - t < span]
            if rest or kept:
                held[k] = rest, kept
            keys += [None if key[0] < 0 else k] * len(ready)
            times += ready
            allowed += flags
        self._hold(held)
        if times:
            yield pd.DataFrame({"key": keys, "ts": pd.to_datetime(times, unit="us", utc=True), "allowed": allowed})

    def _held(self) -> dict[int, tuple[list[int], list[int]]]:
        if not self.state.exists():
            return {}
        keys, waits, keeps, waiting, kept = self.state.get()
        w, k = ([0, *accumulate(n)] for n in (waits, keeps))
        return {x: (list(waiting[w[i] : w[i + 1]]), list(kept[k[i] : k[i + 1]])) for i, x in enumerate(keys)}

    def _hold(self, held: dict[int, tuple[list[int], list[int]]]) -> None:
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t[0] if isinstance(t, (list, tuple)) else t)
        if not held:
            self.state.clear()
            return
        both = held.values()
        self.state.update((list(held), [len(w) for w, _ in both], [len(k) for _, k in both], [t for w, _ in both for t in w], [t for _, k in both for t in k]))
        first = min(w[0] if w else k[-1] + int(self.span * 1e6) for w, k in both)
        self.handle.registerTimer(-(-first // 1000))

    def close(self) -> None:
        pass


def rate_limit_stream(events: DataFrame, limit: int = LIMIT, span: float = SPAN_S, late: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """events: key bigint, ts timestamp (a stream) -> key, ts, allowed, as the batch form decides them.

    A hit is decided when the watermark, the latest time seen less `late`, has passed it; later ones are dropped as late. Keys
    lie together in `buckets` by a hash; their number stays that of a stream's first run.
    """
    timed = events.select("key", "ts").withWatermark("ts", late)
    timed = timed.select(F.when(F.col("key").isNull(), -1).otherwise(F.pmod(F.xxhash64("key"), F.lit(buckets))).cast("bigint").alias("bucket"), F.coalesce("key", F.lit(0)).cast("bigint").alias("key"), "ts")
    return timed.groupBy("bucket").transformWithStateInPandas(statefulProcessor=RateLimiter(limit, span), outputStructType="key bigint, ts timestamp, allowed boolean", outputMode="Append", timeMode="EventTime")


def daily_cap(events: DataFrame, cap: int = DAILY, ts: str = "ts", tie: str = "event_id", key: list[str] | None = None) -> DataFrame:
    """Batch form: events with `allowed`, the first `cap` of each UTC day (of each key), by time and then `tie`.

    Events are counted by second first; running counts tell whole seconds apart, and only the events of the second in
    which the cap is reached are ranked one by one. An event without a time is in a day of its own, by `tie` alone.
    """
    keys = key or []
    e = events.withColumns({"_day": F.to_date(F.col(ts)), "_sec": F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / 1e6)})
    same = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in (*keys, "_day", "_sec")])
    per = e.groupBy(*keys, "_day", "_sec").agg(F.count("*").alias("_n"))
    run = Window.partitionBy(*keys, "_day").orderBy("_sec")
    per = per.withColumn("_upto", F.sum("_n").over(run)).select(*keys, "_day", "_sec", (F.col("_upto") - F.col("_n")).alias("_before"), "_upto")
    both = e.alias("e").join(per.alias("p"), same("e", "p")).select(*[F.col(f"e.`{c}`").alias(c) for c in e.columns], "p._before", "p._upto")
    split = (F.col("_before") < cap) & (F.col("_upto") > cap)
    whole = both.filter(~split).withColumn("allowed", F.col("_upto") <= cap)
    rank = F.row_number().over(Window.partitionBy(*keys, "_day").orderBy(ts, tie))
    edge = both.filter(split).withColumn("allowed", F.col("_before") + rank <= cap)
    return whole.unionByName(edge).select(*events.columns, "allowed")


class DailyCap(StatefulProcessor):
    """Streaming form: a day's state is its first events so far, at most as many as the cap, by time and id.

    An event that can't be among them any more is rejected at once, and one that an earlier event pushes out then; those that
    stay are allowed when the watermark passes the end of the day, and the day's state goes.
    """

    def __init__(self, cap: int = DAILY):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("first", "ts array<bigint>, id array<bigint>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        if key[0] < 0:  # events that their task has rejected
            for frame in rows:
                yield pd.DataFrame({"event_id": frame["event_id"], "allowed": False})
            return
        new = [x for frame in rows for x in zip(frame["us"].tolist(), frame["event_id"].tolist(), strict=True)]
        old = list(zip(*self.state.get(), strict=True)) if self.state.exists() else []
        if not old:
            self.handle.registerTimer((key[0] + 1) * 86_400_000)
        first = sorted(old + new)
        self.state.update(tuple(map(list, zip(*first[: self.cap], strict=True))))
        out = [i for _, i in first[self.cap :]]
        if out:
            yield pd.DataFrame({"event_id": out, "allowed": False})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            yield pd.DataFrame({"event_id": list(self.state.get()[1]), "allowed": True})
            self.state.clear()

    def close(self) -> None:
        pass


def daily_cap_stream(events: DataFrame, cap: int = DAILY, late: str = "1 hour") -> DataFrame:
    """events: event_id bigint, ts timestamp (a stream) -> event_id, allowed, once for each event of a day that is over.

    A task sends on at most `cap` events of a day in each Arrow batch to the day's state; the others are rejected where they
    are and go out under a key of their task, so that a busy day isn't one task's.
    """
    rows = events.filter("ts is not null and event_id is not null").withWatermark("ts", late)
    rows = rows.select(F.floor(F.unix_micros("ts") / 86_400_000_000).alias("day"), F.unix_micros("ts").alias("us"), F.col("event_id").cast("bigint").alias("event_id"))

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aside = -1 - TaskContext.get().partitionId()
        for batch in batches:
            frame = batch.to_pandas()
            place = frame.sort_values(["us", "event_id"]).groupby("day").cumcount()
            frame.loc[place[place >= cap].index, "day"] = aside
            yield pa.RecordBatch.from_pandas(frame, schema=batch.schema, preserve_index=False)

    near = rows.mapInArrow(firsts, "day bigint, us bigint, event_id bigint")
    return near.groupBy("day").transformWithStateInPandas(statefulProcessor=DailyCap(cap), outputStructType="event_id bigint, allowed boolean", outputMode="Append", timeMode="EventTime")


def first_write_wins(events: DataFrame, parts: list[str], order: list[str]) -> DataFrame:
    """Batch form: per content key the first row."""
    k = F.sha2(F.to_json(F.struct(*parts)), 256)
    e = events.withColumn("content_key", k)
    return e.withColumn("_r", F.row_number().over(Window.partitionBy("content_key").orderBy(*order))).filter("_r = 1").drop("_r")


def first_write_wins_stream(events: DataFrame, parts: list[str], late: str = "1 hour") -> DataFrame:
    """Streaming form: later rows with the same content key are dropped within the watermark."""
    return events.withColumn("content_key", F.sha2(F.to_json(F.struct(*parts)), 256)).withWatermark("ts", late).dropDuplicatesWithinWatermark(["content_key"])


class ReportState(StatefulProcessor):
    """Last applied state of each asset; a bridge that was closed and is reported open waits for a person."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "passability string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("ts", kind="stable")
        last, out = (self.last.get()[0] if self.last.exists() else None), []
        for r in frame.itertuples():
            fine = r.location_ok and r.passability != "unknown" and r.confidence >= 0.8 and not (r.kind == "bridge" and last == "closed" and r.passability == "open")
            out.append("auto_apply" if fine else "queue")
            last = r.passability if fine else last
        if last is not None:
            self.last.update((last,))
        yield pd.DataFrame({"asset_id": [key[0]] * len(frame), "ts": frame["ts"], "decision": out})

    def close(self) -> None:
        pass


def reports_stream(reports: DataFrame, assets: DataFrame) -> DataFrame:
    """Stream of reports joined with the known assets -> asset_id, ts, decision."""
    known = reports.join(assets.select("asset_id", "kind"), "asset_id")
    return known.groupBy("asset_id").transformWithStateInPandas(statefulProcessor=ReportState(), outputStructType="asset_id bigint, ts timestamp, decision string", outputMode="Append", timeMode="None")


def active_season(events: DataFrame, now: Column, most_h: float = 36.0) -> DataFrame:
    newest = events.agg(F.max("ts").alias("newest"))
    return newest.withColumn("active", F.coalesce((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("newest").cast("timestamp"))) / 3.6e9 <= most_h, F.lit(False)))


def on_new_files(stream: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Runs a batch job for all files that are new since the last call, each once."""
    stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
