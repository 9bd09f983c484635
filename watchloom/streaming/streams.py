"""Streams. The same functions serve a batch: each takes a streaming DataFrame and returns one.

Late data: a watermark of ten minutes on ts unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

LATE = "10 minutes"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def incremental_files(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "json", per_trigger: int = 100, newest_first: bool = False) -> DataFrame:
    """Each file is read once; the checkpoint remembers which."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", per_trigger).option("latestFirst", newest_first).load(path)


def tail_and_score(alerts: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Scores new alerts and appends them as JSON every five seconds, or once over what is there."""
    writer = score(alerts).writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def stream_dedup(events: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    return events.withWatermark(ts, LATE).dropDuplicatesWithinWatermark([key])


def discard_late_or_old(events: DataFrame, since: str, ts: str = "ts", late: str | None = LATE) -> DataFrame:
    """Data since a date; late=None if a later step sets the watermark."""
    kept = events.filter(F.col(ts) >= F.lit(since).cast("timestamp"))
    return kept.withWatermark(ts, late) if late else kept


def hourly_totals_stream(events: DataFrame, is_alert: Column, ts: str = "ts") -> DataFrame:
    hours = events.withWatermark(ts, LATE).groupBy(F.window(ts, "1 hour").alias("w"))
    return hours.agg(F.count(F.lit(1)).alias("events"), F.count_if(is_alert).alias("alerts")).select(F.col("w.start").alias("hour"), "events", "alerts")


def auth_episode_stream(events: DataFrame, key: str, failed: Column, ts: str = "ts") -> DataFrame:
    """Bursts by key with pauses of up to five minutes."""
    s = events.withWatermark(ts, LATE).groupBy(F.session_window(ts, "5 minutes").alias("w"), key)
    return s.agg(F.count(F.lit(1)).alias("attempts"), F.count_if(failed).alias("failed")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "attempts", "failed", (F.col("failed") > 5).alias("brute_force"))


def port_scan_stream(events: DataFrame, key: str, port: str, least: int = 10, ts: str = "ts") -> DataFrame:
    """Exact numbers of distinct ports above least in ten minutes, for every minute.

    Events are combined to one row for each key and minute, with its set of ports (65536 at most); only these rows enter the ten windows that hold them.
    """
    panes = events.withWatermark(ts, LATE).groupBy(F.window(ts, "1 minute").alias("pane"), key).agg(F.collect_set(port).alias("ports"))
    wide = panes.groupBy(F.window(F.window_time("pane"), "10 minutes", "1 minute").alias("w"), key).agg(F.array_distinct(F.flatten(F.collect_set("ports"))).alias("ports"))
    return wide.select(key, F.col("w.start").alias("start"), F.size("ports").cast("bigint").alias("ports")).filter(F.col("ports") > least)


class _Changes(StatefulProcessor):
    """Pending change of an id, kept until it is taken: existing, operation, data."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("pending", "existing boolean, operation string, data string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        for op, data in pd.concat(list(rows)).sort_values("seq")[["operation", "data"]].itertuples(index=False):
            if held is None:
                held = (op != "CREATE", op, data)
            elif not held[0] and op == "DELETE":
                held = None
            elif not held[0]:
                held = (False, "CREATE", data)
            else:
                held = (True, op, data)
        if held is None:
            self.state.clear()
            yield pd.DataFrame({"id": [key[0]], "operation": ["NONE"], "data": [None], "existing": [False]})
        else:
            self.state.update(held)
            yield pd.DataFrame({"id": [key[0]], "operation": [held[1]], "data": [held[2]], "existing": [bool(held[0])]})

    def close(self) -> None:
        pass


def stream_coalesce_changes(changes: DataFrame) -> DataFrame:
    """changes: id, seq, operation, data. The pending change of an id after each batch; NONE if it came to nothing."""
    return changes.withColumn("id", F.col("id").cast("string")).groupBy("id").transformWithStateInPandas(_Changes(), "id string, operation string, data string, existing boolean", "Update", "None")


class _Keepalive(StatefulProcessor):
    def __init__(self, disconnect_ms: int, alert_ms: int) -> None:
        self.waits = (disconnect_ms, alert_ms)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms bigint, stage int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = max(int(pdf["ts"].max().timestamp() * 1000) for pdf in rows)
        held = self.last.get() if self.last.exists() else None
        if held is not None and newest <= held[0]:
            return
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(newest + self.waits[0])
        self.last.update((newest, 0))
        if held is None or held[1] > 0:
            yield pd.DataFrame({"agent_id": [key[0]], "status": ["active"], "at_ms": [newest]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ms, stage = self.last.get()
        told = [(key[0], "disconnected" if stage == 0 else "alert", expiredTimerInfo.getExpiryTimeInMs())]
        after = told[0][2] + self.waits[1]
        if stage == 0 and after > timerValues.getCurrentWatermarkInMs():
            self.last.update((ms, 1))
            self.handle.registerTimer(after)
        else:  # nothing is kept of an agent that was told of: it counts as new when it comes back
            told += [(key[0], "alert", after)] * (stage == 0)
            self.last.clear()
        yield pd.DataFrame(told, columns=["agent_id", "status", "at_ms"])

    def close(self) -> None:
        pass


def keepalive_timeout(keepalives: DataFrame, disconnect_seconds: int, alert_seconds: int) -> DataFrame:
    """keepalives: agent_id, ts. Status changes by event-time timers: active, disconnected, alert."""
    rows = keepalives.withWatermark("ts", "0 seconds").groupBy("agent_id")
    return rows.transformWithStateInPandas(_Keepalive(disconnect_seconds * 1000, alert_seconds * 1000), "agent_id string, status string, at_ms bigint", "Append", "EventTime")


class _Lines(StatefulProcessor):
    def __init__(self, pattern: str, timeout_ms: int) -> None:
        self.pattern, self.timeout = pattern, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "event string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        import re

        held = self.held.get()[0] if self.held.exists() else None
        out = []
        for line in pd.concat(list(rows)).sort_values("line_no")["line"]:
            if re.search(self.pattern, line):
                if held is not None:
                    out.append(held)
                held = line
            elif held is not None:
                held += "\n" + line
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if held is not None:
            self.held.update((held,))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout)
        if out:
            yield pd.DataFrame({"file": [key[0]] * len(out), "event": out})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        event = self.held.get()[0]
        self.held.clear()
        yield pd.DataFrame({"file": [key[0]], "event": [event]})

    def close(self) -> None:
        pass


def multiline_timeout(lines: DataFrame, pattern: str, timeout_seconds: int) -> DataFrame:
    """lines: file, line_no, line. A line that matches opens an event; an open one is flushed after the timeout."""
    return lines.groupBy("file").transformWithStateInPandas(_Lines(pattern, timeout_seconds * 1000), "file string, event string", "Append", "ProcessingTime")


class _Gaps(StatefulProcessor):
    """Observed numbers of a session as closed intervals."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spans = handle.getValueState("spans", "firsts array<bigint>, lasts array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = list(zip(*self.spans.get(), strict=True)) if self.spans.exists() else []
        size = 0
        for pdf in rows:
            size = max(size, int(pdf["size"].max()))
            held += [(int(s), int(s)) for s in pdf["seq"]]
        merged: list[list[int]] = []
        for a, b in sorted(held):
            if merged and a <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        self.spans.update(([a for a, _ in merged], [b for _, b in merged]))
        edges = [-1, *(x for span in merged for x in span), size]
        gaps = [f"{edges[i] + 1}-{edges[i + 1] - 1}" for i in range(0, len(edges), 2) if edges[i + 1] - edges[i] > 1]
        yield pd.DataFrame({"session": [key[0]], "complete": [not gaps], "missing": [",".join(gaps)]})

    def close(self) -> None:
        pass


def stream_sequence_gaps(messages: DataFrame) -> DataFrame:
    """messages: session, seq, size. After each batch: whether all of 0 … size - 1 came, and the ranges still missing."""
    return messages.groupBy("session").transformWithStateInPandas(_Gaps(), "session string, complete boolean, missing string", "Update", "None")
