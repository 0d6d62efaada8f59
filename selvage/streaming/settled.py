"""Settled inputs: of events that follow each other quickly only the last counts, once nothing has followed it for a while.

This is what a form does that starts its work a moment after the last change:
each change starts the waiting anew, a cancelling event throws away what waits,
and the work that starts knows how many changes went into it.  As a stream it
is one keyed state with a timer for every event.  Events may come in any order
within the lateness: an event is judged when the watermark has passed the end
of its waiting, so that nothing that counts can still arrive.  What is judged is
forgotten, so a key's state holds the events of one waiting only, and the
length of the run that they belong to.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

def settled_batch(events: DataFrame, wait_ms: int, cancels: list[str]) -> DataFrame:
    """``key, event, ts, changes`` of ``events(key, event, ts, kind)``: the last event of every run, unless it cancels.

    A run ends where the next event of its key comes later than the waiting.
    Events of one key at one time follow each other by number.
    """
    order = Window.partitionBy("key").orderBy("ts", "event")
    at = F.unix_micros("ts")
    rows = events.withColumn("gap", at - F.lag(at).over(order)).withColumn("run", F.sum(F.when(F.col("gap") <= wait_ms * 1000, 0).otherwise(1)).over(order))
    ends = rows.groupBy("key", "run").agg(F.max(F.struct("ts", "event", "kind")).alias("last"), F.count("*").alias("changes"))
    return ends.where(~F.col("last.kind").isin(cancels)).select("key", "last.event", "last.ts", "changes")


class _Settling(StatefulProcessor):
    """State of a key, read and written once for all its rows: what waits, by time and number, how many events of its run have been judged, and the one timer, for the first that waits."""

    def __init__(self, wait_ms: int, cancels: list[str]) -> None:
        self.wait, self.cancels = wait_ms * 1000, set(cancels)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("waiting", "at array<long>, event array<long>, kind array<string>, judged long, timer long")

    def _read(self) -> tuple[dict[tuple[int, int], str], int, int | None]:
        if not self.state.exists():
            return {}, 0, None
        at, event, kind, judged, timer = self.state.get()
        return dict(zip(zip(at, event), kind)), judged, timer

    def _write(self, waiting: dict[tuple[int, int], str], judged: int, timer: int | None) -> None:
        """Keeps what waits, with a timer for its first event; ``timer`` is the one that is set."""
        due = self._due(min(waiting)[0]) if waiting else None
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if due is None:
            self.state.clear()
            return
        if timer != due:
            self.handle.registerTimer(due)
        self.state.update(([at for at, _ in waiting], [event for _, event in waiting], list(waiting.values()), judged, due))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        waiting, judged, timer = self._read()
        for part in rows:
            waiting.update(zip(zip(part["at"].tolist(), part["event"].tolist()), part["kind"].tolist()))
        self._write(waiting, judged, timer)
        return iter(())

    def _due(self, at: int) -> int:
        """Milliseconds when the waiting of an event is surely over."""
        return (at + self.wait) // 1000 + 1

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        over = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        waiting, changes, _ = self._read()
        out = []
        order = sorted(waiting)
        for (at, event), following in zip(order, [*order[1:], None]):
            if self._due(at) > over:
                break
            changes += 1
            kind = waiting.pop((at, event))
            if following is None or following[0] - at > self.wait:
                if kind not in self.cancels:
                    out.append((key[0], event, at, changes))
                changes = 0
        self._write(waiting, changes, None)
        if out:
            yield pd.DataFrame(out, columns=["key", "event", "at", "changes"])

    def close(self) -> None:
        pass


def settled(events: DataFrame, wait_ms: int, cancels: list[str], lateness: str = "1 second") -> DataFrame:
    """:func:`settled_batch` of a stream of ``key long, event long, ts timestamp, kind string``.

    Rows come when the watermark has passed their waiting; runs at the end of
    the stream wait for it.  The session's state store has to be RocksDB.
    """
    rows = events.withWatermark("ts", lateness).select("key", "event", "ts", "kind", F.unix_micros("ts").alias("at"))
    out = rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=_Settling(wait_ms, cancels), outputStructType="key long, event long, at long, changes long", outputMode="Append", timeMode="EventTime")
    return out.select("key", "event", F.timestamp_micros("at").alias("ts"), "changes")


def fresh_folder(root: str) -> str:
    return f"{root}/settled-{uuid.uuid4().hex}"


def run_to_end(stream: DataFrame, folder: str) -> None:
    """Work off what is there into ``folder/rows``, going on from ``folder/state``."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
