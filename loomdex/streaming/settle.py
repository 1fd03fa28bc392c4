"""Debounce as keyed state: a path's burst of events is given out once the path has been quiet."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Events of a path that are merged at a time.
_ROWS = 10_000
_BURST = "started long, ended long, events long, kind string, last long, quiet long"
_OUT = "path {path}, started long, ended long, events long, kind string"


class _Bursts(StatefulProcessor):
    """Open bursts of a path, never more than lie within the lateness; a timer at the end of the earliest.

    Times are microseconds, timers milliseconds. In event time a burst ends when the watermark
    passes the gap after its last event; in processing time, when nothing of the path arrived
    for the gap. quiet is that moment.
    """

    def __init__(self, gap: int, live: bool):
        self.gap, self.live = gap, live

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", _BURST)

    def _put(self, bursts: list[tuple]) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if bursts:
            self.open.put(bursts)
            self.handle.registerTimer(min(b[5] for b in bursts) // 1000 + 1)
        else:
            self.open.clear()

    def _merged(self, bursts: list[tuple]) -> list[tuple]:
        """Bursts that lie within the gap of one another as one; the last event's kind counts, ties by order."""
        out: list[tuple] = []
        for b in sorted(bursts):
            if out and (self.live or b[0] - self.gap <= out[-1][1]):
                a = out.pop()
                last = max(a, b, key=lambda x: (x[1], x[4]))
                b = (min(a[0], b[0]), last[1], a[2] + b[2], last[3], last[4], max(a[5], b[5]))
            out.append(b)
        return out

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        bursts = [tuple(b) for b in self.open.get()]
        now = timerValues.getCurrentProcessingTimeInMs() * 1000
        while some := list(islice(rows, _ROWS)):
            if key[0] is not None:  # ticks only move the watermark
                bursts = self._merged(bursts + [(r["us"], r["us"], 1, r["kind"] or "", r["seq"], (now if self.live else r["us"]) + self.gap) for r in some])
        if key[0] is not None:
            self._put(bursts)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs() if self.live else timerValues.getCurrentWatermarkInMs()
        bursts = [tuple(b) for b in self.open.get()]
        self._put([b for b in bursts if b[5] >= now * 1000])
        for b in bursts:
            if b[5] < now * 1000:
                yield Row(path=key[0], started=b[0], ended=b[1], events=b[2], kind=b[3])


def settle(events: DataFrame, gap_ms: int, lateness: str | None = None, order: str = "event_id") -> DataFrame:
    """(path, started, ended, events, kind) of each burst of a path's events on a stream, like debounce() on a table.

    With a lateness the events' own times count: a burst is given out once the watermark is past
    the gap after its last event, and events that come later than the lateness are dropped. A row
    with a null path is a tick that only moves the watermark, so the last bursts of a quiet
    source end too. Without a lateness the time of arrival counts, and timers end bursts by
    themselves. Memory holds open bursts only, one row each, however many events they have.
    Rows come to the processor one by one (as in its pandas form inside), which takes null keys.
    An event without kind counts as one whose kind is empty. The session must keep state in RocksDB (see with_rocks).
    """
    path = events.schema["path"].dataType.simpleString()
    timed = events.withWatermark("ts", lateness) if lateness else events
    cut = timed.select("path", "ts", "kind", F.unix_micros("ts").alias("us"), F.col(order).cast("long").alias("seq"))
    made = cut.groupBy("path").transformWithState(_Bursts(gap_ms * 1000, not lateness), outputStructType=_OUT.format(path=path), outputMode="Append", timeMode="EventTime" if lateness else "ProcessingTime")
    return made.select("path", F.timestamp_micros("started").alias("started"), F.timestamp_micros("ended").alias("ended"), "events", "kind")


class with_rocks:
    """Within it, streams that start keep their state in RocksDB, as keyed state with timers needs; the setting then goes back."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(STORE, None)
        self.spark.conf.set(STORE, ROCKS)

    def __exit__(self, *_) -> None:
        if self.before is None:
            self.spark.conf.unset(STORE)
        else:
            self.spark.conf.set(STORE, self.before)
