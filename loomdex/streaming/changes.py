"""The change stream: a source of file changes, debounce, last event per path, application to a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

from loomdex.operators.metadata import VersionedTable
from loomdex.sources.workspace import MAX_FILE_BYTES, walk
from loomdex.streaming.settle import settle, with_rocks

CREATED, MODIFIED, DELETED = "created", "modified", "deleted"
DEBOUNCE, FILES_PER_TRIGGER = "500 milliseconds", 1000


def debounce(events: DataFrame, gap: str = DEBOUNCE, lateness: str | None = None, order: str = "event_id") -> DataFrame:
    """(path, started, ended, events, kind) of each burst of a path's events; the last event's kind counts.

    A burst ends once no event follows within the gap; one at exactly the gap still belongs to
    it. Events need path, kind, ts and an order for ties. On a stream, lateness sets the
    watermark; a burst is given out when the watermark passes its end.
    """
    if lateness:
        events = events.withWatermark("ts", lateness)
    last = F.max_by("kind", F.struct("ts", order))
    bursts = events.groupBy("path", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"), F.max("ts").alias("ended"), last.alias("kind"))
    return bursts.select("path", F.col("w.start").alias("started"), "ended", "events", "kind")


def last_per_path(events: DataFrame, order: str = "event_id") -> DataFrame:
    """(path, kind, ts) of the last event of each path; a partial aggregation, so a busy path is no hot spot."""
    last = events.groupBy("path").agg(F.max(F.struct("ts", order, "kind")).alias("x"))
    return last.select("path", "x.kind", "x.ts")


def apply_batch(table: VersionedTable, read: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that brings one table up to date with a batch of events.

    read turns the paths that were created or modified into rows of the table; rows without text
    are left out. Deleted paths go. A batch that is delivered again changes nothing, as its
    number is kept with the table.
    """

    def run(batch: DataFrame, number: int) -> None:
        last = last_per_path(batch).persist()
        try:
            table.change(read(last.where(F.col("kind") != DELETED).select("path")), last.select("path"), number)
        finally:
            last.unpersist()

    return run


class _Feed(SimpleDataSourceStreamReader):
    """Compares what the roots hold now with what they held; the first time, with nothing.

    At most so many changes are handed out at a time; the rest are seen as changes again at the
    next look, so a burst waits in the file system, not in memory. After a restart everything
    is reported as created once more, which a reader that compares hashes doesn't notice.
    """

    def __init__(self, options: dict):
        self.roots = [r for r in options.get("roots", "").split("\n") if r]
        self.max_bytes = int(options.get("maxFileBytes", MAX_FILE_BYTES))
        self.most = int(options.get("maxFilesPerTrigger", FILES_PER_TRIGGER))
        self.held: dict[str, tuple[int, int]] = {}
        self.given: list[tuple[int, list[tuple]]] = []

    def initialOffset(self) -> dict:
        return {"n": 0}

    def changes(self) -> list[tuple[str, str]]:
        found = {f"{r.rstrip('/').rsplit('/', 1)[-1]}/{p}": (size, modified) for r in self.roots for p, size, modified in walk(r, self.max_bytes, exact=True)}
        out = [(p, DELETED) for p in sorted(self.held.keys() - found.keys())]
        out += [(p, MODIFIED if p in self.held else CREATED) for p in sorted(found) if self.held.get(p) != found[p]]
        for p, kind in out[: self.most]:
            if kind == DELETED:
                del self.held[p]
            else:
                self.held[p] = found[p]
        return out[: self.most]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now, n = datetime.now(timezone.utc), start["n"]
        rows = [(p, kind, now, n + k) for k, (p, kind) in enumerate(self.changes())]
        if rows:
            self.given.append((n, rows))
        return iter(rows), {"n": n + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([r for n, rows in self.given if start["n"] <= n < end["n"] for r in rows])

    def commit(self, end: dict) -> None:
        self.given = [(n, rows) for n, rows in self.given if n >= end["n"]]


class ChangeSource(DataSource):
    """spark.readStream.format("workspace_changes").option("roots", newline-joined folders): (path, kind, ts, event_id) of indexable files."""

    @classmethod
    def name(cls) -> str:
        return "workspace_changes"

    def schema(self) -> str:
        return "path string, kind string, ts timestamp, event_id long"

    def simpleStreamReader(self, schema) -> _Feed:
        return _Feed(self.options)


def watch_workspaces(spark: SparkSession, roots: Sequence[str], max_bytes: int = MAX_FILE_BYTES, most: int = FILES_PER_TRIGGER) -> DataFrame:
    """The stream of changes below the roots, paths as read_workspaces has them."""
    spark.dataSource.register(ChangeSource)
    return spark.readStream.format("workspace_changes").option("roots", "\n".join(roots)).option("maxFileBytes", str(max_bytes)).option("maxFilesPerTrigger", str(most)).load()


def milliseconds(time: str) -> int:
    """Of a debounce time, which is given as "500 milliseconds" or "2 seconds"."""
    number, unit = time.split()
    return int(number) * (1 if unit.startswith("milli") else 1000)


class Watcher:
    """A running change stream: start, stop, whether it is active. Starting twice keeps the first.

    The debounce time is the trigger's interval: events of a path that fall in the same trigger
    are one batch's, of which the last counts. With settled, a path's events are held until none
    has arrived for that time, so a burst that spans triggers is applied once; this keeps a
    checkpoint of its own. What is there already (available_now) is never held.
    """

    def __init__(self, events: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, debounce: str = DEBOUNCE, settled: bool = False):
        self.events, self.apply, self.checkpoint, self.debounce, self.settled = events, apply, checkpoint, debounce, settled
        self.query: StreamingQuery | None = None

    def start(self, available_now: bool = False) -> StreamingQuery:
        if not self.is_watching():
            if self.settled and not available_now:
                bursts = settle(self.events, milliseconds(self.debounce))
                held = bursts.select("path", "kind", F.col("ended").alias("ts"), F.unix_micros("ended").alias("event_id"))
                with with_rocks(held.sparkSession):
                    self.query = held.writeStream.foreachBatch(self.apply).option("checkpointLocation", f"{self.checkpoint}-settled").trigger(processingTime=self.debounce).start()
                return self.query
            writer = self.events.writeStream.foreachBatch(self.apply).option("checkpointLocation", self.checkpoint)
            self.query = (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=self.debounce)).start()
        return self.query

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()
            self.query = None

    def is_watching(self) -> bool:
        return self.query is not None and self.query.isActive
