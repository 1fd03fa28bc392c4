"""Debounce as keyed state against the same on a table."""

import time
from datetime import datetime, timedelta

from loomdex.streaming import changes
from loomdex.streaming.settle import STORE, settle, with_rocks

SCHEMA = "path string, kind string, ts timestamp, event_id long"
START = datetime(2024, 1, 1)


def at(seconds):
    return START + timedelta(seconds=seconds)


def test_bursts_in_event_time(spark, tmp_path):
    """Bursts over several files, one at exactly the gap, ties in time, late and repeated rows, and a tick that ends the last."""
    files = [
        [("a", "created", at(0), 0), ("a", "modified", at(0), 1), ("b", "created", at(1), 2)],
        [("a", "deleted", at(10), 4), ("b", "modified", at(30), 5), ("b", "modified", at(12), 3)],
        [("a", "created", at(40), 6), ("b", "deleted", at(45), 7)],
        [(None, None, at(500), 8)],
    ]
    folder = str(tmp_path / "in")
    for rows in files:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)
    before = spark.conf.get(STORE, None)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    with with_rocks(spark):
        query = settle(stream, 10_000, "30 seconds").writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
        query.start(str(tmp_path / "out"), format="parquet").awaitTermination()
    assert spark.conf.get(STORE, None) == before
    events = spark.createDataFrame([r for rows in files for r in rows if r[0]], SCHEMA)
    want = sorted(map(tuple, changes.debounce(events, "10 seconds").collect()))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == want
    assert ("a", at(0), at(10), 3, "deleted") in want and len(want) == 6


def test_watcher_holds_until_quiet(spark, tmp_path):
    """A burst over several triggers is handed on once, with its last event, without any later event."""
    folder, given = str(tmp_path / "in"), []
    put = lambda kind, n: spark.createDataFrame([("a", kind, at(n), n)], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    put("created", 0)
    watcher = changes.Watcher(spark.readStream.schema(SCHEMA).parquet(folder), lambda batch, number: given.extend(map(tuple, batch.collect())), str(tmp_path / "cp"), "6 seconds", settled=True)
    watcher.query = None
    query = watcher.start()
    assert watcher.start() is query
    try:
        for n, kind in ((1, "modified"), (2, "deleted")):
            time.sleep(1)
            put(kind, n)
        until = time.time() + 60
        while not given and time.time() < until and query.isActive:
            time.sleep(0.5)
    finally:
        watcher.stop()
    assert [(path, kind, ts) for path, kind, ts, _ in given] == [("a", "deleted", at(2))]
