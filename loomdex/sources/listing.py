"""Listings of workspaces level by level, and a log of their changes that survives restarts.

Each level of a folder tree is a stored table, listed by tasks from the folders of the level above:
a folder's row has the ignore files above it. The driver knows the number of folders of a
level and nothing else of the tree. Listings follow the same rules as workspace.walk. Roots
must be mounted on every machine; a root that isn't there has no files.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.sources import ignore
from loomdex.sources.workspace import MAX_FILE_BYTES, PARTITION_BYTES, PARTITION_FILES, entries, global_texts, read_paths, rule_texts

FOLDERS_A_TASK, MOST_TASKS, BATCH_ROWS = 64, 4_096, 10_000
LISTED = "root string, path string, is_folder boolean, size long, modified long, rules array<struct<base:string,text:string>>"
FILES = "path string, size long, modified long"
EVENTS = "path string, kind string, ts timestamp, event_id long"
_RULES = pa.list_(pa.struct([("base", pa.string()), ("text", pa.string())]))
_LISTED = pa.schema([("root", pa.string()), ("path", pa.string()), ("is_folder", pa.bool_()), ("size", pa.int64()), ("modified", pa.int64()), ("rules", _RULES)])


@lru_cache(4_096)
def _parsed(text: str, base: str) -> list[ignore.Rule]:
    """The rules of an ignore file, read once for all folders of a task that it holds for."""
    return ignore.parse(text, base)


def _scan(max_bytes: int, indexable_only: bool):
    """A level's entries from its folders; a folder of any size is given out in batches of BATCH_ROWS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for f in batch.to_pylist():
                root, base = f["root"], f["path"]
                own = rule_texts(f"{root}/{base}" if base else root)
                above = [*f["rules"], *({"base": base, "text": t} for t in own)]
                rules = [r for x in above for r in _parsed(x["text"], x["base"])]
                for path, info in entries(root, base, rules, max_bytes, indexable_only):
                    size, modified = (None, None) if info is None else (info.st_size, info.st_mtime_ns)
                    rows.append({"root": root, "path": path, "is_folder": info is None, "size": size, "modified": modified, "rules": above if info is None else None})
                    if len(rows) >= BATCH_ROWS:
                        yield pa.RecordBatch.from_pylist(rows, _LISTED)
                        rows = []
        yield pa.RecordBatch.from_pylist(rows, _LISTED)

    return run


def list_workspaces(spark: SparkSession, roots: Sequence[str], folder: str, max_bytes: int = MAX_FILE_BYTES, indexable_only: bool = True) -> DataFrame:
    """(path, size, modified) of all files below the roots; path starts with the root's name, modified is in nanoseconds.

    The levels are tables in folder, which all machines share; those of an earlier run there are replaced.
    """
    first = [(r.rstrip("/"), "", [("", t) for t in global_texts(r.rstrip("/"))]) for r in dict.fromkeys(roots)]
    level, count, levels = spark.createDataFrame(first, "root string, path string, rules array<struct<base:string,text:string>>"), len(first), []
    while count:
        tasks = min(MOST_TASKS, -(-count // FOLDERS_A_TASK))
        levels.append(f"{folder}/level-{len(levels)}")
        level.repartition(tasks, "root", "path").mapInArrow(_scan(max_bytes, indexable_only), LISTED).write.mode("overwrite").parquet(levels[-1])
        level = spark.read.schema(LISTED).parquet(levels[-1]).where("is_folder").select("root", "path", "rules")
        count = level.count()
    found = spark.read.schema(LISTED).parquet(*levels) if levels else spark.createDataFrame([], LISTED)
    return found.where("not is_folder").select(F.concat_ws("/", F.element_at(F.split("root", "/"), -1), "path").alias("path"), "size", "modified")


def read_listed(listed: DataFrame, roots: Sequence[str], max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """As workspace.read_workspaces, of a listing: tasks of bounded bytes and files on average read what it names."""
    held = listed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.count("*").alias("files")).first()
    tasks = max(1, -(-held["size"] // PARTITION_BYTES), -(-held["files"] // PARTITION_FILES))
    return read_paths(listed.repartition(tasks, "path"), roots, max_bytes)


class ListingLog:
    """Stored listings of roots and the changes from each to the next, as files that a stream reads.

    look() lists the roots, stores the listing, and writes what differs from the one before, by a join. A log that is
    opened again in its folder goes on from the last stored listing, so only what changed since is
    reported. Should a look end after its listing was stored and before its changes were, the next
    one writes these first; a stream may then see some of them twice, which readers of the last
    event of a path don't notice. The last two listings are kept, changes stay for streams that
    start later. One writer at a time.
    """

    def __init__(self, spark: SparkSession, roots: Sequence[str], folder: str, max_bytes: int = MAX_FILE_BYTES, most: int = PARTITION_FILES):
        self.spark, self.roots, self.folder, self.max_bytes, self.most = spark, list(roots), folder.rstrip("/"), max_bytes, most

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _done(self, kind: str) -> list[int]:
        """Numbers of complete tables."""
        fs, at = self._fs(f"{self.folder}/{kind}")
        names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n) for n in names if n.isdigit() and fs.exists(self._fs(f"{self.folder}/{kind}/{n}/_SUCCESS")[1]))

    def listing(self, number: int) -> DataFrame:
        return self.spark.read.schema(FILES).parquet(f"{self.folder}/listings/{number:09d}")

    def _write_changes(self, number: int, listings: list[int]) -> None:
        now = self.listing(number).withColumnRenamed("size", "_size").withColumnRenamed("modified", "_modified")
        before = self.listing(number - 1) if number - 1 in listings else self.spark.createDataFrame([], FILES)
        both = before.withColumn("_old", F.lit(True)).join(now.withColumn("_new", F.lit(True)), "path", "full")
        differs = ~(F.col("size").eqNullSafe(F.col("_size")) & F.col("modified").eqNullSafe(F.col("_modified")))
        kind = F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull(), "deleted").when(differs, "modified")
        found = both.select("path", kind.alias("kind"), F.current_timestamp().alias("ts"), F.lit(number).cast("long").alias("event_id")).where("kind is not null")
        found.write.mode("overwrite").option("maxRecordsPerFile", self.most).parquet(f"{self.folder}/changes/{number:09d}")

    def look(self) -> DataFrame:
        """Take the next listing; the changes that it shows."""
        listings = self._done("listings")
        number = listings[-1] + 1 if listings else 0
        if listings and listings[-1] not in self._done("changes"):
            self._write_changes(listings[-1], listings)
        levels = f"{self.folder}/levels"
        list_workspaces(self.spark, self.roots, levels, self.max_bytes).write.mode("overwrite").parquet(f"{self.folder}/listings/{number:09d}")
        self._write_changes(number, [*listings, number])
        for old in (levels, *(f"{self.folder}/listings/{n:09d}" for n in listings if n < number - 1)):
            fs, at = self._fs(old)
            fs.delete(at, True)
        return self.spark.read.schema(EVENTS).parquet(f"{self.folder}/changes/{number:09d}")

    def stream(self) -> DataFrame:
        """The changes of all looks, also of those to come, at most so many in a trigger; its checkpoint tells what was read. Take a look first."""
        return self.spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/changes/*")
