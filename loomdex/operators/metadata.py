"""File metadata, incremental diffs, keyed tables and statistics."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdex.functions.text import content_hash

SYMBOLS_PER_FILE, BUCKETS = 20, 32
_BUCKET = "loomdex_bucket"


def file_metadata(docs: DataFrame, now: Column | int, path: str = "path", text: str = "content", language: str = "language", modified: str | None = None) -> DataFrame:
    """(path, size, modified, language, hash, indexed_at): byte size, content hash, and times in epoch seconds.

    modified names a column with the source's own time; without it, now stands for it.
    """
    clock = now if isinstance(now, Column) else F.lit(now).cast("long")
    return docs.select(
        F.col(path).alias("path"),
        F.octet_length(text).cast("long").alias("size"),
        (F.col(modified).cast("long") if modified else clock).alias("modified"),
        F.col(language).alias("language"),
        content_hash(F.col(text)).alias("hash"),
        clock.alias("indexed_at"),
    )


def paths(metadata: DataFrame) -> DataFrame:
    return metadata.select("path")


def lookup(metadata: DataFrame, path: str) -> DataFrame:
    return metadata.where(F.col("path") == path)


def diff(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(path, status) of all paths of two metadata tables: new, changed, unchanged or deleted, by hash."""
    now, old = (d.select("path", F.col("hash").alias(h)) for d, h in ((current, "now"), (previous, "old")))
    both = now.withColumn("in_now", F.lit(True)).join(old.withColumn("in_old", F.lit(True)), "path", "full_outer")
    status = F.when(F.col("in_old").isNull(), "new").when(F.col("in_now").isNull(), "deleted").when(F.col("now").eqNullSafe(F.col("old")), "unchanged").otherwise("changed")
    return both.select("path", status.alias("status"))


def to_index(docs: DataFrame, current: DataFrame, previous: DataFrame) -> DataFrame:
    """Documents with text that are new or whose hash differs. Texts are matched by path only after the hashes were compared."""
    changed = diff(current, previous).where(F.col("status").isin("new", "changed")).select("path")
    return docs.where(F.length("content") > 0).join(changed, "path", "left_semi")


def upsert(table: DataFrame, rows: DataFrame, key: str = "path") -> DataFrame:
    """The table with rows put in, replacing those of the same key."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows.select(*table.columns))


def delete(table: DataFrame, keys: DataFrame, key: str = "path") -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def replace_chunks(vectors: DataFrame, chunks: DataFrame, path: str = "file_path") -> DataFrame:
    """Chunk rows with those of the given files replaced as a whole, so ranges that are gone leave none."""
    return vectors.join(chunks.select(path).distinct(), path, "left_anti").select(*vectors.columns).unionByName(chunks.select(*vectors.columns))


def cleared(table: DataFrame) -> DataFrame:
    return table.limit(0)


def symbol_counts(metadata: DataFrame, symbols: DataFrame | None = None, column: str = "symbol_list") -> DataFrame:
    """indexed_files, total_symbols as the estimate of 20 a file and, given symbol arrays, exact_symbols."""
    out = metadata.agg(F.count("*").alias("indexed_files"), (F.count("*") * SYMBOLS_PER_FILE).alias("total_symbols"))
    return out if symbols is None else out.join(F.broadcast(symbols.agg(F.coalesce(F.sum(F.size(column)), F.lit(0)).alias("exact_symbols"))))


def duplicates(chunks: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return chunks.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


class Conflict(RuntimeError):
    """Another writer made the same version first."""


class Pointer:
    """The newest of numbered small files of JSON.

    A file is made only where none of its number is, and counts once it is whole, so a reader
    sees one state or the next and never a part, whenever a writer stops; of two writers of the
    same number one fails.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.folder, self._jvm = folder.rstrip("/"), spark.sparkContext._jvm
        self._path = lambda p: self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{p}")
        self._fs = self._path("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        if not self._fs.exists(self._path("")):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(""))]
        return sorted((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), reverse=True)

    def get(self, number: int) -> dict | None:
        """What a number holds; None if its writer stopped before the end."""
        stream = self._fs.open(self._path(f"{number:020d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) if text.endswith("\n") else None

    def current(self) -> tuple[int, dict | None]:
        """The newest whole number and what it holds; -1 and None if there is none."""
        for n in self._numbers():
            if (held := self.get(n)) is not None:
                return n, held
        return -1, None

    def next(self) -> int:
        return max(self._numbers(), default=-1) + 1

    def advance(self, number: int, content: dict) -> int:
        try:
            out = self._fs.create(self._path(f"{number:020d}.json"), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception):
                raise Conflict(f"{self.folder}: {number} exists") from e
            raise
        try:
            out.write(bytearray((json.dumps(content) + "\n").encode()))
        finally:
            out.close()
        return number

    def forget(self, keep: set[int]) -> None:
        """Delete all numbers but those to keep and the newest."""
        for n in self._numbers()[1:]:
            if n not in keep:
                self._fs.delete(self._path(f"{n:020d}.json"), False)


class VersionedTable:
    """A keyed table as Parquet folders, one for each bucket of the key's hash, and numbered lists of the current ones.

    A change writes only the buckets that hold the changed keys; the next version lists these
    and the old folders of all others. Readers see one version or the other (see Pointer), and
    older ones can be read by number until vacuum() drops them. Committing the same batch again
    changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str = "path", buckets: int = BUCKETS, order: Sequence[str] = ()):
        self.spark, self.folder, self.key, self.buckets, self.order = spark, folder.rstrip("/"), key, buckets, order
        self.pointer = Pointer(spark, f"{self.folder}/versions")
        self._at = lambda p: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{p}")
        self._fs = self._at("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @property
    def version(self) -> int:
        return self.pointer.current()[0]

    @property
    def batch(self) -> int:
        """The last batch applied; -1 before the first."""
        held = self.pointer.current()[1]
        return -1 if held is None else held["batch"]

    def _held(self, version: int | None) -> dict | None:
        if version is None:
            return self.pointer.current()[1]
        return None if version < 0 else self.pointer.get(version)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The table as it is, or as it was; None before the first commit."""
        held = self._held(version)
        return None if held is None else self._read(held, held["parts"])

    def _read(self, held: dict, buckets: Iterable[str]) -> DataFrame:
        schema = T.StructType.fromJson(held["schema"])
        paths = [f"{self.folder}/{held['parts'][b]}" for b in sorted(buckets, key=int) if b in held["parts"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(self.buckets)).cast("int")

    def _write(self, df: DataFrame, number: int) -> dict[str, str]:
        """The buckets of a new folder that have rows."""
        name = f"v{number}-{uuid.uuid4().hex[:8]}"
        dealt = df.withColumn(_BUCKET, self._bucket(self.key)).hint("rebalance", _BUCKET).sortWithinPartitions(_BUCKET, *self.order)
        dealt.write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{self.folder}/{name}")
        found = [f.getPath().getName() for f in self._fs.listStatus(self._at(name))]
        return {x.split("=")[1]: f"{name}/{x}" for x in found if x.startswith(f"{_BUCKET}=")}

    def commit(self, df: DataFrame, batch: int | None = None) -> int:
        """Replace the whole table."""
        version, held = self.pointer.current()
        last = -1 if held is None else held["batch"]
        if batch is not None and batch <= last:
            return version
        number = self.pointer.next()
        parts = self._write(df, number)
        return self.pointer.advance(number, {"batch": last if batch is None else batch, "schema": df.schema.jsonValue(), "parts": parts})

    def change(self, rows: DataFrame, keys: DataFrame, batch: int | None = None, base: int | None = None) -> int:
        """Put rows in the place of all that have one of the keys, which are those of the rows at least. base is the version to start from."""
        version, held = self.pointer.current()
        if batch is not None and held is not None and batch <= held["batch"]:
            return version
        if base is not None:
            held = self._held(base)
        if held is None:
            return self.commit(rows, batch)
        touched = [str(r[0]) for r in keys.select(self._bucket(self.key)).distinct().collect()]
        number = self.pointer.next()
        schema = T.StructType.fromJson(held["schema"])
        kept = self._read(held, touched).join(keys.select(self.key), self.key, "left_anti")
        new = kept.select(*schema.names).unionByName(rows.select(*schema.names))
        parts = {b: p for b, p in held["parts"].items() if b not in touched} | (self._write(new, number) if touched else {})
        return self.pointer.advance(number, held | {"batch": held["batch"] if batch is None else batch, "parts": parts})

    def upsert(self, rows: DataFrame, batch: int | None = None) -> int:
        return self.change(rows, rows.select(self.key).distinct(), batch)

    def delete(self, keys: DataFrame, batch: int | None = None) -> int:
        table = self.read()
        return self.version if table is None else self.change(cleared(table), keys, batch)

    def clear(self) -> int:
        table = self.read()
        return self.version if table is None else self.commit(cleared(table))

    def optimize(self, version: int | None = None) -> int:
        """Rewrite a version, or the current one, in few files."""
        table = self.read(version)
        return self.version if table is None else self.commit(table)

    def vacuum(self, keep: Iterable[int] = ()) -> None:
        """Drop what neither the current version nor one of those to keep holds."""
        kept = {self.version, *keep} - {-1}
        used = {p.split("/")[0] for n in kept for p in (self.pointer.get(n) or {"parts": {}})["parts"].values()}
        for f in self._fs.listStatus(self._at("")) if self._fs.exists(self._at("")) else []:
            name = f.getPath().getName()
            if name.startswith("v") and name != "versions" and name not in used:
                self._fs.delete(f.getPath(), True)
        self.pointer.forget(kept)

    def size_bytes(self, version: int | None = None) -> int:
        held = self._held(version)
        return 0 if held is None else sum(int(self._fs.getContentSummary(self._at(p)).getLength()) for p in held["parts"].values())
