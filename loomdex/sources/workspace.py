"""Workspaces as tables of files.

A Python data source walks the roots when it is planned, skipping what ignore files name, files
that are too large and files that aren't indexable, and cuts the list into partitions of bounded
bytes; tasks read the files. Folders that are left out aren't entered. Hidden files count. The
roots must be mounted on every machine. Texts that aren't UTF-8 are empty.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomdex.functions.language import INDEXABLE_EXTENSIONS, INDEXABLE_NAMES
from loomdex.sources import ignore

MAX_FILE_BYTES, PARTITION_BYTES, PARTITION_FILES = 10 * 1024 * 1024, 32 * 1024 * 1024, 2_000
SCHEMA = "root string, path string, size long, modified long, content string"


def is_indexable_name(name: str) -> bool:
    stem, dot, ext = name.rpartition(".")
    return ext.lower() in INDEXABLE_EXTENSIONS if dot and stem else name in INDEXABLE_NAMES


def _read(path: str) -> str:
    try:
        with open(path, encoding="utf-8", newline="") as f:
            return f.read()
    except (OSError, UnicodeDecodeError):
        return ""


def rule_texts(folder: str) -> list[str]:
    """The ignore files that a folder itself holds; .ignore outranks .gitignore."""
    return [_read(f"{folder}/{name}") for name in (".gitignore", ".ignore") if os.path.isfile(f"{folder}/{name}")]


def _rules(folder: str, base: str) -> list[ignore.Rule]:
    return [r for text in rule_texts(folder) for r in ignore.parse(text, base)]


def entries(root: str, base: str, rules: list[ignore.Rule], max_bytes: int, indexable_only: bool) -> Iterator[tuple[str, os.stat_result | None]]:
    """(path relative to root, stat) of what a folder holds and rules don't leave out, in order of names; folders have no stat."""
    try:
        found = sorted(os.scandir(f"{root}/{base}" if base else root), key=lambda e: e.name)
    except OSError:
        return
    for e in found:
        path = f"{base}/{e.name}" if base else e.name
        if e.is_dir(follow_symlinks=False):
            if not ignore.ignored(path, True, rules):
                yield path, None
        elif e.is_file() and not ignore.ignored(path, False, rules) and (not indexable_only or is_indexable_name(e.name)):
            info = e.stat()
            if info.st_size <= max_bytes:
                yield path, info


def global_texts(root: str) -> list[str]:
    """The ignore files that hold for a whole root: the user's, and the repository's own list."""
    home = os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config")
    return [_read(f) for f in (f"{home}/git/ignore", f"{root}/.git/info/exclude") if os.path.isfile(f)]


def walk(root: str, max_bytes: int = MAX_FILE_BYTES, indexable_only: bool = True, exact: bool = False) -> Iterator[tuple[str, int, int]]:
    """(path relative to root, size, modification time) of files, folder by folder in order of names; times are in seconds, or exact in nanoseconds."""
    root = root.rstrip("/")
    first = [r for text in global_texts(root) for r in ignore.parse(text)]
    stack = [("", first)]
    while stack:
        base, rules = stack.pop()
        folder = f"{root}/{base}" if base else root
        rules = [*rules, *_rules(folder, base)]
        deeper = []
        for path, info in entries(root, base, rules, max_bytes, indexable_only):
            if info is None:
                deeper.append((path, rules))
            else:
                yield path, info.st_size, info.st_mtime_ns if exact else int(info.st_mtime)
        stack += reversed(deeper)


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, str, int, int]]):
        self.files = files


class WorkspaceReader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = [r for r in options.get("roots", options.get("path", "")).split("\n") if r]
        self.max_bytes = int(options.get("maxFileBytes", MAX_FILE_BYTES))
        self.indexable_only = options.get("indexableOnly", "true") == "true"

    def partitions(self) -> list[InputPartition]:
        out, files, held = [], [], 0
        for root in self.roots:
            for path, size, modified in walk(root, self.max_bytes, self.indexable_only):
                if files and (held + size > PARTITION_BYTES or len(files) >= PARTITION_FILES):
                    out.append(_Files(files))
                    files, held = [], 0
                files.append((root.rstrip("/"), path, size, modified))
                held += size
        return [*out, _Files(files)] if files or not out else out

    def read(self, partition: _Files) -> Iterator[tuple]:
        for root, path, size, modified in partition.files:
            yield root, path, size, modified, _read(f"{root}/{path}")


class WorkspaceSource(DataSource):
    """spark.read.format("workspace").option("roots", newline-joined folders)."""

    @classmethod
    def name(cls) -> str:
        return "workspace"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WorkspaceReader(self.options)


def read_workspaces(spark: SparkSession, roots: Sequence[str], max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(path, repository, content, size, modified) of the indexable files with text; repository is the root's name, path starts with it."""
    spark.dataSource.register(WorkspaceSource)
    files = spark.read.format("workspace").option("roots", "\n".join(roots)).option("maxFileBytes", str(max_bytes)).load()
    name = F.element_at(F.split("root", "/"), -1)
    return files.where(F.length("content") > 0).select(F.concat_ws("/", name, F.col("path")).alias("path"), name.alias("repository"), "content", "size", "modified")


def read_paths(paths: DataFrame, roots: Sequence[str], max_bytes: int = MAX_FILE_BYTES, path: str = "path") -> DataFrame:
    """As read_workspaces, of the named files only; those that are gone, too large, without text or not indexable are left out."""
    of = {r.rstrip("/").rsplit("/", 1)[-1]: r.rstrip("/") for r in roots}

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p in b.column(0).to_pylist():
                name, _, rest = (p or "").partition("/")
                at = f"{of.get(name)}/{rest}"
                if name in of and is_indexable_name(rest.rsplit("/", 1)[-1]) and os.path.isfile(at):
                    info = os.stat(at)
                    if info.st_size <= max_bytes and (text := _read(at)):
                        rows.append((p, name, text, info.st_size, int(info.st_mtime)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["path", "repository", "content", "size", "modified"])

    return paths.select(path).mapInArrow(found, "path string, repository string, content string, size long, modified long")


def decoded(files: DataFrame, content: str = "content") -> DataFrame:
    """Binary contents as text: empty where they aren't UTF-8; rows without text are dropped."""
    text = F.when(F.is_valid_utf8(F.col(content).cast("string")), F.col(content).cast("string")).otherwise("")
    return files.withColumn(content, text).where(F.length(content) > 0)


def folder_bytes(spark: SparkSession, folder: str) -> int:
    """Bytes of all files below a folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(path).getLength()) if fs.exists(path) else 0
