"""The engine: workspaces in, searches out.

    with Engine(spark, Config(workspace_roots=("/src/app",), cache_dir="/shared/index")) as e:
        e.search_symbols("parse").results.show()
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions.language import detect_language
from loomdex.functions.vectors import fallback_embedding
from loomdex.operators import metadata, vectors
from loomdex.operators.chunks import chunk_files
from loomdex.operators.lexical import Index
from loomdex.operators.metadata import Pointer, VersionedTable
from loomdex.operators.symbols import symbols_text, with_symbols
from loomdex.plans import search
from loomdex.plans.cache import ResultCache
from loomdex.plans.config import Config, SearchQuery
from loomdex.sources.workspace import folder_bytes, read_paths, read_workspaces
from loomdex.streaming.changes import DELETED, Watcher, last_per_path, watch_workspaces


class NotStarted(RuntimeError):
    """The engine was asked before it was started."""


@dataclass(frozen=True)
class SearchResponse:
    """One page; results is a table of the rows that rows holds."""

    query: str
    rows: list
    results: DataFrame
    total_matches: int
    search_time_ms: int
    from_cache: bool = False


def document_rows(files: DataFrame) -> DataFrame:
    """What the index holds of files: their symbols and the range of their lines."""
    made = with_symbols(files).withColumn("symbols", symbols_text(F.col("symbol_list")))
    lines = F.size(F.split(F.regexp_replace("content", r"\n\z", ""), "\n"))
    return made.select("path", "content", "language", "symbols", F.concat(F.lit("1-"), lines.cast("string")).alias("line_numbers"), "repository", F.size("symbol_list").alias("n_symbols"))


class Engine:
    """embedder turns texts into vectors; without one, semantic search finds nothing, as hashes carry no meaning."""

    def __init__(self, spark: SparkSession, config: Config | None = None, embedder: Callable[[list[str]], list] | None = None, clock: Callable[[], float] = time.time):
        self.spark, self.config, self.embedder, self.clock = spark, config or Config.from_session(spark), embedder, clock
        self.cache = ResultCache()
        self._watcher: Watcher | None = None
        self._open()
        self.started = False

    def _open(self) -> None:
        if not self.config.cache_dir:
            raise ValueError("cache_dir must name a folder that all machines share")
        at = lambda name, key="path", order=(): VersionedTable(self.spark, f"{self.config.cache_dir}/{name}", key, self.config.index_buckets, order)
        self.tables = {"documents": at("documents"), "files": at("files"), "chunks": at("chunks", "file_path"), "postings": at("index/postings", order=("term",)), "lengths": at("index/lengths")}
        self._state = Pointer(self.spark, f"{self.config.cache_dir}/state")

    def state(self) -> dict:
        """The versions of the tables that belong together, and the last batch of changes they hold."""
        return self._state.current()[1] or {"tables": {}, "batch": -1}

    def read(self, name: str, state: dict | None = None) -> DataFrame | None:
        """A table as the state has it."""
        version = (state or self.state())["tables"].get(name)
        return None if version is None else self.tables[name].read(version)

    def __enter__(self) -> Engine:
        return self.start()

    def __exit__(self, *_) -> None:
        self.stop()

    def start(self) -> Engine:
        if not self.started:
            self.started = True
            self.reindex()
        return self

    def stop(self) -> None:
        if self._watcher:
            self._watcher.stop()
            self._watcher = None
        self.started = False

    def configure(self, **changes) -> Engine:
        """Stop, change some settings, open again."""
        was = self.started
        self.stop()
        self.config = self.config.merged(**changes)
        self.cache.clear()
        self._open()
        return self.start() if was else self

    def _scan(self, repositories: Sequence[str] | None = None) -> DataFrame:
        roots = [r for r in self.config.workspace_roots if repositories is None or r.rstrip("/").rsplit("/", 1)[-1] in repositories]
        return self._kept(read_workspaces(self.spark, roots, self.config.max_file_size))

    def _kept(self, found: DataFrame) -> DataFrame:
        """Files with their language, of the languages that are indexed."""
        found = found.withColumn("language", detect_language(F.col("path"), F.col("content")))
        return found.where(F.col("language").isin(*self.config.languages)) if self.config.languages else found

    def _chunks_of(self, files: DataFrame) -> DataFrame:
        chunks = chunk_files(files)
        return vectors.embed_with(chunks, self.embedder) if self.embedder else chunks.withColumn("embedding", fallback_embedding(F.col("content")).cast("array<float>"))

    def reindex(self, repositories: Sequence[str] | None = None) -> dict[str, int]:
        """Bring the index up to date with the workspaces, or with some repositories; returns counts by status.

        Files are compared by hash; unchanged ones keep their rows and get a new time, files
        that are gone are removed with their chunks.
        """
        self._check()
        known = self.read("files")
        if known is not None and repositories is not None:
            known = known.where(F.split_part("path", F.lit("/"), F.lit(1)).isin(*repositories))
        return self._bring(self._scan(repositories), known)

    def _bring(self, found: DataFrame, known: DataFrame | None, batch: int | None = None) -> dict[str, int]:
        """Make the tables hold what was found in the place of what was known of it.

        Every table gets a new version, in which only the changed files' buckets are written; the
        state that names these versions comes last. So a search sees all of a change or nothing,
        and after a crash in between the change is simply made again from the old state.
        """
        files = found.persist()
        status = None
        try:
            now = metadata.file_metadata(files, int(self.clock()), modified="modified")
            status = metadata.diff(now, self.spark.createDataFrame([], now.schema) if known is None else known).persist()
            counts = {r["status"]: r["count"] for r in status.groupBy("status").count().collect()}
            state = self.state()
            versions = dict(state["tables"])
            change = lambda name, rows, keys: versions.update({name: self.tables[name].change(rows, keys, base=versions.get(name, -1))})
            changed = status.where("status <> 'unchanged'").select("path")
            if set(counts) - {"unchanged"}:
                fresh = files.join(status.where(F.col("status").isin("new", "changed")), "path", "left_semi")
                change("documents", document_rows(fresh), changed)
                if self.config.enable_semantic:
                    change("chunks", self._chunks_of(fresh), changed.withColumnRenamed("path", "file_path"))
                made = self.tables["documents"].read(versions["documents"]).join(changed, "path", "left_semi").select("path", "symbols")
                index = Index.build(made)
                change("postings", index.postings, changed)
                change("lengths", index.lengths, changed)
            if counts:
                change("files", now, status.select("path"))
            if counts or batch is not None:
                self._state.advance(self._state.next(), {"tables": versions, "batch": state["batch"] if batch is None else batch})
                self.cache.invalidate(versions.get("documents", -1))
            return counts
        finally:
            files.unpersist()
            if status is not None:
                status.unpersist()

    def watch(self, events: DataFrame | None = None, available_now: bool = False, settled: bool = False) -> None:
        """Follow the workspaces, or a stream of (path, kind, ts, event_id) with paths as read_workspaces has them.

        A batch reads the files it names and no others. One that is delivered again changes nothing.
        settled holds a path's events until it has been quiet for the debounce time (see Watcher).
        """
        self._check()
        if self._watcher is None:
            if events is None:
                events = watch_workspaces(self.spark, self.config.workspace_roots, self.config.max_file_size)

            def apply(batch: DataFrame, number: int) -> None:
                if number <= self.state()["batch"]:
                    return
                last = last_per_path(batch).persist()
                try:
                    if last.isEmpty():
                        return
                    named = read_paths(last.where(F.col("kind") != DELETED), self.config.workspace_roots, self.config.max_file_size)
                    known = self.read("files")
                    self._bring(self._kept(named), None if known is None else known.join(last.select("path"), "path", "left_semi"), number)
                finally:
                    last.unpersist()

            self._watcher = Watcher(events, apply, f"{self.config.cache_dir}/watch", f"{self.config.file_watch_debounce_ms} milliseconds", settled)
        self._watcher.start(available_now)

    def is_watching(self) -> bool:
        return self._watcher is not None and self._watcher.is_watching()

    def _check(self) -> None:
        if not self.started:
            raise NotStarted("start the engine first")

    def search(self, query: SearchQuery) -> SearchResponse:
        self._check()
        began = time.perf_counter()
        state = self.state()
        version = state["tables"].get("documents", -1)
        if cached := self.cache.get(query, version):
            return SearchResponse(cached.query, cached.rows, cached.results, cached.total_matches, cached.search_time_ms, True)
        found = self._results(query, state)
        if found is None:
            rows, results, total = [], self.spark.createDataFrame([], "file_path string"), 0
        else:
            found = found.persist()
            total = search.total_matches(found).first()[0]
            rows = search.page(found, query.limit, query.offset).collect()
            results = self.spark.createDataFrame(rows, found.schema)
            found.unpersist()
        response = SearchResponse(query.query, rows, results, total, int((time.perf_counter() - began) * 1000))
        self.cache.put(query, response, version)
        return response

    def _results(self, query: SearchQuery, state: dict) -> DataFrame | None:
        docs = self.read("documents", state)
        if docs is None:
            return None
        if query.mode == "symbol":
            return search.symbol_results(query, Index(self.read("postings", state), self.read("lengths", state)), docs)
        chunks = self.read("chunks", state)
        if self.embedder is None or chunks is None or not self.config.enable_semantic:
            return None
        return search.semantic_results(query, self.embedder([query.query])[0], chunks, docs, self.config.quantization)

    def search_symbols(self, query: str, **how) -> SearchResponse:
        return self.search(SearchQuery(query, "symbol", **how))

    def search_semantic(self, query: str, **how) -> SearchResponse:
        return self.search(SearchQuery(query, "semantic", **how))

    def index_status(self) -> dict:
        """Counts and sizes; total_symbols is the estimate of 20 a file, exact_symbols what was found."""
        self._check()
        state = self.state()
        files, docs = self.read("files", state), self.read("documents", state)
        n = 0 if files is None else files.count()
        exact = 0 if docs is None else docs.agg(F.sum("n_symbols")).first()[0] or 0
        return {
            "indexed_files": n,
            "total_symbols": n * metadata.SYMBOLS_PER_FILE,
            "exact_symbols": exact,
            "index_size_bytes": folder_bytes(self.spark, f"{self.config.cache_dir}/index"),
            "cache_size_bytes": folder_bytes(self.spark, self.config.cache_dir),
            "file_watching_active": self.is_watching(),
        }

    def optimize(self) -> None:
        """Rewrite all tables in few files and drop what only earlier states hold."""
        self._check()
        state = self.state()
        if not state["tables"]:
            return
        versions = {name: self.tables[name].optimize(n) for name, n in state["tables"].items()}
        self._state.advance(self._state.next(), state | {"tables": versions})
        self._state.forget(set())
        for name, n in versions.items():
            self.tables[name].vacuum([n])
