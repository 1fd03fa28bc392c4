"""Configuration of the engine and of queries."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import SparkSession

from loomdex.operators.vectors import QuantizationConfig

PREFIX = "spark.loomdex."


@dataclass(frozen=True)
class Config:
    """languages limits what is indexed to some languages; empty is all."""

    workspace_roots: tuple[str, ...] = ()
    cache_dir: str = ""
    max_file_size: int = 10 * 1024 * 1024
    enable_semantic: bool = True
    languages: tuple[str, ...] = ()
    file_watch_debounce_ms: int = 500
    index_buckets: int = 32
    quantization: QuantizationConfig = field(default_factory=QuantizationConfig)

    def merged(self, **changes) -> Config:
        """With some settings changed; the others stay."""
        unknown = set(changes) - set(self.__dataclass_fields__)
        if unknown:
            raise ValueError(f"no such settings: {', '.join(sorted(unknown))}")
        return replace(self, **changes)

    @classmethod
    def from_session(cls, spark: SparkSession) -> Config:
        """From the session's spark.loomdex.* settings; lists are comma-separated."""
        get = lambda key: spark.conf.get(PREFIX + key, None)
        found: dict = {}
        for key in ("workspace_roots", "languages"):
            if (v := get(key)) is not None:
                found[key] = tuple(x for x in v.split(",") if x)
        for key in ("max_file_size", "file_watch_debounce_ms", "index_buckets"):
            if (v := get(key)) is not None:
                found[key] = int(v)
        if (v := get("cache_dir")) is not None:
            found["cache_dir"] = v
        if (v := get("enable_semantic")) is not None:
            found["enable_semantic"] = v.lower() == "true"
        return cls(**found)


@dataclass(frozen=True)
class SearchQuery:
    """A query; mode is symbol or semantic, and any other is semantic. A limit of 0 means the default of 50."""

    query: str
    mode: str = "symbol"
    repositories: tuple[str, ...] | None = None
    file_patterns: tuple[str, ...] | None = None
    limit: int = 50
    offset: int = 0
    prefilter: bool = False

    def __post_init__(self) -> None:
        if self.limit < 0 or self.offset < 0:
            raise ValueError("limit and offset can't be negative")
        put = lambda k, v: object.__setattr__(self, k, v)
        put("limit", self.limit or 50)
        put("mode", "symbol" if self.mode.lower() == "symbol" else "semantic")
        for key in ("repositories", "file_patterns"):
            value = getattr(self, key)
            put(key, tuple(value) if value is not None else None)
