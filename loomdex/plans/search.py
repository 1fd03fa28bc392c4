"""Search plans: from a query to a page of results, each one lazy plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.operators import lexical, vectors
from loomdex.operators.filters import name_filter, path_filter, path_repository_filter, repository_filter
from loomdex.operators.lines import SEMANTIC_CONTEXT, definition_matches, range_context
from loomdex.operators.vectors import QuantizationConfig
from loomdex.plans.config import SearchQuery

RESULT_COLUMNS = ("file_path", "repository", "line_number", "column", "content", "context_before", "context_after", "score", "match_type")


def symbol_results(query: SearchQuery, index: lexical.Index, docs: DataFrame, depth: int | None = None) -> DataFrame:
    """All result lines of a symbol query: the best depth documents, limit + offset if not given, filtered, then their definition lines.

    Filters come after the top k; with prefilter they come before it. More depth leaves more for the filters.
    """
    keep = lambda d: repository_filter(d, query.repositories)
    scores = lexical.search(index, query.query)
    if query.prefilter:
        allowed = docs.where(keep(F.col("repository")) & name_filter(F.col("path"), query.file_patterns)).select("path")
        scores = scores.join(allowed, "path", "left_semi")
    top = lexical.top_k(scores, query.limit + query.offset if depth is None else depth)
    found = lexical.fetch(top, docs.select("path", "repository", "content"))
    found = found.where(keep(F.col("repository")) & name_filter(F.col("path"), query.file_patterns))
    lines = definition_matches(found.select(F.col("path").alias("file_path"), "repository", "score", "content"), query.query)
    return lines.withColumn("match_type", F.lit("symbol")).select(*RESULT_COLUMNS)


def semantic_results(
    query: SearchQuery,
    query_vector: Sequence[float],
    chunks: DataFrame,
    docs: DataFrame,
    config: QuantizationConfig | None = None,
    glob: str = "legacy",
) -> DataFrame:
    """All results of a semantic query: the nearest limit + offset chunks, filtered, with the lines around them."""
    path = F.col("file_path")
    tests = path_repository_filter(path, query.repositories) & path_filter(path, query.file_patterns, glob)
    top = vectors.search(chunks, query_vector, query.limit + query.offset, where=tests if query.prefilter else None, config=config)
    around = range_context(top.where(tests), docs, n=SEMANTIC_CONTEXT)
    out = around.withColumns({
        "repository": F.split_part(path, F.lit("/"), F.lit(1)),
        "line_number": F.col("start_line"),
        "column": F.lit(0),
        "match_type": F.lit("semantic"),
    })
    return out.select(*RESULT_COLUMNS)


def ordered(results: DataFrame) -> DataFrame:
    return results.orderBy(F.desc("score"), "file_path", "line_number")


def page(results: DataFrame, limit: int, offset: int) -> DataFrame:
    return ordered(results).offset(offset).limit(limit)


def total_matches(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("total_matches"))


def as_json(results: DataFrame) -> DataFrame:
    return results.select(F.to_json(F.struct(*results.columns)).alias("json"))
