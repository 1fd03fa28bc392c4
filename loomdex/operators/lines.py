"""Line operators: explode, definition matches, context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.functions.text import byte_position, is_definition, lines_of

SYMBOL_CONTEXT, SEMANTIC_CONTEXT = 3, 2


def explode_lines(df: DataFrame, text: str = "content", keep_lines: bool = False) -> DataFrame:
    """A row for each line: line_number from 1 and content; with keep_lines also the array of all lines."""
    others = [c for c in df.columns if c != text]
    made = df.select(*others, lines_of(F.col(text)).alias("_lines"))
    out = made.select(*others, *(["_lines"] if keep_lines else []), F.posexplode("_lines").alias("_at", text))
    return out.withColumn("line_number", F.col("_at") + 1).drop("_at")


def before(lines: str | Column, number: Column, n: int) -> Column:
    """Up to n lines before a 1-based line."""
    return F.slice(lines, F.greatest(number - n, F.lit(1)), F.least(number - 1, F.lit(n)))


def after(lines: str | Column, number: Column, n: int) -> Column:
    return F.slice(lines, number + 1, F.lit(n))


def definition_matches(docs: DataFrame, query: str, text: str = "content", context: int = SYMBOL_CONTEXT) -> DataFrame:
    """A row for each line that has a definition word and the query: its number, byte column, text and context.

    Lines are filtered inside their array, so only matches are exploded.
    """
    others = [c for c in docs.columns if c != text]
    made = docs.select(*others, lines_of(F.col(text)).alias("_lines"))
    numbered = F.transform("_lines", lambda x, i: F.struct((i + 1).alias("n"), x.alias("t")))
    hits = made.select(*others, "_lines", F.explode(F.filter(numbered, lambda x: is_definition(x["t"], query))).alias("_hit"))
    n = F.col("_hit.n")
    return hits.select(
        *others,
        n.alias("line_number"),
        byte_position(query, F.col("_hit.t")).alias("column"),
        F.col("_hit.t").alias(text),
        before("_lines", n, context).alias("context_before"),
        after("_lines", n, context).alias("context_after"),
    )


def range_context(chunks: DataFrame, docs: DataFrame, path: str = "file_path", n: int = SEMANTIC_CONTEXT) -> DataFrame:
    """chunks with the lines around start_line..end_line in the current text of their file; empty where the file is gone."""
    texts = docs.select(F.col("path").alias("_path"), lines_of(F.col("content")).alias("_lines"))
    empty = F.array().cast("array<string>")
    joined = chunks.join(texts, chunks[path] == texts["_path"], "left")
    return joined.withColumns({
        "context_before": F.coalesce(before("_lines", F.col("start_line"), n), empty),
        "context_after": F.coalesce(after("_lines", F.col("end_line"), n), empty),
    }).drop("_path", "_lines")
