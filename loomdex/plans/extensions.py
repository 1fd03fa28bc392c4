"""Further search modes: literal, regular expression, fuzzy, and fusion of rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.functions.text import tokens_of
from loomdex.operators.lines import explode_lines


def literal_search(docs: DataFrame, needle: str, text: str = "content") -> DataFrame:
    """Lines that contain a text."""
    return explode_lines(docs.where(F.contains(F.col(text), F.lit(needle))), text).where(F.contains(F.col(text), F.lit(needle)))


def regex_search(docs: DataFrame, pattern: str, text: str = "content") -> DataFrame:
    """Lines in which a regular expression is found."""
    return explode_lines(docs, text).where(F.col(text).rlike(pattern))


def closeness(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def fuzzy_search(docs: DataFrame, word: str, threshold: float = 0.75, path: str = "path", text: str = "content") -> DataFrame:
    """Distinct tokens of each document at or above a closeness to a word."""
    tokens = docs.select(F.col(path).alias("path"), F.explode(F.array_distinct(tokens_of(F.col(text)))).alias("token"))
    spread = int(len(word) / threshold - len(word)) + 1
    near = tokens.where(F.abs(F.length("token") - len(word)) <= spread).withColumn("score", closeness(F.col("token"), F.lit(word)))
    return near.where(F.col("score") >= threshold)


def reciprocal_rank_fusion(a: DataFrame, b: DataFrame, limit: int, key: str = "path", k: int = 60) -> DataFrame:
    """(key, score): sums of 1 / (k + rank) over two rankings (key, rank). Rankings are top lists, so their join is small."""
    both = a.select(key, F.col("rank").alias("ra")).join(b.select(key, F.col("rank").alias("rb")), key, "full_outer")
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    return both.select(key, (part("ra") + part("rb")).alias("score")).orderBy(F.desc("score"), key).limit(limit)


def ranked(top: DataFrame, key: str = "path") -> DataFrame:
    """A top list with its ranks from 1: the list is bounded, so one window holds it."""
    from pyspark.sql import Window

    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))
