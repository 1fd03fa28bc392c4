"""The lexical index: postings, BM25 and top-k.

BM25 has k1 = 1.2, b = 0.75, idf = ln(1 + (N - n + 0.5) / (n + 0.5)) and exact text lengths. A
phrase scores like a term whose idf is the sum of its terms' and whose frequency is the phrase's.

Postings are an ordinary table (term, path, tf, positions, dl). Written, they are sorted by term
within files, so a query's few terms prune row groups; texts are fetched only for the top k.
Every reduction is a partial aggregation, statistics are one row, and the top k is Spark's
TakeOrderedAndProject.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions.text import tokens_of
from loomdex.operators.query_grammar import Group, Phrase, TermRange, parse

K1, B = 1.2, 0.75


def postings(docs: DataFrame, path: str = "path", text: str = "symbols") -> DataFrame:
    """(term, path, tf, positions, dl): a row for each distinct term of a document."""
    tokens = docs.select(F.col(path).alias("path"), tokens_of(F.col(text)).alias("_t"))
    each = tokens.select("path", F.size("_t").alias("dl"), F.posexplode("_t").alias("at", "term"))
    grouped = each.groupBy("path", "term").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("at")).alias("positions"), F.first("dl").alias("dl"))
    return grouped.select("term", "path", "tf", "positions", "dl")


def lengths(docs: DataFrame, path: str = "path", text: str = "symbols") -> DataFrame:
    """(path, dl) of every document, empty ones too."""
    return docs.select(F.col(path).alias("path"), F.size(tokens_of(F.col(text))).alias("dl"))


def term_counts(docs: DataFrame, path: str = "path", text: str = "symbols") -> DataFrame:
    """(term, df, cf): documents and places of each term; documents count their own terms first, without positions."""
    each = docs.select(F.col(path).alias("path"), F.explode(tokens_of(F.col(text))).alias("term"))
    return each.groupBy("path", "term").agg(F.count("*").alias("tf")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def statistics(dl: DataFrame) -> DataFrame:
    """One row: N, the number of documents, and avgdl."""
    return dl.agg(F.count("*").alias("N"), F.avg("dl").alias("avgdl"))


def idf(n: Column, total: Column) -> Column:
    return F.log(1 + (total - n + 0.5) / (n + 0.5))


def saturation(tf: Column, dl: Column, avgdl: Column) -> Column:
    return (K1 + 1) * tf / (tf + K1 * (1 - B + B * dl / avgdl))


@dataclass(frozen=True)
class Index:
    """Postings and document lengths; totals, if given, are maintained statistics (see term_deltas), and searches read no lengths."""

    postings: DataFrame
    lengths: DataFrame
    totals: DataFrame | None = None

    @staticmethod
    def build(docs: DataFrame, path: str = "path", text: str = "symbols") -> Index:
        return Index(postings(docs, path, text), lengths(docs, path, text))

    def write(self, folder: str) -> None:
        self.postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/postings")
        self.lengths.write.mode("overwrite").parquet(f"{folder}/lengths")

    @staticmethod
    def read(spark: SparkSession, folder: str) -> Index:
        return Index(spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/lengths"))


def _phrases(node) -> list[Phrase]:
    if isinstance(node, Group):
        return [p for part in (node.must, node.should, node.must_not) for n in part for p in _phrases(n)]
    return [node] if isinstance(node, Phrase) else []


def _ranges(node) -> list[TermRange]:
    if isinstance(node, Group):
        return [r for part in (node.must, node.should, node.must_not) for n in part for r in _ranges(n)]
    return [node] if isinstance(node, TermRange) else []


def _within(r: TermRange) -> Column:
    tests = [F.col("term") >= r.low if r.with_low else F.col("term") > r.low] if r.low is not None else []
    tests += [F.col("term") <= r.high if r.with_high else F.col("term") < r.high] if r.high is not None else []
    return reduce(and_, tests, F.lit(True))


def search(index: Index, query: str | Group, fields: tuple[str, ...] = ("symbols",)) -> DataFrame:
    """(path, score) of the documents that a query matches."""
    clause = parse(query, fields) if isinstance(query, str) else query
    phrases, ranges = _phrases(clause), _ranges(clause)
    terms = sorted({t for p in phrases for t in p.tokens})
    wanted = F.col("term").isin(*terms) if terms else F.lit(False)
    some = index.postings.where(reduce(or_, map(_within, ranges), wanted))
    at = {t: f"p{i}" for i, t in enumerate(terms)}
    found = some.groupBy("path").agg(
        F.first("dl").alias("dl"),
        *(F.max(F.when(F.col("term") == t, F.col("positions"))).alias(c) for t, c in at.items()),
        *(F.max(_within(r)).alias(f"r{i}") for i, r in enumerate(ranges)),
    )
    in_docs = some.where(wanted).groupBy().agg(F.lit(1).alias("_"), *(F.count_if(F.col("term") == t).alias(f"n_{c}") for t, c in at.items())).drop("_")
    totals = statistics(index.lengths) if index.totals is None else index.totals
    found = found.join(F.broadcast(totals.join(F.broadcast(in_docs))))

    def frequency(p: Phrase) -> Column:
        # where the phrase could begin by each of its terms: places are distinct, so the sets meet in linear time
        places = [F.coalesce(F.col(at[t]), F.array().cast("array<int>")) for t in p.tokens]
        begins = [F.transform(c, lambda x: x - k) for k, c in enumerate(places)]  # noqa: B023
        return F.size(reduce(F.array_intersect, begins))

    def compiled(node) -> tuple[Column, Column]:
        """Whether a document matches, and its score if so."""
        if isinstance(node, Phrase):
            if not node.tokens:
                return F.lit(False), F.lit(0.0)
            tf = frequency(node)
            weight = reduce(add, (idf(F.col(f"n_{at[t]}"), F.col("N")) for t in node.tokens))
            return tf > 0, node.boost * weight * saturation(tf, F.col("dl"), F.col("avgdl"))
        if isinstance(node, TermRange):
            return F.col(f"r{ranges.index(node)}"), F.lit(node.boost)
        must, should, never = ([compiled(n) for n in part] for part in (node.must, node.should, node.must_not))
        matches = reduce(and_, (m for m, _ in must), F.lit(bool(must))) if must else reduce(or_, (m for m, _ in should), F.lit(False))
        matches = matches & ~reduce(or_, (m for m, _ in never), F.lit(False))
        score = reduce(add, (F.when(m, s).otherwise(0.0) for m, s in [*must, *should]), F.lit(0.0))
        return matches, node.boost * score

    matches, score = compiled(clause)
    return found.where(matches).select("path", score.alias("score"))


def scan_scores(docs: DataFrame, terms: list[str], path: str, text: str) -> DataFrame:
    """(path, score) of documents that have any of the terms, straight from texts.

    Terms are counted inside each document's token array: nothing is exploded. The narrow counts
    are dealt out once, and both the statistics and the scores read them from there, so texts are
    cut into tokens once.
    """
    tokens = docs.select(F.col(path).alias("path"), tokens_of(F.col(text)).alias("_t"))

    def count(term: str) -> Column:
        return F.size(F.filter("_t", lambda x: x == term))

    names = [f"tf{i}" for i in range(len(terms))]
    counted = tokens.select("path", F.size("_t").alias("dl"), *(count(t).alias(c) for t, c in zip(terms, names, strict=True))).hint("rebalance", "path")
    stats = counted.agg(F.count("*").alias("N"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(c) > 0).alias(f"n{i}") for i, c in enumerate(names)))
    each = [idf(F.col(f"n{i}"), F.col("N")) * saturation(F.col(c), F.col("dl"), F.col("avgdl")) for i, c in enumerate(names)]
    some = reduce(or_, (F.col(c) > 0 for c in names))
    # a test of the score, as one of the counts would be made before the counts are dealt out
    return counted.join(F.broadcast(stats)).select("path", F.when(some, reduce(add, each)).alias("score")).where("score > 0")


def top_k(scores: DataFrame, k: int, key: str = "path") -> DataFrame:
    """The k best, ties by key."""
    if k <= 0:
        raise ValueError("limit and offset leave nothing to ask for")
    return scores.orderBy(F.desc("score"), F.asc(key)).limit(k)


def fetch(top: DataFrame, docs: DataFrame, path: str = "path") -> DataFrame:
    """Stored columns of found documents. The found side is k rows at most, so it is the broadcast one."""
    return docs.join(F.broadcast(top), docs[path] == top["path"]).drop(top["path"])
