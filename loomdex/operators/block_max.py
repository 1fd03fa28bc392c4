"""Top k by BM25 from postings in blocks, of which those that can't matter are never scored.

Each task puts its documents in order of their length, cuts them into blocks, counts their terms an Arrow batch at a
time, and stores its postings sorted by term and block: neither texts nor postings are shuffled. A term's first posting in
a block also has the term's number of documents, largest frequency and shortest document there; the latter two bound what any
document of the block can add to a score. The sum of these bounds over a query's terms bounds what a document of the block
can reach. The k blocks of the highest bounds are scored first, and the k-th score among them is a threshold: other blocks
whose bound is below it are left out, by a pushed filter where few remain, by a join otherwise. The result is that of
scoring everything.

Statistics are those of the table when it was built. Terms that no document has add nothing; with no such
document at all the result is empty. Ties go by path; a document's shares are added in the order of the terms. Null texts
and null paths have no postings, and null texts don't count as documents. A path that repeats is one document with all its
tokens' postings, as long as its longest row; where one does, as a job over the paths tells first, terms are grouped by path.
The driver holds the query's terms, k rows, and at most LISTED block numbers; a Python worker holds a batch of documents
and their postings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions.batches import small_batches
from loomdex.functions.text import tokens_of
from loomdex.operators import lexical

BLOCK_DOCS, LISTED, SLACK = 128, 1000, 1e-9
_IN_PART = 33
_COLUMNS = "term string, block long, path {}, tf int, dl int, n int, most int, least int"


def _documents(docs: DataFrame, path: str, text: str) -> DataFrame:
    """(path, terms) in order of length within tasks; if paths repeat, (path, terms, tfs, dl), each term once."""
    docs = docs.select(F.col(path).alias("path"), F.col(text).alias("_text")).where("path IS NOT NULL")
    once = docs.groupBy("path").count().where("count > 1").isEmpty()
    docs = docs.where("_text IS NOT NULL")
    if once:
        return docs.sortWithinPartitions(F.octet_length("_text"), "path").select("path", tokens_of(F.col("_text")).alias("terms"))
    tokens = docs.select("path", tokens_of(F.col("_text")).alias("_t"))
    each = tokens.select("path", F.size("_t").alias("dl"), F.explode_outer("_t").alias("term"))
    counted = each.groupBy("path", "term").agg(F.count("term").cast("int").alias("tf"), F.max("dl").alias("dl"))
    # a text without tokens has one row without term, which the list leaves out
    listed = counted.groupBy("path").agg(F.max("dl").alias("dl"), F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "tf"))).alias("_c"))
    return listed.sortWithinPartitions("dl", "path").select("path", F.col("_c.term").alias("terms"), F.col("_c.tf").alias("tfs"), "dl")


def _postings(block_docs: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Postings of batches of documents, by term and block; a block ends with its batch at the latest. A row without term has the batch's documents and tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << _IN_PART
        for batch in batches:
            docs, lists = batch.num_rows, batch.column("terms")
            if not docs:
                continue
            sizes, given = lists.value_lengths().to_numpy(zero_copy_only=False), "tfs" in batch.schema.names
            dl = batch.column("dl").to_numpy(zero_copy_only=False) if given else sizes
            coded = lists.flatten().dictionary_encode()
            order = pc.array_sort_indices(coded.dictionary)
            rank = np.empty(len(order), np.int64)
            rank[order.to_numpy()] = np.arange(len(order))
            # one number for term and document, in the order of postings
            key = rank[coded.indices.to_numpy(zero_copy_only=False)] * docs + np.repeat(np.arange(docs), sizes)
            if given:
                by = np.argsort(key)
                key, tf = key[by], batch.column("tfs").flatten().to_numpy(zero_copy_only=False)[by]
            else:
                key, tf = np.unique(key, return_counts=True)
            term, doc = key // docs, key % docs
            place, long = doc // block_docs, dl[doc]
            opens = np.ones(len(key), bool)
            opens[1:] = (term[1:] != term[:-1]) | (place[1:] != place[:-1])
            first = np.flatnonzero(opens)

            def on_first(values: np.ndarray, opens: np.ndarray = opens, first: np.ndarray = first) -> pa.Array:
                out = np.zeros(len(opens), np.int32)
                out[first] = values
                return pa.array(out, mask=~opens)

            made = {
                "term": coded.dictionary.take(order).take(pa.array(term)),
                "block": pa.array(block + place, pa.int64()),
                "path": batch.column("path").take(pa.array(doc)),
                "tf": pa.array(tf, pa.int32()),
                "dl": pa.array(long, pa.int32()),
                "n": on_first(np.diff(np.append(first, len(key)))),
                "most": on_first(np.maximum.reduceat(tf, first) if len(key) else tf),
                "least": on_first(np.minimum.reduceat(long, first) if len(key) else long),
            }
            found = pa.RecordBatch.from_pydict(made)
            yield found
            yield pa.RecordBatch.from_pylist([{"block": block, "tf": int(dl.sum()), "n": docs}], found.schema)
            block += -(-docs // block_docs)

    return run


@dataclass(frozen=True)
class BlockMax:
    """Postings (term, block, path, tf, dl; n, most, least on a term's first in a block; rows without term for totals) in a folder."""

    folder: str

    @staticmethod
    def build(docs: DataFrame, folder: str, path: str = "path", text: str = "symbols", block_docs: int = BLOCK_DOCS) -> BlockMax:
        small_batches(docs.sparkSession)
        whole = _documents(docs, path, text)
        found = whole.mapInArrow(_postings(block_docs), _COLUMNS.format(whole.schema["path"].dataType.simpleString()))
        found.sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{folder}/postings")
        return BlockMax(folder)

    def _table(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/postings")

    def _weights(self, spark: SparkSession, terms: Sequence[str]) -> tuple[Column, float]:
        """The inverse document frequency of a row's term, and the average length."""
        heads = self._table(spark).where((F.col("term").isin(*terms) | F.col("term").isNull()) & F.col("n").isNotNull())
        found = {r["term"]: r for r in heads.groupBy("term").agg(F.sum("n").alias("n"), F.sum("tf").alias("tokens")).collect()}
        total = found[None]["n"] if None in found else 0
        weight = F.lit(None).cast("double")
        for t in terms:
            weight = F.when(F.col("term") == t, lexical.idf(F.lit(found[t]["n"] if t in found else 0), F.lit(total))).otherwise(weight)
        return weight, (found[None]["tokens"] / total if total else 0) or 1.0

    def needed(self, spark: SparkSession, terms: Sequence[str], k: int) -> DataFrame:
        """(path, term, share) of the postings in blocks that can hold one of the k best."""
        terms = sorted(set(terms))
        if k <= 0 or not terms:
            raise ValueError("a search needs terms and a positive k")
        weight, avgdl = self._weights(spark, terms)
        share = lambda tf, dl: weight * lexical.saturation(F.col(tf), F.col(dl), F.lit(avgdl))
        rows = self._table(spark).where(F.col("term").isin(*terms))
        bounds = rows.where("n IS NOT NULL").groupBy("block").agg(F.sum(share("most", "least")).alias("bound"))
        first = [r["block"] for r in bounds.orderBy(F.desc("bound"), "block").limit(k).collect()]
        scored = lambda some: some.select("path", "term", share("tf", "dl").alias("share"))
        best = lexical.top_k(self._scores(scored(rows.where(F.col("block").isin(first))), terms), k).collect()
        if len(best) < k:  # fewer blocks than k, all of them scored, or fewer documents
            return scored(rows)
        able = bounds.where(F.col("bound") >= best[-1]["score"] - SLACK).select("block")
        some = [r["block"] for r in able.limit(LISTED + 1).collect()]
        return scored(rows.where(F.col("block").isin(some)) if len(some) <= LISTED else rows.join(able, "block", "left_semi"))

    @staticmethod
    def _scores(shares: DataFrame, terms: Sequence[str]) -> DataFrame:
        """(path, score); equal documents have equal scores to the last bit, as shares are added in one order."""
        each = [F.coalesce(F.max(F.when(F.col("term") == t, F.col("share"))), F.lit(0.0)) for t in sorted(set(terms))]
        return shares.groupBy("path").agg(reduce(add, each).alias("score"))

    def top_k(self, spark: SparkSession, terms: Sequence[str], k: int) -> DataFrame:
        """(path, score) of the k best."""
        return lexical.top_k(self._scores(self.needed(spark, terms, k), terms), k)
