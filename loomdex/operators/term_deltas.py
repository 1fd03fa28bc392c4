"""Statistics of a collection, maintained as signed deltas of its changes and folded at read.

A change costs the texts it touches; neither all texts nor all lengths are read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions.text import tokens_of

_SUMS = ("df", "cf", "docs", "tokens")
_SCHEMA = "term string, df long, cf long, docs long, tokens long, kind string, batch long"


def deltas(before: DataFrame | None, after: DataFrame | None, path: str = "path", text: str = "content") -> DataFrame:
    """(term, df, cf, docs, tokens): what a change adds; before and after are the changed documents as they were and are.

    Documents and places of each term, and in one row without term the number of documents and of
    tokens. A null text is an empty one. A document that stays the same adds nothing, and terms
    that nothing changes have no row. Rows that repeat a path on one side are one document. Where none
    does, as a job over the paths tells first, a document's distinct terms are found in its own row, and tasks
    add up by term before anything moves; else its terms are grouped by path before.
    """
    if before is None and after is None:
        raise ValueError("a change has documents before or after it")
    signed = lambda df, sign: df.select(F.col(path).alias("path"), F.coalesce(tokens_of(F.col(text)), F.array().cast("array<string>")).alias("_t"), F.lit(sign).cast("long").alias("_s"))
    sides = [signed(df, sign) for df, sign in ((before, -1), (after, 1)) if df is not None]
    each = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    zero = F.lit(0).cast("long")
    if each.groupBy("path", "_s").count().where("count > 1").isEmpty():
        # of each row all tokens, the distinct ones, and one entry without term for the document itself: one pass makes all sums
        views = each.select("_s", F.size("_t").alias("_n"), F.posexplode(F.array("_t", F.array_distinct("_t"), F.array(F.lit(None).cast("string")))).alias("_view", "_t"))
        placed = views.select("_s", "_n", "_view", F.explode("_t").alias("term"))
        total = lambda k, c: F.sum(F.when(F.col("_view") == k, c).otherwise(zero))
        made = placed.groupBy("term").agg(total(1, F.col("_s")).alias("df"), total(0, F.col("_s")).alias("cf"), total(2, F.col("_s")).alias("docs"), total(2, F.col("_s") * F.col("_n")).alias("tokens"))
    else:
        counted = each.select("path", "_s", F.explode("_t").alias("term")).groupBy("path", "_s", "term").agg(F.count("*").alias("_n"))
        terms = counted.groupBy("term").agg(F.sum("_s").alias("df"), F.sum(F.col("_s") * F.col("_n")).alias("cf")).select("term", "df", "cf", zero.alias("docs"), zero.alias("tokens"))
        whole = each.agg(F.coalesce(F.sum("_s"), zero).alias("docs"), F.coalesce(F.sum(F.col("_s") * F.size("_t")), zero).alias("tokens"))
        made = terms.unionByName(whole.select(F.lit(None).cast("string").alias("term"), zero.alias("df"), zero.alias("cf"), "docs", "tokens"))
    return made.where("df <> 0 OR cf <> 0 OR docs <> 0 OR tokens <> 0")


class TermStatistics:
    """Deltas below a shared folder, a part for each batch of changes, and sums of all up to a batch.

    A batch that is delivered again replaces its own part, so it counts once as long as no sum
    holds it yet; fold() only what will not come again.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def apply(self, batch: int, before: DataFrame | None = None, after: DataFrame | None = None, path: str = "path", text: str = "content") -> None:
        deltas(before, after, path, text).write.mode("overwrite").parquet(f"{self.folder}/kind=delta/batch={batch}")

    def _parts(self) -> DataFrame:
        """The newest sum and the deltas after it."""
        all_ = self.spark.read.schema(_SCHEMA).parquet(self.folder)
        # the partitions' names: one number comes to the driver, and the parts before it are never opened
        newest = all_.where("kind = 'sum'").agg(F.max("batch")).first()[0]
        return all_ if newest is None else all_.where(((F.col("kind") == "sum") & (F.col("batch") == newest)) | ((F.col("kind") == "delta") & (F.col("batch") > newest)))

    def _folded(self) -> DataFrame:
        summed = self._parts().groupBy("term").agg(*(F.sum(c).alias(c) for c in _SUMS))
        return summed.where("df <> 0 OR docs <> 0")

    def fold(self, batch: int) -> None:
        """Sum everything up to a batch, the last applied, so that reads open one part and what follows it."""
        self._folded().write.mode("overwrite").parquet(f"{self.folder}/kind=sum/batch={batch}")

    def terms(self) -> DataFrame:
        """(term, df, cf) of the terms that documents have now."""
        return self._folded().where(F.col("term").isNotNull()).select("term", "df", "cf")

    def totals(self) -> DataFrame:
        """One row as lexical.statistics has it: N and avgdl; avgdl is null without documents."""
        found = self._parts().where(F.col("term").isNull()).agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("N"), F.sum("tokens").alias("_t"))
        return found.select("N", F.when(F.col("N") > 0, F.col("_t") / F.col("N")).alias("avgdl"))
