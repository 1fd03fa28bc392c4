"""Embedding and vector search operators.

Search is exact: distances to the one query vector are computed where the rows are, and the top
k is TakeOrderedAndProject, so nothing but k rows a task moves. Quantised modes rank by codes,
oversample, and re-score what they return with full vectors.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from enum import StrEnum

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from loomdex.functions.batches import small_batches
from loomdex.functions.vectors import code_dot, cosine, fallback_embedding, hamming, normalised, scalar_code, sign_bits

DIMENSIONS = 384


class QuantizationMode(StrEnum):
    NONE = "none"
    SCALAR = "scalar"
    BINARY = "binary"
    ASYMMETRIC = "asymmetric"

    @classmethod
    def parse(cls, name: str | None) -> QuantizationMode:
        """By name, case aside; what isn't known is scalar."""
        try:
            return cls((name or "").lower())
        except ValueError:
            return cls.SCALAR

    def bytes_per_vector(self, dimensions: int = DIMENSIONS) -> int:
        return {"none": 4 * dimensions, "scalar": dimensions}.get(self.value, dimensions // 8)

    def memory_reduction(self) -> float:
        return {"none": 0.0, "scalar": 0.75}.get(self.value, 0.97)


@dataclass(frozen=True)
class QuantizationConfig:
    mode: QuantizationMode = QuantizationMode.SCALAR
    always_ram: bool = True
    oversampling: float = 2.0
    rescore: bool = True

    @classmethod
    def of(cls, mode: QuantizationMode) -> QuantizationConfig:
        """The mode with its own oversampling."""
        times = {"none": 1.0, "scalar": 2.0, "binary": 3.0, "asymmetric": 2.5}[mode.value]
        return cls(mode, oversampling=times, rescore=mode is not QuantizationMode.NONE)

    def candidates(self, k: int) -> int:
        return k if self.mode is QuantizationMode.NONE else math.ceil(k * self.oversampling)


def as_column(vector: Sequence[float]) -> Column:
    return F.lit([float(x) for x in vector])


def code_bound(df: DataFrame, embedding: str = "embedding", quantile: float = 0.99) -> float:
    """The bound of scalar codes: a quantile of absolute values, from the whole table by a mergeable sketch."""
    values = df.select(F.explode(embedding).alias("x")).agg(F.percentile_approx(F.abs(F.col("x").cast("double")), quantile, 10_000)).first()[0]
    return float(values) if values else 1.0


def search(
    df: DataFrame,
    query: Sequence[float],
    k: int,
    embedding: str = "embedding",
    key: str = "id",
    where: Column | None = None,
    config: QuantizationConfig | None = None,
    bound: float | None = None,
) -> DataFrame:
    """The k rows of df nearest to the query by cosine, with score; ties by key. where is applied before."""
    if k <= 0:
        raise ValueError("k must be positive")
    config = config or QuantizationConfig(QuantizationMode.NONE)
    rows = df if where is None else df.where(where)
    q, v = as_column(query), F.col(embedding)
    exact = cosine(v, q)
    if config.mode is QuantizationMode.NONE:
        return rows.withColumn("score", exact).orderBy(F.desc("score"), F.asc(key)).limit(k)
    if config.mode is QuantizationMode.SCALAR:
        b = F.lit(bound if bound is not None else code_bound(df, embedding))
        rough = code_dot(scalar_code(normalised(v), b), scalar_code(normalised(q), b)).cast("double")
    elif config.mode is QuantizationMode.BINARY:
        rough = -hamming(sign_bits(v), sign_bits(q)).cast("double")
    else:  # signs against the full query
        rough = F.aggregate(F.zip_with(v, q, lambda x, y: F.when(x > 0, y).otherwise(-y)), F.lit(0.0), lambda s, x: s + x)
    near = rows.withColumn("score", rough).orderBy(F.desc("score"), F.asc(key)).limit(config.candidates(k))
    if config.rescore:
        near = near.withColumn("score", exact)
    return near.orderBy(F.desc("score"), F.asc(key)).limit(k)


def mean_pool(tokens: DataFrame, keys: Sequence[str], embedding: str = "embedding", mask: str | None = None) -> DataFrame:
    """Mean of the vectors of each key, by dimension, over rows whose mask is above 0; zeros where there are none."""
    on = F.lit(True) if mask is None else F.col(mask) > 0
    each = tokens.select(*keys, on.alias("_on"), F.posexplode(embedding).alias("_i", "_x"))
    dims = each.groupBy(*keys, "_i").agg(F.coalesce(F.avg(F.when(F.col("_on"), F.col("_x").cast("double"))), F.lit(0.0)).alias("_x"))
    return dims.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias(embedding))


def embed(df: DataFrame, text: str = "content", out: str = "embedding") -> DataFrame:
    """Fallback vectors, made from texts' hashes; they carry no meaning. Equal texts have equal ones, so no memo is needed."""
    return df.withColumn(out, fallback_embedding(F.col(text)))


def by_model(model, batch: int):
    @pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        rows = texts.tolist()
        return pd.Series([v for at in range(0, len(rows), batch) for v in model(rows[at : at + batch])])

    return run


def embed_with(df: DataFrame, model, text: str = "content", out: str = "embedding", batch: int = 32) -> DataFrame:
    """Vectors from a model: a function from a list of texts to a list of vectors, called with batches.

    Each distinct text is embedded once, and the vectors are joined back by the text's hash. A task holds one small batch of texts.
    """
    small_batches(df.sparkSession)
    keyed = df.withColumn("_hash", F.sha2(text, 256))
    once = keyed.select("_hash", text).dropDuplicates(["_hash"]).select("_hash", by_model(model, batch)(F.col(text)).alias(out))
    return keyed.join(once, "_hash", "left").drop("_hash")


def embed_lasting(df: DataFrame, model, folder: str, text: str = "content", out: str = "embedding", batch: int = 32) -> DataFrame:
    """As embed_with, with a memo in a folder that outlives the session: only texts that it lacks reach the model.

    The memo is a table of (hash, vector) that grows by one append a run; a run that fails before its append is committed leaves it
    as it was. Should two runs have added one text, one of its vectors is taken. Null texts have no vector.
    """
    spark = df.sparkSession
    small_batches(spark)
    keyed = df.withColumn("_hash", F.sha2(text, 256))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    held = lambda: spark.read.schema("_hash string, _v array<float>").parquet(folder).dropDuplicates(["_hash"])
    lacking = keyed.where(F.col(text).isNotNull()).select("_hash", text)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        lacking = lacking.join(held().select("_hash"), "_hash", "left_anti")
    lacking.dropDuplicates(["_hash"]).select("_hash", by_model(model, batch)(F.col(text)).alias("_v")).write.mode("append").parquet(folder)
    return keyed.drop(out).join(held().withColumnRenamed("_v", out), "_hash", "left").drop("_hash")
