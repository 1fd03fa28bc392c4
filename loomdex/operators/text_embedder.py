"""A text embedder made from the corpus itself: hashed TF-IDF, reduced by a randomised SVD.

Words are hashed to a fixed number of buckets. Texts are cut into words once; what is kept of them, on
disk, are their buckets and how often each is hit. Three passes over these: how
many texts have each bucket; the product of the weights' Gram matrix with a random basis; the same with that
product's orthonormal basis, from which the leading right singular vectors follow. Each task adds
up its texts' part and gives out a row a bucket; Spark sums the rows. What the driver and each
task hold is bounded by buckets times dimensions (8 and 4 MB as set), a batch and WORDS words, whatever the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdex.functions.batches import small_batches
from loomdex.functions.text import TOKEN_BYTES
from loomdex.operators.vectors import by_model

BUCKETS, DIMENSIONS, SPARE, FIT_TASKS, WORDS, GROUP, EMBEDDED = 16_384, 64, 16, 1_024, 400_000, 16, 32
_WORD, _ASTRAL = regex.compile(r"[\p{L}\p{N}]+"), re.compile("[\U00010000-\U0010ffff]")


@lru_cache(1)
def _word() -> re.Pattern:
    """_WORD below 0x10000, where re finds it in half the time: runs of the characters that _WORD knows, as ranges."""
    runs = _WORD.findall("".join(map(chr, range(0x10000))))
    return re.compile("[" + "".join(f"{x[0]}-{x[-1]}" for x in runs) + "]+")


def words_of(text: str) -> list[str]:
    return (_WORD if _ASTRAL.search(text) else _word()).findall(text)


def _bucket(word: str, buckets: int) -> int:
    return xxhash.xxh64_intdigest(word.encode(), seed=42) % buckets


class _Buckets(dict):
    """The bucket of each word met, -1 for words too long; forgets all when it has WORDS of them."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS:
            self.clear()
        at = self[word] = _bucket(word, self.buckets) if len(word.encode()) < TOKEN_BYTES else -1
        return at


_buckets_of = lru_cache(2)(_Buckets)


def term_counts(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's tokens, ascending, and how often each is hit."""
    words = words_of(text.lower())
    at, n = np.unique(np.fromiter(map(_buckets_of(buckets).__getitem__, words), np.int64, len(words)), return_counts=True)
    return (at[1:], n[1:].astype(np.float64)) if len(at) and at[0] < 0 else (at, n.astype(np.float64))


def _weighted(at: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = (1 + np.log(tf)) * idf[at] if len(at) else tf
    size = np.sqrt(w @ w)
    return (at, w / size) if size > 0 else (at[:0], w[:0])


def weights(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's buckets and weights: (1 + ln tf) idf, at length 1; none for a text without tokens."""
    return _weighted(*term_counts(text, len(idf)), idf)


def counted(df: DataFrame, text: str = "content", buckets: int = BUCKETS) -> DataFrame:
    """df with at and tf, a text's buckets and how often each is hit, in the text's place; null texts have nulls."""
    small_batches(df.sparkSession)
    others = [c for c in df.columns if c not in (text, "at", "tf")]
    schema = T.StructType([*(df.schema[c] for c in others), T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("tf", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(len(others))
            found = [term_counts(t.as_py() or "", buckets) for t in texts]
            if found:
                ends = pa.array(np.cumsum([0, *(len(at) for at, _ in found)]), pa.int32())
                lists = (pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x).astype(np.int32)), mask=texts.is_null()) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *lists], names=schema.fieldNames())

    return df.select(*others, F.col(text).cast("string").alias("_t")).mapInArrow(run, schema)


def _each(at: pa.ListArray, tf: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The counts of each text; nulls have none."""
    spans = [c.offsets.to_numpy() for c in (at, tf)]
    at, tf = (c.values.to_numpy() for c in (at, tf))
    yield from ((at[i:j], tf[k : k + j - i]) for i, j, k in zip(spans[0][:-1], spans[0][1:], spans[1], strict=False))


def _frequencies(counts: DataFrame, buckets: int) -> tuple[int, np.ndarray]:
    """The number of texts, and of those that have each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has = np.zeros(buckets + 1, np.int64)
        for b in batches:
            has += np.bincount(b.column(0).flatten().to_numpy(), minlength=buckets + 1)
            has[buckets] += b.num_rows  # the number of texts goes behind the buckets
        at = np.flatnonzero(has)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(has[at])], names=["bucket", "n"])

    made = np.zeros(buckets + 1, np.int64)
    table = counts.select("at").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # a row a bucket at most
    made[table["bucket"].to_numpy()] = table["n"].to_numpy()
    return int(made[buckets]), made[:buckets]


def _gram_times(counts: DataFrame, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The product of the weights' Gram matrix, over all texts, with a basis (buckets, columns).

    GROUP texts at a time are a dense matrix over the buckets that they have; tasks add up in single precision, Spark in double.
    """
    width = basis.shape[1]
    names = [f"c{j}" for j in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, lean = np.zeros(basis.shape, np.float32), basis.astype(np.float32)
        for b in batches:
            texts = [_weighted(*found, idf) for found in _each(*b.columns)]
            for k in range(0, len(texts), GROUP):
                at, w = (np.concatenate(x) for x in zip(*texts[k : k + GROUP], strict=True))
                some, column = np.unique(at, return_inverse=True)
                m = np.zeros((min(GROUP, len(texts) - k), len(some)), np.float32)
                m[np.repeat(np.arange(len(m)), [len(x) for x, _ in texts[k : k + GROUP]]), column] = w
                total[some] += m.T @ (m @ lean[some])
        at = np.flatnonzero(np.abs(total).sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(total[at, j].astype(float)) for j in range(width))], names=["bucket", *names])

    parts = counts.select("at", "tf").mapInArrow(run, "bucket long, " + ", ".join(f"{c} double" for c in names))
    out = np.zeros_like(basis)
    table = parts.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in names)).toArrow()  # a row a bucket at most
    out[table["bucket"].to_numpy()] = np.column_stack([table[c].to_numpy() for c in names])
    return out


@dataclass(frozen=True)
class TextEmbedder:
    """A fitted model: a function from texts to vectors of length 1, as Engine(embedder=...) and embed_with take it.

    Null and empty texts, and texts whose words the corpus lacks, get zeros. Equal texts get equal vectors.
    """

    idf: np.ndarray
    basis: np.ndarray

    @classmethod
    def fit(cls, df: DataFrame, text: str = "content", buckets: int = BUCKETS, dimensions: int = DIMENSIONS, seed: int = 7) -> TextEmbedder:
        """From all texts of df. An empty table, or one without tokens, makes a model that gives zeros."""
        counts = counted(df.select(text).coalesce(FIT_TASKS), text, buckets).persist(StorageLevel.DISK_ONLY)
        try:
            return cls.fit_counted(counts, buckets, dimensions, seed)
        finally:
            counts.unpersist()

    @classmethod
    def fit_counted(cls, counts: DataFrame, buckets: int = BUCKETS, dimensions: int = DIMENSIONS, seed: int = 7) -> TextEmbedder:
        """As fit, from what counted() made; read three times, so it had better be stored."""
        counts = counts.select("at", "tf").coalesce(FIT_TASKS)
        n, has = _frequencies(counts, buckets)
        idf = np.where(has > 0, np.log((1 + n) / (1 + has)) + 1, 0.0)
        start = np.random.default_rng(seed).standard_normal((buckets, dimensions + SPARE))
        once = np.linalg.qr(_gram_times(counts, idf, start))[0]
        twice = once.T @ _gram_times(counts, idf, once)
        values, turned = np.linalg.eigh((twice + twice.T) / 2)
        lead = np.argsort(-values)[:dimensions]
        return cls(idf, (once @ turned[:, lead]).astype(np.float32) * (values[lead] > 1e-9))

    def _vector(self, at: np.ndarray, tf: np.ndarray) -> np.ndarray:
        at, w = _weighted(at, tf, self.idf)
        v = w @ self.basis[at] if len(at) else np.zeros(self.basis.shape[1])
        size = np.sqrt(v @ v)
        return v / size if size > 0 else v * 0

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return [self._vector(*term_counts(t or "", len(self.idf))).tolist() for t in texts]

    def embed(self, df: DataFrame, text: str = "content", out: str = "embedding") -> DataFrame:
        """df with a vector for each text, none for null texts. Texts stay where they are: to embed a copy again costs less than to find it by a shuffle."""
        small_batches(df.sparkSession)
        return df.withColumn(out, F.when(F.col(text).isNotNull(), by_model(self, EMBEDDED)(F.col(text))))

    def embed_counted(self, counts: DataFrame, out: str = "embedding") -> DataFrame:
        """What counted() made, with a vector in place of at and tf, null where these are."""
        others = [c for c in counts.columns if c not in ("at", "tf", out)]
        schema = T.StructType([*(counts.schema[c] for c in others), T.StructField(out, T.ArrayType(T.FloatType()))])
        width = self.basis.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, tf = b.columns[-2:]
                made = [self._vector(*found) for found in _each(at, tf)]
                if made:
                    flat = pa.array(np.concatenate(made).astype(np.float32))
                    vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1) * width, pa.int32()), flat, mask=at.is_null())
                    yield pa.RecordBatch.from_arrays([*b.columns[:-2], vectors], names=schema.fieldNames())

        return counts.select(*others, "at", "tf").mapInArrow(run, schema)
