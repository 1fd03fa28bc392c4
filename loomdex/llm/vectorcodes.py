"""Vector compression by codes of parts, with integer arithmetic and segment-mean lower bounds.

A vector's components become integers, and the vector is cut into equal parts. Each part position
has a codebook of up to ENTRIES entries, learned by a few rounds of k-means over all vectors; a
code names the nearest entry of each part.

Nearest entries are found from coarse to fine. A block's mean and the norm of what a vector
deviates from its means bound distances from below: in each block the squared difference of
means times the block's length, plus the squared difference of the norms of the deviations. The
coarsest level has one block, each further one cuts blocks in two. At each level the entry of
the least bound gives an exact distance; entries whose bound is above the least such distance
can't be nearest, so they go. What survives gets its exact integer distance, ties going to the lower index.
Bounds are floating point, so each is lowered by more than its rounding can amount to; nothing
that could win is dropped.

Learning reads the integer vectors, which are stored once, in each round: tasks add up the
parts that each entry takes, Spark sums what tasks found, and the driver holds one codebook set, a
fixed number of integers. No vector leaves its task, so common vectors are no hot spot.

Rows whose vector is null, or holds null or non-finite components, are dropped; so are those that can't be cut
into parts, and, by the length of the vector of the smallest id, those of another length. Components beyond
2^27 in steps of 1/256 are clamped to that, so that all sums fit 64 bits. A null id comes after
all others. Rows of one id are each coded; where they compete for a first entry, the smaller vector comes
first. Equal vectors have equal codes. With fewer rows than entries there are fewer entries; an
empty table gives an empty result. Only the named columns are read and only the documented ones come out, so others
can't clash. A vector is held whole in a task, a batch of at most 500 at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdex.llm.common import small_batches, stored

PARTS, ENTRIES, ROUNDS, SCALE, MOST = 16, 64, 2, 256, 1 << 27
SALTS = 64


def whole_numbers(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", parts: int = PARTS) -> DataFrame:
    """(vec_id, label, v), stored: v has floor(256 x) of each component."""
    v = F.col(embedding).cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    whole = F.transform(v, lambda x: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(x * SCALE))).cast("int"))
    rows = df.where(finite & (F.size(embedding) > 0) & (F.size(embedding) % parts == 0))
    return stored(rows.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), whole.alias("v")))


def first_entries(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray | None:
    """Codebooks [part, entry, place] of the smallest ids' vectors; None without any. At most so many rows come to the driver."""
    order = [F.col("vec_id").isNull(), F.col("vec_id"), F.col("v")]
    one = vectors.orderBy(*order).select(F.size("v").alias("d")).first()
    if one is None:
        return None
    some = vectors.where(F.size("v") == one["d"]).orderBy(*order).limit(entries).collect()
    rows = np.array([r["v"] for r in some], np.int64)
    return np.ascontiguousarray(rows.reshape(len(rows), parts, -1).transpose(1, 0, 2))


def _levels(x: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Block sums over the square root of the block's length, and the norm of the deviations, for so many blocks."""
    edges = np.linspace(0, x.shape[1], parts + 1).astype(int)
    sizes = np.diff(edges)
    sums = np.add.reduceat(x, edges[:-1], axis=1)
    scaled = sums / np.sqrt(sizes)
    rest = (x.astype(float) - np.repeat(sums / sizes, sizes, axis=1))
    return scaled, np.sqrt((rest * rest).sum(axis=1))


def _exact(x: np.ndarray, entries: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return ((x[i] - entries[j]) ** 2).sum(axis=1)


def _least(i: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each run of equal i the least value, and the first place that has it; i is sorted and has every row."""
    starts = np.flatnonzero(np.diff(i, prepend=-1))
    least = np.minimum.reduceat(values, starts)
    at = np.flatnonzero(values == np.repeat(least, np.diff(np.append(starts, len(i)))))
    return least, at[np.flatnonzero(np.diff(i[at], prepend=-1))]


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the index of the nearest row of entries and its exact squared distance; of equal ones the lowest index. Integers.

    At each level the entry of the least bound tells an exact distance, and entries with a bound above the least one told go.
    """
    n, d = x.shape
    slack = 1e-9 * ((x.astype(float) ** 2).sum(axis=1)[:, None] + (entries.astype(float) ** 2).sum(axis=1)[None, :]) + 1e-6
    a, b = _levels(x, 1), _levels(entries, 1)
    bound = (a[0] - b[0].T) ** 2 + (a[1][:, None] - b[1][None, :]) ** 2 - slack
    most = _exact(x, entries, np.arange(n), bound.argmin(axis=1))
    i, j = np.nonzero(bound <= most[:, None])
    blocks = 2
    while blocks < d:
        a, b = _levels(x, blocks), _levels(entries, blocks)
        bound = ((a[0][i] - b[0][j]) ** 2).sum(axis=1) + (a[1][i] - b[1][j]) ** 2 - slack[i, j]
        first = _least(i, bound)[1]
        most = np.minimum(most, _exact(x, entries, i[first], j[first]))
        stays = bound <= most[i]  # the nearest entry's among them
        i, j, blocks = i[stays], j[stays], blocks * 2
    least, first = _least(i, _exact(x, entries, i, j))
    return j[first], least


def assign(v: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes [row, part] and squared distances summed over parts, of vectors [row, component]."""
    parts = v.reshape(len(v), len(books), -1)
    codes, error = np.zeros(parts.shape[:2], np.int64), np.zeros(len(v), np.int64)
    for p in range(len(books)):
        codes[:, p], far = nearest(np.ascontiguousarray(parts[:, p]), books[p])
        error += far
    return codes, error


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.int64).reshape(len(column), -1)


def learn(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every entry becomes the floored mean of the parts that are nearest to it; unused ones stay."""
    small_batches(vectors.sparkSession)
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for b in batches:
            if b.num_rows:
                v = _matrix(b.column(0))
                of = assign(v, books)[0] + np.arange(parts) * entries
                np.add.at(sums, of, v.reshape(len(v), parts, width))
                counts += np.bincount(of.ravel(), minlength=parts * entries)
        used = np.flatnonzero(counts)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * width), pa.array(sums[used].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used]), lists], names=["of", "n", "sums"])

    some = vectors.where(F.size("v") == parts * width).select("v").mapInArrow(run, "of long, n long, sums array<long>")
    means = some.groupBy("of").agg(F.sum("n").alias("n"), *(F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(width)))
    out = books.reshape(-1, width).copy()
    for r in means.collect():  # a row an entry
        out[r["of"]] = [r[f"s{k}"] // r["n"] for k in range(width)]
    return out.reshape(books.shape)


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks [part, entry, place] from all vectors of whole_numbers()."""
    books = first_entries(vectors, parts, entries)
    for _ in range(rounds if books is not None else 0):
        books = learn(vectors, books)
    return books


def encode(vectors: DataFrame, books: np.ndarray | None) -> DataFrame:
    """(vec_id, label, codes, error) of each vector that has the codebooks' length."""
    small_batches(vectors.sparkSession)
    schema = T.StructType([vectors.schema["vec_id"], vectors.schema["label"], T.StructField("codes", T.ArrayType(T.IntegerType(), False)), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                codes, error = assign(_matrix(b.column("v")), books)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * codes.shape[1]), pa.array(codes.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), lists, pa.array(error)], names=schema.fieldNames())

    fit = vectors.where(F.size("v") == (books.shape[0] * books.shape[2] if books is not None else -2))
    return fit.select("vec_id", "label", "v").mapInArrow(run, schema)


def decode(coded: DataFrame, books: np.ndarray, codes: str = "codes", out: str = "v") -> DataFrame:
    """coded with the vector of the entries that its codes name, in the components' own scale."""
    flat = F.lit([[[float(x) for x in e] for e in p] for p in (books / SCALE).tolist()])
    return coded.withColumn(out, F.flatten(F.transform(codes, lambda c, p: F.get(F.get(flat, p), c))))


def with_label_error(coded: DataFrame, out: str = "label_error") -> DataFrame:
    """coded with the errors summed over rows of one label, nulls together. A label's rows go to SALTS tasks, each of which has its sum."""
    sums = coded.groupBy("label").agg(F.sum("error").alias(out))
    sums = sums.select(F.col("label").alias("_of"), out, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_t"))
    salted = coded.withColumn("_s", F.pmod(F.xxhash64("vec_id", "codes"), F.lit(SALTS)).cast("int"))
    met = F.col("label").eqNullSafe(F.col("_of")) & (F.col("_s") == F.col("_t"))
    return salted.join(sums, met).drop("_of", "_t", "_s")


def as_hex(codes: Column) -> Column:
    return F.array_join(F.transform(codes, lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")


def compress(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray | None]:
    """(vec_id, label, codes, error, label_error) of each row that stays, and the codebooks."""
    vectors = whole_numbers(df, vec_id, embedding, label)
    books = train(vectors)
    return with_label_error(stored(encode(vectors, books))), books
