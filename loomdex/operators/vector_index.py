"""Vector search for many queries: exact by blocks, approximate by an inverted file, and over stored codes.

Exact. Rows and queries are dealt into blocks of at most BLOCK_BYTES of vectors; a task holds one pair of blocks and
goes through its products tile by tile, in single precision: what its error leaves possible beside the k best so far is computed
again in double. A query's partial lists are merged by a window that drops all but k rows of each before and after the
shuffle. Products grow with rows times queries; each row is copied for every block of queries, and the other way round.

Inverted file. Centroids are fitted by k-means on a sample of SAMPLE_ROWS or so unit vectors; every row is then
put in the cell of its nearest centroid, and what it deviates from the centroid is stored as one byte a
dimension. A query meets the rows of the cells nearest to it by a join on the cell; large cells and
much-asked ones are split, so none is one task's. The best by codes are scored again with full vectors. How
many cells a query is to visit is found when the index is built: for CALIBRATION rows the cells of their true
neighbours are ranked by distance, and the number that covers TARGET of them is kept. recall() measures what a search finds.

Stored codes. A code table holds bytes and sign bits instead of vectors. A search reads only the column that its mode
ranks by; full vectors are read for the candidates alone, by an id filter that prunes a table sorted by id.

Scores are cosines, ranked as rounded to 9 places, ties by id. Rows whose id or vector is null, or whose vector is empty
or holds null or non-finite numbers, or differs in length from the queries', are left out; a zero vector scores 0. A row
isn't its own neighbour. Rows that repeat an id are rows of their own. Tasks hold centroids, a batch, and at most PROBED_BYTES of
what is made of it (one query with its cells at least). The driver holds centroids (MOST_CELLS at most), counts of
cells and the candidates of a single query.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdex.functions.vectors import code_dot, cosine, normalised, scalar_code, sign_bits
from loomdex.operators.vectors import QuantizationConfig, QuantizationMode, as_column, code_bound

BLOCK_ROWS, SAMPLE_ROWS, MOST_CELLS, ROUNDS, DIGITS, SEED = 2048, 65_536, 4096, 6, 9, 42
CALIBRATION, TARGET = 256, 0.95
BLOCK_BYTES, TILE_QUERIES, TILE_ROWS, TILE_PAIRS, PROBED_BYTES = 1 << 25, 256, 2048, 1 << 16, 1 << 22


def _valid(df: DataFrame, key: str, embedding: str) -> DataFrame:
    """(id, v) of the rows that can be searched."""
    v = F.col(embedding).cast("array<double>")
    whole = F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return df.where(F.col(key).isNotNull() & (F.size(embedding) > 0) & whole).select(F.col(key).alias("id"), v.alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as rows of length 1; zero vectors as they are."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    m = np.asarray(flat.flatten(), float).reshape(len(flat), -1)
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(n == 0, 1, n)


def _first(i: np.ndarray, j: np.ndarray, score: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best pairs of each i; ties by order[j]."""
    by = np.lexsort((order[j], -score, i))
    i, j, score = i[by], j[by], score[by]
    starts = np.flatnonzero(np.diff(i, prepend=-1))
    kept = np.arange(len(i)) - np.repeat(starts, np.diff(np.append(starts, len(i)))) < k
    return i[kept], j[kept], score[kept]


def _best_of(query_ids: pa.Array, ids: pa.Array, tile: Callable[[slice, slice], np.ndarray], k: int, exact: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, slack: float = 0.0) -> dict:
    """The k best rows of each query, its own row aside; ties by id.

    tile gives the scores of some queries by some rows. If they are rough, exact gives those of pairs, less than slack away.
    Held are one tile, the pairs of it that may be among the best, TILE_PAIRS at a time, and the best so far.
    """
    both = np.concatenate([query_ids.to_numpy(zero_copy_only=False), ids.to_numpy(zero_copy_only=False)])
    both = np.unique(both, return_inverse=True)[1]
    q, r = both[: len(query_ids)], both[len(query_ids) :]
    made = []
    for a in range(0, len(q), TILE_QUERIES):
        n = min(TILE_QUERIES, len(q) - a)
        best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        least = np.full(n, -np.inf)  # the k-th score so far
        for b in range(0, len(r), TILE_ROWS):
            score = tile(slice(a, a + n), slice(b, b + TILE_ROWS))
            bar = least
            if score.shape[1] > k and np.isinf(least).any():
                others = np.where(q[a : a + n, None] == r[None, b : b + TILE_ROWS], -np.inf, score)
                bar = np.maximum(bar, np.partition(others, -k, axis=1)[:, -k] - slack)
            at = np.flatnonzero(score >= (bar - slack - 10.0**-DIGITS)[:, None].astype(score.dtype))
            for c in range(0, len(at), TILE_PAIRS):
                i, j = np.divmod(at[c : c + TILE_PAIRS], score.shape[1])
                other = q[a + i] != r[b + j]
                i, j = i[other], j[other]
                true = score[i, j] if exact is None else exact(a + i, b + j)
                best = _first(*(np.concatenate(x) for x in zip(best, (i, b + j, np.round(true, DIGITS)), strict=True)), r, k)
            if len(at):
                full = np.flatnonzero(np.bincount(best[0], minlength=n) >= k)
                least[full] = best[2][np.searchsorted(best[0], full, "right") - 1]
        made.append((a + best[0], *best[1:]))
    i, j, score = (np.concatenate(x) for x in zip(*made, strict=True))
    return {"query_id": query_ids.take(pa.array(i)), "id": ids.take(pa.array(j)), "score": pa.array(score)}


def _nearest_of(query_ids: pa.Array, queries: np.ndarray, ids: pa.Array, rows: np.ndarray, k: int) -> dict:
    """The k best rows of each query by the products of unit vectors."""
    q, r = queries.astype(np.float32), rows.astype(np.float32)
    return _best_of(query_ids, ids, lambda a, b: q[a] @ r[b].T, k, lambda i, j: np.einsum("pd,pd->p", queries[i], rows[j]), (queries.shape[1] + 4) * 2.0**-23)


def _found(rows: DataFrame, queries: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("query_id", queries.schema["id"].dataType), T.StructField("id", rows.schema["id"].dataType), T.StructField("score", T.DoubleType())])


def best(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, score): the k best of each query, from 1."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _dealt(n: int) -> Column:
    """A block for each row; not by id alone, as ids may repeat."""
    return F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(n)).cast("int")


def search_many(rows: DataFrame, queries: DataFrame, k: int, key: str = "id", embedding: str = "embedding", block_rows: int | None = None) -> DataFrame:
    """(query_id, rank, id, score) of the k nearest rows of each query, exactly. Blocks have block_rows rows or so, else as many as fit and keep all cores busy."""
    if k <= 0:
        raise ValueError("k must be positive")
    rows, queries = _valid(rows, key, embedding), _valid(queries, key, embedding)
    first = queries.select(F.size("v").alias("d")).first()
    width = first["d"] if first else -2
    rows, queries = rows.where(F.size("v") == width), queries.where(F.size("v") == width)
    n, asking = rows.count(), queries.count()
    most = block_rows or max(1, BLOCK_BYTES // (8 * abs(width)))
    turns = max(1, math.ceil(asking / (block_rows or max(1, most // 2))))
    busy = 0 if block_rows else min(math.ceil(n / BLOCK_ROWS), math.ceil(4 * rows.sparkSession.sparkContext.defaultParallelism / turns))
    parts = max(1, busy, math.ceil(n / most))
    asked = queries.withColumn("turn", _dealt(turns)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    held = rows.withColumn("part", _dealt(parts)).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    schema = _found(rows, queries)

    def block(q: pa.Table, r: pa.Table) -> pa.Table:
        if not q.num_rows or not r.num_rows:
            return pa.table({"query_id": q["id"].slice(0, 0), "id": r["id"].slice(0, 0), "score": pa.array([], pa.float64())})
        return pa.table(_nearest_of(q["id"].combine_chunks(), _matrix(q["v"]), r["id"].combine_chunks(), _matrix(r["v"]), k))

    return best(asked.groupBy("turn", "part").cogroup(held.groupBy("turn", "part")).applyInArrow(block, schema), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: queries, the exact neighbours, how many of them were found, and their share."""
    hit = found.select("query_id", "id", F.lit(1).alias("hit"))
    met = exact.join(hit, ["query_id", "id"], "left")
    return met.agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("neighbours"), F.count("hit").alias("hits"), (F.count("hit") / F.count("*")).alias("recall"))


def _nearest(m: np.ndarray, centroids: np.ndarray, n: int = 1) -> np.ndarray:
    """The n nearest centroids of each unit vector; TILE_QUERIES vectors at a time meet all centroids."""
    half, out = (centroids * centroids).sum(axis=1) / 2, np.empty((len(m), min(n, len(centroids))), np.int64)
    for a in range(0, len(m), TILE_QUERIES):
        far = half - m[a : a + TILE_QUERIES] @ centroids.T
        out[a : a + TILE_QUERIES] = far.argmin(axis=1)[:, None] if n == 1 else np.argpartition(far, min(n, far.shape[1]) - 1, axis=1)[:, :n]
    return out


def fit_centroids(rows: DataFrame, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """k-means over the unit vectors of (id, v): tasks add up their vectors by cell, Spark adds up what tasks found."""
    first = rows.orderBy(F.xxhash64(F.lit(SEED), "id"), "id").limit(cells).select("v").toArrow()
    centroids = _matrix(first["v"])
    width = centroids.shape[1]
    for _ in range(rounds):

        def summed(batches: Iterator[pa.RecordBatch], now: np.ndarray = centroids) -> Iterator[pa.RecordBatch]:
            sums, n = np.zeros(now.shape), np.zeros(len(now), np.int64)
            for b in batches:
                if b.num_rows:
                    m = _matrix(b.column(0))
                    of = _nearest(m, now)[:, 0]
                    np.add.at(sums, of, m)
                    n += np.bincount(of, minlength=len(now))
            used = np.flatnonzero(n)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * width), pa.array(sums[used].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), lists], names=["cell", "n", "sums"])

        parts = rows.select("v").mapInArrow(summed, "cell long, n long, sums array<double>")
        means = parts.groupBy("cell").agg(F.sum("n").alias("n"), *(F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(width)))
        centroids = centroids.copy()
        for r in means.collect():  # a row a cell
            centroids[r["cell"]] = np.array(r[2:]) / r["n"]
    return centroids


@dataclass(frozen=True)
class InvertedFile:
    """An index in a folder: codes (cell, id, scale, code) sorted by cell, its centroids, and how many cells a query visits."""

    folder: str
    centroids: np.ndarray
    probes: int = 1

    @staticmethod
    def build(df: DataFrame, folder: str, cells: int | None = None, key: str = "id", embedding: str = "embedding", sample_rows: int = SAMPLE_ROWS, k: int = 10, target: float = TARGET) -> InvertedFile:
        """Every row of df indexed; centroids are fitted on a sample of about sample_rows. A search is to find the target share of the k nearest."""
        spark, rows = df.sparkSession, _valid(df, key, embedding)
        n = rows.count()
        dims = rows.orderBy("id").select(F.size("v").alias("d")).first()
        if dims is None:
            raise ValueError("no vectors to index")
        rows = rows.where(F.size("v") == dims["d"])
        cells = min(MOST_CELLS, cells or max(1, math.isqrt(n)))
        share = 1 << 30
        some = rows.where(F.pmod(F.xxhash64(F.lit(SEED + 1), "id"), F.lit(share)) < min(share, math.ceil(share * sample_rows / n)))
        some.write.mode("overwrite").parquet(f"{folder}/sample")
        centroids = fit_centroids(spark.read.parquet(f"{folder}/sample"), cells)
        schema = T.StructType([T.StructField("cell", T.IntegerType()), rows.schema["id"], T.StructField("scale", T.DoubleType()), T.StructField("code", T.BinaryType())])

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    m = _matrix(b.column(1))
                    of = _nearest(m, centroids)[:, 0]
                    rest = m - centroids[of]
                    scale = np.maximum(np.abs(rest).max(axis=1), 1e-30) / 127
                    codes = np.rint(rest / scale[:, None]).astype(np.int8)
                    yield pa.RecordBatch.from_arrays([pa.array(of.astype(np.int32)), b.column(0), pa.array(scale), pa.array([c.tobytes() for c in codes], pa.binary())], names=schema.fieldNames())

        rows.mapInArrow(coded, schema).repartitionByRange("cell", "id").sortWithinPartitions("cell").write.mode("overwrite").parquet(f"{folder}/codes")
        index = InvertedFile(folder, centroids)
        index = InvertedFile(folder, centroids, index.probes_for(rows, k, target))
        spark.createDataFrame([(json.dumps([centroids.tolist(), index.probes]),)], "held string").write.mode("overwrite").text(f"{folder}/centroids")
        return index

    @staticmethod
    def open(spark: SparkSession, folder: str) -> InvertedFile:
        centroids, probes = json.loads(spark.read.text(f"{folder}/centroids", wholetext=True).first()[0])
        return InvertedFile(folder, np.array(centroids), probes)

    def probes_for(self, rows: DataFrame, k: int, target: float) -> int:
        """How many cells, nearest first, hold the target share of the k nearest of CALIBRATION rows of (id, v)."""
        asked, centroids = rows.orderBy(F.xxhash64(F.lit(SEED + 2), "id"), "id").limit(CALIBRATION), self.centroids
        true = search_many(rows, asked, k, "id", "v").select("query_id", "id").join(self.codes(rows.sparkSession).select("id", "cell"), "id")
        met = true.join(asked.select(F.col("id").alias("query_id"), "v"), "query_id").select("v", "cell")

        def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    for a in range(0, b.num_rows, TILE_QUERIES):
                        some = b.slice(a, TILE_QUERIES)
                        far = (centroids * centroids).sum(axis=1) / 2 - _matrix(some.column(0)) @ centroids.T
                        own = far[np.arange(len(far)), some.column(1).to_numpy()]
                        yield pa.RecordBatch.from_arrays([pa.array((far <= own[:, None]).sum(axis=1))], names=["n"])

        n = met.mapInArrow(ranked, "n long").agg(F.percentile("n", target)).first()[0]
        return max(1, math.ceil(n or 1))

    def codes(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/codes")

    def candidates(self, queries: DataFrame, k: int, probes: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
        """(query_id, rank, id, score) by codes: the k best of the rows in each query's nearest cells; queries are (id, v)."""
        spark, centroids = queries.sparkSession, self.centroids
        near = min(probes or self.probes, len(centroids))
        step = max(1, PROBED_BYTES // (8 * near * centroids.shape[1]))
        asked_schema = T.StructType([queries.schema["id"], queries.schema["v"], T.StructField("cell", T.IntegerType())])

        def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for a in range(0, b.num_rows, step):  # a query is given out near times: no whole batch at once
                    some = b.slice(a, step)
                    of = _nearest(_matrix(some.column(1)), centroids, near)
                    at = pa.array(np.repeat(np.arange(some.num_rows), of.shape[1]))
                    yield pa.RecordBatch.from_arrays([some.column(0).take(at), some.column(1).take(at), pa.array(of.ravel().astype(np.int32))], names=asked_schema.fieldNames())

        asked = queries.select("id", "v").where(F.size("v") == centroids.shape[1]).mapInArrow(probed, asked_schema)
        held = self.codes(spark)
        # how many blocks a cell has on either side: a row a cell
        sizes = held.groupBy("cell").count().collect(), asked.groupBy("cell").count().collect()
        split = [F.element_at(F.array(*(F.lit(x) for x in np.maximum(1, -(-np.bincount([r["cell"] for r in s] or [0], [r["count"] for r in s] or [0], len(centroids)).astype(int) // block_rows)).tolist())), F.col("cell") + 1) for s in sizes]
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        deal = lambda n: F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), n).cast("int")
        asked = asked.withColumn("turn", deal(split[1])).withColumn("part", every(split[0]))
        held = held.withColumn("part", deal(split[0])).withColumn("turn", every(split[1]))

        def block(q: pa.Table, r: pa.Table) -> pa.Table:
            if not q.num_rows or not r.num_rows:
                return pa.table({"query_id": q["id"].slice(0, 0), "id": r["id"].slice(0, 0), "score": pa.array([], pa.float64())})
            m, scale = _matrix(q["v"]), r["scale"].to_numpy()
            codes = np.frombuffer(b"".join(r["code"].to_pylist()), np.int8).reshape(r.num_rows, -1).astype(float)
            near = m @ centroids[r["cell"][0].as_py()]
            return pa.table(_best_of(q["id"].combine_chunks(), r["id"].combine_chunks(), lambda a, b: near[a, None] + (m[a] @ codes[b].T) * scale[b], k))

        keys = ["cell", "turn", "part"]
        return best(asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(block, _found(held, queries)), k)

    def search(self, vectors: DataFrame, queries: DataFrame, k: int, probes: int | None = None, oversampling: float = 2.0, key: str = "id", embedding: str = "embedding") -> DataFrame:
        """(query_id, rank, id, score) of about the k nearest rows of each query: candidates by codes, scores by the full vectors."""
        rows, queries = _valid(vectors, key, embedding), _valid(queries, key, embedding)
        near = self.candidates(queries, math.ceil(k * oversampling), probes).select("query_id", "id")
        met = near.join(rows, "id").join(queries.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
        return best(met.select("query_id", "id", F.round(cosine(F.col("v"), F.col("q")), DIGITS).alias("score")).dropDuplicates(["query_id", "id"]), k)


@dataclass(frozen=True)
class CodeTable:
    """Codes in a folder beside the vectors they stand for: bytes within a bound, and sign bits as words."""

    folder: str
    bound: float

    @staticmethod
    def build(df: DataFrame, folder: str, key: str = "id", embedding: str = "embedding") -> CodeTable:
        rows, v = _valid(df, key, embedding), F.col("v")
        bound = code_bound(rows, "v")
        rows.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{folder}/vectors")
        kept = df.sparkSession.read.parquet(f"{folder}/vectors")
        codes = scalar_code(normalised(v), F.lit(bound)).cast("array<tinyint>")
        kept.select("id", codes.alias("code"), sign_bits(v).alias("bits")).write.mode("overwrite").parquet(f"{folder}/codes")
        return CodeTable(folder, bound)

    def first_pass(self, spark: SparkSession, query: Sequence[float], k: int, mode: QuantizationMode) -> DataFrame:
        """(id, score): the k best by codes alone."""
        q, bits = as_column(query), F.col("bits")
        if mode is QuantizationMode.SCALAR:
            rough = code_dot(F.col("code").cast("array<int>"), scalar_code(normalised(q), F.lit(self.bound))).cast("double")
        elif mode is QuantizationMode.BINARY:
            rough = -F.aggregate(F.zip_with(bits, sign_bits(q), lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("double")), F.lit(0.0), lambda s, x: s + x)
        elif mode is QuantizationMode.ASYMMETRIC:
            word = lambda i: F.call_function("shiftright", F.get(bits, F.call_function("shiftright", i, F.lit(5))), i.bitwiseAND(F.lit(31)))
            signed = F.transform(q, lambda x, i: F.when(word(i).bitwiseAND(F.lit(1)) == 1, x).otherwise(-x))
            rough = F.round(F.aggregate(signed, F.lit(0.0), lambda s, x: s + x), DIGITS)
        else:
            raise ValueError("this mode has no codes")
        codes = spark.read.parquet(f"{self.folder}/codes")
        return codes.select("id", rough.alias("score")).orderBy(F.desc("score"), "id").limit(k)

    def search(self, spark: SparkSession, query: Sequence[float], k: int, config: QuantizationConfig) -> DataFrame:
        """(id, score) of the k nearest rows by the mode's codes, scored with full vectors."""
        near = [r["id"] for r in self.first_pass(spark, query, config.candidates(k), config.mode).select("id").collect()]
        rows = spark.read.parquet(f"{self.folder}/vectors").where(F.col("id").isin(near) if near else F.lit(False))
        return rows.select("id", cosine(F.col("v"), as_column(query)).alias("score")).orderBy(F.desc("score"), "id").limit(k)
