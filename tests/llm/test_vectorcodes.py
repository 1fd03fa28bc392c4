"""Vector codes: nearest entries against all distances, k-means against plain loops."""

import hashlib
import math
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T
from samples import folder_of

from loomdex.llm import queries, vectorcodes
from loomdex.llm.vectorcodes import nearest

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


@given(st.integers(1, 9), st.integers(1, 70), st.integers(0, 2**32), st.sampled_from([2, 40, 10**4, 2**27]))
@settings(max_examples=300, deadline=None)
def test_nearest(width, entries, seed, size):
    """The exact nearest entry and, of equal ones, the lowest; small ranges make ties."""
    rng = np.random.default_rng(seed)
    x, c = rng.integers(-size, size, (50, width)), rng.integers(-size, size, (entries, width))
    far = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    j, least = nearest(x, c)
    assert j.tolist() == far.argmin(axis=1).tolist() and least.tolist() == far.min(axis=1).tolist()


def test_bounds_drop_most_entries(monkeypatch):
    """Few entries get an exact distance."""
    rng = np.random.default_rng(1)
    x, c = rng.normal(0, 100, (500, 4)).astype(np.int64), rng.normal(0, 100, (64, 4)).astype(np.int64)
    exact, seen = vectorcodes._exact, []
    monkeypatch.setattr(vectorcodes, "_exact", lambda x, c, i, j: (seen.append(len(i)), exact(x, c, i, j))[1])
    nearest(x, c)
    assert sum(seen) < 0.4 * 500 * 64  # of the hardest data, without any clusters


def plain(rows):
    """The whole contract in loops: {(id, vector): (code, error)}, label sums, digest."""
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // 16
    books = [[r[1][p * w : p * w + w] for r in kept[:64]] for p in range(16)]

    def best(x, p):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))

    for _ in range(2):
        new = []
        for p in range(16):
            held = defaultdict(list)
            for r in kept:
                held[best(r[1][p * w : p * w + w], p)[1]].append(r[1][p * w : p * w + w])
            new.append([[sum(y) // len(y) for y in zip(*held[e])] if e in held else c for e, c in enumerate(books[p])])
        books = new
    out, labels = [], defaultdict(int)
    for i, v, lab in kept:
        got = [best(v[p * w : p * w + w], p) for p in range(16)]
        out.append((i, "".join(f"{e:02x}" for _, e in got), sum(d for d, _ in got), lab))
        labels[lab] += out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for p in books for c in p for x in c).encode()).hexdigest()
    return sorted(((i, code, err, labels[lab], digest) for i, code, err, lab in out), key=repr)


def test_op12_against_loops(spark, tmp_path):
    rng = np.random.default_rng(3)
    vec = lambda: [float(x) for x in rng.normal(0, 0.2, 32).astype(np.float32)]
    rows = [(k, vec(), k % 3 if k % 5 else None) for k in range(150)]
    rows += [(200 + k, rows[7][1], 1) for k in range(60)]  # a common vector
    rows += [(7, rows[7][1], 1), (None, vec(), 2), (None, vec(), None), (300, None, 1), (301, [None] * 32, 1), (302, [float("nan")] * 32, 1), (303, [float("inf")] + [0.0] * 31, 1)]
    some = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("codes", F.lit(1)).withColumn("v", F.lit("x"))
    got = queries.op12_vector_codes(spark, folder_of(tmp_path / "a", embeddings=some)).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows)
    few = rows[:5]
    got = queries.op12_vector_codes(spark, folder_of(tmp_path / "b", embeddings=spark.createDataFrame(few, SCHEMA))).collect()
    assert sorted(map(tuple, got), key=repr) == plain(few)
    for gone in ([], rows[-4:]):
        assert queries.op12_vector_codes(spark, folder_of(tmp_path / f"c{len(gone)}", embeddings=spark.createDataFrame(gone, SCHEMA))).collect() == []


def test_lengths_that_do_not_fit(spark):
    rows = [(1, [0.5] * 32, 0), (0, [1.0] * 5, 0), (2, [0.1] * 16, 0), (3, [], 0), (4, [1e30] * 32, 0)]
    found, books = vectorcodes.compress(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r["vec_id"] for r in found.collect()) == [1, 4] and books.shape == (16, 2, 2) and books.max() == vectorcodes.MOST


def test_decode(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rng.integers(-3, 3, 16)], 0) for k in range(40)]  # so few values that every part has its entry
    found, books = vectorcodes.compress(spark.createDataFrame(rows, SCHEMA))
    back = {r["vec_id"]: r for r in vectorcodes.decode(found, books).collect()}
    assert all(back[k]["v"] == v and back[k]["error"] == 0 for k, v, _ in rows)
