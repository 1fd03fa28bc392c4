"""The embedder against a dense SVD, and near copies of real documents."""

import numpy as np
from pyspark.sql import functions as F

from loomdex.operators import text_embedder as te


def test_fit_equals_dense_svd(spark):
    rng = np.random.default_rng(3)
    topics = [[f"w{t}x{i}" for i in range(12)] for t in range(4)]
    rows = [" ".join(rng.choice(topics[n % 4], 30)) for n in range(120)] + ["", None, "é__é Ünï", "same same", "same same"]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(rows)], "id int, content string").repartition(5)
    model = te.TextEmbedder.fit(df, buckets=512, dimensions=4)
    assert np.array_equal(te.TextEmbedder.fit(df.repartition(2), buckets=512, dimensions=4).idf, model.idf)
    full = np.zeros((len(rows), 512))
    for n, t in enumerate(rows):
        at, w = te.weights(t or "", model.idf)
        full[n, at] = w
    has = (full > 0).sum(0)
    assert np.allclose(model.idf[has > 0], np.log((1 + len(rows)) / (1 + has[has > 0])) + 1)
    want = np.linalg.svd(full)[2][:4].T
    assert np.linalg.svd(want.T @ model.basis)[1].min() > 0.99  # the same subspace
    made = {r["id"]: r["embedding"] and np.array(r["embedding"]) for r in model.embed(df).collect()}
    assert not made[120].any() and made[121] is None and np.allclose(made[123], made[124])
    near = lambda a, b: made[a] @ made[b]
    assert min(near(n, n + 4) for n in range(100)) > 0.8 and max(abs(near(n, n + 1)) for n in range(100)) < 0.3
    none = te.TextEmbedder.fit(df.limit(0), buckets=64, dimensions=4)
    assert none(["a b", None]) == [[0.0] * 4] * 2 and np.isfinite(none.basis).all()


def test_buckets_agree_with_sql(spark):
    words = ["license", "é", "x1"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(F.pmod(F.xxhash64("w"), F.lit(1024))).collect()]
    assert got == [te._bucket(w, 1024) for w in words]


def test_counted_once(spark):
    """Vectors from stored counts are those of the texts, words are those of the plain expression, and texts are not shuffled."""
    rows = [(1, "alpha beta beta"), (2, None), (3, ""), (4, "x" * 50 + " gamma"), (5, "𝒜lpha é_é"), (6, "alpha beta beta")]
    df = spark.createDataFrame(rows, "id int, content string").repartition(2)
    model = te.TextEmbedder.fit(df, buckets=256, dimensions=3)
    counts = te.counted(df, buckets=256)
    assert {r["id"]: r["at"] for r in counts.collect()}[2] is None and te.TextEmbedder.fit_counted(counts, 256, 3).idf.tolist() == model.idf.tolist()
    a, b = ({r["id"]: r["embedding"] for r in x.collect()} for x in (model.embed(df), model.embed_counted(counts)))
    assert a == b and a[2] is None and a[1] == a[6]
    words = "a1 É² _b-cͅ " + "".join(map(chr, range(0x20, 0x3000)))
    assert te.words_of(words) == te._WORD.findall(words) and te.words_of(words + "\U00010400") == te._WORD.findall(words + "\U00010400")
    assert "Exchange" not in model.embed(spark.createDataFrame(rows, df.schema))._jdf.queryExecution().executedPlan().toString()
