"""Search for many queries, the inverted file and stored codes, against all distances."""

import numpy as np
import pytest

from loomdex.operators import vector_index
from loomdex.operators.vectors import QuantizationConfig, QuantizationMode
from loomdex.operators.vectors import search as scan

SCHEMA = "id long, embedding array<float>"


@pytest.fixture(scope="module")
def made():
    rng = np.random.default_rng(2)
    centre = rng.normal(0, 1, (12, 16))
    rows = [(k, (centre[k % 12] + rng.normal(0, 0.4, 16)).astype(np.float32).tolist()) for k in range(900)]
    return rows + [(2000 + k, rows[5][1]) for k in range(300)]  # a third of a cell's rows are one vector


@pytest.fixture(scope="module")
def rows(spark, made):
    odd = [(None, made[0][1]), (5000, None), (5001, []), (5002, [None] * 16), (5003, [float("nan")] * 16), (5004, [float("inf")] + [0.0] * 15), (5005, [1.0] * 3), (5006, [0.0] * 16), (7, made[7][1])]
    return spark.createDataFrame(made + odd, SCHEMA).repartition(6)


def unit(v):
    v = np.asarray(v, float)
    n = np.sqrt((v * v).sum(axis=-1, keepdims=True))
    return v / np.where(n == 0, 1, n)


def neighbours(made, asked, k):
    """{query: [(id, score)]} by all distances."""
    held = [*made, (5006, [0.0] * 16), (7, made[7][1])]
    ids, m = np.array([i for i, _ in held]), unit([v for _, v in held])
    out = {}
    for q in asked:
        score = np.round(m @ unit(dict(made)[q]), 9)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def told(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    return out


@pytest.mark.parametrize("block", [37, 2048])
def test_many_queries(rows, made, block):
    asked = rows.where("id % 20 = 0 and id < 3000")
    got, want = told(vector_index.search_many(rows, asked, 7, block_rows=block)), neighbours(made, [i for i, _ in made if i % 20 == 0], 7)
    assert got.keys() == want.keys()
    for q in got:
        assert [round(s, 6) for _, s in got[q]] == [round(s, 6) for _, s in want[q]] and len(got[q]) == 7
        assert all(i in {j for j, s in want[q]} or abs(s - want[q][-1][1]) < 1e-8 for i, s in got[q])
    assert vector_index.search_many(rows, rows.limit(0), 3).count() == 0 and vector_index.search_many(rows.limit(0), asked, 3).count() == 0
    with pytest.raises(ValueError):
        vector_index.search_many(rows, asked, 0)


def test_inverted_file(spark, rows, made, tmp_path):
    index = vector_index.InvertedFile.build(rows, str(tmp_path), cells=12)
    assert index.codes(spark).count() == len(made) + 2  # every row that can be searched
    again = vector_index.InvertedFile.open(spark, str(tmp_path))
    assert (again.centroids == index.centroids).all() and again.probes == index.probes
    asked = rows.where("id % 20 = 0 and id < 900")
    exact = vector_index.search_many(rows, asked, 10)
    few, all_ = (vector_index.recall(again.search(rows, asked, 10, probes=p, oversampling=4), exact).first() for p in (3, 12))
    assert few["queries"] == 45 and few["neighbours"] == 450 and few["recall"] >= 0.9 and all_["recall"] >= 0.99
    assert vector_index.recall(again.search(rows, asked, 10), exact).first()["recall"] >= 0.9
    # cells and queries that are split find the same
    queries = vector_index._valid(asked, "id", "embedding")
    assert sorted(map(tuple, again.candidates(queries, 10, 3, block_rows=17).collect())) == sorted(map(tuple, again.candidates(queries, 10, 3).collect()))
    with pytest.raises(ValueError):
        vector_index.InvertedFile.build(rows.limit(0), str(tmp_path / "none"))


@pytest.mark.parametrize("mode", [QuantizationMode.SCALAR, QuantizationMode.BINARY, QuantizationMode.ASYMMETRIC])
def test_stored_codes(spark, rows, made, mode, tmp_path):
    codes, q, config = vector_index.CodeTable.build(rows.where("embedding is null or size(embedding) <> 3"), str(tmp_path)), made[33][1], QuantizationConfig.of(mode)
    got = codes.search(spark, q, 10, config).collect()
    plain = scan(rows.where("id = 5006 or id < 3000"), q, 10, config=config, bound=codes.bound).collect()
    assert [(r["id"], round(r["score"], 9)) for r in got] == [(r["id"], round(r["score"], 9)) for r in plain]
    plan = codes.first_pass(spark, q, 10, mode)._jdf.queryExecution().executedPlan().toString()
    assert ("code:array<tinyint>" in plan) == (mode is QuantizationMode.SCALAR) and ("bits:array<bigint>" in plan) == (mode is not QuantizationMode.SCALAR) and "v:array" not in plan
    with pytest.raises(ValueError):
        codes.first_pass(spark, q, 10, QuantizationMode.NONE)


def test_blocks_are_few(spark, rows, monkeypatch):
    """Copies of rows and queries made for the exact search: by bytes of a block, not one for each 2,048 of the other side."""
    many = spark.range(6000).selectExpr("id", "array(float(id), 1f, 2f) as embedding")
    found = vector_index.search_many(many, many.where("id % 2 = 0"), 3)
    blocks = [x for x in str(found._jdf.queryExecution().analyzed()).split("explode(sequence(0, ")[1:]]
    assert len(blocks) == 2 and all(int(x.split(",")[0].rstrip("))").split(")")[0]) < 3 for x in blocks)


def test_rough_scores_are_made_sure(made):
    """Tiles in single precision, many equal rows and ids at the border of tiles: the same as from all scores in double."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    m = unit(np.concatenate([rng.normal(0, 1, (1, 16)) + rng.normal(0, 1e-7, (5000, 16)), rng.normal(0, 1, (300, 16))])[rng.permutation(5300)])
    ids, k = rng.permutation(5300), 9
    got = vector_index._nearest_of(pa.array(ids[:300]), m[:300], pa.array(ids), m, k)
    score = np.round(np.einsum("qd,rd->qr", m[:300], m), 9)
    want = [(ids[q], ids[j], score[q, j]) for q in range(300) for j in [j for j in np.lexsort((ids, -score[q])) if j != q][:k]]
    assert list(zip(*(got[c].to_pylist() for c in ("query_id", "id", "score")))) == want


def test_work_space_of_cells(made):
    """What finding cells takes beside its input and output does not grow with the batch."""
    import tracemalloc

    rng = np.random.default_rng(1)
    m, c = rng.normal(0, 1, (6000, 4)), rng.normal(0, 1, (2000, 4))
    tracemalloc.start()
    one, three = vector_index._nearest(m, c), vector_index._nearest(m, c, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6  # 6000 by 2000 doubles are 96 MB
    far = ((m[:500, None] - c[None]) ** 2).sum(2)
    assert (one[:500, 0] == far.argmin(1)).all() and (np.sort(three[:500]) == np.sort(np.argsort(far)[:, :3])).all()
