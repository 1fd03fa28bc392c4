"""The stored memo of vectors: texts reach the model once, over sessions and runs."""

from loomdex.operators.vectors import embed_lasting


def test_unseen_texts_only(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def model(texts):
        calls.add(len(texts))
        return [[float(len(t)), 1.0] for t in texts]

    folder = str(tmp_path / "memo")
    rows = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a"), (4, None), (5, "")], "id int, content string")
    want = {1: [1.0, 1.0], 2: [2.0, 1.0], 3: [1.0, 1.0], 4: None, 5: [0.0, 1.0]}
    assert {r["id"]: r["embedding"] for r in embed_lasting(rows, model, folder).collect()} == want and calls.value == 3
    assert {r["id"]: r["embedding"] for r in embed_lasting(rows, model, folder).collect()} == want and calls.value == 3
    more = rows.union(spark.createDataFrame([(6, "ccc"), (7, "ccc")], rows.schema))
    assert {r["id"]: r["embedding"] for r in embed_lasting(more, model, folder).collect()} == {**want, 6: [3.0, 1.0], 7: [3.0, 1.0]} and calls.value == 4
    assert embed_lasting(rows.limit(0), model, folder).collect() == []
