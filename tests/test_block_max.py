"""Pruned top lists equal those of all scores, from fewer postings."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loomdex.operators import lexical
from loomdex.operators.block_max import BlockMax


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(rng.choices(words, [1 / (j + 1) for j in range(60)], k=rng.choice([3, 20, 200])))) for k in range(1500)]
    rows += [(3000 + k, "w0 w1") for k in range(400)] + [(5000, ""), (5001, None), (None, "w0")]  # ties by hundreds
    return spark.createDataFrame(rows, "path long, symbols string")


@pytest.fixture(scope="module")
def index(docs, tmp_path_factory):
    return BlockMax.build(docs, str(tmp_path_factory.mktemp("blocks")), block_docs=16)


@pytest.mark.parametrize(("terms", "k"), [(["w0"], 5), (["w0", "w1"], 30), (["w40", "w7", "none"], 10), (["w2", "w2", "w55"], 1), (["w59"], 10_000)])
def test_top_k(spark, docs, index, terms, k):
    got = [(r["path"], round(r["score"], 9)) for r in index.top_k(spark, terms, k).collect()]
    all_ = lexical.scan_scores(docs.where("symbols is not null and path is not null"), sorted(set(terms)), "path", "symbols")
    assert got == [(r["path"], round(r["score"], 9)) for r in lexical.top_k(all_, k).collect()]


def test_fewer_postings_are_scored(spark, index):
    terms = ["w3", "w30"]
    all_ = spark.read.parquet(f"{index.folder}/postings").where(F.col("term").isin(*terms)).count()
    needed = index.needed(spark, terms, 5)
    assert needed.count() < 0.5 * all_
    assert "In(block" in needed._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]


def test_nothing_to_find(spark, docs, index, tmp_path):
    assert index.top_k(spark, ["none"], 5).collect() == []
    assert BlockMax.build(docs.limit(0), str(tmp_path)).top_k(spark, ["w0"], 5).collect() == []
    for terms, k in (([], 5), (["w0"], 0)):
        with pytest.raises(ValueError):
            index.top_k(spark, terms, k)


def _shuffled(spark, since):
    """Records that stages after one have written to shuffles, and the last stage's number."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    found = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    stages = [found.apply(i) for i in range(found.size())]
    return sum(s.shuffleWriteRecords() for s in stages if s.stageId() > since), max((s.stageId() for s in stages), default=-1)


def test_postings_are_not_shuffled(spark, docs, tmp_path):
    _, last = _shuffled(spark, -1)
    BlockMax.build(docs, str(tmp_path), block_docs=16)
    assert _shuffled(spark, last)[0] <= docs.count()  # the paths alone


def test_repeated_paths_are_one_document(spark, docs, tmp_path):
    some = docs.unionByName(docs.where("path % 7 = 0").selectExpr("path", "concat('w0 w59 ', symbols) AS symbols")).unionByName(spark.createDataFrame([(5000, ""), (6000, "")], docs.schema))
    index, terms = BlockMax.build(some, str(tmp_path), block_docs=16), ["w0", "w59"]
    whole = some.where("symbols is not null and path is not null").groupBy("path").agg(F.collect_list("symbols").alias("all"))
    tokens = whole.select("path", F.expr("filter(split(concat_ws(' ', all), ' '), x -> x <> '')").alias("t"), F.expr("array_max(transform(all, x -> size(filter(split(x, ' '), y -> y <> ''))))").alias("dl")).collect()
    total, avgdl = len(tokens), sum(r["dl"] for r in tokens) / len(tokens)
    idf = {t: math.log(1 + (total - n + 0.5) / (n + 0.5)) for t in terms for n in [sum(t in r["t"] for r in tokens)]}
    score = {r["path"]: sum(idf[t] * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * r["dl"] / avgdl)) for t in terms for tf in [r["t"].count(t)]) for r in tokens}
    best = sorted(((-round(s, 9), p) for p, s in score.items() if s > 0))[:40]
    assert [(r["path"], round(r["score"], 9)) for r in index.top_k(spark, terms, 40).collect()] == [(p, -s) for s, p in best]


def test_bounds_hold_and_blocks_are_small(spark, docs, index):
    rows = spark.read.parquet(f"{index.folder}/postings")
    inside = rows.where("term is not null").groupBy("term", "block").agg(F.count("*").alias("n_"), F.max("tf").alias("most_"), F.min("dl").alias("least_"), F.count("n").alias("heads"), F.max("n").alias("n"), F.max("most").alias("most"), F.max("least").alias("least"))
    assert inside.where("n <> n_ or most <> most_ or least <> least_ or heads <> 1 or n > 16").isEmpty()
    totals = rows.where("term is null").agg(F.sum("n"), F.sum("tf")).first()
    held = docs.where("symbols is not null and path is not null")
    assert tuple(totals) == (held.count(), held.selectExpr("sum(size(filter(split(symbols, ' '), x -> x <> '')))").first()[0])
