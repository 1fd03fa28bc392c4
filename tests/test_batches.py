"""What reaches a Python worker at once is small, and long files are cut in linear time."""

import time

import pytest
from pyspark.sql import functions as F

from loomdex.operators import chunks, symbols, vectors

KEYS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")


def _files(spark):
    return spark.createDataFrame([("a.rs", "fn a() {}\n", "rust")], "path string, content string, language string")


def _sizes(texts):
    return [[float(len(texts))] for _ in texts]


@pytest.fixture
def large_batches(spark):
    held = {k: spark.conf.get(k) for k in KEYS}
    for k in KEYS:
        spark.conf.set(k, str(1 << 30))
    yield spark
    for k, v in held.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize(
    "made",
    [
        symbols.with_symbols,
        chunks.chunk_files,
        chunks.chunk_by_rules,
        lambda df: vectors.embed_with(df, _sizes),
    ],
)
def test_batches_are_small(large_batches, made):
    assert made(_files(large_batches)).count() == 1
    assert int(large_batches.conf.get(KEYS[0])) <= 500 and int(large_batches.conf.get(KEYS[1])) <= 1 << 23


def test_units_of_a_long_file_in_linear_time():
    code = "".join(f"use a{i};\n" for i in range(10_000)) + "".join(f"fn f{i}() {{ // some words behind it\n}}\n" for i in range(20_000))
    began = time.process_time()
    found = chunks.unit_chunks(code, "rust", target=1 << 30)
    assert time.process_time() - began < 4
    assert [(a, b) for a, b, *_ in found] == [(10_001, 50_000)]


def test_symbols_of_rows_over_several_batches(spark):
    rows = spark.range(1200).select("id", F.concat(F.lit("fn f"), F.col("id").cast("string"), F.lit("() {\n}\n")).alias("content"), F.lit("rust").alias("language")).coalesce(1)
    found = symbols.with_symbols(rows).select("id", F.col("symbol_list")[0]["name"].alias("name"), F.col("symbol_list")[0]["end_line"].alias("last"))
    assert found.where(F.col("name") == F.concat(F.lit("f"), F.col("id").cast("string"))).where("last = 1").count() == 1200
