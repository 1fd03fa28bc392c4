"""Expressions and line operators on hand-made rows."""

import hashlib
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomdex.functions import language, text, vectors
from loomdex.operators import chunks, filters, lines


def values(spark, expression, *items, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
    return [r[0] for r in df.select(F.col("i"), expression(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_lines(spark):
    assert values(spark, text.lines_of, "a\nb\n", "", "a\r\nb", "\n", "a\n\n", "a\r") == [["a", "b"], [], ["a", "b"], [""], ["a", ""], ["a"]]


def test_byte_position(spark):
    assert values(spark, lambda c: text.byte_position("Stack", c), "pub struct Stack<T> {", "none", "é stack") == [11, 0, 3]


def test_patterns(spark):
    paths = ("src/main.rs", "test.py", "xrs/y", "a.rsx")
    assert values(spark, lambda c: text.path_pattern("*.rs", c), *paths) == [True, False, True, True]
    assert values(spark, lambda c: text.path_pattern("*.rs", c, "strict"), "main.rs", "src/main.rs", "a.rsx") == [True, False, False]
    assert values(spark, lambda c: text.path_pattern("**/*.rs", c, "strict"), "main.rs", "src/a/main.rs") == [True, True]
    assert values(spark, lambda c: text.path_pattern("src/", c), "src/a", "lib/a") == [True, False]
    assert values(spark, lambda c: text.path_pattern("*[", c), "a[") == [False]
    assert text.legacy_glob("**/*.rs") == ".[^/]*/[^/]*.rs"
    assert values(spark, lambda c: text.name_pattern("*.rs", c), "a/b.rs", "a.rs/b.py") == [True, False]
    assert values(spark, lambda c: text.name_pattern("b.rs", c), "a/b.rs", "a/bb.rs") == [True, False]


def test_empty_filter_lets_nothing_pass(spark):
    assert values(spark, lambda c: filters.repository_filter(c, []), "a") == [False]
    assert values(spark, lambda c: filters.repository_filter(c, None), "a") == [True]
    assert values(spark, lambda c: filters.path_repository_filter(c, ["a"]), "a/b", "/a/b", "b/a") == [True, False, False]
    assert values(spark, lambda c: filters.name_filter(c, []), "a") == [False]


def test_languages(spark):
    got = values(spark, lambda c: language.detect_language(c), "go.mod", "Cargo.toml", "Dockerfile", "a/X.RS", "noext", ".gitignore")
    assert got == ["unknown", "toml", "shell", "rust", "unknown", "unknown"]
    got = values(spark, lambda c: language.detect_language(F.lit("run"), c), "#!/usr/bin/env python3\n", "#!/bin/sh", "#!/usr/bin/perl", "x")
    assert got == ["python", "shell", "unknown", "unknown"]
    assert values(spark, language.is_indexable, "test.rs", "main.py", "Dockerfile", "image.png", "binary.exe", ".gitignore") == [True, True, True, False, False, True]
    assert len(language.INDEXABLE_EXTENSIONS) == 53 and len(language.INDEXABLE_NAMES) == 10
    assert values(spark, language.chunk_language, "a.h", "a.sh", "a.RS", "a") == ["cpp", "bash", None, None]


def test_vectors(spark):
    a = F.array(F.lit(0.0), F.lit(0.0))
    b = F.array(F.lit(3.0), F.lit(4.0))
    row = spark.range(1).select(vectors.cosine(a, b), vectors.cosine(b, b), vectors.normalised(b), vectors.normalised(a)).first()
    assert row[0] == 0 and row[1] == pytest.approx(1) and row[2] == pytest.approx([0.6, 0.8]) and row[3] == [0, 0]
    v = spark.range(1).select(vectors.fallback_embedding(F.lit("x"))).first()[0]
    assert len(v) == 256 and sum(x * x for x in v) == pytest.approx(1) and not any(v[32:])


@pytest.mark.parametrize(("n", "want"), [(0, []), (1, [(1, 1)]), (18, [(1, 18)]), (19, [(1, 18), (17, 19)]), (34, [(1, 18), (17, 34)]), (35, [(1, 18), (17, 34), (33, 35)])])
def test_windows(spark, n, want):
    df = spark.createDataFrame([("\n".join("x" * n),)], "content string")
    assert [(r.start_line, r.end_line) for r in chunks.fixed_windows(df).orderBy("start_line").collect()] == want


def test_large_windows(spark):
    df = spark.createDataFrame([("\n".join("x" * 40),)], "content string")
    assert [(r.start_line, r.end_line) for r in chunks.split_large(df).orderBy("start_line").collect()] == [(1, 18), (19, 36), (37, 40)]


CODE = "use a;\n\npub trait T {}\n\n/// A stack.\npub struct Stack<T> {\n    items: Vec<T>,\n}\n\nimpl<T> Stack<T> {\n    fn new() {}\n}\n"


def test_definition_lines(spark):
    df = spark.createDataFrame([("a.rs", CODE)], "path string, content string")
    (hit,) = lines.definition_matches(df, "Stack").collect()
    assert (hit["line_number"], hit["column"], hit["content"]) == (6, 11, "pub struct Stack<T> {")
    assert hit["context_before"] == ["pub trait T {}", "", "/// A stack."] and hit["context_after"] == ["    items: Vec<T>,", "}", ""]
    first = lines.definition_matches(spark.createDataFrame([("def a\ndef b\n3\n4\n5",)], "content string"), "def").orderBy("line_number").collect()
    assert [(len(r["context_before"]), len(r["context_after"])) for r in first] == [(0, 3), (1, 3)]


def test_range_context(spark):
    docs = spark.createDataFrame([("a", "1\n2\n3\n4\n5\n6")], "path string, content string")
    hits = spark.createDataFrame([("a", 3, 4), ("gone", 1, 1)], "file_path string, start_line int, end_line int")
    got = {r["file_path"]: (r["context_before"], r["context_after"]) for r in lines.range_context(hits, docs).collect()}
    assert got == {"a": (["1", "2"], ["5", "6"]), "gone": ([], [])}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab {}", max_size=60), max_size=120), st.sampled_from(["rust", "python", "javascript", None]))
def test_heuristic_chunks_cover_all_lines(rows, name):
    found = chunks.heuristic_chunks("\n".join(rows), name)
    total = len(chunks.lines_of_text("\n".join(rows)))
    covered = {i for s, e, _, _ in found for i in range(s, e + 1)}
    assert covered == set(range(1, total + 1))


def test_heuristic_cut():
    body = "def f():\n" + "    x = 1\n" * 100
    found = chunks.heuristic_chunks(body * 3, "python")
    assert [(s, e) for s, e, _, _ in found] == [(1, 101), (102, 202), (203, 303)]
    assert [k for _, _, k, _ in found] == ["Block", "Function", "Function"]


def test_fallback_vectors_hash_a_text_once(spark):
    one = spark.range(1).select(F.expr("repeat('abcdefgh', 250000)").alias("t")).persist()
    assert one.count() == 1
    began = time.perf_counter()
    v = one.select(vectors.fallback_embedding(F.col("t"))).first()[0]
    assert time.perf_counter() - began < 5
    raw = [b / 255 - 0.5 for b in hashlib.sha256(b"abcdefgh" * 250_000).digest()]
    n = sum(x * x for x in raw) ** 0.5
    assert v == pytest.approx([x / n for x in raw] + [0.0] * 224)
    assert values(spark, vectors.normalised, [3.0, 4.0], [0.0, 0.0], None, kind="array<double>") == [[0.6, 0.8], [0.0, 0.0], None]
