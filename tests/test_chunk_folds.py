"""Chunks by a fold in the JVM against the same rules in Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loomdex.operators import chunks
from loomdex.operators.scanner import units


def code(rng: random.Random) -> str:
    heads = ["fn a() {", "  pub fn b() {", "def c():", "    def d(): fn ", "class E {", "const f = {", "impl G {", "}", "}}", "x = 1", "y = '" + "é" * 40 + "'", "", "z" * rng.choice((10, 700, 3500)) + "\r"]
    return "\n".join(rng.choice(heads) for _ in range(rng.randrange(1, 120))) + rng.choice(("", "\n"))


@pytest.mark.parametrize("seed", range(2))
def test_fold_equals_rules(spark, seed):
    rng = random.Random(seed)
    languages = ["rust", "python", "javascript", "java", "go", None]
    rows = [(n, code(rng), languages[n % 6]) for n in range(90)] + [(90, "", "rust"), (91, None, "rust"), (92, "\n", None), (93, "x" * 9000, "rust"), (94, "fn a() {\n" * 4000, "rust"), (94, "fn a() {\n" * 4000, "rust")]
    df = spark.createDataFrame(rows, "id int, content string, language string").withColumn("start", F.lit(7))
    made = chunks.chunk_structure(df)
    assert made.columns == ["id", "language", "start", "start_line", "end_line", "chunk_type", "content"]
    got = sorted((r["id"], r["start_line"], r["end_line"], r["chunk_type"], r["content"]) for r in made.collect())
    assert got == sorted((n, *c) for n, t, lang in rows for c in chunks.heuristic_chunks(t or "", lang))
    assert len({g[3] for g in got}) == 2
    assert chunks.chunk_structure(df.limit(0)).count() == 0


def test_packing_equals_rules(spark):
    """Units of code packed by the fold against the same rules in Python: imports repeated, large units cut."""
    rng, files = random.Random(5), []
    for n in range(40):
        heads = ["import os\nfrom a import b\n"] * (n % 2)
        bodies = [f"def f{i}():\n" + "    x = 'é'\n" * rng.choice((1, 5, 60, 400)) for i in range(rng.randrange(1, 12))]
        files.append((n, "".join(heads + bodies)))
    rows = []
    for n, code_text in files:
        line = lambda at, t=code_text: t.count("\n", 0, at) + 1
        found = units(code_text, "python")
        body = [(line(u.start), line(max(u.end - 1, u.start)), "Function" if u.kind == "function" else "Class", code_text[u.start : u.end]) for u in found if u.kind != "import"]
        rows.append((n, body, "\n".join(code_text[u.start : u.end] for u in found if u.kind == "import"), 1))
    schema = f"id int, units array<{chunks.UNIT}>, head string, end_line int"
    made = chunks.pack_units(spark.createDataFrame(rows, schema), head="head")
    assert made.columns == ["id", "start_line", "end_line", "chunk_type", "content"]
    got = sorted((r["id"], r["start_line"], r["end_line"], r["chunk_type"], r["content"]) for r in made.collect())
    assert got == sorted((n, *c) for n, t in files for c in chunks.unit_chunks(t, "python"))
    odd = [(1, None, None, 1), (2, [], "h", 1), (3, [(1, 1, None, None), (2, 2, "Class", "a")], None, 1), (3, [(1, 1, None, None), (2, 2, "Class", "a")], None, 1)]
    assert [tuple(r) for r in chunks.pack_units(spark.createDataFrame(odd, schema), head="head").collect()] == [(3, 1, 2, None, "\n\na")] * 2
    assert chunks.pack_units(spark.createDataFrame(odd, schema).limit(0)).count() == 0


def test_boundaries_by_plain_rule(spark):
    """Heads, blanks before and after them, and a head without more."""
    blanks = ["", " ", "\t", " \x0b\r"]
    rows = [(x, b + h + e) for x, heads in chunks.BOUNDARIES.items() for h in {*heads, *(y.strip() for y in heads)} for b in blanks for e in (*blanks, "name", " name ")]
    df = spark.createDataFrame([*rows, ("go", "fn a"), (None, "fn a"), ("rust", None)], "language string, line string")
    for r in df.select("language", "line", chunks.is_boundary(F.col("line"), F.col("language")).alias("b")).collect():
        heads = chunks.BOUNDARIES.get(r["language"], ())
        assert r["b"] == bool(heads and r["line"] is not None and r["line"].strip(" \t\n\x0b\f\r").startswith(heads)), r


def test_units_are_made_once_and_not_copied(spark):
    """No filter that makes the units again, and an explode that hands on nothing but chunks."""
    made = spark.range(3).select("id", F.expr("transform(sequence(0, 3), k -> named_struct('start_line', k, 'end_line', k, 'kind', 'Class', 'content', repeat('x', 900)))").alias("units"))
    lines = spark.range(3).select("id", F.lit("rust").alias("language"), F.repeat(F.lit("fn a() {\n"), 9).alias("content"))
    for df in (chunks.pack_units(made), chunks.chunk_structure(lines)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        handed = re.search(r", \[([^\[\]]*)\], false, \[_[pc]#", plan)[1]
        assert "id#" in handed and "_u#" not in handed and "_lines#" not in handed
    assert "Filter" not in chunks.pack_units(made)._jdf.queryExecution().optimizedPlan().toString()
    assert chunks.pack_units(made).count() == 12
