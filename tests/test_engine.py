"""Workspaces, symbols, chunks, metadata, the change stream, the cache and the engine as a whole."""

import os
import time

import pytest
from pyspark.sql import functions as F

from loomdex.operators import chunks, metadata, scanner, symbols, vectors
from loomdex.operators.metadata import Conflict, VersionedTable
from loomdex.operators.vectors import QuantizationConfig, QuantizationMode
from loomdex.plans.cache import ResultCache
from loomdex.plans.config import Config, SearchQuery
from loomdex.plans.engine import Engine, NotStarted
from loomdex.sources import ignore
from loomdex.sources.workspace import decoded, is_indexable_name, read_workspaces, walk
from loomdex.streaming import changes

RUST = """use std::fmt;

pub struct Ledger<K> {
    rows: Vec<K>,
}

impl<K> Ledger<K> {
    pub fn post(&mut self, x: K) { let s = "fn fake() {"; }
}

enum Tree { Leaf, Node(Box<Tree>) }
trait Shape { fn area(&self) -> f64; }
impl<'a> Shape for Tree { fn area(&self) -> f64 { 0.0 } }
mod inner { fn hidden() {} }
const LIMIT: usize = 3;
// fn commented() {}
async fn find(xs: &[i32]) -> i32 { 0 }
"""


def kinds(code, language):
    return [(s["kind"], s["name"]) for s in symbols.symbols_of(code, language)]


def test_rust_symbols():
    assert kinds(RUST, "rust") == [("struct", "Ledger"), ("impl", "Ledger<K>"), ("enum", "Tree"), ("trait", "Shape"), ("impl", "Tree"), ("module", "inner"), ("constant", "LIMIT"), ("function", "find")]
    first = symbols.symbols_of(RUST, "rust")[0]
    assert (first["start_line"], first["end_line"], first["start_col"], first["signature"]) == (2, 4, 0, "pub struct Ledger<K> {")


@pytest.mark.parametrize(
    ("language", "code", "want"),
    [
        ("python", "import a\nclass A:\n    def m(self): pass\nasync def f():\n    def g(): pass\nif x:\n    def h(): pass\n", [("class", "A"), ("function", "f"), ("function", "h")]),
        ("python", "def broken(:\n    x\ndef ok():\n  pass\n", [("function", "broken"), ("function", "ok")]),
        ("javascript", "function a() { return 1 }\nclass B { m() {} }\nconst c = () => 1, d = 2;\nexport async function e() {}\n", [("function", "a"), ("class", "B"), ("variable", "c"), ("function", "e")]),
        ("go", "package p\nfunc A() {}\nfunc (r *T) M(x int) int { return 1 }\ntype T struct { a int }\ntype I interface { M() }\ntype N int\n", [("function", "A"), ("function", "M"), ("struct", "T"), ("interface", "I"), ("type", "N")]),
        ("java", "import x;\npublic class A { void m() {} enum E { X } }\ninterface I { void f(); }\nenum C { A, B }\n", [("class", "A"), ("interface", "I"), ("enum", "C")]),
        ("c", "struct point { int x; };\nenum color { RED };\nint add(int a, int b) { return a + b; }\n", [("struct", "point"), ("enum", "color"), ("function", "add")]),
        ("ruby", "def a; end", []),
        ("rust", "", []),
    ],
)
def test_symbols(language, code, want):
    assert kinds(code, language) == want


def test_symbols_column(spark):
    df = spark.createDataFrame([("a", RUST, "rust"), ("b", "x", "toml"), ("c", None, "rust")], "path string, content string, language string")
    got = {r["path"]: r["t"] for r in symbols.with_symbols(df).select("path", symbols.symbols_text(F.col("symbol_list")).alias("t")).collect()}
    assert got["a"].startswith("struct Ledger\nimpl Ledger<K>") and got["b"] == "" and got["c"] == ""


def test_signature_cut():
    assert symbols.signature_of("é" * 99 + "xéy") is None and symbols.signature_of("a\r\nb") == "a"


def test_unit_chunks():
    body = "use a::b;\n" + "\n".join(f"fn f{i}() {{\n{'    work();' * 20}\n}}" for i in range(12))
    found = chunks.unit_chunks(body, "rust")
    assert len(found) > 1 and found[1][3].startswith("use a::b;\n\nfn f") and found[1][0] > 1 and not found[0][3].startswith("use")
    large = "fn big() {\n" + "    let x = 1; // filler filler filler\n" * 200 + "}\n"
    assert [c[:2] for c in chunks.unit_chunks(large, "rust")][:2] == [(1, 18), (19, 36)]
    assert chunks.unit_chunks("let x;", "rust") == [(1, 1, "Block", "let x;")]
    assert [u.name for u in scanner.units(RUST, "rust") if u.kind == "function"] == ["post", "area", "hidden", "find"]


def test_chunk_files(spark):
    df = spark.createDataFrame([("src/a.rs", RUST), ("b.txt", "x\ny"), ("c.md", "")], "path string, content string")
    rows = chunks.chunk_files(df).collect()
    assert {r["file_path"] for r in rows} == {"src/a.rs", "b.txt"} and all(len(r["id"]) == 36 for r in rows)


def test_ignore_rules():
    rules = ignore.parse("# c\n*.log\n!keep.log\nbuild/\n/top.txt\nsrc/**/gen\n[ab].md\n")
    out = lambda p, folder=False: ignore.ignored(p, folder, rules)
    assert out("x/a.log") and not out("x/keep.log") and out("build", True) and not out("build") and out("top.txt") and not out("x/top.txt")
    assert out("src/a/b/gen") and out("src/gen") and out("a.md") and not out("c.md")


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "app"
    for path, content in {"main.rs": "pub struct Cache {}\nfn main() {}\n", "lib/util.py": "def helper():\n    pass\n", "skip/x.rs": "fn x() {}", "a.png": "x", ".hidden/y.rs": "fn y() {}", "lib/no.tmp.rs": "fn n() {}", ".gitignore": "skip/\n", "lib/.ignore": "*.tmp.rs\n", "empty.rs": "", "big.rs": "x" * 5000}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(content)
    (root / "bad.txt").write_bytes(b"\xff\xfe\xff")
    return root


def test_workspace(spark, tree):
    assert [p for p, _, _ in walk(str(tree), 4000)] == [".gitignore", "bad.txt", "empty.rs", "main.rs", ".hidden/y.rs", "lib/util.py"]
    rows = {r["path"]: r for r in read_workspaces(spark, [str(tree)], 4000).collect()}
    assert set(rows) == {"app/.gitignore", "app/main.rs", "app/.hidden/y.rs", "app/lib/util.py"}
    assert rows["app/main.rs"]["repository"] == "app" and rows["app/main.rs"]["size"] == 33
    assert [is_indexable_name(x) for x in ("lexer.rs", "setup.py", "Makefile", "logo.svgz", "tool.dll")] == [True, True, True, False, False]
    raw = spark.createDataFrame([(bytearray(b"ok"),), (bytearray(b"\xff"),)], "content binary")
    assert [r[0] for r in decoded(raw).collect()] == ["ok"]


def test_versioned_table(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    assert t.read() is None and t.version == -1
    rows = lambda *x: spark.createDataFrame(list(x), "path string, v int")
    t.upsert(rows(("a", 1), ("b", 1)), batch=0)
    t.upsert(rows(("b", 2), ("c", 2)), batch=1)
    assert t.upsert(rows(("z", 9)), batch=1) == 1
    assert sorted(map(tuple, t.read().collect())) == [("a", 1), ("b", 2), ("c", 2)]
    t.delete(rows(("a", 0)).select("path"))
    t.optimize()
    t.vacuum()
    assert t.read().count() == 2 and t.size_bytes() > 0 and len([x for x in os.listdir(tmp_path / "t") if x.startswith("v") and x != "versions"]) == 1
    t.clear()
    assert t.read().count() == 0


def test_versions_are_whole(spark, tmp_path):
    """Old versions stay readable, only touched buckets are written, and a file whose writer stopped doesn't count."""
    t = VersionedTable(spark, f"file://{tmp_path}/t", buckets=8)
    rows = lambda *x: spark.createDataFrame(list(x), "path string, v int")
    t.commit(rows(*((f"p{k}", k) for k in range(40))))
    first = t.pointer.get(0)["parts"]
    t.upsert(rows(("p3", 99)))
    second = t.pointer.get(1)["parts"]
    assert sum(first[b] != second[b] for b in first) == 1
    assert t.read(0).where("path = 'p3'").first()["v"] == 3 and t.read().where("path = 'p3'").first()["v"] == 99 and t.read().count() == 40
    (tmp_path / "t/versions/00000000000000000002.json").write_text('{"batch": 5, "par')
    assert t.version == 1 and t.read().count() == 40 and t.upsert(rows(("new", 1))) == 3 and t.read().count() == 41
    with pytest.raises(Conflict):
        t.pointer.advance(3, {})
    assert t.change(rows(("q", 1)), rows(("q", 1)), base=0) == 4 and t.read().count() == 41 and t.read().where("path = 'new'").isEmpty()


def test_incremental(spark):
    docs = spark.createDataFrame([("a", "1", "x"), ("b", "2", "x"), ("c", "", "x")], "path string, content string, language string")
    old = metadata.file_metadata(docs.where("path <> 'c'").withColumn("content", F.when(F.col("path") == "b", "9").otherwise(F.col("content"))), 1)
    assert [r["path"] for r in metadata.to_index(docs, metadata.file_metadata(docs, 2), old).collect()] == ["b"]
    stale = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "file_path string, start_line int")
    fresh = spark.createDataFrame([("a", 7)], "file_path string, start_line int")
    assert sorted(map(tuple, metadata.replace_chunks(stale, fresh).collect())) == [("a", 7), ("b", 1)]


def test_quantization(spark):
    assert [m.bytes_per_vector() for m in QuantizationMode] == [1536, 384, 48, 48]
    assert [QuantizationConfig.of(m).oversampling for m in QuantizationMode] == [1.0, 2.0, 3.0, 2.5]
    assert QuantizationConfig().candidates(5) == 10 and QuantizationMode.parse("BINARY") is QuantizationMode.BINARY and QuantizationMode.parse("x") is QuantizationMode.SCALAR
    df = spark.createDataFrame([(i, [float((i * 7 + j * 3) % 11 - 5) for j in range(40)]) for i in range(60)], "id int, embedding array<float>")
    q = df.where("id = 7").first()["embedding"]
    exact = {r["id"] for r in vectors.search(df, q, 5).collect()}
    for mode in (QuantizationMode.SCALAR, QuantizationMode.BINARY, QuantizationMode.ASYMMETRIC):
        got = vectors.search(df, q, 5, config=QuantizationConfig.of(mode)).collect()
        assert got[0]["id"] in exact and got[0]["score"] == pytest.approx(1) and len(got) == 5
    with pytest.raises(ValueError):
        vectors.search(df, q, 0)


def test_embed_once(spark):
    calls = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame([("a",), ("a",), ("bb",)], "content string")

    def model(texts):
        calls.add(len(texts))
        return [[float(len(t))] for t in texts]

    assert sorted(r["embedding"][0] for r in vectors.embed_with(df, model).collect()) == [1.0, 1.0, 2.0] and calls.value == 2


def test_cache():
    now = [0.0]
    cache = ResultCache(2, 10, lambda: now[0])
    a, b, c = (SearchQuery(x) for x in ("aa", "bb", "cc"))
    assert cache.get(a) is None and not ResultCache.cacheable(SearchQuery("a"))
    cache.put(a, 1)
    cache.put(b, 2)
    assert cache.get(a) == 1
    cache.put(c, 3)
    assert cache.get(b) is None and cache.get(a) == 1 and cache.metrics.hit_rate() == pytest.approx(0.5)
    assert cache.get(a, version=1) is None
    now[0] = 11
    assert cache.get(a) is None and cache.expire() == 1 and len(cache) == 0
    assert ResultCache().metrics.hit_rate() == 0 and ResultCache().metrics.average_micros() == 0
    assert SearchQuery("x", limit=0).limit == 50 and SearchQuery("x", "fuzzy").mode == "semantic"


def test_stream_equals_batch(spark, sf, tmp_path):
    from loomdex.plans.catalog import change_events, table

    events = change_events(table(spark, sf, "events"))
    late = spark.createDataFrame([(10**9, 10**9, "modified")], "event_id long, path long, kind string").withColumn("ts", F.lit("2030-01-01").cast("timestamp"))
    folder = str(tmp_path / "events")
    events.unionByName(late).write.parquet(folder)
    stream = changes.debounce(spark.readStream.schema(events.schema).parquet(folder), "1 hour", "1 hour")
    out = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    out.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = changes.debounce(events, "1 hour")
    assert got.count() == want.count() and got.exceptAll(want.select(*got.columns)).count() == 0


def test_watcher(spark, tmp_path):
    schema = "path string, kind string, ts timestamp, event_id long"
    row = lambda p, k, i: (p, k, __import__("datetime").datetime(2024, 1, 1, 0, 0, i), i)
    folder = str(tmp_path / "in")
    spark.createDataFrame([row("a", "created", 1), row("b", "created", 2), row("a", "modified", 3), row("c", "created", 4), row("c", "deleted", 5)], schema).write.parquet(folder)
    table = VersionedTable(spark, f"file://{tmp_path}/t")
    read = lambda paths: paths.withColumn("content", F.concat(F.lit("text of "), "path"))
    w = changes.Watcher(spark.readStream.schema(schema).parquet(folder), changes.apply_batch(table, read), str(tmp_path / "cp"))
    w.start(available_now=True).awaitTermination()
    assert sorted(r["path"] for r in table.read().collect()) == ["a", "b"] and not w.is_watching()
    spark.createDataFrame([row("a", "deleted", 9)], schema).write.mode("append").parquet(folder)
    w.start(available_now=True).awaitTermination()
    assert [r["path"] for r in table.read().collect()] == ["b"]
    w.stop()


def stamped(rows):
    from datetime import datetime

    return [(p, kind, datetime(2024, 1, 1, 0, 0, n), n) for p, kind, n in rows]


EVENTS = "path string, kind string, ts timestamp, event_id long"


def test_search_after_watched_changes(spark, tree, tmp_path):
    """Edits, new files and deletions that a stream names are found, or no longer, after each batch; chunks and statistics follow."""
    model = lambda texts: [[float("cache" in t.lower()), float("fresh" in t.lower()), 0.1] for t in texts]
    folder = f"{tmp_path}/events"
    put = lambda *rows: spark.createDataFrame(stamped(rows), EVENTS).coalesce(1).write.mode("append").parquet(folder)
    put(("app/none.rs", "modified", 1))
    with Engine(spark, Config(workspace_roots=(str(tree),), cache_dir=f"file://{tmp_path}/index", max_file_size=4000, index_buckets=4), model) as e:
        chunks_before = e.read("chunks").count()

        def step():
            e.watch(spark.readStream.schema(EVENTS).parquet(folder), available_now=True)
            e._watcher.query.awaitTermination()

        step()
        assert e.search_symbols("main").total_matches == 1 and e.read("chunks").count() == chunks_before
        (tree / "main.rs").write_text("struct Fresh {}\nfn renamed() {}\n")
        (tree / "added.rs").write_text("fn added() {}\n")
        put(("app/main.rs", "modified", 2), ("app/added.rs", "deleted", 3), ("app/added.rs", "created", 4))
        step()
        assert e.search_symbols("main").rows == [] and e.search_symbols("renamed").total_matches == 1 and e.search_symbols("added").total_matches == 1
        assert e.search_semantic("fresh").rows[0]["file_path"] == "app/main.rs" and e.read("chunks").count() == chunks_before + 1
        assert e.index_status()["indexed_files"] == 5
        n = e._state.current()[0]
        (tree / "added.rs").unlink()
        put(("app/added.rs", "deleted", 5), ("app/lib/util.py", "modified", 6))
        step()
        assert e.search_symbols("added").rows == [] and e.search_symbols("helper").total_matches == 1 and e.read("chunks").count() == chunks_before
        assert e._state.current()[0] == n + 1 and e.index_status()["indexed_files"] == 4
        e.optimize()
        assert e.search_symbols("renamed").total_matches == 1 and e.reindex() == {"unchanged": 4}


def test_crash_between_tables_and_state(spark, tree, tmp_path):
    """A writer that stops before the state is renewed leaves the old one whole; the next one makes the change again."""
    with Engine(spark, Config(workspace_roots=(str(tree),), cache_dir=f"file://{tmp_path}/index", max_file_size=4000, index_buckets=4)) as e:
        (tree / "main.rs").write_text("fn renamed() {}\n")
        advance = e._state.advance

        def stop(*_):
            raise KeyboardInterrupt

        e._state.advance = stop
        with pytest.raises(KeyboardInterrupt):
            e.reindex()
        e._state.advance = advance
        assert e.search_symbols("main").total_matches == 1 and e.search_symbols("renamed").rows == []
        assert e.reindex() == {"unchanged": 3, "changed": 1}
        assert e.search_symbols("main").rows == [] and e.search_symbols("renamed").total_matches == 1


def test_changes_of_workspaces(spark, tree, tmp_path):
    """The source tells what was created, modified and deleted since it looked last, so many at a time, and what isn't indexable never."""
    feed = changes._Feed({"roots": str(tree), "maxFileBytes": "4000", "maxFilesPerTrigger": "4"})
    first, at = feed.read(feed.initialOffset())
    second, end = feed.read(at)
    assert {(p, k) for p, k, _, _ in [*first, *second]} == {(f"app/{p}", "created") for p in (".gitignore", "bad.txt", "empty.rs", "main.rs", ".hidden/y.rs", "lib/util.py")}
    assert end == {"n": 6} and [r[0] for r in feed.readBetweenOffsets(at, end)] and feed.read(end)[1] == end
    (tree / "main.rs").write_text("fn other_main() {}\n")
    (tree / "lib/util.py").unlink()
    (tree / "skip/z.rs").write_text("fn z() {}")
    rows, last = feed.read(end)
    assert [(p, k) for p, k, _, _ in rows] == [("app/lib/util.py", "deleted"), ("app/main.rs", "modified")]
    feed.commit(last)
    assert not feed.given
    with Engine(spark, Config(workspace_roots=(str(tree),), cache_dir=f"file://{tmp_path}/index", max_file_size=4000, index_buckets=4)) as e:
        (tree / "late.rs").write_text("fn arrived_late() {}\n")
        e.watch(available_now=False)
        assert e.is_watching()
        e.watch()
        for _ in range(240):
            if e.search_symbols("arrived_late").total_matches:
                break
            e.cache.clear()
            time.sleep(0.25)
        assert e.search_symbols("arrived_late").total_matches == 1
        e.stop()
        assert not e.is_watching()


def test_empty_engine(spark, tmp_path):
    (tmp_path / "nothing").mkdir()
    with Engine(spark, Config(workspace_roots=(str(tmp_path / "nothing"),), cache_dir=f"file://{tmp_path}/index")) as e:
        e.optimize()
        assert e.search_symbols("main").rows == [] and e.index_status()["indexed_files"] == 0 and e.reindex() == {}


def test_engine(spark, tree, tmp_path):
    model = lambda texts: [[float("cache" in t.lower()), float("helper" in t), 0.1] for t in texts]
    e = Engine(spark, Config(workspace_roots=(str(tree),), cache_dir=f"file://{tmp_path}/index", max_file_size=4000), model, clock=lambda: 1000)
    with pytest.raises(NotStarted):
        e.search_symbols("main")
    with e:
        got = e.search_symbols("main")
        assert [(r["file_path"], r["line_number"], r["column"]) for r in got.rows] == [("app/main.rs", 2, 3)] and got.total_matches == 1 and not got.from_cache
        assert e.search_symbols("main").from_cache
        assert [r["file_path"] for r in e.search_semantic("cache").rows][0] == "app/main.rs"
        assert e.search_symbols("helper", file_patterns=("*.rs",)).rows == []
        assert e.search_symbols("helper", repositories=("app",)).total_matches == 1
        status = e.index_status()
        assert status["indexed_files"] == 4 and status["total_symbols"] == 80 and status["exact_symbols"] == 4 and status["index_size_bytes"] > 0
        assert e.reindex() == {"unchanged": 4}
        (tree / "main.rs").write_text("fn renamed() {}\n")
        (tree / "lib/util.py").unlink()
        assert e.reindex() == {"unchanged": 2, "changed": 1, "deleted": 1}
        assert e.search_symbols("main").rows == [] and e.search_symbols("renamed").total_matches == 1
        e.configure(languages=("rust",))
        assert e.config.workspace_roots == (str(tree),)
        with pytest.raises(ValueError):
            e.configure(nonsense=1)
