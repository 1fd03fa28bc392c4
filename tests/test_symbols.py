"""Symbols and chunks of small files, by hand."""

import time

from pyspark.sql import functions as F

from loomdex.operators import chunks, symbols

CODE = {
    "rust": "pub struct Ledger<K> {\n    rows: Vec<K>,\n}\nimpl<K> Ledger<K> {\n    fn post(&mut self) {}\n}\nenum Side { Debit }\ntrait Priced { fn price(&self); }\nmod audit { fn hidden() {} }\nconst LIMIT: usize = 3;\nfn main() {}\n",
    "python": "class A:\n    def m(self):\n        pass\n\nasync def f():\n    pass\n",
    "javascript": "function a() { return 1 }\nclass B { m() {} }\nconst c = () => 1;\nrun(function d() { return 2 });\nmodule.exports = {\n  e(x) { if (x) { return 1 } },\n  async g() {}\n};\n",
    "typescript": "export class Box<T> { get(): T { return this.v } }\nexport function pack(n: number): string { return `${n}` }\nlet z: number = 1;\nexport default { render(): void {} };\n",
    "go": "package p\nfunc A() {}\nfunc (r *T) M() {}\ntype T struct { a int }\ntype I interface { M() }\n",
    "java": "public class A { void m() {} }\ninterface I { void f(); }\nenum C { A }\n",
    "c": "struct point { int x; };\nenum color { RED };\nint add(int a, int b) { return a + b; }\n",
    "cpp": "class Shape {\npublic:\n  Shape(int n) : n_(n) {}\n  int area() const { return n_; }\n  ~Shape() {}\n};\nenum class Mode { On };\nint Shape::twice(int k) { return 2 * k; }\nstruct Pair { int sum() { return 0; } };\n",
    "toml": "[a]\nb = 1\n",
}
SYMBOLS = {
    "rust": [("struct", "Ledger", 0, 2), ("impl", "Ledger<K>", 3, 5), ("enum", "Side", 6, 6), ("trait", "Priced", 7, 7), ("module", "audit", 8, 8), ("constant", "LIMIT", 9, 9), ("function", "main", 10, 10)],
    "python": [("class", "A", 0, 2), ("function", "f", 4, 5)],
    "javascript": [("function", "a", 0, 0), ("class", "B", 1, 1), ("variable", "c", 2, 2), ("function", "d", 3, 3), ("method", "e", 5, 5), ("method", "g", 6, 6)],
    "typescript": [("class", "Box", 0, 0), ("function", "pack", 1, 1), ("variable", "z", 2, 2), ("method", "render", 3, 3)],
    "go": [("function", "A", 1, 1), ("function", "M", 2, 2), ("struct", "T", 3, 3), ("interface", "I", 4, 4)],
    "java": [("class", "A", 0, 0), ("interface", "I", 1, 1), ("enum", "C", 2, 2)],
    "c": [("struct", "point", 0, 0), ("enum", "color", 1, 1), ("function", "add", 2, 2)],
    "cpp": [("function", "Shape", 2, 2), ("function", "area", 3, 3), ("function", "~Shape", 4, 4), ("enum", "Mode", 6, 6), ("function", "Shape::twice", 7, 7), ("struct", "Pair", 8, 8)],
}
FUNCTIONS = "\n".join(f"def f{i}():\n" + "\n".join(f"    step_{j} = work(step_{j - 1}, {i})" for j in range(1, 21)) for i in range(4))


def found(spark):
    return symbols.with_symbols(spark.createDataFrame(list(CODE.items()), "language string, content string"))


def test_symbols(spark):
    got = {r["language"]: [(s["kind"], s["name"], s["start_line"], s["end_line"]) for s in r["symbol_list"]] for r in found(spark).collect()}
    assert got == SYMBOLS | {"toml": []}


def test_symbols_text(spark):
    got = {r[0]: r[1] for r in found(spark).select("language", symbols.symbols_text(F.col("symbol_list"))).collect()}
    assert got == {x: "\n".join(f"{k} {n}" for k, n, _, _ in all_) for x, all_ in SYMBOLS.items()} | {"toml": ""}


def test_signatures(spark):
    got = {r["language"]: [s["signature"] for s in r["symbol_list"]] for r in found(spark).where(F.col("language").isin("python", "go")).collect()}
    assert got["python"] == ["class A:", "async def f():"]
    assert got["go"] == ["func A() {}", "func (r *T) M() {}", "type T struct { a int }", "type I interface { M() }"]


def test_chunks_by_hand(spark):
    assert [c[:3] for c in chunks.heuristic_chunks(FUNCTIONS, "python")] == [(1, 21, "Block"), (22, 42, "Function"), (43, 63, "Function"), (64, 84, "Function")]
    files = spark.createDataFrame([("m.py", FUNCTIONS), ("n.txt", "a\nb"), ("e.rs", "")], "path string, content string")
    got = {tuple(r) for r in chunks.chunk_files(files).select("file_path", "start_line", "end_line", "chunk_type").collect()}
    assert got == {("m.py", 1, 42, "Function"), ("m.py", 43, 84, "Function"), ("n.txt", 1, 2, "Block")}


def test_long_comments_are_linear():
    """A comment of a megabyte is a run of blanks to the patterns; none may go back and forth over it."""
    started = time.process_time()
    for language in ("rust", "javascript", "go", "java", "c"):
        symbols.symbols_of("x() { // " + "le ouou " * 130_000 + "\n}\nclass Behind {}\n", language)
    assert time.process_time() - started < 20
