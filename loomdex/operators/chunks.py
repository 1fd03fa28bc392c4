"""Cutting texts into chunks: fixed windows, structure by heuristics, and units of code."""

from __future__ import annotations

import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from loomdex.functions.batches import small_batches
from loomdex.functions.language import chunk_language
from loomdex.functions.vectors import bound
from loomdex.functions.text import chunk_id, lines_of
from loomdex.operators.scanner import CHUNKED, units

CHUNK_BYTES, MAX_BYTES, OVERLAP, LINE_BYTES = 1500, 3000, 0.15, 80
WINDOW = CHUNK_BYTES // LINE_BYTES
SHARED = int(WINDOW * OVERLAP)
CHUNK = "struct<start_line:int,end_line:int,chunk_type:string,content:string>"

#: How lines that open a unit begin, blanks apart.
BOUNDARIES = {
    "rust": ("pub fn", "fn ", "pub struct", "struct ", "impl ", "pub trait", "trait "),
    "python": ("def ", "class ", "async def "),
    "javascript": ("function ", "const ", "let ", "class ", "export "),
}
BOUNDARIES["typescript"] = BOUNDARIES["javascript"]
BRACED = ("rust", "javascript", "typescript", "java", "cpp")


def is_boundary(line: Column, language: Column) -> Column:
    """Whether a line opens a unit of its language: begins with one of its heads, blanks apart; a head that ends with a blank needs more after it.

    One anchored expression a language looks at the beginning of a line only.
    """
    out = F.lit(False)
    for name, heads in BOUNDARIES.items():
        some = "|".join(h + r"(?=\s*\S)" if h.endswith(" ") else h for h in heads)
        out = F.when(language == name, line.rlike(rf"^\s*(?:{some})")).otherwise(out)
    return F.coalesce(out, F.lit(False))


def _windows(df: DataFrame, text: str, width: int, step: int, starts) -> DataFrame:
    others = [c for c in df.columns if c != text]
    made = df.select(*others, lines_of(F.col(text)).alias("_lines")).where(F.size("_lines") > 0)
    each = made.select(*others, "_lines", F.explode(starts(F.size("_lines"))).alias("_s"))
    end = F.least(F.col("_s") + width, F.size("_lines"))
    return each.select(*others, (F.col("_s") + 1).alias("start_line"), end.alias("end_line"), F.array_join(F.slice("_lines", F.col("_s") + 1, F.lit(width)), "\n").alias(text))


def fixed_windows(df: DataFrame, text: str = "content") -> DataFrame:
    """Windows of 18 lines, 2 of them shared with the one before; a window that would only repeat isn't begun."""
    step = WINDOW - SHARED
    return _windows(df, text, WINDOW, step, lambda n: F.sequence(F.lit(0), F.greatest(n - SHARED - 1, F.lit(0)), F.lit(step)))


def split_large(df: DataFrame, text: str = "content") -> DataFrame:
    """Windows of 18 lines that share none."""
    return _windows(df, text, WINDOW, WINDOW, lambda n: F.sequence(F.lit(0), n - 1, F.lit(WINDOW)))


def lines_of_text(text: str) -> list[str]:
    return [x.removesuffix("\r") for x in text.removesuffix("\n").split("\n")] if text else []


def heuristic_chunks(text: str, language: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, type, content): cut before a unit's first line once half full or outside braces, or when overfull.

    A cut within a unit repeats the last 15 % of its lines in the next chunk.
    """
    heads, braced = BOUNDARIES.get(language or "", ()), language in BRACED
    out, held, size, first, in_unit, depth = [], [], 0, 0, False, 0
    rows = lines_of_text(text)
    for i, row in enumerate(rows):
        opens = row.strip().startswith(heads) if heads else False
        if braced:
            depth += row.count("{") - row.count("}")
        if size > MAX_BYTES or opens and held and (size > CHUNK_BYTES // 2 or depth == 0):
            kept = 0
            if held:
                out.append((first + 1, i, "Function" if in_unit else "Block", "\n".join(held)))
                kept = 0 if opens else int(len(held) * OVERLAP)
            held = held[len(held) - kept :]
            first, size = i - kept, sum(len(x.encode()) for x in held)
            in_unit = opens and "fn " in row or "def " in row
        held.append(row)
        size += len(row.encode())
    if held:
        out.append((first + 1, len(rows), "Function" if in_unit else "Block", "\n".join(held)))
    return out


def heuristic_spans(lines: Column, language: Column) -> Column:
    """array<struct<start_line, end_line, chunk_type>> by the rules of heuristic_chunks, as one fold over an array of lines.

    The fold carries where the open chunk begins, its bytes, the depth of braces and whether it
    is a unit's; each line is looked at once, and the lines that a cut repeats once more. Null
    lines or a null language cut by size alone; no lines make no chunks. Blanks before a unit's
    head are those of ASCII.
    """
    braced = F.coalesce(language.isin(*BRACED), F.lit(False))
    count = lambda x, c: F.length(x) - F.length(F.translate(x, c, ""))
    rows = F.transform(
        lines,
        lambda x: F.struct(
            is_boundary(x, language).alias("opens"),
            F.when(braced, count(x, "{") - count(x, "}")).otherwise(0).alias("turn"),
            F.octet_length(x).alias("size"),
            F.contains(x, F.lit("fn ")).alias("fn"),
            F.contains(x, F.lit("def ")).alias("def"),
        ),
    )
    span = "struct<start_line:int,end_line:int,chunk_type:string>"
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("first"), F.lit(0).alias("size"), F.lit(0).alias("depth"), F.lit(False).alias("unit"), F.array().cast(f"array<{span}>").alias("out"))
    kind = lambda s: F.when(s["unit"], "Function").otherwise("Block")
    chunk = lambda s: F.struct((s["first"] + 1).alias("start_line"), s["at"].alias("end_line"), kind(s).alias("chunk_type"))

    def step(s: Column, x: Column) -> Column:
        depth = s["depth"] + x["turn"]
        some = s["at"] > s["first"]
        cut = (s["size"] > MAX_BYTES) | x["opens"] & some & ((s["size"] > CHUNK_BYTES // 2) | (depth == 0))
        kept = F.when(x["opens"], 0).otherwise(F.floor((s["at"] - s["first"]) * OVERLAP).cast("int"))
        again = F.aggregate(F.slice(lines, s["at"] - kept + 1, kept), F.lit(0), lambda n, y: n + F.octet_length(y))  # of the column, not of rows, which would be made again at each cut
        return F.struct(
            (s["at"] + 1).alias("at"),
            F.when(cut, s["at"] - kept).otherwise(s["first"]).alias("first"),
            (F.when(cut, again).otherwise(s["size"]) + x["size"]).alias("size"),
            depth.alias("depth"),
            F.when(cut, x["opens"] & x["fn"] | x["def"]).otherwise(s["unit"]).alias("unit"),
            F.when(cut, F.concat(s["out"], F.array(chunk(s)))).otherwise(s["out"]).alias("out"),
        )

    def finish(s: Column) -> Column:
        return F.when(s["at"] > s["first"], F.concat(s["out"], F.array(chunk(s)))).otherwise(s["out"])

    return F.aggregate(rows, start, step, finish)


def chunk_structure(df: DataFrame, text: str = "content", language: str = "language") -> DataFrame:
    """A row for each chunk of heuristic_spans: start_line, end_line, chunk_type and the chunk's text in text's place; other columns stay.

    Lines and spans are made in the JVM, once each, as they are written into a column before the chunks are exploded.
    """
    others = [c for c in df.columns if c != text]
    made = df.where(F.length(text) > 0).select(*others, lines_of(F.col(text)).alias("_lines"))  # not by the lines' number, which would make them twice
    body = lambda c: F.array_join(F.slice("_lines", c["start_line"], c["end_line"] - c["start_line"] + 1), "\n")
    whole = F.transform(heuristic_spans(F.col("_lines"), F.col(language)), lambda c: F.struct(c["start_line"].alias("start_line"), c["end_line"].alias("end_line"), c["chunk_type"].alias("chunk_type"), body(c).alias("text")))
    each = made.select(*others, F.explode(whole).alias("_c"))  # chunks are cut inside the row: lines would be copied for each
    return each.select(*others, "_c.start_line", "_c.end_line", "_c.chunk_type", F.col("_c.text").alias(text))


UNIT = "struct<start_line:int,end_line:int,kind:string,content:string>"


def packed_spans(sizes: Column, head: Column, target: int = CHUNK_BYTES, largest: int = MAX_BYTES) -> Column:
    """array<struct<first, last, headed, large>>: units' indexes from 0, packed in order by the sizes of an array, as one fold.

    A chunk is closed before the unit that would take it over target, and the next one then begins
    with a head of so many bytes, if that is above 0. A unit over largest closes the chunk and
    is one by itself; what follows it begins without a head. A single unit between target and
    largest is a chunk. No units make no chunks.
    """
    span = "struct<first:int,last:int,headed:boolean,large:boolean>"
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("first"), F.lit(0).cast("long").alias("size"), F.lit(False).alias("headed"), F.array().cast(f"array<{span}>").alias("out"))
    chunk = lambda first, last, headed, large: F.array(F.struct(first.alias("first"), last.alias("last"), headed.alias("headed"), F.lit(large).alias("large")))
    open_one = lambda s: chunk(s["first"], s["at"] - 1, s["headed"], False)

    def step(s: Column, n: Column) -> Column:
        some, large = s["at"] > s["first"], n > largest
        over = some & (s["size"] + n > target)
        closed = F.when(some & (large | over), F.concat(s["out"], open_one(s))).otherwise(s["out"])
        return F.struct(
            (s["at"] + 1).alias("at"),
            F.when(large, s["at"] + 1).when(over, s["at"]).otherwise(s["first"]).alias("first"),
            F.when(large, F.lit(0).cast("long")).when(over, (head + n).cast("long")).otherwise(s["size"] + n).alias("size"),
            F.when(large, False).when(over, head > 0).otherwise(s["headed"]).alias("headed"),
            F.when(large, F.concat(closed, chunk(s["at"], s["at"], F.lit(False), True))).otherwise(closed).alias("out"),
        )

    return F.aggregate(sizes, start, step, lambda s: F.when(s["at"] > s["first"], F.concat(s["out"], open_one(s))).otherwise(s["out"]))


def pack_units(df: DataFrame, units: str = "units", head: str | None = None, out: str = "content", target: int = CHUNK_BYTES, largest: int = MAX_BYTES) -> DataFrame:
    """A row for each chunk of an array of UNITs, in their order: start_line, end_line, chunk_type and text; df's other columns stay.

    A chunk's type is its first unit's kind; its units stand with an empty line between them, behind
    the text of column head where the chunk before was full. A unit over largest is cut into windows
    of 18 lines. Null or empty arrays have no chunks; a null head is none; null texts in units are empty ones.
    """
    others = [c for c in df.columns if c not in (units, head, out, "start_line", "end_line", "chunk_type")]
    again = F.lit("") if head is None else F.coalesce(F.col(head), F.lit(""))
    body = lambda u: F.coalesce(u["content"], F.lit(""))

    def pieces(c: Column) -> Column:
        first, last = F.get("_u", c["first"]), F.get("_u", c["last"])
        texts = F.transform(F.slice("_u", c["first"] + 1, c["last"] - c["first"] + 1), body)
        joined = F.array_join(F.concat(F.when(c["headed"], F.array("_head")).otherwise(F.array().cast("array<string>")), texts), "\n\n")
        piece = lambda a, b, text: F.struct(a.alias("a"), b.alias("b"), first["kind"].alias("kind"), text.alias("text"))
        window = lambda rows, at: piece(first["start_line"] + at, first["start_line"] + F.least(at + WINDOW, F.size(rows)) - 1, F.array_join(F.slice(rows, at + 1, F.lit(WINDOW)), "\n"))
        cut = bound(lines_of(body(first)), lambda rows: F.transform(F.sequence(F.lit(0), F.size(rows) - 1, F.lit(WINDOW)), lambda at: window(rows, at)))
        return F.when(c["large"], cut).otherwise(F.array(piece(first["start_line"], last["end_line"], joined)))

    # no filter by the units' number, which would make them twice; chunks are cut inside the row, so that only they are copied, not all units for each
    made = df.select(*others, F.col(units).alias("_u"), again.alias("_head"))
    spans = packed_spans(F.transform("_u", lambda u: F.octet_length(body(u))), F.octet_length("_head"), target, largest)
    each = made.select(*others, F.explode(F.flatten(F.transform(spans, pieces))).alias("_p"))
    return each.select(*others, F.col("_p.a").alias("start_line"), F.col("_p.b").alias("end_line"), F.col("_p.kind").alias("chunk_type"), F.col("_p.text").alias(out))


def _rows(made: list[tuple[int, int, str, str]]) -> list[dict]:
    return [dict(zip(("start_line", "end_line", "chunk_type", "content"), c, strict=True)) for c in made]


def _by_rules(text: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([_rows(heuristic_chunks(t or "", x)) for t, x in zip(text, language, strict=True)])


def chunk_by_rules(df: DataFrame, text: str = "content", language: str = "language") -> DataFrame:
    """As chunk_structure, by heuristic_chunks in Arrow batches; blanks before a unit's head may be any of Unicode. A small batch's texts are held at once."""
    small_batches(df.sparkSession)
    others = [c for c in df.columns if c != text]
    each = df.select(*others, F.explode(pandas_udf(_by_rules, f"array<{CHUNK}>")(F.col(text), F.col(language))).alias("_c"))
    return each.select(*others, "_c.start_line", "_c.end_line", "_c.chunk_type", F.col("_c.content").alias(text))


def unit_chunks(text: str, language: str, target: int = CHUNK_BYTES, largest: int = MAX_BYTES) -> list[tuple[int, int, str, str]]:
    """(start, end, type, content): units packed in order up to a target size, imports repeated at the head of later chunks.

    Units over the largest size are cut into windows. A text without units is one chunk.
    """
    found = units(text, language)
    imports = "\n".join(text[u.start : u.end] for u in found if u.kind == "import")
    ends = [m.start() for m in re.finditer("\n", text)]
    line = lambda at: bisect_left(ends, at) + 1
    out: list[tuple[int, int, str, str]] = []
    parts: list[str] = []
    size, start, end, kind = 0, 0, 0, "Block"

    def flush() -> None:
        nonlocal parts, size, start
        if start:
            out.append((start, end, kind, "\n\n".join(parts)))
        parts, size, start = [], 0, 0

    for u in found:
        if u.kind == "import":
            continue
        body = text[u.start : u.end]
        n = len(body.encode())
        if n > largest:
            flush()
            rows = lines_of_text(body)
            out += [(line(u.start) + at, line(u.start) + min(at + WINDOW, len(rows)) - 1, "Function" if u.kind == "function" else "Class", "\n".join(rows[at : at + WINDOW])) for at in range(0, len(rows), WINDOW)]
            continue
        if start and size + n > target:
            flush()
            if imports:
                parts, size = [imports], len(imports.encode())
        if not start:
            start, kind = line(u.start), "Function" if u.kind == "function" else "Class"
        parts.append(body)
        size, end = size + n, line(max(u.end - 1, u.start))
    flush()
    if not out and text:
        out.append((1, len(lines_of_text(text)), "Block", text))
    return out


def chunks_of(text: str | None, language: str | None) -> list[dict]:
    """By units for the languages that have them, else by heuristics."""
    if not text:
        return []
    return _rows(unit_chunks(text, language) if language in CHUNKED else heuristic_chunks(text, language))


def _chunk(text: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([chunks_of(t, x) for t, x in zip(text, language, strict=True)])


def chunk_files(docs: DataFrame, path: str = "path", text: str = "content") -> DataFrame:
    """(id, file_path, start_line, end_line, language, chunk_type, content) of each chunk of each file; a task holds one small batch of files."""
    small_batches(docs.sparkSession)
    cut = pandas_udf(_chunk, f"array<{CHUNK}>")
    made = docs.select(F.col(path).alias("file_path"), chunk_language(F.col(path)).alias("language"), F.col(text).alias("_t"))
    each = made.select("file_path", "language", F.explode(cut(F.col("_t"), F.col("language"))).alias("_c")).select("file_path", "language", "_c.*")
    return each.select(chunk_id(F.col("file_path"), F.col("start_line"), F.col("end_line")).alias("id"), "file_path", "start_line", "end_line", "language", "chunk_type", "content")
