"""Expressions on texts and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that open a definition; each counts wherever it stands in a line, with its blank.
DEFINITION_WORDS = ("fn ", "function ", "def ", "class ", "struct ", "interface ", "trait ", "impl ", "type ", "enum ")

#: What separates tokens, and the bytes from which on a token is left out.
TOKEN_GAP = r"[^\p{L}\p{N}]+"
TOKEN_BYTES = 40


def lines_of(text: Column) -> Column:
    """The lines of a text: split at newlines, less one carriage return each; a final newline opens no line, and an empty text has none."""
    body = F.regexp_replace(text, r"\n\z", "")
    split = F.transform(F.split(body, "\n"), lambda x: F.regexp_replace(x, r"\r\z", ""))
    return F.when(F.length(text) > 0, split).otherwise(F.array().cast("array<string>"))


def tokens_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits of fewer than 40 bytes, in order."""
    return F.filter(F.split(F.lower(text), TOKEN_GAP), lambda x: (x != "") & (F.octet_length(x) < TOKEN_BYTES))


def byte_position(needle: str, line: Column) -> Column:
    """0-based byte offset of a lower-cased text's first occurrence in the lower-cased line; 0 where absent."""
    low = F.lower(line)
    return F.octet_length(F.substring(low, F.lit(1), F.greatest(F.locate(needle.lower(), low) - 1, F.lit(0))))


def is_definition(line: Column, query: str) -> Column:
    """Whether a line has a definition word and the query, case aside."""
    low = F.lower(line)
    found = F.lit(False)
    for word in DEFINITION_WORDS:
        found = found | F.contains(low, F.lit(word))
    return found & F.contains(low, F.lit(query.lower()))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def first_segment(path: Column) -> Column:
    """What stands before the first slash; empty for absolute paths."""
    return F.split_part(path, F.lit("/"), F.lit(1))


def extension(path: Column) -> Column:
    """What follows the last dot of a file name, lower-cased; null without one, or where only a leading dot is."""
    found = F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1)
    return F.when(file_name(path).rlike(r"^.+\.[^.]*$"), F.lower(found))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def workspace_id(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 16)


def chunk_id(path: Column, start: Column, end: Column) -> Column:
    """UUID-shaped id of a line range of a file: 16 hex digits of the path's hash, 8 of either line."""
    digits = F.concat(F.substring(F.sha2(path, 256), 1, 16), _hex8(start), _hex8(end))
    return F.concat_ws("-", *(F.substring(digits, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def _hex8(n: Column) -> Column:
    return F.lower(F.lpad(F.hex(n.cast("long")), 8, "0"))


def name_pattern(pattern: str, path: Column) -> Column:
    """Symbol search's file pattern: on the file name; with stars, their removal must leave a part of it, else it is the name."""
    name = file_name(path)
    return F.contains(name, F.lit(pattern.replace("*", ""))) if "*" in pattern else name == pattern


def path_pattern(pattern: str, path: Column, glob: str = "legacy") -> Column:
    """Semantic search's file pattern: on the whole path.

    legacy: with stars, an unanchored regular expression in which ** and * are replaced one
    after the other, and dots stand for anything; an invalid one matches nothing; without
    stars, a part of the path. strict: an anchored glob, ** across folders.
    """
    if glob == "strict":
        return path.rlike(strict_glob(pattern))
    if "*" not in pattern:
        return F.contains(path, F.lit(pattern))
    expression = legacy_glob(pattern)
    return path.rlike(expression) if valid_regex(expression) else F.lit(False)


def legacy_glob(pattern: str) -> str:
    return pattern.replace("**", ".*").replace("*", "[^/]*")


def strict_glob(pattern: str) -> str:
    """An anchored regular expression: ** crosses folders, * and ? don't, all else is literal."""
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif pattern.startswith("**", i):
            out.append(".*")
            i += 2
        else:
            c = pattern[i]
            out.append("[^/]*" if c == "*" else "[^/]" if c == "?" else c if c.isalnum() or c in "_/-" else "\\" + c)
            i += 1
    return r"\A" + "".join(out) + r"\z"


def valid_regex(expression: str) -> bool:
    """Judged by Python's compiler; what stars and literals translate to means the same to Java's."""
    import re

    try:
        re.compile(expression)
    except re.error:
        return False
    return True
