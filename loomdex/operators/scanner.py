"""Declarations in source code, without a grammar library.

Python is parsed by its own ast module. For the other languages comments and strings are blanked
out, declaration heads are found by patterns, and bodies by matching braces. What stands inside
a found declaration isn't searched. Code that doesn't parse yields what its heads show.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from dataclasses import dataclass


@dataclass(frozen=True)
class Declaration:
    """A named piece of code; start and end are code point offsets."""

    kind: str
    name: str
    start: int
    end: int


_HIDE = {
    "c": re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'""", re.S),
    "rust": re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|r(\#*)".*?"\1|"(?:\\.|[^"\\])*"|'(?:\\[^\n]{1,8}|[^'\\\n])'""", re.S),
    "script": re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`""", re.S),
}
_HIDE |= {"go": _HIDE["script"], "java": _HIDE["c"], "cpp": _HIDE["c"], "javascript": _HIDE["script"], "typescript": _HIDE["script"]}

_RUST_LEAD = r"(?:\bpub(?:\s*\([^)]*\))?\s+)?"
_EXPORTS = r"(?:\b(?:public|private|protected|static|final|abstract|sealed|strictfp)\s+)*"
_HEADS: dict[str, list[tuple[str, re.Pattern]]] = {
    "rust": [
        ("function", re.compile(_RUST_LEAD + r"""(?:\b(?:default|async|unsafe|const|extern(?:\s+"[^"]*")?)\s+)*\bfn\s+(?P<name>\w+)""")),
        ("struct", re.compile(_RUST_LEAD + r"\bstruct\s+(?P<name>\w+)")),
        ("enum", re.compile(_RUST_LEAD + r"\benum\s+(?P<name>\w+)")),
        ("trait", re.compile(_RUST_LEAD + r"(?:\bunsafe\s+)?\btrait\s+(?P<name>\w+)")),
        ("impl", re.compile(r"(?:\bunsafe\s+)?\bimpl\b(?P<head>[^{;]*)")),
        ("module", re.compile(_RUST_LEAD + r"\bmod\s+(?P<name>\w+)")),
        ("constant", re.compile(_RUST_LEAD + r"\b(?:const|static)\s+(?:mut\s+)?(?P<name>\w+)\s*:")),
    ],
    "javascript": [
        ("function", re.compile(r"(?:\basync\s+)?\bfunction\s*\*?\s+(?P<name>[\w$]+)")),
        ("class", re.compile(r"(?:\babstract\s+)?\bclass\s+(?!extends\b)(?P<name>[\w$]+)")),
        ("variable", re.compile(r"\b(?:const|let|var)\s+(?P<name>[\w$]+|[\[{][^=;]*?[\]}])")),
        # of objects and unnamed classes: what is inside a named declaration isn't searched
        ("method", re.compile(r"(?<![\w$.)\s])\s*(?P<lead>(?:(?:static|async|get|set)\s+)*(?:\*\s*)?)(?P<name>[\w$]+)\s*\([^(){};]*\)\s*(?::\s*[\w<>\[\]|. ]+)?\{")),
    ],
    "go": [
        ("function", re.compile(r"(?m)^func\s+(?:\([^)]*\)\s*)?(?P<name>\w+)")),
        ("type", re.compile(r"(?m)^type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s*=?\s*(?P<what>\w*)")),
    ],
    "java": [
        ("class", re.compile(_EXPORTS + r"\bclass\s+(?P<name>\w+)")),
        ("interface", re.compile(_EXPORTS + r"(?<!@)\binterface\s+(?P<name>\w+)")),
        ("enum", re.compile(_EXPORTS + r"\benum\s+(?P<name>\w+)")),
    ],
    "c": [
        ("struct", re.compile(r"\bstruct\s+(?P<name>\w+)")),
        ("enum", re.compile(r"\benum\s+(?:class\s+|struct\s+)?(?P<name>\w+)")),
        # at the start of a line, or behind what ends a declaration; constructors have no type, and may have a list of initial values
        ("function", re.compile(r"(?m)(?:^|(?<=[{};:]))[ \t]*(?P<lead>(?:[\w:<>,~*&]+[ \t*&]+)*[*&]*)(?P<name>~?\w+(?:::~?\w+)*)\s*\([^;{}]*?\)[^;{}()=]*(?:(?<!:):(?!:)[^;{}]*)?(?=\{)")),
    ],
}
_HEADS |= {"typescript": _HEADS["javascript"], "cpp": _HEADS["c"]}
#: What a head of the kind cannot do without, whatever the language: code that lacks it isn't searched for such heads.
_WORDS = {"struct": ("struct",), "enum": ("enum",), "trait": ("trait",), "impl": ("impl",), "module": ("mod",), "constant": ("const", "static"), "class": ("class",), "interface": ("interface",), "variable": ("const", "let", "var"), "type": ("type",)}
_NOT_NAMES = {"if", "for", "while", "switch", "return", "else", "catch", "sizeof", "do", "with", "function"}
_OPEN, _CLOSE = "([{", ")]}"
_ENDS = re.compile(r"[()\[\]{};]")


def hidden(code: str, language: str) -> str:
    """The code with comments and strings as blanks, newlines kept, offsets unchanged."""
    return _HIDE[language].sub(lambda m: "\n".join(" " * len(x) for x in m[0].split("\n")), code)


def body_end(bare: str, at: int, braces_only: bool = False) -> int:
    """Where a declaration ends: behind the brackets of its body, or behind a semicolon before any."""
    depth = 0
    for m in _ENDS.finditer(bare, at):
        i, c = m.start(), m[0]
        if c in _OPEN:
            depth += 1
        elif c in _CLOSE:
            depth -= 1
            if depth < 0:
                return i
            if depth == 0 and c == "}":
                return i + 1
        elif c == ";" and depth == 0 and not braces_only:
            return i + 1
    return len(bare)


def _variable_end(bare: str, at: int) -> int:
    depth = 0
    for i in range(at, len(bare)):
        c = bare[i]
        depth += (c in _OPEN) - (c in _CLOSE)
        if depth < 0 or depth == 0 and (c == ";" or c == "," or c == "\n" and not re.match(r"\s*[.?:&|+=*/-]", bare[i + 1 : i + 80])):
            return i
    return len(bare)


def _impl_type(head: str) -> str:
    """The type that an impl is for: behind `for`, else behind the impl's own parameters; bounds of `where` apart."""
    head = re.split(r"\bwhere\b", head)[0].strip()
    if head.startswith("<"):
        depth = 0
        for i, c in enumerate(head):
            depth += (c == "<") - (c == ">" and head[i - 1] != "-")
            if depth == 0:
                head = head[i + 1 :].strip()
                break
    return re.split(r"\bfor\b(?!\s*<)", head)[-1].strip()


def _python(code: str) -> list[Declaration]:
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _python_heads(code)
    starts = _line_starts(code)
    rows = code.splitlines(keepends=True)
    at = lambda line, col: starts[line - 1] + len(rows[line - 1].encode()[:col].decode("utf-8", "ignore"))
    found = []

    def visit(node: ast.AST) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                kind = "class" if isinstance(child, ast.ClassDef) else "function"
                found.append(Declaration(kind, child.name, at(child.lineno, child.col_offset), at(child.end_lineno, child.end_col_offset)))
            else:
                visit(child)

    visit(tree)
    return sorted(found, key=lambda d: d.start)


def _line_starts(code: str) -> list[int]:
    out, at = [], 0
    for row in code.splitlines(keepends=True):
        out.append(at)
        at += len(row)
    return out or [0]


def _python_heads(code: str) -> list[Declaration]:
    """Heads of code that doesn't parse; a body lasts as long as lines are indented deeper."""
    found, end = [], 0
    for m in re.finditer(r"(?m)^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+(\w+)", code):
        if m.start() < end:
            continue
        deep = len(m[1].expandtabs())
        end = len(code)
        for row in re.finditer(r"(?m)^([ \t]*)\S", code[m.end() :]):
            if row.start() and len(row[1].expandtabs()) <= deep:
                end = m.end() + row.start()
                break
        found.append(Declaration("class" if m[2] == "class" else "function", m[3], m.start() + len(m[1]), len(code[:end].rstrip())))
    return found


def declarations(code: str, language: str, inside: tuple[str, ...] = ()) -> list[Declaration]:
    """The outermost declarations in order; those of the kinds in inside are searched as well."""
    if language == "python":
        return _python(code)
    bare = hidden(code, language)
    able = ((kind, p) for kind, p in _HEADS[language] if kind not in _WORDS or any(w in bare for w in _WORDS[kind]))
    heads = sorted(((m.start(), -m.end(), kind, m) for kind, p in able for m in p.finditer(bare)), key=lambda x: x[:3])
    found, free = [], 0
    for start, _, kind, m in heads:
        if start < free:
            continue
        name = m.groupdict().get("name") or ""
        if kind == "impl":
            name = _impl_type(code[m.start("head") : m.end("head")])
        if name in _NOT_NAMES or not name:
            continue
        if kind == "method":
            start = m.start("name") if not m["lead"].strip() else m.start("lead") + len(m["lead"]) - len(m["lead"].lstrip())
            found.append(Declaration(kind, name, start, end := body_end(bare, m.end() - 1)))
            free = end
            continue
        if language in ("c", "cpp") and kind == "function":
            start += len(m[0]) - len(m[0].lstrip())
        if kind == "variable":
            end = _variable_end(bare, m.end())
            start = m.start("name")
        elif kind == "type":
            kind = {"struct": "struct", "interface": "interface"}.get(m["what"], "type")
            end = body_end(bare, m.end()) if kind != "type" else bare.find("\n", m.end()) % (len(bare) + 1)
        elif language in ("c", "cpp") and kind in ("struct", "enum"):
            after = re.compile(r"[^{;()=,*&]*\{").match(bare, m.end())
            # a struct that is only mentioned, as in a parameter, is a symbol too, but has no body
            end = body_end(bare, m.end()) if after else m.end()
            if not after and re.compile(r"[^;{}]*\([^;{}]*\)\s*\{").match(bare, m.end()):
                continue
        else:
            end = body_end(bare, m.end(), braces_only=language in ("c", "cpp"))
        found.append(Declaration(kind, name, start, max(end, m.end())))
        if kind not in inside:
            free = max(end, m.end())
    return found


_IMPORTS = {
    "rust": re.compile(r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?use\s[^;]*;"),
    "python": re.compile(r"(?m)^[ \t]*(?:import[ \t]+[^\n]+|from[ \t]+\S+[ \t]+import[ \t]+(?:\([^)]*\)|[^\n]+))"),
    "javascript": re.compile(r"(?m)^[ \t]*import\b[^;\n]*(?:\{[^}]*\}[^;\n]*)?;?"),
    "go": re.compile(r"(?m)^import\s+(?:\([^)]*\)|[^\n]+)"),
}
_IMPORTS["typescript"] = _IMPORTS["javascript"]
#: Which declarations are units of chunking, by language.
_UNITS = {"rust": {"function", "struct", "enum", "trait"}, "python": {"function", "class"}, "javascript": {"function", "class"}, "typescript": {"function", "class"}, "go": {"function"}}
CHUNKED = tuple(_UNITS)


def units(code: str, language: str) -> list[Declaration]:
    """Imports, functions and classes by start, outermost only; functions within impl blocks and modules are units."""
    inside = ("impl", "module") if language == "rust" else ()
    found = [d for d in declarations(code, language, inside) if d.kind in _UNITS[language]]
    if language == "go":
        found = [d for d in found if not code.startswith("func (", d.start)]
    bare = code if language in ("python", "javascript", "typescript", "go") else hidden(code, language)
    starts, ends = [d.start for d in found], [d.end for d in found]  # they don't overlap and are in order, and neither do imports
    for m in _IMPORTS[language].finditer(bare):
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        last = bisect_right(starts, start) - 1
        if last < 0 or start >= ends[last]:
            found.append(Declaration("import", "", start, start + len(m[0].strip())))
    return sorted(found, key=lambda d: d.start)
