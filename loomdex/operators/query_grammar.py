"""The query language of the lexical index: words, "phrases", +must, -mustn't, AND, OR, NOT, (groups), field:, ^boost, [ranges].

Without operators, words are alternatives. A word that has several tokens is a phrase of them.
AND binds tighter than OR. Errors raise InvalidQuery.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace


class InvalidQuery(ValueError):
    """A query that the grammar rejects."""


@dataclass(frozen=True)
class Phrase:
    """Tokens that stand side by side; one token is a term."""

    tokens: tuple[str, ...]
    boost: float = 1.0


@dataclass(frozen=True)
class TermRange:
    """Terms between two bounds; a bound of None is open."""

    low: str | None
    high: str | None
    with_low: bool = True
    with_high: bool = True
    boost: float = 1.0


@dataclass(frozen=True)
class Group:
    """All of must, none of must_not and, where must is empty, at least one of should."""

    must: tuple = ()
    should: tuple = ()
    must_not: tuple = ()
    boost: float = field(default=1.0)


_TOKEN = re.compile(r"""\s*(?:(?P<open>\()|(?P<close>\))|(?P<sign>[+-])(?=\S)|(?P<range>(?:\w+:)?[\[{]\s*\S+\s+TO\s+\S+?\s*[\]}])|(?P<phrase>(?:\w+:)?"[^"]*")|(?P<word>[^\s()"]+))""")
_BOOST = re.compile(r"\^([0-9]+(?:\.[0-9]+)?)")
_GAP = re.compile(r"[^\w]|_")


def tokens_of(text: str) -> tuple[str, ...]:
    """As the index cuts texts."""
    return tuple(t for t in _GAP.sub(" ", text.lower()).split() if len(t.encode()) < 40)


class _Parser:
    def __init__(self, query: str, fields: tuple[str, ...]):
        self.query, self.fields, self.at = query, fields, 0

    def peek(self) -> tuple[str, str] | None:
        if not self.query[self.at :].strip():
            return None
        m = _TOKEN.match(self.query, self.at)
        if not m:
            raise InvalidQuery(f"can't read {self.query[self.at:]!r}")
        return m.lastgroup, m[m.lastgroup]

    def take(self) -> tuple[str, str]:
        token = self.peek()
        self.at = _TOKEN.match(self.query, self.at).end()
        return token

    def boosted(self, node):
        if m := _BOOST.match(self.query, self.at):
            self.at = m.end()
            return replace(node, boost=node.boost * float(m[1]))
        return node

    def group(self, inner: bool) -> Group:
        """Clauses up to the end or a closing bracket; AND-linked runs are groups within."""
        clauses: list[tuple[str, object]] = []
        joined = False
        while (token := self.peek()) and token[0] != "close":
            if token == ("word", "AND"):
                if not clauses or joined:
                    raise InvalidQuery("AND needs two sides")
                self.take()
                joined = True
                continue
            if token == ("word", "OR"):
                if not clauses or joined:
                    raise InvalidQuery("OR needs two sides")
                self.take()
                if not self.peek() or self.peek()[0] == "close":
                    raise InvalidQuery("OR needs two sides")
                continue
            how = ""
            while token and (token[0] == "sign" or token == ("word", "NOT")):
                how = "-" if token[1] in ("-", "NOT") else "+"
                self.take()
                token = self.peek()
            if not token or token[0] == "close":
                raise InvalidQuery("an operator without its operand")
            node = self.operand()
            if joined:
                mode, last = clauses.pop()
                left = last if isinstance(last, Group) and mode == "AND" else Group(must_not=(last,)) if mode == "-" else Group(must=(last,))
                clauses.append(("AND", replace(left, must_not=(*left.must_not, node)) if how == "-" else replace(left, must=(*left.must, node))))
                joined = False
            else:
                clauses.append((how, node))
        if joined:
            raise InvalidQuery("AND needs two sides")
        if inner:
            if not self.peek():
                raise InvalidQuery("a bracket isn't closed")
            self.take()
        of = lambda *modes: tuple(n for m, n in clauses if m in modes and n is not None)
        return Group(must=of("+"), should=of("", "AND"), must_not=of("-"))

    def operand(self):
        kind, text = self.take()
        if kind == "open":
            return self.boosted(self.group(inner=True))
        if kind == "close":
            raise InvalidQuery("a bracket isn't opened")
        boost = 1.0
        if text in ("+", "-"):
            raise InvalidQuery("an operator without its operand")
        if kind == "word" and (m := re.search(r"\^([0-9]+(?:\.[0-9]+)?)$", text)):
            text, boost = text[: m.start()], float(m[1])
        name, _, rest = text.partition(":")
        if rest and re.fullmatch(r"\w+", name):
            if name not in self.fields:
                raise InvalidQuery(f"no field {name!r}")
            text = rest
        elif kind == "word" and text.endswith(":"):
            raise InvalidQuery("a field without a value")
        if kind == "range":
            low, _, high = (x.strip() for x in text[1:-1].partition(" TO "))
            bound = lambda x: None if x == "*" else x.lower()
            return self.boosted(TermRange(bound(low), bound(high), text[0] == "[", text[-1] == "]"))
        node = Phrase(tokens_of(text.strip('"')), boost)
        return self.boosted(node) if kind == "phrase" else node


def parse(query: str, fields: tuple[str, ...] = ("symbols",)) -> Group:
    """The clauses of a query."""
    if query.count('"') % 2:
        raise InvalidQuery("a quotation mark isn't closed")
    p = _Parser(query, fields)
    found = p.group(inner=False)
    if p.peek():
        raise InvalidQuery("a bracket isn't opened")
    return found
