"""Ignore rules: which files of a folder tree are left out."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    """One pattern line; base is the folder of its file, relative to the root."""

    base: str
    pattern: re.Pattern
    negated: bool
    folders_only: bool


def glob_regex(glob: str) -> str:
    """A pattern's regular expression over a relative path: stars stay in a folder, double stars cross, brackets are classes."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
            continue
        if glob.startswith("/**", i) and i + 3 == len(glob):
            out.append("/.*")
            i += 3
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out.append(f"[{'^' + body[1:] if body[0] in '!^' else body}]")
            i = end
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


def parse(text: str, base: str = "") -> list[Rule]:
    """The rules of an ignore file. Lines that can't be read are skipped."""
    rules = []
    for line in text.splitlines():
        glob = re.sub(r"(?<!\\)\s+$", "", line)
        if not glob or glob.startswith("#"):
            continue
        negated = glob.startswith("!")
        glob = glob[1:] if negated else glob
        folders_only = glob.endswith("/")
        glob = glob.rstrip("/")
        anchored = "/" in glob
        glob = glob.lstrip("/")
        if not glob:
            continue
        try:
            pattern = re.compile(("" if anchored else "(?:.*/)?") + glob_regex(glob))
        except re.error:
            continue
        rules.append(Rule(base, pattern, negated, folders_only))
    return rules


def ignored(path: str, is_folder: bool, rules: list[Rule]) -> bool:
    """Whether the last rule that fits a path leaves it out. Rules come from outer to inner folders."""
    for rule in reversed(rules):
        if rule.folders_only and not is_folder or rule.base and not path.startswith(rule.base + "/"):
            continue
        if rule.pattern.fullmatch(path[len(rule.base) + 1 :] if rule.base else path):
            return not rule.negated
    return False
