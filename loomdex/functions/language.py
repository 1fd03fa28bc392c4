"""Languages of files: by extension, name or first line."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomdex.functions.text import extension, file_name

# What the results must agree with.
INDEXABLE_EXTENSIONS = (
    "rs js jsx ts tsx py go java cpp c h hpp cs rb php swift kt scala r jl lua dart elm clj ex exs erl hrl hs ml vim "
    "sh bash zsh fish ps1 bat sql md txt yml yaml toml json xml html css scss sass less vue svelte astro"
).split()
INDEXABLE_NAMES = "Makefile Dockerfile Gemfile Rakefile Procfile Vagrantfile .gitignore .dockerignore LICENSE README".split()
LANGUAGE_EXTENSIONS = {
    "rust": "rs",
    "javascript": "js mjs cjs jsx",
    "typescript": "ts tsx",
    "python": "py pyw",
    "go": "go",
    "java": "java",
    "cpp": "cpp cc cxx c++ hpp hxx h++",
    "c": "c h",
    "csharp": "cs",
    "ruby": "rb",
    "php": "php",
    "swift": "swift",
    "kotlin": "kt kts",
    "scala": "scala sc",
    "haskell": "hs lhs",
    "elixir": "ex exs",
    "html": "html htm",
    "css": "css scss sass less",
    "markdown": "md markdown",
    "json": "json",
    "yaml": "yml yaml",
    "toml": "toml",
    "xml": "xml",
    "shell": "sh bash zsh fish",
}
LANGUAGE_NAMES = {"Dockerfile": "shell", "Makefile": "shell", "makefile": "shell", "Gemfile": "ruby", "Rakefile": "ruby"}
CHUNK_EXTENSIONS = {
    "rust": "rs",
    "python": "py",
    "javascript": "js mjs",
    "typescript": "ts tsx",
    "java": "java",
    "cpp": "cpp cc cxx hpp h",
    "go": "go",
    "ruby": "rb",
    "php": "php",
    "swift": "swift",
    "kotlin": "kt",
    "scala": "scala",
    "bash": "sh bash",
    "sql": "sql",
    "markdown": "md",
}
ALIASES = {"c++": "cpp", "c#": "csharp", "md": "markdown", "yml": "yaml", "bash": "shell", "sh": "shell"}
PARSED_LANGUAGES = ("rust", "javascript", "typescript", "python", "go", "java", "cpp", "c")
# End of fixed values.

LANGUAGES = tuple(LANGUAGE_EXTENSIONS)


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(table.items())))[key]


def _by_extension(table: dict[str, str]) -> dict[str, str]:
    return {e: name for name, all_ in table.items() for e in all_.split()}


def is_indexable(path: Column) -> Column:
    """By extension, case aside; a file without one by its exact name."""
    ext = extension(path)
    return F.when(ext.isNotNull(), ext.isin(*INDEXABLE_EXTENSIONS)).otherwise(file_name(path).isin(*INDEXABLE_NAMES))


def shebang_language(text: Column) -> Column:
    """The interpreter in a first line that starts with #!; unknown for others."""
    first = F.split_part(text, F.lit("\n"), F.lit(1))
    has = lambda word: F.contains(first, F.lit(word))
    named = F.when(has("python"), "python").when(has("node") | has("bun"), "javascript").when(has("ruby"), "ruby").when(has("bash") | has("sh"), "shell")
    return F.when(F.startswith(first, F.lit("#!")), F.coalesce(named, F.lit("unknown"))).otherwise("unknown")


def detect_language(path: Column, text: Column | None = None) -> Column:
    """By extension, or by name for files that have none; where that is unknown, by the first line of the text."""
    ext = extension(path)
    by_path = F.coalesce(F.when(ext.isNotNull(), _lookup(_by_extension(LANGUAGE_EXTENSIONS), ext)).otherwise(_lookup(LANGUAGE_NAMES, file_name(path))), F.lit("unknown"))
    return by_path if text is None else F.when((by_path == "unknown") & text.isNotNull(), shebang_language(text)).otherwise(by_path)


def chunk_language(path: Column) -> Column:
    """The chunker's own map, by what follows the last dot of the path, case counting; null where it has none."""
    return _lookup(_by_extension(CHUNK_EXTENSIONS), F.substring_index(path, ".", -1))


def parse_language(name: Column) -> Column:
    """The language that a name or alias means, case aside; unknown for others."""
    low = F.lower(name)
    return F.when(low.isin(*LANGUAGES), low).otherwise(F.coalesce(_lookup(ALIASES, low), F.lit("unknown")))


def is_parsed(language: Column) -> Column:
    """Whether symbols are extracted from a language."""
    return language.isin(*PARSED_LANGUAGES)
