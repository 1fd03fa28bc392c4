"""Filters on repositories and file patterns.

None means no filter; an empty list lets nothing pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomdex.functions.text import first_segment, name_pattern, path_pattern


def any_of(tests: Sequence[Column]) -> Column:
    return reduce(or_, tests, F.lit(False))


def repository_filter(repository: Column, repositories: Sequence[str] | None) -> Column:
    return F.lit(True) if repositories is None else F.coalesce(any_of([repository == r for r in repositories]), F.lit(False))


def path_repository_filter(path: Column, repositories: Sequence[str] | None) -> Column:
    return repository_filter(first_segment(path), repositories)


def name_filter(path: Column, patterns: Sequence[str] | None) -> Column:
    return F.lit(True) if patterns is None else any_of([name_pattern(p, path) for p in patterns])


def path_filter(path: Column, patterns: Sequence[str] | None, glob: str = "legacy") -> Column:
    return F.lit(True) if patterns is None else any_of([path_pattern(p, path, glob) for p in patterns])
