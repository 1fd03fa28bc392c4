"""Symbol extraction from source code."""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from loomdex.functions.batches import small_batches
from loomdex.functions.language import PARSED_LANGUAGES
from loomdex.operators.scanner import declarations

SIGNATURE_BYTES = 200
SYMBOL = "struct<name:string,kind:string,start_line:int,end_line:int,start_col:int,end_col:int,signature:string>"


def signature_of(text: str) -> str | None:
    """First line of the first 200 bytes; null if that cut splits a character."""
    try:
        head = text[:SIGNATURE_BYTES].encode()[:SIGNATURE_BYTES].decode()
    except UnicodeDecodeError:
        return None
    return head.split("\n", 1)[0].removesuffix("\r") if head else None


def symbols_of(code: str | None, language: str | None) -> list[dict]:
    """Symbols in order; lines and byte columns from 0. Languages that aren't parsed have none."""
    if not code or language not in PARSED_LANGUAGES:
        return []
    starts = [0, *(m.end() for m in re.finditer("\n", code))]

    def place(at: int) -> tuple[int, int]:
        row = bisect_right(starts, at) - 1
        return row, len(code[starts[row] : at].encode())

    found = []
    for d in declarations(code, language):
        (row, col), (last, end_col) = place(d.start), place(d.end)
        found.append({"name": d.name, "kind": d.kind, "start_line": row, "end_line": last, "start_col": col, "end_col": end_col, "signature": signature_of(code[d.start : min(d.end, d.start + SIGNATURE_BYTES)])})
    return found


def _extract(code: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([symbols_of(c, x) for c, x in zip(code, language, strict=True)])


def with_symbols(df: DataFrame, text: str = "content", language: str = "language", out: str = "symbol_list") -> DataFrame:
    """df with the array of each row's symbols. Texts of languages that aren't parsed aren't sent to Python; a task holds one small batch of texts and their symbols."""
    small_batches(df.sparkSession)
    extract = pandas_udf(_extract, f"array<{SYMBOL}>")
    parsed = F.when(F.col(language).isin(*PARSED_LANGUAGES), F.col(text))
    return df.withColumn(out, extract(parsed, F.col(language)))


def symbols_text(symbols: Column) -> Column:
    """A line "kind name" for each symbol: what the index holds."""
    return F.array_join(F.transform(symbols, lambda s: F.concat(s["kind"], F.lit(" "), s["name"])), "\n")
