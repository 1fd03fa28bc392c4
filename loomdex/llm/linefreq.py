"""Quality rules with cross-document line frequency, in DataFrame operations only.

Rules on one text: words, their code points, symbols, repeated lines and words in 8-word windows
that come back. Across documents: each normalised line (lower case, runs of anything but letters
and digits as one space) is hashed, and for each host the distinct documents that hold it are
counted; exact copies under other ids are documents of their own. Lines in more than MAX_DOCS of
a host's documents, however many it has, are removed, and documents that keep less than MIN_LEFT
of their line characters are rejected.

Null texts are empty: no words, no lines, and failing the base rules. A null host is a host.
Rows that repeat id and text are one document when lines are counted, and judged one by one; rows
of one id and different texts are different documents. A line in exactly MAX_DOCS documents
stays, and so does a document that keeps exactly MIN_LEFT. An empty table gives an empty result.
Hashes are 64-bit, so two different lines or windows are taken for one with a chance of about 1
in 10^19 a pair. Only the columns that line_rules names come out, whatever else the input has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.llm.common import BLANKS, fresh, stored, without, words_of

WINDOW, MIN_WORDS, MAX_REPEAT = 8, 20, 30
SYMBOLS = "#*$%&|<>"
MAX_DOCS, MIN_LEFT, SALTS = 50, 0.3, 16


def _pairs(h: str, step: int) -> Column:
    """Hash of each element with the one some steps further."""
    n = F.size(h) - step
    return F.when(n > 0, F.zip_with(F.slice(h, 1, n), F.slice(h, step + 1, n), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>"))


def repeated_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """Adds the number of words that stand in windows of 8 words found twice or more in the text.

    Window hashes are built by doubling. Only texts with equal hashes sort them with their
    places; the covered words are then sums of gaps between places.
    """
    h1, h2, h4, h8, again, at = fresh(df, "_h1", "_h2", "_h4", "_h8", "_s", "_p")
    df = df.withColumn(h1, F.transform(words, lambda w: F.xxhash64(w)))
    for a, b, step in ((h1, h2, 1), (h2, h4, 2), (h4, h8, 4)):
        df = df.withColumn(b, _pairs(a, step)).drop(a)
    df = df.withColumn(again, F.when(F.size(F.array_distinct(h8)) < F.size(h8), F.sort_array(F.transform(h8, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, j: F.coalesce(F.get(again, j)["h"] == x["h"], F.lit(False))
    twice = F.filter(again, lambda x, j: (F.when(j > 0, same(x, j - 1)).otherwise(False)) | same(x, j + 1))
    df = df.withColumn(at, F.sort_array(F.transform(twice, lambda x: x["i"])))
    gaps = F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)).cast("long"))
    return df.withColumn(out, F.when(F.col(at).isNull(), F.lit(0).cast("long")).otherwise(F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x))).drop(h8, again, at)


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))


def line_rules(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    max_docs: int = MAX_DOCS,
    min_left: float = MIN_LEFT,
    with_text: bool = False,
) -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, line_chars, removed_chars, kept[, text]) of each row.

    with_text adds the text without the removed lines.
    """
    d = df.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    d = d.withColumn("row", F.monotonically_increasing_id()).withColumn("_w", words_of(F.col("text")))
    d = repeated_words(d, "_w", "n_repeat_words").withColumn("n_words", F.size("_w").cast("long")).drop("_w")
    d = d.withColumn("word_chars", F.length(without(F.col("text"), BLANKS)).cast("long"))
    d = d.withColumn("n_symbols", (F.length("text") - F.length(without(F.col("text"), SYMBOLS))).cast("long"))
    d = d.withColumn("_l", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
    d = d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words")))
    lines = F.filter(F.transform("_l", lambda x: F.struct(normalised(x).alias("t"), F.length(x).alias("n"))), lambda x: x["t"] != "")
    d = d.withColumn("lines", F.transform(lines, lambda x: F.struct(F.xxhash64(x["t"]).alias("h"), x["n"].alias("n"))))
    d = d.withColumn("copy", F.md5("text")).drop("_l", *([] if with_text else ["text"]))
    d = stored(d)
    one = d.groupBy("host", "doc_id", "copy").agg(F.min("row").alias("row")).select("row")
    documents = d.select("row", "host", F.array_distinct(F.transform("lines", lambda x: x["h"])).alias("h")).join(one, "row", "left_semi")
    held = documents.select("host", F.explode("h").alias("h")).groupBy("host", "h").agg(F.count("*").alias("n"))
    same_host = lambda a, b: a["host"].eqNullSafe(b["host"])
    above = held.where(F.col("n") > max_docs).select("host", "h")
    # a common line's rows go to SALTS tasks, each of which has the line
    above = stored(above.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    every = d.select("row", "host", F.explode("lines").alias("x")).select("row", "host", F.col("x.h").alias("h"), F.col("x.n").alias("n")).withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int"))
    gone = every.join(above, same_host(every, above) & (every["h"] == above["h"]) & (every["salt"] == above["salt"])).groupBy("row").agg(F.sum("n").alias("removed_chars"), F.collect_set(every["h"]).alias("removed"))
    out = d.join(gone, "row", "left").withColumn("removed_chars", F.coalesce("removed_chars", F.lit(0)).cast("long"))
    out = out.withColumn("line_chars", F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["n"]))
    depleted = (F.col("removed_chars") > 0) & (F.col("line_chars") - F.col("removed_chars") < min_left * F.col("line_chars"))
    out = out.withColumn("kept", ~F.col("base_failed") & ~depleted)
    named = ["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "line_chars", "removed_chars", "kept"]
    if with_text:
        stays = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("removed", F.xxhash64(normalised(x))))
        out = out.withColumn("text", F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(stays, "\n")))
        named.append("text")
    return out.select(*named)
