"""Order MinHash fingerprints, in DataFrame operations only.

A text's k-mers are its runs of 3 words, each numbered by how often it has occurred before, so
that repeats differ. For each of 32 orders the 2 least k-mers are selected, put back in the order in
which they stand in the text and hashed together. Unlike plain MinHash, a fingerprint thus
changes when passages are moved, as edit distance does. The likeness of two fingerprints is the
share of equal components.

Every order ranks all k-mers of the text. The orders are rotations of one seeded hash: order j
counts upwards from the j-th of 32 even places on the circle of hashes, and round it. A rotation
of uniform hashes is uniform, so in each order any two k-mers are as likely to be the least as
any others; and as all orders go round the same circle, one sort serves them all: the two least
k-mers of an order are the first two at or after its place, found by bisection.

Arrays of 64-bit integers (hash above, place below) are sorted as primitives, so a text of n words
costs n log n and no fold copies a growing array. A null text is an empty one. Texts without
words share one fingerprint of zeros; texts of fewer than 3 words are a single k-mer. Places
beyond 2^24 count as equal. K-mers of equal hash, 39 bits of it, rank by their place. Only words
matter: blanks between them don't. Repeated rows have equal fingerprints, an empty table gives an
empty one. Working columns take names that the input hasn't; an input column with the name of an
output is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdex.llm.common import fresh, words_of

K, COMPONENTS = 3, 32
_PLACE = (1 << 24) - 1


def _hash_part(h: Column, low: int) -> Column:
    """A hash without its sign and with its low bits free."""
    return F.shiftrightunsigned(h, 1).bitwiseAND(F.lit(~low & ((1 << 63) - 1)))


def _high(x: Column) -> Column:
    return F.shiftright(x, 24)


def add_sketch(df: DataFrame, text: str, out: str, components: int = COMPONENTS) -> DataFrame:
    """df with an array of integers, one for each component."""
    w, k, again, s, runs, n_th, m = fresh(df, "_w", "_k", "_again", "_s", "_b", "_n", "_m")
    df = df.withColumn(w, F.transform(words_of(F.col(text)), lambda x: F.xxhash64(x)))
    n = F.size(w) - (K - 1)
    tail = lambda i: F.slice(w, i + 1, n)
    kmers = F.zip_with(F.zip_with(tail(0), tail(1), lambda a, b: F.xxhash64(a, b)), tail(2), lambda a, b: F.xxhash64(a, b))
    short = F.when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(k, F.when(n >= 1, kmers).otherwise(short)).drop(w)
    packed = F.transform(k, lambda h, i: _hash_part(h, _PLACE).bitwiseOR(F.least(i, F.lit(_PLACE)).cast("long")))
    df = df.withColumn(again, F.size(F.array_distinct(k)) < F.size(k)).withColumn(s, F.sort_array(packed)).drop(k)
    # equal k-mers are neighbours, in text order: the numbers count up within each run of them
    starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.when(i == 0, F.lit(True)).otherwise(_high(F.get(s, i)) != _high(F.get(s, i - 1))))
    df = df.withColumn(runs, F.when(F.col(again), starts))
    ends = F.concat(F.slice(runs, 2, F.size(runs)), F.array(F.size(s)))
    df = df.withColumn(n_th, F.when(F.col(again), F.flatten(F.zip_with(runs, ends, lambda a, b: F.sequence(F.lit(0), b - a - 1)))))
    numbered = F.zip_with(s, n_th, lambda x, i: F.when(i == 0, x).otherwise(_hash_part(F.xxhash64(_high(x), i), _PLACE).bitwiseOR(x.bitwiseAND(F.lit(_PLACE)))))
    df = df.withColumn(m, F.when(F.col(again), F.sort_array(numbered)).otherwise(F.col(s))).drop(again, s, runs, n_th)

    once = lambda x, f: F.get(F.transform(F.array(x), f), 0)  # noqa: E731  an array of one, so that x is computed once
    at = lambda y: y.bitwiseAND(F.lit(_PLACE))
    size = F.size(m)
    # strides of the bisection: powers of two up to the size
    strides = F.expr(f"filter(array({','.join(str(1 << i) for i in range(30, -1, -1))}), x -> x <= size(`{m}`))")

    def in_text(low: Column, more: Column) -> Column:
        both = F.when(at(low) <= at(more), F.xxhash64(_high(low), _high(more))).otherwise(F.xxhash64(_high(more), _high(low)))
        return F.when(size == 1, F.xxhash64(_high(low))).otherwise(both)

    def component(start: Column, steps: Column) -> Column:
        below = F.aggregate(steps, F.lit(0), lambda p, x: F.when(F.get(m, p + x - 1) < start, p + x).otherwise(p))  # beyond the end is null
        pick = lambda p: in_text(F.get(m, p % size), F.get(m, (p + 1) % size))
        return once(below, pick).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")

    places = F.array(*(F.lit(j * ((1 << 63) // components)).cast("long") for j in range(components)))
    parts = once(strides, lambda steps: F.transform(places, lambda start: component(start, steps)))
    none = F.array_repeat(F.lit(0), components)
    return df.withColumn(out, F.when(size > 0, parts).otherwise(none)).drop(m)


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal components."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return same / F.size(a)


def with_next(df: DataFrame, doc_id: str, columns: list[str]) -> DataFrame:
    """df with next_<column>: the values in the row that follows by doc_id; the last is followed by the first.

    Rows are dealt by quantiles of doc_id, which are ids that occur, to several blocks for each
    shuffle partition. The row that opens a block is sent to the block before as well, so that
    every block is complete, and the first of all to the last block. Rows that repeat a doc_id
    follow each other in the order of the columns; null comes first.
    """
    spark = df.sparkSession
    ids = df.select(doc_id)
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = ids.agg(F.percentile_approx(doc_id, [i / n for i in range(1, n)], 10 * n).alias("q"), F.min(doc_id).alias("least"), F.count_if(F.col(doc_id).isNull()).alias("nulls")).first()
    cuts = sorted(set(found["q"] or []))
    least = None if found["nulls"] else found["least"]
    id_ = F.col(doc_id)
    at = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<bigint>")
    at_cuts, block_, to, role, wraps = fresh(df, "_cuts", "_block", "_to", "_role", "_wraps")
    df = df.withColumn(at_cuts, at if len(cuts) <= 1 else F.lit(cuts))
    # how many cuts are at or below the id, by bisection
    lo = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))

    def halve(a: Column, _: Column) -> Column:
        mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        right = (a["lo"] < a["hi"]) & (F.get(at_cuts, mid) <= id_)
        done = a["lo"] >= a["hi"]
        return F.struct(F.when(done, a["lo"]).when(right, mid + 1).otherwise(a["lo"]).alias("lo"), F.when(done | right, a["hi"]).otherwise(mid).alias("hi"))

    block = F.aggregate(F.sequence(F.lit(0), F.lit(len(cuts).bit_length())), lo, halve, lambda a: a["lo"])
    df = df.withColumn(block_, F.when(id_.isNull(), F.lit(0)).otherwise(block))
    home = F.struct(F.col(block_).alias("b"), F.lit(0).alias("role"))
    opens = (F.col(block_) > 0) & (F.get(at_cuts, F.col(block_) - 1) == id_)
    before = F.when(opens, F.struct((F.col(block_) - 1).alias("b"), F.lit(1).alias("role")))
    wrap = F.when(id_.eqNullSafe(F.lit(least)), F.struct(F.lit(len(cuts)).alias("b"), F.lit(2).alias("role")))
    df = df.withColumn(to, F.explode(F.filter(F.array(home, before, wrap), lambda x: x.isNotNull())))
    df = df.withColumns({block_: F.col(f"{to}.b"), role: F.col(f"{to}.role"), wraps: F.col(f"{to}.role") == 2}).drop(to, at_cuts)
    order = Window.partitionBy(block_).orderBy(wraps, F.col(doc_id).asc_nulls_first(), *columns)
    df = df.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    return df.where(F.col(role) == 0).drop(block_, role, wraps)
