"""Mixing sources to target weights by Sainte-Lague apportionment.

Sizes are words. The mix's budget is a share of all words; sources divide it by weight, none
above a multiple of its size, and what a full source leaves is shared among the others by
weight again. The budget is then handed out in blocks of equal word counts: each goes to the
source with the highest quotient target / (2 * blocks + 1), and within a source, by the same
rule, to its shards. Shards are seeded hash parts of a source, as many as its rows need, so a
hot source is spread over many tasks.

In each shard the documents stand in a seeded order, as one circle of words. The shard's blocks
are a run of consecutive blocks from the circle's start: whole documents, but for the one where
the run ends; more blocks than the circle holds begin a second round. So a document is taken at
most as often as the cap says, and reruns agree whatever the partitioning.

Sources may be as many as hosts: they stay in tables. The level at which weighted shares stop
being capped, and the divisor that gives out just so many blocks, are found by searches, each step
of which is one pass over a row a source; ranks come from a sort in ranges. The shards of one
source, about MOST_SHARDS at most, as shards have ROWS_PER_SHARD documents or, in a large corpus,
a fixed share of all, are apportioned in one task.

Null texts have no words; documents without words are returned with 0 taken. A null source is a
source of its own, after all others. Rows that repeat a doc_id count each for itself. An empty
table gives an empty result. Input columns keep their values unless they have the name of an
output, in which case they are replaced.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence
from fractions import Fraction
from itertools import accumulate
from math import lcm
from operator import add

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdex.llm.common import fresh, stored, words_of

WEIGHTS, SHARE, CAP = (3, 1, 2), Fraction(3, 2), 2
BLOCK_WORDS, ROWS_PER_SHARD, MOST_SHARDS, SALTS, STEPS, SEED = 16, 4_000, 20_000, 16, 32, 42


def targets(sizes: Sequence[int], weights: Sequence[int], budget: Fraction, cap: int = CAP) -> list[Fraction]:
    """Each source's share of the budget by weight, at most cap times its size; the excess is reshared until none is above."""
    out, free, left = [Fraction(0)] * len(sizes), set(range(len(sizes))), Fraction(budget)
    while free:
        total = sum(weights[i] for i in free)
        full = {i for i in free if left * weights[i] / total > cap * sizes[i]}
        for i in full or free:
            out[i] = Fraction(cap * sizes[i]) if full else left * weights[i] / total
        if not full:
            break
        left -= sum(cap * sizes[i] for i in full)
        free -= full
    return out


def sainte_lague(weights: Sequence[Fraction | int], seats: int, most: Sequence[int] | None = None) -> list[int]:
    """Seats by highest quotients weight / (2 * seats + 1), at most so many each; ties go to the first.

    All quotients above a threshold are taken at once, with a threshold found by bisection that
    leaves few seats; these are handed out one by one. That is the same result as handing out
    every seat singly.
    """
    n = len(weights)
    most = [seats] * n if most is None else list(most)
    scale = lcm(*(Fraction(w).denominator for w in weights)) if weights else 1
    whole = [int(Fraction(w) * scale) for w in weights]
    seats = min(seats, sum(m for m, w in zip(most, whole, strict=True) if w > 0))
    if seats <= 0:
        return [0] * n

    def above(divisor: float) -> list[int]:
        p, q = Fraction(divisor).as_integer_ratio()
        return [min(m, (2 * w * q + p) // (2 * p)) for w, m in zip(whole, most, strict=True)]

    high = sum(whole) / seats
    while sum(above(high)) > seats:
        high *= 2
    low = 0.0
    for _ in range(64):
        if sum(above(high)) == seats:
            break
        if sum(above(mid := (low + high) / 2)) > seats:
            low = mid
        else:
            high = mid
    got = above(high)
    quotient = lambda i: (-Fraction(whole[i], 2 * got[i] + 1), i)
    queue = [quotient(i) for i in range(n) if whole[i] > 0 and got[i] < most[i]]
    heapq.heapify(queue)
    for _ in range(seats - sum(got)):
        _, i = heapq.heappop(queue)
        got[i] += 1
        if got[i] < most[i]:
            heapq.heappush(queue, quotient(i))
    return got


def ranked(df: DataFrame, *order: Column, out: str) -> DataFrame:
    """df with the place of each row in an order, from 0: rows are sorted in ranges, and each range starts behind the sizes of those before."""
    (at,) = fresh(df, "_at")
    placed = stored(df.orderBy(*order).withColumn(at, F.monotonically_increasing_id()))
    part = F.shiftright(at, 33)
    sizes = {r["part"]: r["count"] for r in placed.groupBy(part.alias("part")).count().collect()}  # a row for each range
    starts = dict(zip(sorted(sizes), accumulate((sizes[k] for k in sorted(sizes)), initial=0)))
    start = F.element_at(F.create_map(*(F.lit(x).cast("long") for kv in starts.items() for x in kv)), part) if starts else F.lit(0).cast("long")
    return placed.withColumn(out, start + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).drop(at)


def _summed(sources: DataFrame, of: Callable[[int, int], list[int]], width: int) -> list[int]:
    """Sums over sources of what of() makes of a source's size and weight."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * width
        for b in batches:
            for size, weight in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total = list(map(add, total, of(size, weight)))
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.int64()))], names=["x"])

    sums = sources.select("size", "weight").mapInArrow(part, "x array<long>").select(F.posexplode("x").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect()
    found = {r["k"]: r["x"] for r in sums}
    return [found.get(k, 0) for k in range(width)]


def level_of(sources: DataFrame, budget: Fraction, cap: int) -> Fraction | None:
    """The level by which sources' targets are least(cap * size, level * weight) and spend the budget, a round of targets() at a time; None if all are capped."""
    total, capped, level = None, -1, Fraction(0)
    while True:
        weights, held, size = _summed(sources, lambda n, w: [w, w * (cap * n < level * w), n * (cap * n < level * w)], 3)  # noqa: B023
        total = weights
        if held == capped:
            return level
        if held == total:
            return None
        capped, level = held, (budget - cap * size) / (total - held)


def target(size: int, weight: int, level: Fraction | None, cap: int) -> Fraction:
    return Fraction(cap * size) if level is None or cap * size < level * weight else level * weight


def with_blocks(sources: DataFrame, level: Fraction | None, cap: int, block_words: int, seats: int, rank: str) -> DataFrame:
    """sources with target and blocks, the blocks that sainte_lague() gives each.

    Of STEPS divisors at a time the least that doesn't give too many is taken; what it leaves goes
    to the highest quotients, ties to the first rank.
    """
    most = lambda size: -(-cap * size // block_words)

    def given(size: int, weight: int, divisor: float) -> int:
        want, (p, q) = target(size, weight, level, cap), divisor.as_integer_ratio()
        return min(most(size), (2 * want.numerator * q + p * want.denominator) // (2 * p * want.denominator))

    counts = lambda divisors: _summed(sources, lambda n, w: [given(n, w, d) for d in divisors], len(divisors))
    seats = min(seats, _summed(sources, lambda n, w: [most(n)], 1)[0])
    low, high = 0.0, float(max(seats, 1)) * block_words * 4 + 1
    while seats and high > low:
        points = sorted({low + (high - low) * k / (STEPS + 1) for k in range(1, STEPS + 1)} - {low, high, 0.0}) if low else [high / 4**k for k in range(STEPS, 0, -1)]
        if not points:
            break
        sums = counts(points)
        below = [d for d, n in zip(points, sums, strict=True) if n <= seats]
        above = [d for d, n in zip(points, sums, strict=True) if n > seats]
        was = low, high
        low, high = max([low, *above]), min([high, *below])
        if seats in sums or (low, high) == was:
            break

    fields = T.StructType([*sources.schema, T.StructField("target", T.DoubleType()), T.StructField("blocks", T.LongType()), T.StructField("_q", T.DoubleType())])
    divisor, any_ = high, seats > 0

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(b.column("size").to_pylist(), b.column("weight").to_pylist(), strict=True))
            want = [target(n, w, level, cap) for n, w in rows]
            got = [given(n, w, divisor) if any_ else 0 for n, w in rows]
            quotient = [float(t / (2 * g + 1)) if t and g < most(n) and any_ else None for t, g, (n, _) in zip(want, got, rows, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([float(t) for t in want], pa.float64()), pa.array(got, pa.int64()), pa.array(quotient, pa.float64())], names=fields.names)

    found = stored(sources.mapInArrow(made, fields))
    left = seats - (found.agg(F.sum("blocks")).first()[0] or 0)
    if left > 0:
        next_ = ranked(found.where("_q is not null").select(F.col(rank).alias("_rank"), "_q"), F.desc("_q"), F.asc("_rank"), out="_place").where(F.col("_place") < left)
        found = found.join(next_.select("_rank", F.lit(1).cast("long").alias("_one")), F.col(rank) == F.col("_rank"), "left").withColumn("blocks", F.col("blocks") + F.coalesce("_one", F.lit(0))).drop("_rank", "_one")
    return found.drop("_q")


def mix(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: Fraction = SHARE,
    cap: int = CAP,
    block_words: int = BLOCK_WORDS,
    rows_per_shard: int = ROWS_PER_SHARD,
    seed: int = SEED,
) -> DataFrame:
    """(doc_id, source, key, size, source_size, target, taken) for each row.

    key is a digest of the text, by which rows of one doc_id are told apart; taken is the number
    of words that the mix takes: whole rounds of the document, then its first words.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    order = F.xxhash64(F.lit(seed), F.col(doc_id), F.md5(t))
    rows = stored(df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.md5(t).alias("key"), F.size(words_of(t)).cast("long").alias("size"), order.alias("h")))
    of_source = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    placed = ranked(of_source, F.col("source").isNull(), F.col("source"), out="rank")
    weight = F.element_at(F.array(*(F.lit(int(w)).cast("long") for w in weights)), (F.col("rank") % len(weights)).cast("int") + 1)
    sources = stored(placed.withColumn("weight", weight))
    words, n_rows = sources.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    budget = share * words
    level = level_of(sources, budget, cap)
    spent = Fraction(cap * words) if level is None else budget
    given = with_blocks(sources, level, cap, block_words, int(spent / block_words + Fraction(1, 2)), "rank")
    in_shard = max(rows_per_shard, -(-n_rows // MOST_SHARDS))
    given = stored(given.withColumn("parts", F.expr(f"(n + {in_shard - 1}) div {in_shard}")))
    # a hot source's rows go to SALTS tasks, each of which has the source
    salted = given.select(F.col("source").alias("of"), "rank", "parts", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = F.col("source").eqNullSafe(F.col("of")) & (F.pmod(F.shiftright("h", 32), F.lit(SALTS)).cast("int") == F.col("salt"))
    sharded = rows.join(salted, met).withColumn("shard", F.expr("pmod(h, parts)")).drop("of", "parts", "salt")
    shards = sharded.groupBy("rank", "shard").agg(F.sum("size").alias("circle")).join(given.select("rank", "blocks"), "rank")

    def quotas(one: pd.DataFrame) -> pd.DataFrame:
        one = one.sort_values("shard")
        circles = one["circle"].tolist()
        got = sainte_lague(circles, int(one["blocks"].iloc[0]), [-(-cap * n // block_words) for n in circles])
        return pd.DataFrame({"rank": one["rank"], "part": one["shard"], "circle": circles, "quota": [min(q * block_words, cap * n) for n, q in zip(circles, got, strict=True)]})

    told = shards.groupBy("rank").applyInPandas(quotas, "rank long, part long, circle long, quota long")
    told = stored(told.join(given.select("rank", F.col("size").alias("source_size"), "target"), "rank").withColumnRenamed("rank", "of"))
    placed = sharded.join(told, (F.col("rank") == F.col("of")) & (F.col("shard") == F.col("part")))
    before = Window.partitionBy("rank", "shard").orderBy("h", "doc_id", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum("size").over(before)
    rounds, rest = F.expr("case when circle > 0 then quota div circle else 0 end"), F.expr("case when circle > 0 then quota % circle else 0 end")
    taken = F.col("size") * rounds + F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("end") - F.col("size"))))
    return placed.withColumn("end", end).select("doc_id", "source", "key", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mix itself: each row of df as often as it is taken whole, and once cut after its last taken word where it is taken in part.

    Rows that equal each other in id, source and text share what they take evenly.
    """
    id_, of_source, of, all_taken, rows, size, key, own, whole, rest, copy = fresh(df, "_id", "_source", "_of", "_taken", "_rows", "_size", "_key", "_own", "_whole", "_rest", "_copy")
    taken = mix(df, doc_id, text, source, **how).groupBy("doc_id", "source", "key").agg(F.sum("taken").alias(all_taken), F.count("*").alias(rows), F.max("size").alias(size))
    taken = taken.select(F.col("doc_id").alias(id_), F.col("source").alias(of_source), F.col("key").alias(of), all_taken, rows, size).where(F.col(all_taken) > 0)
    keyed = df.withColumn(key, F.md5(F.coalesce(F.col(text), F.lit(""))))
    met = keyed.join(taken, keyed[doc_id].eqNullSafe(taken[id_]) & keyed[source].eqNullSafe(taken[of_source]) & (keyed[key] == taken[of]))
    others = [c for c in df.columns if c not in (doc_id, source, text)]
    turn = F.row_number().over(Window.partitionBy(id_, of_source, of).orderBy(*(others or [of])))
    share = lambda a, b: F.expr(f"`{a}` div `{b}`")
    met = met.withColumn(own, share(all_taken, rows) + F.when(turn <= F.col(all_taken) % F.col(rows), 1).otherwise(0)).where(F.col(own) > 0)
    met = met.withColumn(whole, share(own, size)).withColumn(rest, (F.col(own) % F.col(size)).cast("int"))
    met = met.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(whole) + F.when(F.col(rest) > 0, 1).otherwise(0))))
    # cut before the blank that follows a word, so that blanks stay as they are
    first = F.array_join(F.slice(F.split(F.col(text), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), 1, F.col(rest)), "")
    met = met.withColumn(text, F.when(F.col(copy) <= F.col(whole), F.col(text)).otherwise(first))
    return met.select(*df.columns)
