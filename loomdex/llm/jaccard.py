"""Near-duplicates by SimHash and by the Jaccard similarity of word shingles, as an exact join.

First the operator of simhash links texts, by its fingerprints, popcount grid and exact check. Its
2 bits miss most texts that are alike in 4/5, so the join below adds these; either link counts,
and texts that the first has connected aren't compared again in the join's second step.

A text is the set of its runs of 5 words (A-Z lower-cased, words of non-blank bytes), as 64-bit
hashes; a shorter text is a single run, one without words a set of its own kind. Two texts are
linked if, and only if, their sets have a similarity of 4/5 or more. That needs 4/5 of either set
in common, so the first n div 5 + 1 members of both, in whatever order that is the same for all,
share one: this prefix rule misses nothing. Members that a sample of texts finds in many come
last, the commonest last of all, so that texts meet by what few have and not by a common
passage; the sample only sets this order, and links don't depend on it. It grows with the table:
in a sample of fixed size a passage of a fixed share of a hundred texts looks like one's own.

Sets are made for prefixes and again, in each step, for the texts that have to be compared; a
bitmap of fixed size lets most of the rest go before a join drops all of it.

Every two that meet are compared, unless links already connect them: by parities, which bound
the difference from below, and where these allow it on their whole sets. First
all that share a member are compared with two of them, one by chance and the most typical, which
connects large groups in linear work; then those outside the largest group of a member are compared with all the others there.
The second step leaves out members of two texts, whose only pair the first has compared, and takes
one of the members that the same texts share, as the others would only make the same pairs again.
Texts that are mostly common to many but alike in less than 4/5 are the case in which pairs grow
with the square of their number; none are left out.

Equal sets are one node; as repeats count in fingerprints, a set may have several. Rows and names
of groups are as in simhash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdex.llm import simhash
from loomdex.llm.common import small_batches, stored, with_columns
from loomdex.llm.components import connected_components
from loomdex.llm.simhash import SEED, grouped

SHINGLE, HUBS = 5, 16
SAMPLE, SHARE, LEAST, COMMON, BITS, PARITY = 4000, 0.2, 3, 1 << 20, 1 << 24, 512
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LIST = T.ArrayType(T.LongType())


def shingles(text: bytes | None) -> np.ndarray:
    """The set of a UTF-8 text's runs of words, as sorted hashes."""
    words = (text or b"").lower().split()
    hash64 = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return np.array([hash64(b" ".join(words), SEED)], np.uint64).view(np.int64)
    each = np.fromiter((hash64(w, SEED) for w in words), np.uint64, len(words))
    n = len(words) - SHINGLE + 1
    runs = each[:n].copy()
    for k in range(1, SHINGLE):
        runs = (runs ^ (runs >> np.uint64(29))) * _MIX + each[k : n + k]
    runs = (runs ^ (runs >> np.uint64(32))) * _MIX
    return np.unique(runs.view(np.int64))


def print_of(members: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(members.tobytes(), SEED)


def _sets(texts: pa.Array) -> list[np.ndarray]:
    return [shingles(t) for t in texts.cast(pa.binary()).to_pylist()]


def _prints(sets: list[np.ndarray]) -> np.ndarray:
    return np.fromiter(map(print_of, sets), np.uint64, len(sets)).view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    edges = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Members that a sample of texts often has, sorted, and how often; COMMON at most, all of a frequency or none."""
    some = docs.select("text").sample(min(1.0, max(SHARE, SAMPLE / max(docs.count(), 1))), 42)
    some = with_columns(some, ["text"], [T.StructField("h", _LIST)], lambda texts: [_lists(_sets(texts))], ["text"])
    often = stored(some.select(F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST))
    least, held = LEAST, 0
    for r in often.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).toLocalIterator():
        held += r["k"]
        if held > COMMON:
            least = r["n"] + 1
            break
    top = often.where(F.col("n") >= least).toArrow()
    members, n = top["h"].to_numpy(), top["n"].to_numpy()
    order = np.argsort(members)
    return members[order], n[order]


def prefix(members: np.ndarray, often: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first members of a sorted set: two sets alike have one of them in common."""
    held = np.zeros(len(members), np.int64)
    if len(often[0]):
        at = np.minimum(np.searchsorted(often[0], members), len(often[0]) - 1)
        held = np.where(often[0][at] == members, often[1][at], 0)
    return members[np.argsort(held, kind="stable")[: len(members) // 5 + 1]]


def parity(members: np.ndarray, kinds: int = 0) -> bytes:
    """Of each of several kinds of members, whether the set has an odd number. Two sets differ in as many members as these bits, or more.

    There are two kinds a member or more, a power of two and PARITY at least, as the bound says
    little where many members share a kind; or as many as are asked for.
    """
    kinds = kinds or max(PARITY, 1 << (2 * len(members) - 1).bit_length())
    return np.packbits(np.bincount(members & (kinds - 1), minlength=kinds) & 1).tobytes()


def _folded(odd: Column, size: Column) -> Column:
    """Parities of half as many kinds, where they are more than size words."""
    return F.when(F.size(odd) > size, F.zip_with(F.slice(odd, F.lit(1), size), F.slice(odd, size + 1, size), lambda x, y: x.bitwiseXOR(y))).otherwise(odd)


def with_prefix(docs: DataFrame) -> DataFrame:
    """docs, less their text, with fp, a hash of the set, sim, the SimHash, n, the set's size, its prefix, its parities, and those of PARITY kinds; stored."""
    shared = docs.sparkSession.sparkContext.broadcast(common(docs))

    def made(texts: pa.Array) -> list[pa.Array]:
        raw = texts.cast(pa.binary()).to_pylist()
        sets = list(map(shingles, raw))
        return [pa.array(_prints(sets)), simhash.prints_of(raw), pa.array([len(x) for x in sets], pa.int32()), _lists([prefix(x, shared.value) for x in sets]), _lists([np.frombuffer(parity(x), np.int64) for x in sets]), _lists([np.frombuffer(parity(x, PARITY), np.int64) for x in sets])]

    found = stored(with_columns(docs, ["text"], [T.StructField("fp", T.LongType()), T.StructField("sim", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("prefix", _LIST), T.StructField("odd", _LIST), T.StructField("short", _LIST)], made, ["text"]))
    shared.destroy()
    return found


def by_simhash(prefixes: DataFrame) -> DataFrame:
    """Edges (a, b) that connect exactly the sets whose texts the SimHash operator connects."""
    held = stored(prefixes.select("sim", "fp").distinct())
    of = held.groupBy("sim").agg(F.min("fp").alias("first"))
    near = simhash.links(of.select(F.col("sim").alias("fp"), simhash.cell_of(F.col("sim")).alias("cell")))
    first = lambda c: of.select(F.col("sim").alias(c), F.col("first").alias(f"first_{c}"))
    far = near.join(first("a"), "a").join(first("b"), "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    same = held.join(of, "sim").select(F.col("first").alias("a"), F.col("fp").alias("b"))
    return stored(far.union(same).where("a <> b").distinct())


def buckets(prefixes: DataFrame) -> DataFrame:
    """(h, fp, n) in which any two alike share an h; no h has a single fp."""
    first = prefixes.select(F.explode("prefix").alias("h"), "fp", "n")
    shared = first.groupBy("h").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("h")
    return stored(first.join(shared, "h", "left_semi").distinct())


def sets_of(docs: DataFrame, able: DataFrame) -> DataFrame:
    """(fp, shingles) of the texts of docs whose fp is in able; stored."""
    small_batches(docs.sparkSession)
    at = F.pmod("fp", F.lit(BITS))
    bit = F.call_function("shiftleft", F.lit(1), at.bitwiseAND(F.lit(7)).cast("int"))
    bitmap = np.zeros(BITS // 8, np.uint8)
    for b in able.groupBy(F.shiftright(at, 3).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow().to_batches():
        bitmap[b.column(0).to_numpy()] = b.column(1).to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = _sets(b.column(0))
            prints = _prints(sets)
            place = prints % BITS
            maybe = np.flatnonzero(shared.value[place >> 3] >> (place & 7) & 1)
            yield pa.RecordBatch.from_arrays([pa.array(prints[maybe]), _lists([sets[k] for k in maybe])], names=["fp", "shingles"])

    found = docs.select("text").mapInArrow(made, "fp long, shingles array<long>")
    found = stored(found.join(able, "fp", "left_semi").dropDuplicates(["fp"]))
    shared.destroy()
    return found


def _alike(pairs: DataFrame, prefixes: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sets have a similarity of 4/5 or more; parities tell most of the others without their sets."""
    size = lambda c: prefixes.select(F.col("fp").alias(c), F.col("n").alias(f"n_{c}"), F.col("odd").alias(f"odd_{c}")).dropDuplicates([c])
    # sizes differ by a quarter at most, so kinds do by a factor of two at most
    least = F.least(F.size("odd_a"), F.size("odd_b"))
    bits = F.zip_with(_folded(F.col("odd_a"), least), _folded(F.col("odd_b"), least), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    apart = F.aggregate(bits, F.lit(0), lambda n, x: n + x)
    close = stored(pairs.join(size("a"), "a").join(size("b"), "b").where(9 * apart <= F.col("n_a") + F.col("n_b")).select("a", "b"))
    sets = sets_of(docs, close.select(F.col("a").alias("fp")).union(close.select("b")).distinct())
    of = lambda c: sets.select(F.col("fp").alias(c), F.col("shingles").alias(f"s_{c}"))
    both = close.join(of("a"), "a").join(of("b"), "b")
    return stored(both.where(9 * F.size(F.array_intersect("s_a", "s_b")) >= 4 * (F.size("s_a") + F.size("s_b"))).select("a", "b"))


def _pairs(met: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) from (x, n_x, y, n_y), less those whose sizes differ too much."""
    fit = (F.col("x") != F.col("y")) & (5 * F.least("n_x", "n_y") >= 4 * F.greatest("n_x", "n_y"))
    return met.where(fit).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def links(prefixes: DataFrame, docs: DataFrame, given: DataFrame) -> DataFrame:
    """Edges (a, b) that connect exactly the distinct sets that chains of similar ones and of given edges connect."""
    met = buckets(prefixes)
    # how typical a text is: an original has more members in common with its copies than they have among each other
    held = met.groupBy("h").agg(F.count("*").alias("k"))
    typical = met.join(held, "h").groupBy("fp").agg(F.sum(F.log2("k")).alias("typical"))
    scored = stored(met.join(typical, "fp"))
    text = F.struct(F.col("fp").alias("x"), F.col("n").alias("n_x"))
    hubs = scored.groupBy("h").agg(F.array(F.min_by(text, F.struct(F.xxhash64(F.pmod("h", F.lit(HUBS)), "fp"), "fp")), F.max_by(text, F.struct("typical", "fp"))).alias("hubs"))
    hubs = hubs.select("h", F.explode(F.array_distinct("hubs")).alias("hub")).select("h", "hub.x", "hub.n_x")
    near = _alike(_pairs(met.join(hubs, "h").select("x", "n_x", F.col("fp").alias("y"), F.col("n").alias("n_y"))), prefixes, docs)
    near = near.union(given)
    known = connected_components(near)
    named = stored(met.join(known, met["fp"] == known["node"], "left").select("h", "fp", "n", F.coalesce("component", "fp").alias("c")))
    # members that the same texts share agree in their number and in two hashes of them
    marks = F.bit_xor(F.xxhash64("fp")).alias("s"), F.bit_xor(F.xxhash64(F.lit(1), "fp")).alias("t")
    counts = named.groupBy("h", "c").agg(F.count("*").alias("k"), *marks)
    main = counts.groupBy("h").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.count("*").alias("groups"), F.sum("k").alias("texts"), F.bit_xor("s").alias("s"), F.bit_xor("t").alias("t"))
    main = main.where("groups > 1 AND texts > 2").groupBy("texts", "s", "t").agg(F.min("h").alias("h"), F.min("main").alias("main")).select("h", "main")
    # short parities go with these rows, so that most pairs aren't made at all
    short = prefixes.select("fp", "short").dropDuplicates(["fp"])
    mixed = stored(named.join(main, "h").join(short, "fp"))
    others = mixed.where("c <> main").select("h", F.col("fp").alias("x"), F.col("n").alias("n_x"), F.col("c").alias("c_x"), F.col("short").alias("o_x"))
    all_ = mixed.select("h", F.col("fp").alias("y"), F.col("n").alias("n_y"), F.col("c").alias("c_y"), F.col("short").alias("o_y"))
    apart = sum((F.bit_count(F.get("o_x", F.lit(k)).bitwiseXOR(F.get("o_y", F.lit(k)))) for k in range(1, PARITY // 64)), F.bit_count(F.get("o_x", F.lit(0)).bitwiseXOR(F.get("o_y", F.lit(0)))))
    fit = (others["h"] == all_["h"]) & (F.col("c_x") != F.col("c_y")) & (5 * F.least("n_x", "n_y") >= 4 * F.greatest("n_x", "n_y")) & (9 * apart <= F.col("n_x") + F.col("n_y"))
    return near.union(_alike(_pairs(others.join(all_, fit)), prefixes, docs))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", with_key: bool = False) -> DataFrame:
    """As simhash.near_duplicates, whose links are among those made here, with fp a hash of the text's set."""
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    key = [F.md5(F.coalesce("text", F.lit(""))).alias("key")] if with_key else []
    prefixes = with_prefix(docs.select("doc_id", "text", *key))
    ids = prefixes.drop("sim", "n", "prefix", "odd", "short")
    return grouped(ids, ids.groupBy("fp").agg(F.min("doc_id").alias("least")), links(prefixes, docs, by_simhash(prefixes)))
