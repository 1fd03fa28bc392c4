"""SimHash near-duplicates by a segment-popcount grid.

A fingerprint is cut into 16 segments of 4 bits; the bits set in each make a point on an
integer grid. The Manhattan distance of two points is a lower bound of the Hamming distance,
as a changed bit moves a point by one step. Two fingerprints at 2 or fewer differing bits thus
meet in a cell that is at most one step from each, so an equi-join on a fingerprint's own cell
and its 32 neighbours is a range join that misses nothing.

Cells with a single fingerprint are dropped. The rest is verified exactly, and without pairs:
within a cell each fingerprint is turned into those of its one-bit variants (and itself) that
lie on that cell. Two fingerprints share such a variant if, and only if, they differ in 2 bits
or fewer, so everything that shares one is linked to its smallest member. Work is linear in the
number of distinct fingerprints, however crowded a cell is, and no bucket is capped.

Documents with equal fingerprints are one node. A text without words has fingerprint 0 and is
linked like any other; null counts as empty. Rows that repeat a doc_id are all returned, with
the component of their own fingerprint; a null doc_id is returned, but never names a component
that has another.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdex.llm.common import fresh, stored, with_columns
from loomdex.llm.components import connected_components

SHINGLE, SEED, RADIUS = 3, 42, 2
SEGMENTS, WIDTH = 16, 4
_PART = 1 << 18


def fingerprint(text: bytes | None) -> int:
    """The SimHash of a UTF-8 text; A-Z lower-cased, words of non-blank bytes, shingles counted with repeats."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    hash64 = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return hash64(b" ".join(words), SEED)
    n, ones = len(words) - SHINGLE + 1, np.zeros(64, np.int64)
    for at in range(0, n, _PART):
        some = words[at : at + _PART + SHINGLE - 1]
        hashes = np.fromiter((hash64(x, SEED) for x in map(b" ".join, zip(some, some[1:], some[2:], strict=False))), "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def prints_of(raw: list[bytes | None]) -> pa.Array:
    """The SimHashes of UTF-8 texts as signed 64-bit integers."""
    return pa.array(np.fromiter(map(fingerprint, raw), np.uint64, len(raw)).view(np.int64))


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """df with the fingerprint as a signed 64-bit integer."""
    return with_columns(df, [text], [T.StructField(out, T.LongType())], lambda texts: [prints_of(texts.cast(pa.binary()).to_pylist())])


def _long(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def cell_of(fp: Column) -> Column:
    """The popcounts of the 16 segments, a hexadecimal digit each."""
    half, low = F.shiftrightunsigned(fp, 1), _long(0x5555555555555555)
    two = fp.bitwiseXOR(half).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(half).bitwiseAND(low), 1))
    m = _long(0x3333333333333333)
    return two.bitwiseAND(m) + F.shiftrightunsigned(two, 2).bitwiseAND(m)


def _near(cell: Column) -> list[Column]:
    """(cell, segment, step) of a point and its neighbours; null where a count would leave its range."""
    at = lambda c, s, d: F.struct(c.alias("cell"), F.lit(s).cast("byte").alias("s"), F.lit(d).cast("byte").alias("d"))
    found = [at(cell, 0, 0)]
    for s in range(SEGMENTS):
        count, unit = F.shiftrightunsigned(cell, WIDTH * s).bitwiseAND(F.lit(15)), _long(1 << (WIDTH * s))
        found += [F.when(count < WIDTH, at(cell + unit, s, 1)), F.when(count > 0, at(cell - unit, s, -1))]
    return found


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) that connect exactly the distinct fingerprints within 2 bits of each other, directly or by a shared one."""
    grid = prints.select("fp", F.explode(F.array(*_near(F.col("cell")))).alias("g")).where("g is not null").select("fp", "g.cell", "g.s", "g.d")
    crowded = grid.groupBy("cell").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("cell")
    met = grid.join(crowded, "cell", "left_semi")
    fp, bits = F.col("fp"), []
    for j in range(WIDTH):
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("s").cast("int") * WIDTH + j)
        is_set = fp.bitwiseAND(mask) != 0
        bits.append(F.when((F.col("d") == 1) & ~is_set | (F.col("d") == -1) & is_set, fp.bitwiseXOR(mask)))
    forms = F.array(F.when(F.col("d") == 0, fp), *bits)
    variants = met.select("fp", F.explode(forms).alias("variant")).where("variant is not null")
    shared = variants.groupBy("variant").agg(F.min("fp").alias("hub"), F.max("fp").alias("hi")).where("hub <> hi").select("variant", "hub")
    return variants.join(shared, "variant").where("fp <> hub").select(F.col("hub").alias("a"), F.col("fp").alias("b")).distinct()


def grouped(docs: DataFrame, prints: DataFrame, edges: DataFrame) -> DataFrame:
    """docs, which have doc_id and fp, with the component of their fp and the smallest doc_id in it; prints has the least id of each fp."""
    joined = connected_components(edges)
    named = prints.join(joined, prints["fp"] == joined["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = named.join(ids, "component").select("fp", "component", "component_id")
    return docs.join(by_print, "fp").select("doc_id", "fp", "component", "component_id", *(c for c in docs.columns if c == "key"))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", with_key: bool = False) -> DataFrame:
    """(doc_id, fp, component, component_id) for each row.

    component_id is the smallest doc_id that links reach; component names the group also where
    ids repeat. With with_key a digest of the text, key, is added.
    """
    docs = with_fingerprint(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text")
    docs = stored(docs.select("doc_id", "fp", *([F.md5(F.coalesce("text", F.lit(""))).alias("key")] if with_key else [])))
    prints = docs.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("cell", cell_of(F.col("fp")))
    prints = stored(prints)
    return grouped(docs, prints, links(prints))


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text", groups: Callable = near_duplicates) -> DataFrame:
    """The rows of df less near-duplicates: of each group the row of the smallest doc_id stays, ties going by text and then by the other columns."""
    found = groups(df, doc_id, text, with_key=True)
    key, row, id_, of = fresh(df, "_key", "_n", "_id", "_of")
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("x")).select(F.col("x.doc_id").alias(id_), F.col("x.key").alias(of)).distinct()
    keyed = df.withColumn(key, F.md5(F.coalesce(F.col(text), F.lit(""))))
    left = keyed.join(first, keyed[doc_id].eqNullSafe(first[id_]) & (keyed[key] == first[of]), "left_semi")
    order = Window.partitionBy(doc_id, key).orderBy(*(c for c in df.columns if c != doc_id))
    return left.withColumn(row, F.row_number().over(order)).where(F.col(row) == 1).drop(row, key)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
