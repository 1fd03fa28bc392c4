"""How filters interact: what each removes, alone, in every order and on average over all orders.

Every document is reduced once to a mask of the conditions that it fails; documents of one part,
mask and label are counted, which leaves at most 2^n cells a part, however many documents there
are. Orders are then visited by adjacent transpositions: each differs from the one before by a
swap of two neighbouring filters, which changes only what these two remove and what is left
between them. Both are sums of cells: a filter that comes after a set of others removes the cells that hold its
bit and none of theirs. Shapley values, here sums over all orders, build up along the walk. Walks
of many parts run side by side as rows of matrices; parts are dealt over tasks, and each is one
row with its cells, so parts may be as many as hosts.

The condition that looks across documents, a text that a smaller id has too, is found from hashes of texts:
the smallest id of each hash by partial aggregation, met again by hash and id, so that no group
of copies is gathered in a task.

Null texts are empty. A null part is the part of the empty string. A null id is neither smaller
nor larger than another, so its row never fails that condition, and has no labels. Rows that repeat id and text are
each counted, and none is a copy of the other. Of several labels of one id any counts. An empty
table gives an empty result. Only the named columns are read and only the documented ones come out, so other columns can't
clash. Very long texts are split into their words within a task, one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdex.llm.common import stored, words_of

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
MOST_FILTERS, BATCH_PARTS = 8, 256


def text_filters(text: Column) -> dict[str, Column]:
    """The four conditions on one text, by letter; true where it fails."""
    words, length = words_of(text), F.length(text)
    capitals = length - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * capitals.cast("long") > 5 * length.cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def masks(docs: DataFrame, filters: Mapping[str, Column], part: Column, doc_id: str = "doc_id", text: Column | None = None) -> DataFrame:
    """(doc_id, part, mask, copy, n), counted and stored: bit k of the mask is the k-th filter's condition, copy a hash of the text, if one is given."""
    mask = reduce(add, (F.when(c, 1 << k).otherwise(0) for k, c in enumerate(filters.values())), F.lit(0))
    copy = F.lit(None).cast("binary") if text is None else F.unhex(F.sha2(text, 256))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(part, F.lit("")).alias("part"), mask.alias("mask"), copy.alias("copy"))
    return stored(rows.groupBy("doc_id", "part", "mask", "copy").agg(F.count("*").alias("n")))


def with_copies(rows: DataFrame, bit: int) -> DataFrame:
    """rows of masks() with a bit set where a smaller id has the same text."""
    first = rows.groupBy("copy").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(True))
    known = rows.where("doc_id is not null").join(first, ["copy", "doc_id"], "left")
    again = F.when(F.col("first").isNull(), 1 << bit).otherwise(0)
    return known.withColumn("mask", F.col("mask") + again).drop("first", "copy").unionByName(rows.where("doc_id is null").drop("copy"))


def with_labels(rows: DataFrame, labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """rows with good and toxic, whether any label of the id says so."""
    held = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id"))
    held = held.agg(F.coalesce(F.max(F.col(quality) == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col(toxic) == 1), F.lit(False)).alias("toxic"))
    lost = rows.where("doc_id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)})  # they meet no label, and would all meet in one task
    known = rows.where("doc_id is not null").join(held.where("good or toxic"), "doc_id", "left")
    return known.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")}).unionByName(lost)


def cells_of(rows: DataFrame) -> DataFrame:
    """(part, cells): for each part its masks with their documents, good ones and toxic ones."""
    count = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    cells = rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), count("good"), count("toxic"))
    return cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))


def swaps(n: int) -> Iterator[int]:
    """Places k whose element is swapped with the next one, so that all orders of n elements are visited once: the last element sweeps through the orders of the others."""
    if n < 2:
        return
    others, to_left = swaps(n - 1), True
    while True:
        yield from range(n - 2, -1, -1) if to_left else range(n - 1)
        at = next(others, None)
        if at is None:
            return
        yield at + to_left  # the sweeping element stands before the others
        to_left = not to_left


def walk(cells: np.ndarray, n: int) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """(order, counts) of every order of n filters; counts has (kept, removed, good removed, toxic removed) by part and step.

    cells has, by part and mask, documents, good and toxic ones. The array that is given out changes with the next step.
    """
    all_masks = np.arange(1 << n)
    order = list(range(n))
    counts = np.zeros((len(cells), n, 4), np.int64)

    def update(step: int) -> None:
        before = sum(1 << f for f in order[:step])
        stands = (all_masks & before) == 0
        falls = stands & (all_masks >> order[step] & 1 == 1)
        counts[:, step, 1:] = cells[:, falls].sum(axis=1)
        counts[:, step, 0] = cells[:, stands & ~falls, 0].sum(axis=1)

    for step in range(n):
        update(step)
    yield tuple(order), counts
    for k in swaps(n):
        order[k], order[k + 1] = order[k + 1], order[k]
        update(k)
        update(k + 1)
        yield tuple(order), counts


def audit(cells: DataFrame, letters: Sequence[str]) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for each part, order and step."""
    n = len(letters)
    if not 0 < n <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters, as all their orders are visited")
    schema = T.StructType([T.StructField("part", T.StringType()), T.StructField("filter_order", T.StringType()), T.StructField("step", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in COUNTS)])

    def block(parts: list[str], held: list[list[dict]]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((len(parts), 1 << n, 3), np.int64)
        for row, some in enumerate(held):
            for c in some:
                table[row, c["mask"]] += (c["n"], c["good"], c["toxic"])
        fails = np.stack([table[:, np.arange(1 << n) >> f & 1 == 1, 0].sum(axis=1) for f in range(n)], axis=1)
        alone = table[:, [1 << f for f in range(n)], 0]
        shapley, orders, found = np.zeros((len(parts), n), np.int64), [], []
        for order, counts in walk(table, n):
            shapley[:, order] += counts[:, :, 1]
            orders.append(order)
            found.append(counts.copy())
        for at in range(0, len(orders), 120):
            some, counts = np.array(orders[at : at + 120]), np.stack(found[at : at + 120], axis=1)  # part, order, step, count
            removed = counts[..., 1]
            values = [counts[..., 0], removed, fails[:, some] - removed, alone[:, some], counts[..., 2], counts[..., 3], shapley[:, some]]
            names = ["".join(letters[f] for f in o) for o in some.tolist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.array(parts, object), len(names) * n), pa.string()),
                    pa.array(np.tile(np.repeat(np.array(names, object), n), len(parts)), pa.string()),
                    pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(parts) * len(names))),
                    *(pa.array(v.reshape(-1)) for v in values),
                ],
                names=schema.fieldNames(),
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BATCH_PARTS):
                some = b.slice(at, BATCH_PARTS)
                yield from block(some.column(0).to_pylist(), some.column(1).to_pylist())

    return cells.mapInArrow(run, schema)


def audit_filters(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """The audit of the five standard filters over documents: those of text_filters(), and E, a text that a smaller id has too."""
    t = F.coalesce(F.col(text), F.lit(""))
    filters = text_filters(t)
    rows = masks(docs, filters, F.col(part), doc_id, t)
    rows = with_labels(with_copies(rows, len(filters)), labels)
    return audit(cells_of(rows), [*filters, "E"])
