"""Filter audit: the walk over orders, and the whole against removing documents one by one."""

import math
import re
from collections import Counter
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F
from samples import LABELS, folder_of, sentence

from loomdex.llm import audit, queries


def test_swaps_visit_every_order_once():
    for n in range(7):
        order = list(range(n))
        seen = [tuple(order)]
        for k in audit.swaps(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            seen.append(tuple(order))
        assert len(seen) == len(set(seen)) == math.factorial(n)


def test_walk_equals_counts_from_nothing():
    rng = np.random.default_rng(0)
    cells = rng.integers(0, 9, (3, 16, 3))
    for order, counts in audit.walk(cells, 4):
        left = np.arange(16)
        for step, f in enumerate(order):
            gone, left = left[left >> f & 1 == 1], left[left >> f & 1 == 0]
            assert (counts[:, step, 1:] == cells[:, gone].sum(axis=1)).all() and (counts[:, step, 0] == cells[:, left, 0].sum(axis=1)).all()


def plain(docs, labels):
    """Every order applied document by document."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, t, *_ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    parts = {}
    for i, t, _, source, _ in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and i > first[t],
        }
        parts.setdefault(source or "", []).append((i, {f for f in fails if fails[f]}))
    out, shapley = {}, Counter()
    for part, held in parts.items():
        for order in permutations("ABCDE"):
            left = held
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                failing = sum(f in x[1] for x in held)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(x[1] == {f} for x in held), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)]
                shapley[part, f] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_op13_against_loops(spark, odd, odd_rows, none, labels, tmp_path):
    rows = list(odd_rows)
    for k in range(80):
        t = sentence(k % 60, 20 + k)
        t = t.upper() if k % 7 == 0 else " ".join(f"{x}{j}" for j, x in enumerate(t.split())) if k % 3 else t
        rows.append((100 + k, t + (" | $" if k % 4 == 0 else ""), "en", "abc"[k % 3], 0))
    rows += [(1000 - k, rows[40][1], "en", "a", 0) for k in range(9)] + [rows[40], (None, rows[40][1], "en", "a", 0)]
    marks = [(r[0], (r[0] or 0) % 2, (r[0] or 0) % 5 == 1) for r in rows]
    marks = [(i, q, int(t)) for i, q, t in marks] + [(100, 0, 0), (101, None, 1)]
    docs = spark.createDataFrame(rows, odd.schema).withColumn("mask", F.lit("x")).withColumn("good", F.lit(1)).withColumn("part", F.lit(2))
    where = folder_of(tmp_path / "a", documents=docs.repartition(4), labels=spark.createDataFrame(marks, LABELS))
    found = queries.op13_filter_audit(spark, where)
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in audit.COUNTS) for r in found.collect()}
    want = plain(rows, marks)
    assert got == want and len(want) == 600 * len({r[3] or "" for r in rows})
    assert queries.op13_filter_audit(spark, folder_of(tmp_path / "b", documents=none, labels=labels.limit(0))).collect() == []


def test_more_parts_than_a_batch_and_other_filters(spark):
    rows = spark.createDataFrame([(f"h{k}", k % 8, 1 + k % 3, 0, 1) for k in range(700)], "part string, mask int, n long, good long, toxic long")
    cells = rows.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    got = audit.audit(cells, ["x", "y", "z"])
    assert got.count() == 700 * 6 * 3
    one = {(r["filter_order"], r["step"]): r["removed"] for r in got.where("part = 'h7'").collect()}
    assert all(one[o, s] == (2 if s == 1 else 0) for o, s in one)
