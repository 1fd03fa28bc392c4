"""Maintained statistics against a count from nothing, after random changes."""

import random

from loomdex.operators import lexical
from loomdex.operators.term_deltas import TermStatistics, deltas

SCHEMA = "path string, content string, term string"


def test_changes_equal_a_count_from_nothing(spark, tmp_path):
    rng, held = random.Random(5), {}
    kept = TermStatistics(spark, str(tmp_path / "kept"))
    words = ["a", "b", "cc", "Über", "a,b", "", "x" * 50]
    frame = lambda rows: spark.createDataFrame([(p, t, "clash") for p, t in rows.items()], SCHEMA)
    for batch in range(5):
        names = rng.sample("pqrstuvw", 5)
        after = {p: rng.choice((None, "", " ".join(rng.choice(words) for _ in range(rng.randrange(9))))) for p in names[:3]}
        before = {p: held[p] for p in names if p in held}
        for _ in range(2 if batch % 2 else 1):
            kept.apply(batch, frame(before), frame(after))
        held = {p: t for p, t in held.items() if p not in names} | after
        if batch == 2:
            kept.fold(batch)
        now = frame(held)
        assert sorted(map(tuple, kept.terms().collect())) == sorted(map(tuple, lexical.term_counts(now, "path", "content").collect()))
        want = lexical.statistics(lexical.lengths(now.fillna(""), "path", "content")).first()
        got = kept.totals().first()
        assert got["N"] == want["N"] and abs(got["avgdl"] - want["avgdl"]) < 1e-12
    same = frame(held)
    assert deltas(same, same).count() == 0
    kept.apply(5, before=same)
    assert kept.terms().count() == 0 and tuple(kept.totals().first()) == (0, None)


def test_rows_that_repeat_a_path_are_one_document(spark):
    rows = [("p", "a b a", ""), ("p", "a c", ""), ("q", "a", ""), ("r", None, "")]
    told = lambda some: {r["term"]: (r["df"], r["cf"], r["docs"], r["tokens"]) for r in deltas(None, spark.createDataFrame(some, SCHEMA)).collect()}
    assert told(rows) == {"a": (2, 4, 0, 0), "b": (1, 1, 0, 0), "c": (1, 1, 0, 0), None: (0, 0, 4, 6)}
    assert told(rows[1:]) == {"a": (2, 2, 0, 0), "c": (1, 1, 0, 0), None: (0, 0, 3, 3)}


def test_texts_are_cut_into_tokens_once(spark):
    plan = deltas(None, spark.createDataFrame([("p", "a b a", "")], SCHEMA))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("Aggregate") == 1
