"""The query grammar and boolean, phrase and range search."""

import math

import pytest

from loomdex.operators import lexical
from loomdex.operators.query_grammar import InvalidQuery, Phrase, parse

DOCS = [("a", "function helper_function\nstruct Stack"), ("b", "function main"), ("c", "struct Main\nfunction helper"), ("d", ""), ("e", "function function apple zebra")]


@pytest.fixture(scope="module")
def index(spark):
    return lexical.Index.build(spark.createDataFrame(DOCS, "path string, symbols string"))


def found(index, query):
    return {r["path"]: r["score"] for r in lexical.search(index, query).collect()}


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("main", "bc"),
        ("MAIN stack", "abc"),
        ("helper_function", "a"),
        ('"helper function"', "a"),
        ("+function -main", "ae"),
        ("function AND main", "bc"),
        ("function AND NOT main", "ae"),
        ("(main OR stack) AND struct", "ac"),
        ("symbols:stack", "a"),
        ("-main", ""),
        ("nothing", ""),
        ("[apple TO helper]", "ace" + "b"),
        ("[zebra TO *]", "e"),
        ("{apple TO function}", ""),
        ("!!!", ""),
    ],
)
def test_matches(index, query, want):
    assert set(found(index, query)) == set(want)


def test_score(index):
    n, total, avgdl = 2, 5, (5 + 2 + 4 + 0 + 4) / 5
    want = math.log(1 + (total - n + 0.5) / (n + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / avgdl))
    assert found(index, "main")["b"] == pytest.approx(want)
    assert found(index, "main^2")["b"] == pytest.approx(2 * want)


@pytest.mark.parametrize("query", ['"open', "(a", "a)", "AND a", "a AND", "a OR", "other:a", "+", "symbols:"])
def test_errors(query):
    with pytest.raises(InvalidQuery):
        parse(query)


def test_words_are_alternatives():
    assert parse("a b_c").should == (Phrase(("a",)), Phrase(("b", "c")))


def test_written_index(spark, index, tmp_path):
    index.write(str(tmp_path))
    again = lexical.Index.read(spark, str(tmp_path))
    assert found(again, "main stack") == pytest.approx(found(index, "main stack"))


def test_top_k(spark, index):
    top = lexical.top_k(lexical.search(index, "function"), 2).collect()
    assert [r["path"] for r in top][:1] == ["e"] and len(top) == 2
    with pytest.raises(ValueError):
        lexical.top_k(lexical.search(index, "function"), 0)


def test_phrases_of_three_terms_and_repeats(spark):
    """Frequencies by hand, with terms that repeat within the phrase and in the text."""
    texts = ["a b a b a", "a b b a", "b a b a a b", "c a b a", "a a a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "path int, symbols string")
    index = lexical.Index.build(docs)
    for phrase in ("a b a", "a a", "b a b a", "c", "a c"):
        want = {k for k, t in enumerate(texts) if f" {phrase} " in f" {t} "}
        assert {r["path"] for r in lexical.search(index, f'"{phrase}"').collect()} == want
