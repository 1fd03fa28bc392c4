"""Packing: every id once, the tokenizers library's ids, no padding, balanced groups."""

import json
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from samples import folder_of, sentence
from tokenizers import Tokenizer

from loomdex.llm import packing, queries
from loomdex.llm.packing import plan


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(packing.TOKENIZER)


@pytest.fixture(scope="module")
def model():
    with open(packing.TOKENIZER) as f:
        return f.read()


def pieces_of(made):
    held = defaultdict(list)
    for runs in made:
        for item, at, n in runs:
            assert n > 0
            held[item].append((at, n))
    return {k: sorted(v) for k, v in held.items()}


@given(st.lists(st.integers(0, 300), max_size=60), st.booleans(), st.sampled_from([(64, 32, 16), (64, 16), (64,)]))
@settings(max_examples=300, deadline=None)
def test_plan_is_exact(lengths, last, tiers):
    made, rest = plan([(k, 5 * k, n) for k, n in enumerate(lengths)], tiers, last)
    for item, parts in pieces_of([*made, rest]).items():
        at = 5 * item
        for start, n in parts:
            assert start == at
            at += n
        assert at == 5 * item + lengths[item]
    assert {k for k, n in enumerate(lengths) if n} == pieces_of([*made, rest]).keys()
    sizes = [sum(n for _, _, n in runs) for runs in made]
    assert all(s & (s - 1) == 0 and s <= 64 for s in sizes)
    assert sum(n for _, _, n in rest) < (1 if last else tiers[-1])
    assert sum(s < tiers[-1] for s in sizes) <= (tiers[-1].bit_length() - 1 if last else 0)


def test_plan_fills_gaps_from_shorter_tiers():
    made, rest = plan([(0, 0, 60), (1, 0, 20), (2, 0, 4), (3, 0, 12)], (64, 32, 16), False)
    assert made == [[(0, 0, 60), (2, 0, 4)], [(1, 0, 20), (3, 0, 12)]] and rest == []
    made, _ = plan([(0, 0, 150), (1, 0, 20), (2, 0, 12)], (64, 32, 16), False)  # a long document fills windows alone first
    assert made[:2] == [[(0, 0, 64)], [(0, 64, 64)]]
    made, rest = plan([(0, 0, 60), (1, 0, 30)], (64, 32, 16), False)  # none fits, so the longest is cut
    assert made == [[(0, 0, 60), (1, 0, 4)], [(1, 4, 16)]] and rest == [(1, 20, 10)]


def test_encoder_equals_library(library, model, odd_rows):
    texts = [r[1] for r in odd_rows] + ["Don't STOP's İstanbul ΣΑΣ a<|endoftext|>b <|startoftext|> x y z\x1cq\x85", "é ́a\n̸ 12345 #$%&", "x" * 5000]
    encode = packing.Encoder(model, memo=3)  # forgets between calls
    for _ in range(2):
        got = encode([None if t is None else t.encode() for t in texts])
        assert [x.tolist() for x in got] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert encode([]) == [] and [x.tolist() for x in encode([b"", None])] == [[], []]


@given(st.lists(st.text(max_size=40) | st.text("aZé'sl.,;:!? \n0<|>endoftx", max_size=40), max_size=5))
@settings(max_examples=300, deadline=None)
def test_encoder_on_any_text(library, model, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    held = packing.encoder(model)
    assert [x.tolist() for x in held([t.encode() for t in texts])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def check_pieces(rows, texts, library, tiers=packing.TIERS):
    """rows hold every id of every text once, gapless, in sequences without padding."""
    of = defaultdict(list)
    for r in rows:
        of[r["doc_id"], r["doc_tokens"]].append(r)
    want = defaultdict(list)
    for k, t in texts:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, packing.END]
        want[k, len(ids)].append(ids)
    assert of.keys() == want.keys()
    for key, some in of.items():
        docs = {tuple(x) for x in want[key]}
        if len(docs) == 1 and len(want[key]) == 1:
            at, ids = 0, want[key][0]
            for r in sorted(some, key=lambda r: r["start"]):
                assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
                at += r["length"]
            assert at == len(ids)
        assert sum(r["length"] for r in some) == key[1] * len(want[key])
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
    for some in sequences.values():
        at = 0
        for r in sorted(some, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= tiers[0] and at & (at - 1) == 0 and {r["tier"] for r in some} == {at}


def test_pack(spark, odd, odd_rows, none, library):
    many = [(1000 + k, sentence(k, 5 + 37 * k % 700), "en", "a", 0) for k in range(400)]
    docs = odd.union(spark.createDataFrame(many, odd.schema)).repartition(3)
    check_pieces(packing.pack(docs).collect(), [(r[0], r[1]) for r in [*odd_rows, *many]], library)
    small = packing.pack(docs.withColumn("tier", F.lit(1)).withColumn("Start", F.lit("x")), tiers=(256, 64), group_tokens=500).collect()
    check_pieces(small, [(r[0], r[1]) for r in [*odd_rows, *many]], library, (256, 64))
    assert packing.with_step_groups(packing.pack(none)).collect() == []
    for bad in ((100,), (64, 128), (64, 64)):
        with pytest.raises(ValueError):
            packing.pack(docs, tiers=bad)


def test_sequences_hold_the_texts(spark, library):
    texts = [(k, sentence(k, 3 + 11 * k)) for k in range(60)]
    pieces = packing.pack(spark.createDataFrame(texts, "doc_id long, text string"), with_ids=True, tiers=(512, 128))
    held = {r["sequence_id"]: r for r in packing.sequences(pieces).collect()}
    back = defaultdict(dict)
    for r in pieces.collect():
        assert held[r["sequence_id"]]["ids"][r["offset"] : r["offset"] + r["length"]] == r["ids"]
        back[r["doc_id"]][r["start"]] = r["ids"]
    for k, t in texts:
        assert [i for s in sorted(back[k]) for i in back[k][s]] == [*library.encode(t, add_special_tokens=False).ids, packing.END]
    assert all(sum(r["lengths"]) == len(r["ids"]) for r in held.values())


def test_step_groups_are_balanced(spark):
    docs = spark.createDataFrame([(k, sentence(k, 20 + 53 * k % 3000)) for k in range(300)], "doc_id long, text string")
    rows = packing.with_step_groups(packing.pack(docs), step_tokens=20_000).collect()
    tokens, mix = defaultdict(int), defaultdict(lambda: defaultdict(int))
    for r in rows:
        tokens[r["step_group"]] += r["length"]
        if r["offset"] == 0:
            mix[r["tier"]][r["step_group"]] += 1
    groups = -(-sum(tokens.values()) // 20_000)
    assert sorted(tokens) == list(range(groups))
    for count in mix.values():
        each = [count[g] for g in range(groups)]
        assert max(each) - min(each) <= 1
    assert max(tokens.values()) - min(tokens.values()) <= sum(mix)


def test_op11(spark, odd, odd_rows, none, library, tmp_path):
    rows = queries.op11_pack(spark, folder_of(tmp_path / "a", documents=odd)).collect()
    check_pieces(rows, [(r[0], r[1]) for r in odd_rows], library)
    assert queries.op11_pack(spark, folder_of(tmp_path / "b", documents=none)).collect() == []
    assert json.dumps(rows[0].asDict())
