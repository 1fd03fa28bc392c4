"""The classifier, the ordinal regression, the language model and the piece encoder."""

import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from samples import WORDS, folder_of, sentence

from loomdex.llm import pieces, pseudolm, quality, queries, toxicity

LABELS = "doc_id long, quality int, toxic int"


def held_out(doc_id):
    import zlib

    return zlib.crc32(str(doc_id).encode()) % 3 == 1


@pytest.fixture(scope="module")
def labelled(spark, odd):
    rng = random.Random(11)
    docs, labels = [], []
    for k in range(900):
        junk, rude = rng.random() < 0.2, rng.random() < 0.25
        words = sentence(k, rng.randint(25, 80)).split()
        if junk:
            words = [w.upper() + "!!" for w in words]
        if rude:
            for _ in range(rng.randint(1, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(["vile", "nasty", "horrid"]))
        docs.append((k, " ".join(words) + ".", "en", "a", 0))
        if rng.random() < 0.7:
            labels.append((k, int(not junk), int(rude)))
    return spark.createDataFrame(docs, odd.schema), spark.createDataFrame(labels, LABELS)


def accuracy(found, labels, column, name):
    rows = found.join(labels.select("doc_id", F.col(name).alias("y")), "doc_id").collect()
    out = [r for r in rows if held_out(r["doc_id"])]
    assert len(out) > 100
    return sum(r[column] == r["y"] for r in out) / len(out)


def test_quality(spark, labelled, tmp_path):
    docs, labels = labelled
    found = queries.op1_quality(spark, folder_of(tmp_path, documents=docs, labels=labels))
    assert accuracy(found, labels, "predicted", "quality") > 0.97
    for r in found.collect():
        assert r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_quality_learns_from_its_fold_only(spark, labelled):
    docs, labels = labelled
    turned = labels.withColumn("quality", F.when(quality.in_fold(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r["doc_id"]: r["score"] for r in quality.score(docs, x).collect()} for x in (labels, turned))
    assert a == pytest.approx(b)


def test_quality_accepts(labelled):
    docs, labels = labelled
    good = {r["doc_id"] for r in quality.score(docs, labels).where("predicted = 1").collect()}
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == good


def test_quality_needs_positive_labels_only(spark, labelled):
    """The class prior comes from positives and unlabelled texts: without a bad label the result is the same."""
    docs, labels = labelled
    found = quality.score(docs, labels.where("quality = 1"))
    assert accuracy(found, labels, "predicted", "quality") > 0.97
    a, b = ({r["doc_id"]: r["score"] for r in x.collect()} for x in (found, quality.score(docs, labels)))
    assert a == pytest.approx(b)


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.9])
def test_prior(prior):
    rng = np.random.default_rng(8)
    n = 20_000
    margins = np.where(rng.random(n) < prior, rng.normal(0.6, 0.2, n), rng.normal(-0.6, 0.2, n))
    bins = lambda x: np.histogram(x, quality.BINS, (-2, 2))[0].astype(float)
    assert quality.estimated_prior(bins(margins), bins(rng.normal(0.6, 0.2, 1500))) == pytest.approx(prior, abs=0.03)


def test_risk_is_kept_from_below_zero():
    """With few rows the unbiased risk would go below zero; the fit is then the least of the clamped one, as a search over plain sums finds."""
    rng = np.random.default_rng(0)
    w = quality.WIDTH
    u, p = rng.normal(size=(40, w)), rng.normal(size=(5, w)) + 0.5
    u[:, -1] = p[:, -1] = 1
    parts = np.stack([np.vstack([x.sum(axis=0), x.T @ x]) for x in (u, p)])
    fitted = quality.fit(np.array([40.0, 5.0]), parts, 0.5)

    def risk(v):
        """The clamped risk, row by row."""
        return 0.5 * np.mean((1 - p @ v) ** 2) / 4 + max(0.0, np.mean((1 + u @ v) ** 2) / 4 - 0.5 * np.mean((1 + p @ v) ** 2) / 4)

    scale = np.sqrt(np.maximum(u.var(axis=0), 1e-6))
    scale[-1] = 1
    ridge = np.full(w, quality.RIDGE + 0.02 * w / 5)
    ridge[-1] = 1e-9
    whole = lambda v: risk(v) + (ridge * (v * scale) ** 2).sum() / 4
    assert np.isfinite(fitted).all()
    for _ in range(300):  # no small step in any direction is better
        assert whole(fitted + rng.normal(0, 1e-3, w) / scale) >= whole(fitted) - 1e-7
    assert quality.fit(np.array([40.0, 0.0]), parts, 0.5) is None


def test_odd_quality(spark, odd, none, labels, tmp_path):
    assert queries.op1_quality(spark, folder_of(tmp_path / "a", documents=odd, labels=labels)).count() == odd.count()
    nothing = labels.limit(0)
    assert {r["score"] for r in quality.score(odd, nothing).collect()} == {0.5}
    assert quality.score(none, labels).count() == 0 and quality.score(none, nothing).count() == 0
    clash = odd.withColumn("features", F.lit(1)).withColumn("good", F.lit(2)).withColumn("of", F.lit(3))
    assert quality.accepted(clash, labels).columns == clash.columns


def test_toxicity(spark, labelled, tmp_path):
    docs, labels = labelled
    found = queries.op2_toxicity(spark, folder_of(tmp_path, documents=docs, labels=labels))
    assert accuracy(found, labels, "toxic", "toxic") > 0.97
    for r in found.collect():
        assert 0 <= r["severity"] <= 3 and r["grade"] in (0, 1, 2, 3)


def test_severity_grows(spark, labelled):
    docs, labels = labelled
    model = toxicity.train(docs, labels)
    assert (np.diff(model.thresholds) > 0).all()
    texts = [(k, sentence(1) + " vile nasty" * k) for k in range(5)]
    got = [r["severity"] for r in toxicity.severity(spark.createDataFrame(texts, "k int, text string"), model).orderBy("k").collect()]
    assert got == sorted(got) and got[0] < 0.3 and got[4] > 1


def test_evidence_by_hand(spark):
    """Words that say most about the label, by plain counts and the likelihood ratio; those against toxicity too."""
    rng = random.Random(21)
    rows = []
    for _ in range(400):
        toxic = rng.random() < 0.3
        words = rng.choices(WORDS, k=12) + (["vile"] if rng.random() < (0.7 if toxic else 0.02) else []) + (["kind"] if rng.random() < (0.02 if toxic else 0.6) else [])
        rows.append((" ".join(words), toxic))
    found, bad, good = toxicity.evidence(spark.createDataFrame(rows, "text string, toxic boolean"))
    assert (bad, good) == (sum(t for _, t in rows), sum(not t for _, t in rows))
    want = {}
    for w in {w for t, _ in rows for w in t.split()}:
        b, g = (sum(w in t.split() for t, y in rows if y == k) for k in (True, False))
        if b + g >= toxicity.MIN_DOCS:
            odds, rate = np.log((b + 0.5) / (bad + 1)) - np.log((g + 0.5) / (good + 1)), bad / (bad + good)
            ratio = 2 * sum(k * np.log(k / ((b + g) * r)) for k, r in ((b, rate), (g, 1 - rate)) if k)
            z = np.sign(odds) * np.sqrt(max(ratio, 0))
            if not toxicity.AGAINST < z < toxicity.EVIDENCE:
                want[w] = odds
    assert found == pytest.approx(want) and found["vile"] > 0 > found["kind"]


def test_severity_follows_density(spark, labelled):
    """The same toxic words in a longer text are a lower grade."""
    model = toxicity.train(*labelled)
    texts = [(n, sentence(3, n) + " vile nasty horrid") for n in (10, 60, 400)]
    got = [r["severity"] for r in toxicity.severity(spark.createDataFrame(texts, "n int, text string"), model).orderBy("n").collect()]
    assert got[0] > got[1] > got[2]


def test_odd_toxicity(odd, none, labels):
    model = toxicity.train(odd, labels)
    clash = odd.withColumn("severity", F.lit("x"))
    assert toxicity.severity(clash, model).count() == odd.count()
    assert toxicity.train(none, labels) is None and {r["severity"] for r in toxicity.severity(odd, None).collect()} == {0.0}
    assert toxicity.severity(none, None).count() == 0


def test_ordinal_fit():
    """Recovers known weights from drawn grades."""
    rng = np.random.default_rng(1)
    rows, width = 6000, 4
    x = rng.integers(0, 2, (rows, width)).astype(float)
    w, thr = np.array([2.0, -1.0, 0.5, 3.0]), np.array([1.0, 2.5, 4.0])
    p = 1 / (1 + np.exp(thr[None] - (x @ w)[:, None]))
    y = (rng.random(rows)[:, None] < p).sum(axis=1)
    r, c = np.nonzero(x)
    got, got_thr = toxicity.fit(r, c, x[r, c], width, y)
    assert got == pytest.approx(w, abs=0.3) and got_thr == pytest.approx(thr, abs=0.3)


@pytest.fixture(scope="module")
def lm_docs(spark):
    """Texts of a strict order: each word fixes its neighbours."""
    rows = [(k, " ".join(WORDS[(k + j) % len(WORDS)] for j in range(60))) for k in range(400)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def encoded(lm, counts, texts):
    """Ids and numbers of words of texts, and the sums that the counts give."""
    ids, sizes, rare, _ = pseudolm.Encoder(lm, counts).encode(pa.array(texts, pa.string()))
    return ids, sizes, rare


def test_pseudo_likelihood_learns(spark, lm_docs):
    lm, counts, rest = pseudolm.counted(lm_docs)
    rows = pseudolm.with_ids(lm_docs, lm, counts, rest).cache()
    assert {r["turn"] for r in rows.select("turn").distinct().collect()} == set(range(pseudolm.ROUNDS))
    before = pseudolm.score(rows, lm).agg(F.avg("mean_log_prob")).first()[0]
    trained = pseudolm.train(rows, lm, batch=128)
    after = pseudolm.score(rows, trained).agg(F.avg("mean_log_prob")).first()[0]
    assert after > before + 0.5
    rng = random.Random(2)
    mixed = [" ".join(rng.sample(WORDS, len(WORDS))) for _ in range(20)]
    ordered = [" ".join(WORDS[k:] + WORDS[:k]) for k in range(20)]
    each = lambda texts: trained.scores(*encoded(trained, counts, texts)[:2]).mean() / len(WORDS)
    assert each(ordered) > each(mixed) + 0.3


def test_gradients_by_differences():
    """Every gradient is the slope of the summed negative log-probability."""
    rng = np.random.default_rng(3)
    flat = rng.normal(0, 0.3, pseudolm.SIZE)
    ctx, target = rng.integers(0, pseudolm.WORDS + 1, (40, 4)), rng.integers(0, 200, 40)
    ctx[:20] = 7
    w = pseudolm.unpack(flat)
    loss = lambda: -pseudolm.log_probs(w, ctx, target).sum()
    seen = 0
    for part, rows, g, n in pseudolm.gradients(w, ctx, target):
        assert np.all(np.asarray(n) >= 1)
        view = part[rows]
        for at in zip(*np.unravel_index(rng.integers(0, g.size, 3), g.shape), strict=True):
            place = (np.arange(len(part))[rows][at[0]], *at[1:])
            held, step = part[place], 1e-5
            part[place] = held + step
            above = loss()
            part[place] = held - step
            below = loss()
            part[place] = held
            assert (above - below) / (2 * step) == pytest.approx(g[at], abs=1e-5)
            seen += 1
        assert view.shape == g.shape
    assert seen > 15


def test_large_scores_are_safe():
    """Where exponentials could overflow, rows are moved first; the result is that of plain softmaxes."""
    rng = np.random.default_rng(4)
    w = pseudolm.unpack(rng.normal(0, 12, pseudolm.SIZE))
    assert not pseudolm._safe(w)
    ctx, target = rng.integers(0, pseudolm.WORDS + 1, (30, 4)), rng.integers(0, pseudolm.WORDS, 30)
    h = np.concatenate([np.tanh(w["embed"][ctx].reshape(30, -1) @ w["hidden"] + w["hidden_bias"]), np.ones((30, 1))], axis=1)

    def plain(z, at):
        z = z - z.max()
        return z[at] - np.log(np.exp(z).sum())

    want = [plain(h[k] @ w["classes"], t // pseudolm.CLASS) + plain(h[k] @ w["members"][t // pseudolm.CLASS], t % pseudolm.CLASS) for k, t in enumerate(target)]
    assert pseudolm.log_probs(w, ctx, target) == pytest.approx(np.maximum(want, np.log(1e-38)), abs=1e-6)


@pytest.fixture(scope="module")
def many_words(spark):
    """More distinct words than the vocabulary holds."""
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(["of", f"w{rng.randrange(7000)}x", f"w{rng.randrange(7000)}x", f"u{k}q{j}"]) for j in range(80))) for k in range(500)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()


def test_probabilities_of_all_words_sum_to_one(spark, many_words):
    lm, counts, _ = pseudolm.counted(many_words)
    w = pseudolm.unpack(lm.flat)
    words = sorted({x for r in many_words.collect() for x in r["text"].split()})
    assert len(words) > pseudolm.VOCABULARY + 1000
    ids, _, rare = encoded(lm, counts, words)
    ctx = np.repeat(np.array([[1, 2, 3, pseudolm.OUTSIDE]]), len(ids), axis=0)
    known = np.exp(pseudolm.log_probs(w, ctx, ids.astype(np.int64)) + rare).sum()
    kinds = np.arange(pseudolm.VOCABULARY, pseudolm.WORDS)  # a word that the corpus hasn't, of each kind
    unseen = np.exp(pseudolm.log_probs(w, ctx[: len(kinds)], kinds) - lm.log_shape).sum()
    assert known + unseen == pytest.approx(1, abs=1e-3) and known > 0.5


@pytest.mark.parametrize("tier", [pseudolm.TIER, 50, 0])
def test_scores_by_hand(spark, many_words, tier):
    """Scores are those of a plain loop over words with counts by a dictionary, wherever the counts are kept."""
    from collections import Counter

    texts = {r["doc_id"]: r["text"] for r in many_words.collect()}
    n = Counter(x for t in texts.values() for x in t.lower().split())
    lm, counts, rest = pseudolm.counted(many_words, tier=tier)
    assert (rest is None) == (tier == pseudolm.TIER) and len(counts.hashes) <= tier
    of_kind = Counter()
    for x, k in n.items():
        if x not in lm.index:
            of_kind[pseudolm.shape_of(x)] += k
    assert set(lm.index) == {x for x, _ in sorted(n.items(), key=lambda x: (-x[1], x[0]))[: pseudolm.VOCABULARY]}
    got = {r["doc_id"]: r for r in pseudolm.score(pseudolm.with_ids(many_words, lm, counts, rest), lm).collect()}
    w = pseudolm.unpack(lm.flat)
    for k in range(0, 500, 50):
        words = texts[k].lower().split()
        ids = [lm.index.get(x, pseudolm.VOCABULARY + pseudolm.shape_of(x)) for x in words]
        padded = [pseudolm.OUTSIDE] * 2 + ids + [pseudolm.OUTSIDE] * 2
        want = sum(pseudolm.log_probs(w, np.array([[padded[i], padded[i + 1], padded[i + 3], padded[i + 4]]]), np.array([ids[i]]))[0] for i in range(len(ids)))
        want += sum(np.log(n[x] / (of_kind[pseudolm.shape_of(x)] + 1)) for x in words if x not in lm.index)
        assert got[k]["n_words"] == 80 and got[k]["log_likelihood"] == pytest.approx(want, rel=1e-4)


def test_copies_score_above_their_like(spark):
    """Words that only a twice occurring document has count twice, so it scores above one that occurs once."""
    rng = random.Random(6)
    text = lambda k: " ".join(rng.choice(["of", "the", f"zz{k}y{j}"]) for j in range(120))
    once = [text(k) for k in range(300)]
    rows = [(k, t) for k, t in enumerate(once)] + [(1000 + k, once[k]) for k in range(40)]
    filler = [(5000 + k, " ".join(f"f{k}g{j}" for j in range(5000)) + (" " + " ".join(f"c{j}d" for j in range(4000))) * 3) for k in range(3)]  # so that these words aren't in the vocabulary
    found = {r["doc_id"]: r["mean_log_prob"] for r in pseudolm.pseudo_likelihood(spark.createDataFrame(rows + filler, "doc_id long, text string")).collect()}
    twice, single = [found[k] for k in range(40)], [found[k] for k in range(40, 300)]
    assert np.mean(twice) > np.mean(single) + 0.15


def test_odd_lm(spark, odd, none):
    rows = pseudolm.pseudo_likelihood(odd.withColumn("n_words", F.lit("x")).withColumn("rare", F.lit(1))).collect()
    assert len(rows) == odd.count()
    assert all(r["log_likelihood"] == 0 and r["n_words"] == 0 for r in rows if r["doc_id"] in (3, 4, 5))
    assert all(r["log_likelihood"] < 0 for r in rows if r["doc_id"] in (1, 7, 9))
    assert pseudolm.pseudo_likelihood(none).count() == 0 and pseudolm.pseudo_likelihood(odd, tier=0).count() == odd.count()


TEXTS = [
    "",
    None,
    " ",
    "   ",
    "a",
    " a  b   c ",
    "Hello, world! 12345 3.14",
    "tabs\tand\r\nnew\n\nlines ",
    "漢字 かな 한글 🙂🙂 é ü ß ñ",
    "x" * 500,
    "=" * 300 + " " * 90 + "end",
    "</s><s><unk> <0x41>",
    "\x00\x01  zero",
    "internationalization antidisestablishmentarianism",
    "http://example.com/a/b?c=d&e=f#g",
    "ıİſK",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def expected(library, texts):
    return [library.encode(t) if t else [] for t in texts]


@pytest.mark.parametrize("tier", [pieces.TIER, 5, 0])
def test_encode_as_the_library(spark, library, tier):
    """With all words in the dictionary that is broadcast, with few, and with none."""
    rng = random.Random(4)
    alphabet = "aeiourstnl" * 3 + "bcdfgz" + " " * 8 + "\n.,:;!?()[]{}<>0123456789AETS_-=/\\é漢🙂"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 200))) for _ in range(150)]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "i int, text string, ids int")
    got = {r["i"]: (r["ids"], r["ok"]) for r in pieces.encode(df, tier=tier, check="ok").collect()}
    want = expected(library, texts)
    assert [list(got[i][0]) for i in range(len(texts))] == want and all(ok for _, ok in got.values())


def test_long_words(library):
    p = pieces.Pieces()
    rng = random.Random(9)
    for _ in range(60):
        word = "".join(rng.choice("abcdefghinorst") for _ in range(rng.randint(1, 300)))
        assert p.long_word("▁" + word) == library.encode(word)


def test_decode(spark, library):
    texts = [t for t in TEXTS if t]
    rows = [(i, library.encode(t)) for i, t in enumerate(texts)] + [(98, None), (99, [])]
    got = {r["i"]: r["decoded"] for r in pieces.decode(spark.createDataFrame(rows, "i int, ids array<int>")).collect()}
    assert [got[i] for i in range(len(texts))] == texts and got[98] is None and got[99] == ""


def brute(word, table, worst, longest):
    """Best sum of scores over all cuts; a character without a piece costs the worst."""
    best = [(0.0, [])]
    for e in range(1, len(word) + 1):
        ways = [(best[s][0] + table[word[s:e]][1], [*best[s][1], table[word[s:e]][0]]) for s in range(max(0, e - longest), e) if word[s:e] in table]
        if word[e - 1] not in table:
            ways.append((best[e - 1][0] + worst, [*best[e - 1][1], None]))
        best.append(max(ways, key=lambda x: x[0]))
    return best[-1]


def test_viterbi_of_unigram_models(spark):
    rng = random.Random(6)
    p = pieces.Pieces()
    p.unigram = True
    names = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(40)} | {"a", "b"}
    p.table = [(n, 300 + k, -rng.random() * 9) for k, n in enumerate(sorted(names - {"c"}))]
    p.longest = 4
    score = {i: s for _, i, s in p.table}
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 14))) for _ in range(80)} | {"ab" * 30})
    rows = pieces.dictionary(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), p).collect()
    worst = min(s for _, _, s in p.table) - 10
    table = {n: (i, s) for n, i, s in p.table}
    assert len(rows) == len(words)
    for r in rows:
        total = sum(score.get(i, worst) for i in r["ids"])
        assert total == pytest.approx(brute(r["word"], table, worst, 4)[0])


def test_odd_pieces(odd, odd_rows, none, library):
    clash = odd.withColumn("ids", F.lit("x")).withColumn("word", F.lit(1)).withColumn("_row", F.lit(2)).withColumn("_more", F.lit(3))
    for tier in (pieces.TIER, 3):
        rows = pieces.encode(clash, tier=tier, check="ok").collect()
        assert sorted((repr(r["doc_id"]), list(r["ids"])) for r in rows) == sorted((repr(r[0]), library.encode((r[1] or "").replace(pieces.MARK, " "))) for r in odd_rows)
        assert all(r["ok"] and r["word"] == 1 and r["_row"] == 2 and r["_more"] == 3 for r in rows)
    assert pieces.encode(none, check="ok").count() == 0


def test_round_trip_tells_faults():
    """The check decodes all ids of a text: one id too many, too few or another one shows."""
    p = pieces.Pieces()
    texts = ["so it is", "", None, "  two  blanks\n", "\u2581mark"]
    each = [[i for w in p.words(t or "") for i in p.long_word(w.replace(" ", pieces.MARK))] for t in texts]
    sizes = np.array([len(x) for x in each])
    assert pieces.come_back(p, texts, np.array(sum(each, [])), sizes) == [True] * 5
    good = each[0]
    for broken in (good[:-1], good + good[-1:], good[::-1], good[:-1] + [p.table[0][1]]):
        assert pieces.come_back(p, texts, np.array(broken + sum(each[1:], [])), np.array([len(broken), *sizes[1:]])) == [False, True, True, True, True]


def test_equal_hashes_are_mended(library, monkeypatch):
    """Where words share a hash the decoded text shows it, and the document is encoded word by word."""
    p = pieces.Pieces()
    monkeypatch.setattr(pieces, "_hashes", lambda c, starts: np.array([np.uint64(len(x)) for x in np.split(c, starts[1:])], np.uint64) if len(starts) else np.zeros(0, np.uint64))
    words = ["\u2581so", "\u2581it", "\u2581is"]
    each = [np.array(p.long_word(w), np.uint16) for w in words]
    packed = pieces.Packed(3, sum(map(len, each)), np.uint16)
    packed.add(pa.table({"h": pieces.hash_words(words).view(np.int64), "n": [len(x) for x in each], "ids": [x.tobytes() for x in each]}))
    texts = ["so it is so", "is", None, "it it"]
    ids, sizes = pieces.Assembler(p, packed).encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [library.encode(t) if t else [] for t in texts]


def test_packed_dictionary(spark):
    """Ranges of hashes that tasks packed give back each word's ids, whatever their order."""
    words = [f"\u2581w{k}" for k in range(3000)]
    ids = [list(range(k % 7, k % 7 + k % 4)) for k in range(3000)]
    rows = spark.createDataFrame(list(zip(words, ids, strict=True)), "word string, ids array<int>").repartition(5)
    for wide in (False, True):
        packed = pieces.Packed.of(pieces.entries(rows, wide), wide)
        hit, at, n = packed.find(pieces.hash_words([*words, "none"]))
        assert hit.tolist() == [True] * 3000 + [False] and [packed.ids[a : a + k].tolist() for a, k in zip(at, n, strict=True)][:3000] == ids
        assert (np.diff(packed.hashes.astype(object)) > 0).all()
    assert pieces.Packed.of(pieces.entries(rows.limit(0), False), False).find(np.zeros(2, np.uint64))[0].tolist() == [False, False]


def test_portions(monkeypatch):
    monkeypatch.setattr(pieces, "PORTION", 10)
    texts = ["a" * 4, None, "b" * 30, "", "c" * 9, "d" * 2]
    assert [texts[x] for x in pieces.portions(texts)] == [["aaaa", None, "b" * 30], ["", "c" * 9, "dd"], []]
