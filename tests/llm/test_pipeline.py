"""The pipeline: each stage against its operator's brute force, and the whole on odd rows."""

import random
import re

import pytest
import sentencepiece
from pyspark.sql import functions as F
from samples import folder_of, sentence

import corpus_pipeline
from loomdex.llm import mixing, pieces, quality, secrets
from test_near_copies import groups_of, simhash_of


@pytest.fixture(scope="module")
def docs(spark, odd):
    rows = [(k, sentence(k, 60) + ".", "en", "ab"[k % 2], 0) for k in range(60)]
    rows += [(100 + k, rows[k][1] + (" " if k % 2 else ""), "en", "b", 0) for k in range(20)]
    rows += [(200 + k, sentence(300 + k, 40) + f' password = "hunter2hunter{k}" ' + sentence(400 + k), "en", "c", 0) for k in range(10)]
    return spark.createDataFrame(rows, odd.schema)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, int(k % 10 != 3), 0) for k in range(60)], "doc_id long, quality int, toxic int")


def test_stages_keep_columns(spark, docs, labels, odd, tmp_path):
    where = folder_of(tmp_path, labels=labels, documents=docs)
    for table in (docs, odd, odd.limit(0), docs.withColumn("score", F.lit("x")).withColumn("_key", F.lit(1)).withColumn("taken", F.lit(2))):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, table, where).columns == table.columns


def test_quality_stage(spark, docs, labels, tmp_path):
    where = folder_of(tmp_path, labels=labels)
    want = {r["doc_id"] for r in quality.score(docs, labels).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in corpus_pipeline.quality_classifier(spark, docs, where).collect()} == want


def test_dedup_stage(spark, docs, odd):
    for table in (docs, odd):
        rows = table.collect()
        root = groups_of([simhash_of(r["text"]) for r in rows])
        kept = corpus_pipeline.near_duplicates(spark, table, "").collect()
        assert len(kept) == len(set(root))
        for g in set(root):
            ids = [r["doc_id"] for r, h in zip(rows, root, strict=True) if h == g]
            first = min((i for i in ids if i is not None), default=None)
            assert sum(k["doc_id"] == first for k in kept) >= 1


def test_dedup_stage_by_similarity(spark, odd):
    """Groups are those of all pairs at a 5-word similarity of 0.8, near copies many bits apart included."""
    rng = random.Random(5)
    texts = []
    for k in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([6, 30, 120]))]
        for _ in range(rng.choice([1, 3, 25])):
            words = list(base)
            for _ in range(rng.choice([0, 1, 2, 3])):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    docs = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in enumerate(texts)], odd.schema)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    group = list(range(len(texts)))
    far = 0
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                far += (simhash_of(texts[i]) ^ simhash_of(texts[j])).bit_count() > 2
                group = [group[j] if g == group[i] else g for g in group]
    assert far > 10
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept == {min(i for i, h in enumerate(group) if h == g) for g in set(group)}


def test_dedup_stage_by_fingerprint(spark, odd):
    """Links of operator 4 count where the 5-word similarity is low, in chains with links by similarity too."""
    often, words = "a b c " * 200, [f"w{k}" for k in range(80)]
    texts = [often + " ".join(words), often + " ".join(words[:60] + [f"v{k}" for k in range(30)]), " ".join(words), " ".join(words[:79] + ["x"]), "else", often + " ".join(f"u{k}" for k in range(60))]
    prints = [simhash_of(t) for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for w in map(str.split, texts)]
    alike = lambda i, j: 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    linked = lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2
    assert linked(0, 1) and linked(0, 5) and not alike(0, 1) and not alike(0, 5) and not alike(1, 5) and alike(0, 2) and not linked(0, 2) and alike(2, 3)
    docs = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in enumerate(texts)], odd.schema)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [0, 4]


def test_secret_stage(spark, docs):
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in corpus_pipeline.secret_scan(spark, docs, "").collect():
        spans = secrets.find_spans(before[r["doc_id"]])
        want = before[r["doc_id"]]
        for s, e, _ in reversed(spans):
            want = want[:s] + "[SECRET]" + want[e:]
        assert r["text"] == want and r["n_chars"] == len(want) and secrets.find_spans(r["text"]) == []


def test_mix_stage(spark, docs):
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect() if r["taken"]}
    got = {}
    for r in corpus_pipeline.mix_sources(spark, docs, "").collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert got == taken


def test_encode_stage(spark, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in corpus_pipeline.sentencepiece(spark, docs, "").collect():
        assert list(r["ids"]) == library.encode(text[r["doc_id"]]) and r["n_tokens"] == len(r["ids"])


def test_run(spark, docs, labels, odd, tmp_path):
    out = corpus_pipeline.run(spark, folder_of(tmp_path / "a", documents=docs, labels=labels))
    assert out.columns == ["doc_id", "source", "n_tokens", "ids"] and out.count() > 40
    assert corpus_pipeline.run(spark, folder_of(tmp_path / "b", documents=odd, labels=labels)).count() > 0
    assert corpus_pipeline.run(spark, folder_of(tmp_path / "c", documents=odd.limit(0), labels=labels.limit(0))).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_duplicates", "secret_scan", "mix_sources", "sentencepiece"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_run_releases_heaps(spark, docs, labels, tmp_path):
    """Full collections, one a stage at least: no stage starts on a heap that the one before has grown."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = full()
    corpus_pipeline.run(spark, folder_of(tmp_path, documents=docs.limit(0), labels=labels.limit(0)))
    assert full() - before >= len(corpus_pipeline.STAGES)
