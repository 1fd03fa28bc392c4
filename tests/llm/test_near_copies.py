"""SimHash groups, components, order MinHash, WARC: against brute force and on odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomdex.llm import jaccard, ordermin, queries, simhash, warc
from loomdex.llm.components import connected_components


def simhash_of(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(prints, most=2):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= most:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_fingerprints(spark, odd, odd_rows):
    got = sorted((r["doc_id"] or -1, r["fp"] % (1 << 64)) for r in simhash.near_duplicates(odd).collect())
    assert got == sorted((r[0] or -1, simhash_of(r[1])) for r in odd_rows)
    same = spark.createDataFrame([("a b c",)], "t string").select(F.xxhash64("t")).first()[0] % (1 << 64)
    assert same == xxhash.xxh64_intdigest(b"a b c", 42)


def test_odd_components(odd, odd_rows, none):
    rows = simhash.near_duplicates(odd).collect()
    prints = [r["fp"] for r in rows]
    root = groups_of([p % (1 << 64) for p in prints])
    for r, g in zip(rows, root, strict=True):
        ids = [x["doc_id"] for x, h in zip(rows, root, strict=True) if h == g and x["doc_id"] is not None]
        assert r["component_id"] == min(ids, default=None)
    assert len(rows) == len(odd_rows) and simhash.near_duplicates(none).count() == 0
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns and kept.count() == len(set(root)) and simhash.one_of_each(none).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_links_against_all_pairs(spark, seed):
    """Clustered fingerprints, crowded cells included: groups are those of all pairs."""
    rng = random.Random(seed)
    prints = set()
    for _ in range(12):
        center = rng.getrandbits(64)
        for _ in range(rng.choice([1, 4, 40])):
            p = center
            for _ in range(rng.randint(0, 5)):
                p ^= 1 << rng.randrange(64)
            prints.add(p)
    prints |= {0, (1 << 64) - 1, 1, 3, 7}
    prints = sorted(prints)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long").withColumn("cell", simhash.cell_of(F.col("fp")))
    for r in df.collect():
        assert r["cell"] == sum((r["fp"] >> (4 * s) & 15).bit_count() << (4 * s) for s in range(16))
    edges = simhash.links(df)
    for r in edges.collect():
        assert (r["a"] ^ r["b"]).bit_count() <= 2 or ((r["a"] ^ r["b"]) % (1 << 64)).bit_count() <= 2
    label = {r["node"] % (1 << 64): r["component"] for r in connected_components(edges).collect()}
    root = groups_of(prints)
    for i, p in enumerate(prints):
        for j in range(i):
            same = label.get(p, p) == label.get(prints[j], prints[j])
            assert same == (root[i] == root[j])


def test_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 60)] + [(5000, 5000)]
    got = {}
    for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect():
        got.setdefault(r["component"], set()).add(r["node"])
    assert sorted(map(len, got.values())) == [60, 201]
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def sketch_by_hand(text, components=32):
    """Order MinHash by its definition: in each order all numbered k-mers are ranked, and the two first put back in text order."""
    mask = (1 << 64) - 1
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    of_long = lambda x, seed=42: xxhash.xxh64_intdigest((x & mask).to_bytes(8, "little"), seed)
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if not words:
        return (0,) * components
    each = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    pair = lambda a, b: of_long(b, of_long(a))
    if len(words) < 3:
        h = 42
        for x in each:
            h = of_long(x, h)
        kmers = [h]
    else:
        kmers = [pair(pair(a, b), c) for a, b, c in zip(each, each[1:], each[2:])]
    high = lambda h: (h >> 1 & ((1 << 63) - 1)) >> 24
    seen, numbered = {}, []
    for place, h in enumerate(map(high, kmers)):
        n = seen[h] = seen.get(h, -1) + 1
        if n:
            h = high(xxhash.xxh64_intdigest(n.to_bytes(4, "little"), of_long(h)))
        numbered.append((h, place))
    out = []
    for j in range(components):
        start = j * ((1 << 63) // components) >> 24
        first = sorted(numbered, key=lambda x: ((x[0] - start) % (1 << 39), x[1]))[:2]
        h = 42
        for x, _ in sorted(first, key=lambda x: x[1]):
            h = of_long(x, h)
        out.append(h & 0x7FFFFFFF)
    assert all(isinstance(signed(x), int) for x in out)
    return tuple(out)


def test_sketch_by_hand(spark):
    """The fingerprint is the one that ranking every k-mer in every order gives, repeats and short texts included."""
    rng = random.Random(3)
    texts = ["", None, " ", "a", "a b", "a b c", "a b c " * 9, "x " * 40] + [" ".join(rng.choice("abcdef") for _ in range(rng.randint(3, 60))) for _ in range(60)] + [" ".join(f"w{rng.randrange(500)}" for _ in range(900)) for _ in range(4)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumns({"_m": F.lit(1), "_s": F.lit("y"), "_w": F.lit(2)})
    rows = ordermin.add_sketch(df, "text", "s").collect()
    assert all((r["_m"], r["_s"], r["_w"]) == (1, "y", 2) for r in rows)
    for r in rows:
        assert tuple(r["s"]) == sketch_by_hand(texts[r["i"]]), texts[r["i"]]
    assert ordermin.add_sketch(df.limit(0), "text", "s").count() == 0


def test_next_keeps_columns(spark):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (None, "n"), (2, "b"), (2, "b2")], "id long, t string").withColumns({"_block": F.lit(7), "_cuts": F.lit(8), "_to": F.lit(9)})
    got = [tuple(r) for r in ordermin.with_next(df, "id", ["t"]).orderBy(F.col("id").asc_nulls_first(), "t").collect()]
    assert got == [(None, "n", 7, 8, 9, "a"), (1, "a", 7, 8, 9, "b"), (2, "b", 7, 8, 9, "b2"), (2, "b2", 7, 8, 9, "c"), (3, "c", 7, 8, 9, "n")]


def test_order_matters(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join(words[200:] + words[:200]), " ".join(words[:390] + ["x"] * 10), " ".join(f"v{i}" for i in range(400))]
    df = ordermin.add_sketch(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "text", "s")
    s = {r["i"]: r["s"] for r in df.collect()}
    like = lambda a, b: sum(x == y for x, y in zip(s[a], s[b], strict=True)) / len(s[a])
    assert like(0, 0) == 1 and like(0, 3) == 0 and like(0, 2) > 0.7 and 0.2 < like(0, 1) < 0.9


def test_all_of_a_text_counts(spark):
    """Half of a long text is as like as its k-mers are: both of the least of all are in it a quarter of the time."""
    texts = [" ".join(f"{k}w{i}" for i in range(n)) for k in range(20) for n in (3000, 6000)]
    df = ordermin.add_sketch(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "text", "s")
    s = {r["i"]: r["s"] for r in df.collect()}
    same = sum(x == y for k in range(0, 40, 2) for x, y in zip(s[k], s[k + 1], strict=True))
    assert 0.18 < same / 640 < 0.32


def test_repeats_are_numbered(spark):
    texts = ["a b c " * 3, "a b c " * 30, "a b c", "", None, "  a\tb \n c ", "x y"]
    df = ordermin.add_sketch(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "text", "s")
    s = {r["i"]: tuple(r["s"]) for r in df.collect()}
    assert s[0] != s[1] != s[2] and s[2] == s[5] and s[3] == s[4] == (0,) * 32 and any(s[6])


def edited(rows):
    """(doc_id, edited text) of rows in order."""
    for (d, t), (_, n) in zip(rows, [*rows[1:], rows[0]], strict=True):
        half = len(t) // 2
        yield d, t[: len(t) - half] + n[:half]


@pytest.mark.parametrize("n", [1, 2, 57])
def test_op7(spark, tmp_path, n):
    rng = random.Random(n)
    rows = [(k * k - 5, "".join(rng.choice("ab c\n🙂") for _ in range(rng.choice([0, 1, 9, 300])))) for k in rng.sample(range(1000), n)]
    spark.createDataFrame([*rows, (10**6, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op7_order_minhash(spark, str(tmp_path)).collect()}
    full = sorted(rows) + [(10**6, "")]
    assert len(got) == len(full)
    for (d, t), (_, e) in zip(full, edited(full), strict=True):
        assert got[d]["n_chars"] == len(t) and got[d]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert (got[d]["near_edited"] == 1) == (got[d]["fingerprint"] == got[d]["edited_fingerprint"])
    order = [d for d, _ in full]
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        f, g = got[a]["fingerprint"], got[b]["fingerprint"]
        assert got[a]["near_next"] == sum(f[i : i + 8] == g[i : i + 8] for i in range(0, 256, 8)) / 32


def test_op7_odd(spark, odd, none, tmp_path):
    odd.write.parquet(f"{tmp_path}/a/documents.parquet")
    none.write.parquet(f"{tmp_path}/b/documents.parquet")
    assert queries.op7_order_minhash(spark, f"{tmp_path}/a").count() == odd.count()
    assert queries.op7_order_minhash(spark, f"{tmp_path}/b").count() == 0


def test_warc(spark, tmp_path):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    big = "<p>é漢</p>" * 200
    pages = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, None), (4, "u", "x" * 999), (5, "u", "x" * 999), (6, "u\r\nX: y", fake * 3 + big), (7, "u", "WARC/"), (8, "u", "tail WARC/1.1\r\n"), (9, "u", big), (None, "u", big), (10, "u", fake), (11, "u", "WARC/1.1\r\nContent-Length: 99999999999999999999\r\n\r\n"), (2, "http://a/2", big), (9, "u", big)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(((r["page_id"] or -1, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in queries.op6_warc(spark, str(tmp_path)).collect()), key=repr)
    want = []
    for p, _, h in pages:
        b = (h or "").encode()
        again = b == big.encode() and p != 9
        want.append((p or -1, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", 9 if again else None))
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("split", [64, 700, 10**6])
def test_warc_splits(spark, tmp_path, split):
    """Uncompressed archives cut at any place give the same records."""
    body = "x" * 50 + "WARC/1.0\r\nContent-Length: 5\r\n\r\n12345\r\n\r\n" + "y" * 30
    one = lambda i, payload: f"WARC/1.{i % 2}\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {len(payload.encode())}\r\n\r\n{payload}\r\n\r\n".encode()
    for k in range(2):
        (tmp_path / f"{k}.warc").write_bytes(b"".join(one(i, body * (i % 3)) for i in range(k * 20, k * 20 + 20)))
    (tmp_path / "cut.warc").write_bytes(one(100, "fine") + one(101, "z" * 50)[:-30])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        got = {r["id"]: bytes(r["block"]).decode() for r in warc.read_warc(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {f"<urn:page:{i}>": body * (i % 3) for i in range(40)} | {"<urn:page:100>": "fine"}


def test_warc_is_scanned_once(spark, tmp_path):
    """Records are whole where files are dealt to partitions otherwise after the chain is known."""
    for k in range(6):
        one = [f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{k}-{i}>\r\nContent-Length: {k + 200}\r\n\r\n{str(k) * (k + 200)}\r\n\r\n" for i in range(3)]
        (tmp_path / f"{k}.warc").write_text("".join(one), newline="")
    key = "spark.sql.files.openCostInBytes"
    old = spark.conf.get(key)
    read = warc.read_warc(spark, str(tmp_path))
    spark.conf.set(key, "128m")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        got = {r["id"]: bytes(r["block"]).decode() for r in read.collect()}
    finally:
        spark.conf.set(key, old)
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert got == {f"<urn:page:{k}-{i}>": str(k) * (k + 200) for k in range(6) for i in range(3)}


def test_no_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert queries.op6_warc(spark, str(tmp_path)).count() == 0


def test_parities_bound_the_difference(spark):
    """Folded parities never differ in more bits than the sets in members, also where one has twice as many kinds."""
    rng = np.random.default_rng(5)
    rows, want = [], []
    for k in range(60):
        n = int(rng.integers(200, 1200))
        a = np.unique(rng.integers(-(2**62), 2**62, n))
        keep = rng.random(len(a)) < rng.choice([0.8, 0.9, 1.0])
        b = np.unique(np.concatenate([a[keep], rng.integers(-(2**62), 2**62, int(rng.integers(0, n // 5)))]))
        if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
            continue
        rows.append((k, *(np.frombuffer(jaccard.parity(x), np.int64).tolist() for x in (a, b))))
        want.append(len(np.setxor1d(a, b)))
    df = spark.createDataFrame(rows, "k int, x array<long>, y array<long>")
    m = F.least(F.size("x"), F.size("y"))
    bits = F.zip_with(jaccard._folded(F.col("x"), m), jaccard._folded(F.col("y"), m), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    got = [r["n"] for r in df.select(F.aggregate(bits, F.lit(0), lambda n, x: n + x).alias("n")).collect()]
    assert any(len(r[1]) != len(r[2]) for r in rows) and all(g <= w and (g > 0 or w == 0) for g, w in zip(got, want, strict=True))


def test_similar_long_texts(spark):
    """Groups of texts of hundreds of words are those that all pairs of a similarity of 0.8 or more connect."""
    rng = random.Random(8)
    texts = []
    for g in range(12):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.randint(60, 600))]
        for _ in range(6):
            words = list(base)
            for _ in range(rng.randint(0, len(base) // 30)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(words[: rng.randint(int(len(words) * 0.85), len(words))]))
    sets = [set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                root[find(i)] = find(j)
    got = {r["doc_id"]: r["component"] for r in jaccard.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len({find(i) for i in range(len(texts))}) == len(set(got.values())) and 12 < len(set(got.values())) < len(texts)
    for i in range(len(texts)):
        for j in range(i):
            assert (got[i] == got[j]) == (find(i) == find(j))


def test_common_members_of_larger_tables(spark, monkeypatch):
    """A passage that one text in twenty has is known to be common, however many texts a fixed sample would leave out."""
    monkeypatch.setattr(jaccard, "SAMPLE", 20)
    passages = [" ".join(f"p{k}w{i}" for i in range(12)) for k in range(20)]
    texts = [f"{passages[k % 20]} " + " ".join(f"t{k}w{i}" for i in range(10)) for k in range(800)]
    members, often = jaccard.common(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert list(members) == sorted(members) and len(members) == len(often) and min(often) >= jaccard.LEAST
    assert sum(set(jaccard.shingles(p.encode()).tolist()) <= set(members.tolist()) for p in passages) >= 18


def test_common_members_are_bounded(spark, monkeypatch):
    """The dictionary holds the commonest members, all of a frequency or none."""
    monkeypatch.setattr(jaccard, "COMMON", 10)
    texts = [" ".join(f"p{k}w{i}" for i in range(8)) for k, n in enumerate([9, 7, 5, 5]) for _ in range(n)]
    members, often = jaccard.common(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert sorted(often.tolist()) == [7] * 4 + [9] * 4


def test_rows_of_texts_with_a_passage(spark, monkeypatch):
    """Three long texts that share half of their members, and no two of them alike, meet by one member, not by each."""
    none = np.zeros(0, np.int64)
    monkeypatch.setattr(jaccard, "common", lambda docs: (none, none))
    made, pairs = [], jaccard._pairs
    monkeypatch.setattr(jaccard, "_pairs", lambda met: made.append(met.select("x", "y").count()) or pairs(met))
    texts = []
    for g in range(4):
        passage = [f"p{g}w{i}" for i in range(600)]
        texts += [" ".join(passage + [f"t{g}x{k}w{i}" for i in range(700)]) for k in range(3)]
    texts += [f"{t} more" for t in texts[:2]]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {k: k - 12 if k > 11 else k for k in range(14)}
    assert 4 * 4 <= made[1] < 200
