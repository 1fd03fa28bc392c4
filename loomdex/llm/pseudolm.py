"""Masked pseudo-likelihood scores from a bidirectional window network.

A word is predicted from the two words before and the two after it: their embeddings, a matrix
for each place, are joined and pass a hidden layer, which predicts the word's class and, within
the class, the word. The sum over a document of log P(word | both sides) is its pseudo
log-likelihood. Scoring masks each word in turn, and so does learning: every place of every
document is predicted once.

Words are counted over all documents. The VOCABULARY commonest are words of their own in the
network; the rest fall into SHAPES kinds by length and ending, which the network predicts like
words, and a word of a kind has the probability n / (all of the kind + 1) from the counts, so
that the probabilities of all words sum to one; the one more stands for all words that the
corpus hasn't. The counts grow with the corpus: the TIER commonest are broadcast as hashes with
numbers, 12 bytes each, and those beyond are joined to the documents that have them. A word that
occurs once needs no entry. Hashes have 64 bits; two words are taken for one with a chance of
about 1 in 10^19 a pair. Classes are runs of the vocabulary in order of frequency.

The network is trained in numpy by rounds of local steps. Documents are dealt to ROUNDS parts; in
each round, every task starts from the shared weights, takes mini-batch steps over its documents
of one part, and returns its weights with the number of words it saw; the weighted mean starts
the next round. There are LEARNERS tasks at most, so that each sees enough, however large the
corpus. Means are formed by aggregation over blocks of weights; the driver receives one set of
weights of fixed size a round.

Null and empty texts have no words and score 0; their mean is 0 too. Ties in word counts go to
the smaller word. Repeated rows count and score as they come. An empty table gives an empty
result. Input columns with the name of an output or of word_ids, rare, lacking or turn are replaced.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdex.llm.common import fresh, small_batches, stored, with_columns

VOCABULARY, SHAPES, CLASS = 3968, 128, 64
SIDE, EMBED, HIDDEN = 2, 12, 24
ROUNDS, LEARNERS, BATCH, RATE, MOST, CHUNK, HOLD = 4, 4096, 8192, 0.3, 2.0, 8192, 65536
FLUSH, MEMO, BLOCK, TIER = 400_000, 400_000, 4096, 4_000_000

WORDS = VOCABULARY + SHAPES
CLASSES = WORDS // CLASS
#: Rows of the embedding table: all words and, for places outside the text, one more.
OUTSIDE = WORDS
PARTS = {
    "embed": (WORDS + 1, EMBED),
    "hidden": (2 * SIDE * EMBED, HIDDEN),
    "hidden_bias": (HIDDEN,),
    # the last row holds biases
    "classes": (HIDDEN + 1, CLASSES),
    "members": (CLASSES, HIDDEN + 1, CLASS),
}
SIZE = sum(int(np.prod(s)) for s in PARTS.values())
_AROUND = [d for d in range(-SIDE, SIDE + 1) if d]
_ONES, _LEAST, _ALL = np.ones(CLASS, np.float32), 1e-38, slice(None)


def tokens_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct lower-cased words of texts, between blanks of any kind; for each word in turn its place among them; the number of words of each text."""
    parts = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    coded = parts.flatten().dictionary_encode()
    at, sizes = coded.indices.to_numpy(), pc.list_value_length(parts).to_numpy()
    if (empty := pc.index(coded.dictionary, "").as_py()) >= 0:  # blanks at either end leave one
        real = at != empty
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[real], minlength=len(sizes))
        at = at[real]
    return coded.dictionary, at, sizes


def shape_of(word: str) -> int:
    """The kind of a word that isn't in the vocabulary: its length up to 16 and a hash of its ending, of 8."""
    return (min(len(word), 16) - 1) * 8 + zlib.crc32(word[-2:].encode("utf-8", "surrogatepass")) % 8


def shapes_of(words: list[str]) -> np.ndarray:
    """shape_of each word; few endings are distinct."""
    each = pa.array(words, pa.string())
    ends = pc.utf8_slice_codeunits(each, -2).dictionary_encode()
    kinds = np.array([zlib.crc32(x.encode()) % 8 for x in ends.dictionary.to_pylist()], np.int64)
    return (np.minimum(pc.utf8_length(each).to_numpy(), 16) - 1) * 8 + (kinds[ends.indices.to_numpy()] if len(words) else 0)


def shape(word: Column) -> Column:
    """shape_of as an expression."""
    return ((F.least(F.length(word), F.lit(16)) - 1) * 8 + F.crc32(F.encode(F.right(word, F.lit(2)), "utf-8")) % 8).cast("int")


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, size in PARTS.items():
        n = int(np.prod(size))
        out[name] = flat[at : at + n].reshape(size)
        at += n
    return out


def start_weights(unigram: np.ndarray) -> np.ndarray:
    """Small random weights from a fixed seed; biases give the corpus's word shares."""
    rng = np.random.default_rng(42)
    flat = np.zeros(SIZE, np.float32)
    w = unpack(flat)
    w["embed"][:] = rng.normal(0, 0.3, PARTS["embed"])
    w["hidden"][:] = rng.normal(0, 1 / np.sqrt(2 * SIDE * EMBED), PARTS["hidden"])
    share = ((unigram + 1) / (unigram + 1).sum()).reshape(CLASSES, CLASS)
    w["classes"][-1] = np.log(share.sum(axis=1))
    w["members"][:, -1] = np.log(share / share.sum(axis=1, keepdims=True))
    return flat


def places(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts' ids with places outside between them, where the words stand in that, and whose they are."""
    who = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(ids)) + SIDE * (who + 1)
    flat = np.full(len(ids) + SIDE * (len(sizes) + 1), OUTSIDE, np.int16)
    flat[at] = ids
    return flat, at, who


def contexts(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The ids around places, SIDE before and SIDE after."""
    return flat[at[:, None] + np.array(_AROUND)]


def _forward(w: dict[str, np.ndarray], ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The joined embeddings, and the hidden layer with a column of ones for biases."""
    x = w["embed"][ctx.ravel()].reshape(len(ctx), -1)
    h = np.ones((len(ctx), HIDDEN + 1), x.dtype)
    np.tanh(x @ w["hidden"] + w["hidden_bias"], out=h[:, :HIDDEN])
    return x, h


def _safe(w: dict[str, np.ndarray]) -> bool:
    """Whether exponentials can't overflow: no hidden value is above 1."""
    return max(np.abs(w["classes"]).sum(axis=0).max(), np.abs(w["members"]).sum(axis=1).max()) < 80


def _exp(h: np.ndarray, weights: np.ndarray, safe: bool) -> tuple[np.ndarray, np.ndarray]:
    """exp of each row's scores, less the row's largest unless that is safe without, and the row sums."""
    z = h @ weights
    if not safe:
        z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    return z, z @ _ONES.astype(z.dtype, copy=False)


def _runs(cls: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(class, from, to) of the classes that sorted rows have."""
    edges = np.searchsorted(cls, np.arange(CLASSES + 1)).tolist()
    return ((c, edges[c], edges[c + 1]) for c in range(CLASSES) if edges[c] < edges[c + 1])


def log_probs(w: dict[str, np.ndarray], ctx: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log P(target | context), row by row; rows stand by class for the second softmax."""
    order, safe = np.argsort(target, kind="stable"), _safe(w)
    _, h = _forward(w, ctx[order])
    cls, member = np.divmod(target[order], CLASS)
    rows = np.arange(len(h))
    e, total = _exp(h, w["classes"], safe)
    share = e[rows, cls] / total
    for c, a, b in _runs(cls):
        e, total = _exp(h[a:b], w["members"][c], safe)
        share[a:b] *= e[rows[: b - a], member[a:b]] / total
    out = np.empty_like(share)
    out[order] = np.log(np.maximum(share, _LEAST))
    return out


def gradients(w: dict[str, np.ndarray], ctx: np.ndarray, target: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray | slice, np.ndarray, int | np.ndarray]]:
    """(weights, their rows, gradient of the summed negative log-probability, how many words it sums), given out one by one: weights may be changed in between."""
    order, safe = np.argsort(target, kind="stable"), _safe(w)
    ctx = ctx[order]
    x, h = _forward(w, ctx)
    cls, member = np.divmod(target[order], CLASS)
    rows = np.arange(len(h))
    # the slope of a softmax is e / total - 1 at the target; dividing what it is multiplied with costs less
    e, total = _exp(h, w["classes"], safe)
    e[rows, cls] -= total
    part = 1 / total[:, None]
    dh = (e @ w["classes"][:-1].T) * part
    yield w["classes"], _ALL, (h * part).T @ e, len(h)
    for c, a, b in _runs(cls):
        own, some = w["members"][c], h[a:b]
        e, total = _exp(some, own, safe)
        e[rows[: b - a], member[a:b]] -= total
        part = 1 / total[:, None]
        dh[a:b] += (e @ own[:-1].T) * part
        yield own, _ALL, (some * part).T @ e, b - a
    h = h[:, :HIDDEN]
    dz = dh * (1 - h * h)
    dx = dz @ w["hidden"].T
    yield w["hidden"], _ALL, x.T @ dz, len(h)
    yield w["hidden_bias"], _ALL, dz.sum(axis=0), len(h)
    flat = ctx.ravel()
    order = np.argsort(flat, kind="stable")
    ids = flat[order]
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    yield w["embed"], ids[first], np.add.reduceat(dx.reshape(-1, EMBED)[order], first, axis=0), np.diff(first, append=len(ids))[:, None]


def learn(w: dict[str, np.ndarray], ctx: np.ndarray, target: np.ndarray, rate: float) -> None:
    """One gradient step on a mini-batch, in place: each sum by the root of its number of words, but for large ones the mean by MOST at most."""
    for part, rows, g, n in gradients(w, ctx, target):
        part[rows] -= np.minimum(rate / np.sqrt(n), MOST / n).astype(np.float32) * g


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """(word, n) over all documents; partitions count first, and hand on what they have counted before it grows large."""
    small_batches(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for b in batches:
            words, at, _ = tokens_of(b.column(0))
            held.append(pa.table({"word": words, "n": np.bincount(at, minlength=len(words)).astype(np.int64)}))
            if sum(map(len, held)) > FLUSH:
                held = [_added(held)]
                if len(held[0]) > FLUSH // 2:
                    yield from held.pop().to_batches()
        if held:
            yield from _added(held).to_batches()

    return docs.select(text).mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _added(tables: list[pa.Table]) -> pa.Table:
    """The sums of n by word; words of no text are left out."""
    sums = pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])
    return sums.filter(pc.greater(sums.column("n"), 0)).combine_chunks()


class Counts:
    """How often rare words occur, by hash: those that are held, in sorted arrays."""

    def __init__(self, hashes: np.ndarray, n: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.n = hashes[order], n[order]

    def of(self, words: list[str]) -> np.ndarray:
        """Numbers of words; 1 for those that aren't held."""
        if not len(self.hashes):
            return np.ones(len(words), np.int64)
        h = np.fromiter((xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 42) for x in words), np.uint64, len(words)).view(np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.n[at], 1).astype(np.int64)


class PseudoLM:
    """Vocabulary, weights and what the kinds hold; pickled to the tasks, of fixed size."""

    def __init__(self, words: list[str], flat: np.ndarray, of_shape: np.ndarray):
        self.index = {w: i for i, w in enumerate(words)}
        self.flat, self.of_shape = flat, of_shape
        self.log_shape = np.log(of_shape + 1.0)

    def trained(self, flat: np.ndarray) -> PseudoLM:
        return PseudoLM(list(self.index), flat, self.of_shape)

    def scores(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Summed log-probabilities of texts' ids, some places at a time."""
        w = unpack(self.flat)
        flat, at, who = places(ids, sizes)
        each = np.zeros(len(at))
        for k in range(0, len(at), CHUNK):
            some = at[k : k + CHUNK]
            each[k : k + CHUNK] = log_probs(w, contexts(flat, some), flat[some])
        return np.bincount(who, each, len(sizes))


class Encoder:
    """Turns texts into ids and what the counts say of their rare words."""

    def __init__(self, lm: PseudoLM, counts: Counts):
        self.lm, self.counts, self.memo = lm, counts, {}

    def __getstate__(self) -> dict:
        return {"lm": self.lm, "counts": self.counts, "memo": {}}

    def codes(self, words: list[str]) -> np.ndarray:
        """For each of distinct words its id and, above it, for rare words how often they occur."""
        if len(self.memo) > MEMO:
            self.memo = {}
        if not self.memo:
            self.memo.update(self.lm.index)
        known = list(map(self.memo.get, words))
        if new := [k for k, code in enumerate(known) if code is None]:
            rare = [words[k] for k in new]
            codes = (VOCABULARY + shapes_of(rare) + WORDS * self.counts.of(rare)).tolist()
            self.memo.update(zip(rare, codes, strict=True))
            for k, code in zip(new, codes, strict=True):
                known[k] = code
        return np.array(known, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
        """All ids, the number of words and the summed log P(word | kind) of each text; the distinct words, whether their counts are held, and which one each word is."""
        words, at, sizes = tokens_of(texts)
        codes = self.codes(words.to_pylist())
        n, ids = np.divmod(codes, WORDS)
        weight = np.where(n > 0, np.log(np.maximum(n, 1)) - self.lm.log_shape[np.maximum(ids - VOCABULARY, 0)], 0.0)
        sums = np.concatenate([[0.0], np.cumsum(weight[at])])
        edges = np.concatenate([[0], np.cumsum(sizes)])
        return ids.astype("<u2")[at], sizes, sums[edges[1:]] - sums[edges[:-1]], (words, n != 1, at)


def counted(docs: DataFrame, text: str = "text", tier: int = TIER) -> tuple[PseudoLM, Counts, DataFrame | None]:
    """An untrained network over the words of all documents, the counts of rare words, and a table (h, n) of those that the counts leave out."""
    counts = stored(count_words(docs, text))
    top = counts.orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()
    words = [r["word"] for r in top]
    of_shape = np.zeros(SHAPES)
    for r in counts.groupBy(shape(F.col("word")).alias("s")).agg(F.sum("n").alias("n")).collect():
        of_shape[r["s"]] = r["n"]
    for r in top:
        of_shape[shape_of(r["word"])] -= r["n"]
    unigram = np.concatenate([[r["n"] for r in top], np.zeros(VOCABULARY - len(top)), of_shape])
    lm = PseudoLM(words, start_weights(unigram), of_shape)
    # no rarer word than the last of the vocabulary is in it; words of its number may be, and aren't looked up
    rare = counts.where((F.col("n") > 1) & (F.col("n") <= (top[-1]["n"] if top else 0))).select(F.xxhash64("word").alias("h"), "n")
    total = rare.count()
    if total <= tier:
        held, rest = rare, None
    else:
        ranked = stored(rare.orderBy(F.desc("n"), "h"))
        held = ranked.orderBy(F.desc("n"), "h").limit(tier)
        least = held.agg(F.min(F.struct("n", (-F.col("h")).alias("h"))).alias("x")).first()["x"]  # ties at the edge go to the smaller hash
        rest = ranked if least is None else ranked.where((F.col("n") < least["n"]) | (F.col("n") == least["n"]) & (F.col("h") > -least["h"]))
    got = held.select("h", F.least("n", F.lit((1 << 31) - 1)).cast("int").alias("n")).toArrow()
    return lm, Counts(got.column(0).to_numpy(), got.column(1).to_numpy()), rest


def with_ids(docs: DataFrame, lm: PseudoLM, counts: Counts, rest: DataFrame | None = None, text: str = "text") -> DataFrame:
    """docs with word_ids, little-endian 16-bit integers, rare, the summed log P(word | kind), and turn, the round that learns from them."""
    shared = docs.sparkSession.sparkContext.broadcast(Encoder(lm, counts))
    turns = {"next": 0}  # of a task
    fields = [T.StructField("word_ids", T.BinaryType()), T.StructField("rare", T.DoubleType()), T.StructField("turn", T.IntegerType())]
    more = [T.StructField("lacking", T.ArrayType(T.LongType()))] if rest is not None else []

    def made(texts: pa.Array) -> list[pa.Array]:
        ids, sizes, rare, (words, held, at) = shared.value.encode(texts)
        turn = (turns["next"] + np.arange(len(sizes))) % ROUNDS
        turns["next"] = (turns["next"] + len(sizes)) % ROUNDS
        edges = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        out = [pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(2 * edges), pa.py_buffer(ids)]), pa.array(rare), pa.array(turn.astype(np.int32))]
        if more:
            hashes = np.array([xxhash.xxh64_intdigest(x.encode(), 42) for x in words.to_pylist()], np.uint64).view(np.int64)
            out.append(pa.array([hashes[x[~held[x]]] for x in np.split(at, edges[1:-1])] if len(sizes) else [], pa.list_(pa.int64())))
        return out

    encoded = with_columns(docs, [text], [*fields, *more], made)
    if rest is None:
        return encoded
    row, add = fresh(encoded, "_row", "_add")
    encoded = stored(encoded.withColumn(row, F.monotonically_increasing_id()))
    found = encoded.select(row, F.explode("lacking").alias("h")).join(rest, "h").groupBy(row).agg(F.sum(F.log("n")).alias(add))
    return encoded.join(found, row, "left").withColumn("rare", F.col("rare") + F.coalesce(add, F.lit(0.0))).drop(row, add, "lacking")


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of word_ids, and how many are of each text."""
    each = column.to_pylist()
    return np.frombuffer(b"".join(each), "<u2"), np.array([len(b) // 2 for b in each], np.int64)


def train(encoded: DataFrame, lm: PseudoLM, rate: float = RATE, batch: int = BATCH) -> PseudoLM:
    """The network learned from all documents' ids, each place once."""
    for turn in range(ROUNDS):
        lm = lm.trained(_round(encoded.where(F.col("turn") == turn), lm, rate / (1 + turn / 2), batch))
    return lm


def _round(encoded: DataFrame, lm: PseudoLM, rate: float, batch: int) -> np.ndarray:
    shared = encoded.sparkSession.sparkContext.broadcast(lm.flat)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = np.zeros(-(-SIZE // BLOCK) * BLOCK, np.float32)
        values[:SIZE] = shared.value
        w = unpack(values[:SIZE])
        seen, held = 0, []

        def step() -> int:
            flat, at, _ = places(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            for k in range(0, len(at), batch):
                learn(w, contexts(flat, at[k : k + batch]), flat[at[k : k + batch]], rate)
            return len(at)

        for b in batches:
            held.append(_ids(b.column(0)))
            if sum(len(ids) for ids, _ in held) >= HOLD:
                seen += step()
        if held:
            seen += step()
        if seen:
            blocks = (values * seen).reshape(-1, BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([seen] * len(blocks), pa.int64()), pa.array([x.tobytes() for x in blocks], pa.binary())], names=["block", "n", "part"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, seen, part in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                n[k] += seen
                sums[k] = sums.get(k, 0) + np.frombuffer(part, np.float32).astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([n[k] for k in sums], pa.int64()), pa.array([(s / n[k]).astype(np.float32).tobytes() for k, s in sums.items()], pa.binary())], names=["block", "n", "part"])

    schema = "block int, n long, part binary"
    parts = encoded.select("word_ids").coalesce(LEARNERS).mapInArrow(local, schema).repartition("block").mapInArrow(added, schema).collect()
    out = np.zeros(-(-SIZE // BLOCK) * BLOCK, np.float32)
    for r in parts:
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["part"], np.float32)
    return out[:SIZE] if parts else lm.flat


def score(encoded: DataFrame, lm: PseudoLM) -> DataFrame:
    """encoded with n_words, log_likelihood (a sum) and mean_log_prob."""
    shared = encoded.sparkSession.sparkContext.broadcast(lm)

    def scored(column: pa.Array, rare: pa.Array) -> list[pa.Array]:
        ids, n = _ids(column)
        total = shared.value.scores(ids, n) + rare.to_numpy(zero_copy_only=False)
        return [pa.array(n), pa.array(total), pa.array(total / np.maximum(n, 1))]

    return with_columns(encoded, ["word_ids", "rare"], [T.StructField("n_words", T.LongType()), T.StructField("log_likelihood", T.DoubleType()), T.StructField("mean_log_prob", T.DoubleType())], scored)


def pseudo_likelihood(docs: DataFrame, text: str = "text", tier: int = TIER) -> DataFrame:
    """docs, less their text, with scores by a network learned from themselves. Texts are read twice: to count words, and to turn them into ids, which are kept in shared storage."""
    lm, counts, rest = counted(docs, text, tier)
    encoded = stored(with_ids(docs, lm, counts, rest, text).drop(text))
    return score(encoded, train(encoded, lm)).drop("word_ids", "rare", "turn")
