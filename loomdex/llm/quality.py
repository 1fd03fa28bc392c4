"""Positive-unlabelled quality classifier.

Trusted positives are the texts labelled good; all documents, whatever their label, are the
unlabelled sample of the web text. With the class prior p and a margin g(x), the classifier
minimises the non-negative unbiased risk

    p * E_P[loss(g)] + max(0, E_U[loss(-g)] - p * E_P[loss(-g)])

with the squared loss (1 - g)^2 / 4, for which only the first and second moments of the
features over P and U matter. One pass over all documents gathers them, so nothing is sampled
and the driver holds two matrices of fixed size. The score is a logistic curve over the margin,
whose middle minimises the same risk with the sigmoid loss, over histograms of the margin in P
and U.

The class prior is estimated from P and U alone; no label of a bad text is read. P is halved by a
hash of ids. A margin learned with one half and U is taken of U and of the other half, which it
hasn't seen. As U is p parts P and the rest something else, the share of U above any margin is at
least p times that of P, so the least ratio of the two bounds p from above; it is taken where
sampling errors blur it least, and the halves' mean is the estimate.

Features are shares of byte classes, punctuation, hashed byte pairs, word shapes and repeats in
the whole text; labels, language, source and ids are never among them. They are written once
to shared storage, half a kilobyte a document, and are what the moments and the scores read.

Labels of null, of ids that no document has, or outside the fold are ignored; an id labelled both
ways counts as good if half of its labels say so. Without any positive, every score is 0.5. Null
and empty texts are scored like any other. Rows that repeat are scored alike. An empty table
gives an empty result. accepted() keeps all columns, whatever their names.
"""

from __future__ import annotations

import operator
import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdex.llm.common import fresh, stored, with_columns

PAIRS = 128
RIDGE, BINS = 1e-3, 2048
#: Chance that sampling errors exceed what the choice of a margin for the prior allows; the prior before it is estimated, and its bounds.
DOUBT, FIRST_PRIOR, PRIORS = 0.1, 0.5, (0.01, 0.99)
#: Steepness of the loss that finds the dividing margin, of the score's curve, and the risk that counts as equal.
SHARP, STEEP, SLACK = 32.0, 6.0, 2e-3
_PUNCT = np.frombuffer(string.punctuation.encode(), np.uint8)
WIDTH = 2 * len(_PUNCT) + PAIRS + 31
TASKS, GROUPS = 4096, 16


def features(raw: bytes | None) -> np.ndarray:
    """The features of a UTF-8 text."""
    raw = raw or b""
    b = np.frombuffer(raw, np.uint8)
    n = max(len(b), 1)
    counts = np.bincount(b, minlength=256)
    words = raw.split()
    w = max(len(words), 1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    per_word = counts[_PUNCT] / (w + 1)
    upper, digits, high, newline = counts[65:91].sum(), counts[48:58].sum(), counts[128:].sum(), counts[10]
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    again = sum(map(operator.eq, words, words[1:])) / w
    bars = counts[124] / w
    shapes = [
        np.tanh(2 * again),
        min(1.0, 10 * again),
        np.sqrt(again),
        np.sqrt(min(1.0, bars)),
        np.log1p(len(b)) / 10,
        np.log1p(len(words)) / 8,
        np.tanh(sizes.mean() / 8),
        np.tanh(sizes.std() / 6),
        np.tanh(sizes.max() / 40),
        len(set(words)) / w,
        len(set(lines)) / max(len(lines), 1),
        np.tanh(len(lines) / w * 10),
        np.tanh(upper / n * 5),
        min(1.0, upper / n * 40),
        np.tanh(digits / n * 10),
        min(1.0, digits / n * 100),
        np.tanh(high / n * 5),
        min(1.0, newline / w * 20),
        sum(x.isupper() for x in words) / w,
        sum(x.isalpha() for x in words) / w,
        sum(x.istitle() for x in words) / w,
        sum(len(x) == 1 for x in words) / w,
        sum(len(x) > 20 for x in words) / w,
        np.exp(-len(words) / 3),
        np.exp(-len(words) / 8),
        np.exp(-len(words) / 20),
        float(len(words) < 20),
        float(len(words) < 60),
        np.tanh(per_word.sum()),
        min(1.0, per_word.sum()),
        1.0,
    ]
    pairs = np.bincount((b[:-1].astype(np.int64) * 257 + b[1:]) * 40503 % 65521 % PAIRS, minlength=PAIRS) / (n + 60) if len(b) > 1 else np.zeros(PAIRS)
    return np.concatenate([np.tanh(4 * per_word), np.minimum(1, 30 * per_word), np.sqrt(pairs), shapes])


def _rows(texts: pa.Array) -> np.ndarray:
    """Features of texts, rounded as they are stored."""
    raw = texts.cast(pa.binary()).to_pylist()
    return np.stack([features(t) for t in raw]).astype("<f2").astype(np.float64) if raw else np.zeros((0, WIDTH))


def with_features(df: DataFrame, text: str = "text", out: str = "features") -> DataFrame:
    """df with the features as little-endian 16-bit floats."""

    def made(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([features(t).astype("<f2").tobytes() for t in texts.cast(pa.binary()).to_pylist()], pa.binary())]

    return with_columns(df, [text], [T.StructField(out, T.BinaryType())], made)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f2").reshape(-1, WIDTH).astype(np.float64)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts, sums and products of features over rows of kind 0 and of kind 1, a row for each task."""
    parts = np.zeros((2, WIDTH + 1, WIDTH))
    n = np.zeros(2)
    for b in batches:
        x, kind = _matrix(b.column(0)), b.column(1).to_numpy()
        for k in (0, 1):
            rows = x[kind == k]
            if len(rows):
                parts[k, 0] += rows.sum(axis=0)
                parts[k, 1:] += rows.T @ rows
                n[k] += len(rows)
    yield pa.RecordBatch.from_arrays([pa.array([n.tobytes()], pa.binary()), pa.array([parts.tobytes()], pa.binary())], names=["n", "parts"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = [None, None]
    for b in batches:
        for k in (0, 1):
            for x in b.column(k).to_pylist():
                total[k] = np.frombuffer(x) + (0 if total[k] is None else total[k])
    if total[0] is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in total], names=["n", "parts"])


def _gathered(rows: DataFrame, fn: Callable) -> tuple[np.ndarray, np.ndarray]:
    """The sums over all tasks, TASKS at most, of the two arrays that fn yields in each; added up in GROUPS tasks before the driver sees them."""
    schema = "n binary, parts binary"
    sums = rows.coalesce(TASKS).mapInArrow(fn, schema).repartition(GROUPS).mapInArrow(_summed, schema).collect()
    if not sums:
        return np.zeros(0), np.zeros(0)
    return sum(np.frombuffer(r["n"]) for r in sums), sum(np.frombuffer(r["parts"]) for r in sums)


def fit(n: np.ndarray, parts: np.ndarray, prior: float) -> np.ndarray | None:
    """Weights of the margin from the moments; the last feature is 1."""
    if not n[1]:
        return None
    (mu, mp), (su, sp) = (parts[k, 0] / n[k] for k in (0, 1)), (parts[k, 1:] / n[k] for k in (0, 1))
    scale = np.sqrt(np.maximum(np.diag(su) - mu**2, 1e-6))
    scale[-1] = 1
    mu, mp, su, sp = mu / scale, mp / scale, su / np.outer(scale, scale), sp / np.outer(scale, scale)
    ridge = (RIDGE + 0.02 * WIDTH / n[1]) * np.eye(WIDTH)  # few positives fit loosely
    ridge[-1, -1] = 1e-9

    def bracket(w: np.ndarray) -> float:
        return (1 + 2 * mu @ w + w @ su @ w) / 4 - prior * (1 + 2 * mp @ w + w @ sp @ w) / 4

    def solved(share: float) -> np.ndarray:
        """The minimum of the positive part plus a share of the bracket: a linear system."""
        return np.linalg.solve(prior * (1 - share) * sp + share * su + ridge, prior * (1 + share) * mp - share * mu)

    w = solved(1.0)
    if bracket(w) < 0:  # overfitted: at the clamped risk's minimum the bracket is zero, with a share between 0 and 1
        low, high = 0.0, 1.0
        for _ in range(40):
            mid = (low + high) / 2
            low, high = (mid, high) if bracket(solved(mid)) >= 0 else (low, mid)
        w = solved(low)
    return w / scale


def estimated_prior(u: np.ndarray, p: np.ndarray) -> float:
    """The class prior from counts of unlabelled and of unseen positive rows in equal bins of the margin."""
    above = lambda x: np.cumsum(x[::-1]) / x.sum()
    blur = np.sqrt(np.log(4 / DOUBT) / 2) * (u.sum() ** -0.5 + p.sum() ** -0.5)
    share_u, share_p = above(u), above(p)
    ratio, error = (np.divide(x, share_p, out=np.full(len(p), np.inf), where=share_p > 0) for x in (share_u, np.full(len(p), blur)))
    return float(ratio[np.argmin(ratio + error)])


def calibrate(u: np.ndarray, p: np.ndarray, prior: float) -> float:
    """The margin at which to divide, by the same risk with the sigmoid loss, which is bounded.

    u and p count unlabelled and positive rows in equal bins of the margin from -2 to 2. Of
    places that are as good, as in a gap between the classes, one on the lower side is taken, which
    keeps more.
    """
    at = (np.arange(BINS) + 0.5) / BINS * 4 - 2
    u, p = u / u.sum(), p / p.sum()
    places = np.linspace(-1, 1, 401)
    risks = []
    for middle in places:
        good = 1 / (1 + np.exp(-np.clip(SHARP * (at - middle), -50, 50)))
        risks.append(prior * p @ (1 - good) + max(0.0, u @ good - prior * p @ good))
    risks = np.array(risks)
    return float(np.quantile(places[risks <= risks.min() + SLACK], 0.25))


def in_fold(doc_id: Column) -> Column:
    """Whether a row is held out from learning: crc32 of the id as text leaves 1 modulo 3; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


class Model:
    """Weights of the margin and the curve over it; without weights every score is 0.5."""

    def __init__(self, weights: np.ndarray | None, middle: float = 0.0, prior: float | None = None):
        self.weights, self.middle, self.prior = weights, middle, prior

    def scores(self, x: np.ndarray) -> list[pa.Array]:
        s = np.full(len(x), 0.5) if self.weights is None else 1 / (1 + np.exp(-np.clip(STEEP * (x @ self.weights - self.middle), -50, 50)))
        return [pa.array(s), pa.array((s >= 0.5).astype(np.int32))]


SCORES = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]


def _histograms(weights: list[np.ndarray]) -> Callable:
    """Counts of rows by bins of the margin: for each weights, those of kind 0 and of kind 1."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = np.zeros((len(weights), 2, BINS))
        for b in batches:
            x, kind = _matrix(b.column(0)), b.column(1).to_numpy()
            for k, w in enumerate(weights):
                at = np.clip((x @ w + 2) / 4 * BINS, 0, BINS - 1).astype(np.int64)
                for j in (0, 1):
                    bins[k, j] += np.bincount(at[kind == j], minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array([bins.tobytes()], pa.binary()), pa.array([b""], pa.binary())], names=["n", "parts"])

    return count


def train(made: DataFrame, labels: DataFrame, label: str) -> Model:
    """The classifier from a table (doc_id, features) of all documents and the labels' learning fold, of which only the good ones count."""
    told = labels.select(F.col("doc_id").alias("of"), F.col(label).alias("y")).where(F.col("of").isNotNull() & F.col("y").isNotNull() & ~in_fold(F.col("of")))
    good = told.groupBy("of").agg((F.avg("y") >= 0.5).alias("good")).where("good").select("of", F.pmod(F.xxhash64("of"), F.lit(2)).cast("int").alias("kind"))
    positive = stored(made.join(good, made["doc_id"] == good["of"]).select("features", "kind"))
    every = made.select("features", F.lit(0).alias("kind"))
    (n_p, p), (n_u, u) = _gathered(positive, _moments), _gathered(every, _moments)
    if not len(n_p) or not n_p.sum():
        return Model(None)
    p, u = p.reshape(2, WIDTH + 1, WIDTH), u.reshape(2, WIDTH + 1, WIDTH)[0]
    fitted = lambda n, of, prior: fit(np.array([n_u[0], n]), np.stack([u, of]), prior)
    halves = (0, 1) if n_p.all() else ()  # too few to be halved are taken whole
    weights = [fitted(n_p[k], p[k], FIRST_PRIOR) for k in halves] or [fitted(n_p.sum(), p.sum(axis=0), FIRST_PRIOR)]
    count = lambda rows, weights: _gathered(rows, _histograms(weights))[0].reshape(len(weights), 2, BINS)
    of_u, of_p = count(every, weights)[:, 0], count(positive, weights)
    unseen = [of_p[k, 1 - k] for k in halves] or [of_p[0].sum(axis=0)]
    prior = float(np.clip(np.mean([estimated_prior(a, b) for a, b in zip(of_u, unseen, strict=True)]), *PRIORS))
    w = fitted(n_p.sum(), p.sum(axis=0), prior)
    return Model(w, calibrate(count(every, [w])[0, 0], count(positive, [w])[0].sum(axis=0), prior), prior)


def _made(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    made = with_features(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text")
    return stored(made.select("doc_id", "features"))


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(doc_id, score, predicted, held_out) of each row."""
    made = _made(docs, doc_id, text)
    model = train(made, labels, label)
    out = with_columns(made, ["features"], SCORES, lambda column: model.scores(_matrix(column)))
    return out.withColumn("held_out", in_fold(F.col("doc_id"))).drop("features")


def accepted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """The rows of docs that are predicted to be good. Texts are read twice, but neither shuffled nor stored."""
    model = train(_made(docs, doc_id, text), labels, label)
    (good,) = fresh(docs, "_good")
    kept = with_columns(docs, [text], [T.StructField(good, T.IntegerType())], lambda texts: model.scores(_rows(texts))[1:])
    return kept.where(F.col(good) == 1).drop(good)
