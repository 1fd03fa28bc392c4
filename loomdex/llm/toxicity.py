"""Toxicity by cumulative-link ordinal regression.

Grades run from 0 (not toxic) to 3. P(grade > j) = 1 / (1 + exp(threshold_j - w . x)) with one
weight vector for all thresholds, which stay ordered, as each is the last plus a positive gap.
The expected severity is the sum of these probabilities over j; a document is toxic if grade 1
or more is likelier than not.

Labels say toxic or not; the grade of a toxic one is how densely learned toxic wording stands in
its text: words that lean to toxic texts by their smoothed log-odds are found in the learning
rows, and rows labelled toxic get grade 1, 2 or 3 by the thirds of the share of such words among
their words, so a grade doesn't follow the length.

Features are sparse: for each of at most VOCABULARY words, chosen by the weight of evidence in
the learning rows for or against toxicity, 1 + log(its count), and log(1 + hits), where hits are
the words of toxic wording in a thousand. Words are runs of letters in lower case. The model is
fitted on at most LEARN_ROWS labelled rows, taken in the order of a hash of their ids, from
the fold that is not held out (see quality.in_fold); every document is then scored whole.

Labels of null are ignored, an id labelled both ways is toxic if half of its labels say so.
Without labelled rows of both kinds every severity is 0. Null and empty texts have no features
and score by the thresholds alone. Repeated rows score alike. An empty table gives an empty result.
Words of equal evidence are taken in alphabetical order, ids by hash, then value. Input columns
with the name of an output are replaced, others kept.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdex.llm.common import stored, with_columns
from loomdex.llm.quality import in_fold

GRADES, LEARN_ROWS, VOCABULARY = 3, 20_000, 2_048
MIN_DOCS, EVIDENCE, AGAINST, RIDGE, STEPS = 3, 4.0, -3.0, 1e-3, 1500
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def learning_rows(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str) -> DataFrame:
    """(text, toxic) of the learning rows; the ids, bounded by LEARN_ROWS, are all that is broadcast."""
    told = labels.select(F.col("doc_id").alias("of"), F.col(label).alias("y")).where(F.col("of").isNotNull() & F.col("y").isNotNull() & ~in_fold(F.col("of")))
    told = told.groupBy("of").agg((F.avg("y") >= 0.5).alias("toxic")).orderBy(F.xxhash64("of"), "of").limit(LEARN_ROWS)
    return docs.select(F.col(doc_id).alias("of"), F.col(text).alias("text")).join(F.broadcast(told), "of").select("text", "toxic")


def evidence(rows: DataFrame) -> tuple[dict[str, float], int, int]:
    """Log-odds of the words that say most about the label, and the numbers of toxic and other rows."""

    def seen(batches):
        for b in batches:
            count = {True: Counter(), False: Counter()}
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                count[toxic].update(set(words_of(text)))
            words = list(count[True].keys() | count[False].keys())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([count[True][w] for w in words], pa.int64()), pa.array([count[False][w] for w in words], pa.int64())], names=["word", "bad", "good"])

    tot = rows.agg(F.count_if("toxic").alias("bad"), F.count("*").alias("n")).first()
    bad, good = tot["bad"], tot["n"] - tot["bad"]
    if not bad or not good:
        return {}, bad, good
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    weighed = rows.mapInArrow(seen, "word string, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where(F.col("bad") + F.col("good") >= MIN_DOCS)
    # the signed root of the likelihood ratio against a word that both kinds of texts share evenly
    rate = bad / (bad + good)
    part = lambda k, expected: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / ((F.col("bad") + F.col("good")) * expected))).otherwise(0.0)
    z = F.signum(odds) * F.sqrt(F.greatest(2 * (part("bad", rate) + part("good", 1 - rate)), F.lit(0.0)))
    best = weighed.select("word", odds.alias("odds"), z.alias("z")).orderBy(F.abs("z").desc(), "word").limit(VOCABULARY).collect()
    return {r["word"]: r["odds"] for r in best if not AGAINST < r["z"] < EVIDENCE}, bad, good


def value_of(count):
    """The feature of a word that occurs so often."""
    return 1 + np.log(count)


def value_of_density(density):
    """The feature of a share of toxic wording."""
    return np.log1p(1000 * density)


class Ordinal:
    """Weights shared by all thresholds, the last of them that of density, the thresholds, and the words that lean to toxic texts."""

    def __init__(self, vocabulary: dict[str, int], leaning: set[int], weights: np.ndarray, thresholds: np.ndarray):
        self.vocabulary, self.leaning, self.weights, self.thresholds = vocabulary, leaning, weights, thresholds

    def margin(self, text: str | None) -> float:
        words = words_of(text)
        seen = Counter(i for w in words if (i := self.vocabulary.get(w)) is not None)
        hits = sum(n for i, n in seen.items() if i in self.leaning)
        return float(sum(self.weights[i] * value_of(n) for i, n in seen.items()) + self.weights[-1] * value_of_density(hits / max(len(words), 1)))

    def above(self, margins: np.ndarray) -> np.ndarray:
        """P(grade > j) by row and threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - margins[:, None], -50, 50)))


def fit(row: np.ndarray, col: np.ndarray, value: np.ndarray, width: int, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that maximise the cumulative-link likelihood less a ridge; Adam with steps that shrink.

    row, col and value are the entries of the sparse feature matrix.
    """
    rows = len(y)
    p = np.zeros(width + GRADES)
    p[width] = 2.0
    m, v = np.zeros_like(p), np.zeros_like(p)
    at = np.arange(rows)
    for t in range(1, STEPS + 1):
        gaps = np.exp(p[width + 1 :])
        margin = np.bincount(row, value * p[col], rows)
        thr = p[width] + np.concatenate([[0], np.cumsum(gaps)])
        z = 1 / (1 + np.exp(np.clip(thr[None, :] - margin[:, None], -50, 50)))
        edges = np.concatenate([np.ones((rows, 1)), z, np.zeros((rows, 1))], axis=1)
        mass = np.maximum(edges[at, y] - edges[at, y + 1], 1e-12)
        slope = edges * (1 - edges)
        lo, hi = slope[at, y] / mass, slope[at, y + 1] / mass
        to_margin = (lo - hi) / rows
        to_thr = np.array([(hi * (y == j) - lo * (y == j + 1)).sum() / rows for j in range(GRADES)])
        grad = np.concatenate([np.bincount(col, value * to_margin[row], width) - RIDGE * p[:width], [to_thr.sum()], [to_thr[j + 1 :].sum() * gaps[j] for j in range(GRADES - 1)]])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        p += 0.1 * (1 - t / (STEPS + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return p[:width], p[width] + np.concatenate([[0], np.cumsum(np.exp(p[width + 1 :]))])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Ordinal | None:
    rows = stored(learning_rows(docs, labels, doc_id, text, label))
    odds, bad, good = evidence(rows)
    if not odds:
        return None
    index = {w: i for i, w in enumerate(sorted(odds))}
    leaning = {i for w, i in index.items() if odds[w] > 0}

    def sparse(batches):
        for b in batches:
            out = []
            for text in b.column(0).to_pylist():
                words = words_of(text)
                seen = Counter(i for w in words if (i := index.get(w)) is not None)
                out.append({"i": list(seen), "n": list(seen.values()), "words": len(words)})
            yield pa.RecordBatch.from_arrays([pa.array([o["i"] for o in out], pa.list_(pa.int32())), pa.array([o["n"] for o in out], pa.list_(pa.int32())), pa.array([o["words"] for o in out], pa.int64()), b.column(1)], names=["i", "n", "words", "toxic"])

    got = rows.mapInArrow(sparse, "i array<int>, n array<int>, words long, toxic boolean").collect()
    got.sort(key=lambda r: (r["words"], r["i"], r["n"], r["toxic"]))  # so that reruns agree
    row = np.repeat(np.arange(len(got)), [len(r["i"]) for r in got])
    col, n = (np.array([x for r in got for x in r[c]], np.int64) for c in ("i", "n"))
    hits = np.bincount(row, n * np.isin(col, list(leaning)), len(got))
    density = hits / np.maximum([r["words"] for r in got], 1)
    toxic = np.array([r["toxic"] for r in got])
    cuts = np.quantile(density[toxic & (hits > 0)], [1 / 3, 2 / 3]) if (toxic & (hits > 0)).any() else [0, 0]
    y = np.where(toxic, 1 + (density > cuts[0]) + (density > cuts[1]), 0).astype(np.int64)
    dense = np.flatnonzero(hits)
    row, col, value = np.concatenate([row, dense]), np.concatenate([col, np.full(len(dense), len(index))]), np.concatenate([value_of(n), value_of_density(density[dense])])
    return Ordinal(index, leaning, *fit(row, col, value, len(index) + 1, y))


def severity(docs: DataFrame, model: Ordinal | None, text: str = "text") -> DataFrame:
    """docs with severity (0 to 3), grade (the likeliest) and toxic (0 or 1)."""

    def scored(texts: pa.Array) -> list[pa.Array]:
        if model is None:
            p = np.zeros((len(texts), GRADES))
        else:
            p = model.above(np.array([model.margin(t) for t in texts.to_pylist()], float))
        mass = np.concatenate([1 - p[:, :1], p[:, :-1] - p[:, 1:], p[:, -1:]], axis=1)
        return [pa.array(p.sum(axis=1)), pa.array(mass.argmax(axis=1).astype(np.int32)), pa.array((p[:, 0] >= 0.5).astype(np.int32))]

    return with_columns(docs, [text], [T.StructField("severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("toxic", T.IntegerType())], scored)
