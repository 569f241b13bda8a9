"""Toxicity by non-negative positive-unlabelled learning.

Method. Confirmed toxic documents are the positives; other documents of the
learning rows, whatever their label, are the unlabelled ones. A text is the
set of its words and word beginnings. Equal texts count once among the positives
and once among the unlabelled, so a text copied into many documents weighs as
any other. The features used are all that are more than twice as frequent among
positives and pass a likelihood-ratio test of equal shares, at a level of
``LEVEL`` over all features of the sample together. A linear
model is trained in numpy on the logistic loss with the risk

    prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1)),

the second part being the risk on negatives; where it falls below zero, the
step goes up its gradient instead, so that it cannot be driven negative.

Bounds. About ``positives`` and ``unlabelled`` rows, chosen by a hash of
doc_id, are used for fitting, however many there are; each comes back as the
numbers of its chosen features only. Scoring reads every row; the model has one weight a feature.

Rows. A null text is empty; a text without features scores what the bias
says. Repeated rows score the same. Without any positive all scores are 0.
Rows with a null doc_id are scored but not learned from. An empty table gives
an empty result. Label, language and source are no inputs of a score.
"""

from __future__ import annotations

import math
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrat.llm.common import LOWER, map_rows, schema_of, texts
from quadrat.storage import settle

#: Lengths in bytes of word beginnings.
HEADS = (4, 5, 6, 7)
#: ASCII punctuation separates words, too.
PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in LOWER)
REMEMBERED = 200_000
#: Texts counted at once.
SLICE = 512
STEPS, RATE, DECAY = 400, 0.05, 1e-3
#: Probability that chance alone makes any feature.
LEVEL = 0.01


def word_features(word: bytes) -> list[int]:
    """Codes of the whole word and of its beginnings."""
    return [zlib.crc32(b"=" + word)] + [zlib.crc32(word[:n]) for n in HEADS if len(word) >= n]


def text_words(text: bytes) -> set[bytes]:
    return set(text.translate(PLAIN).split())


def text_features(text: bytes) -> set[int]:
    return {f for w in text_words(text) for f in word_features(w)}


def count_features(batches):
    """code, and how many positive and unlabelled texts of a slice have it.

    A slice is counted in arrays, as counters and rows of its features take several times the memory.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE).to_pydict()
            for positive in (0, 1):
                own = (text_features(t) for t, p in zip(part["text"], part["positive"]) if p == positive)
                code, n = np.unique(np.fromiter(chain.from_iterable(own), np.int64), return_counts=True)
                none = np.zeros(len(n), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(code), *map(pa.array, (n, none) if positive else (none, n))],
                                                 ["code", "p", "u"])


class Marks(dict):
    """Word to the numbers of its chosen features, found when first asked for."""

    def __init__(self, chosen: dict[int, int]):
        self.chosen = chosen

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        found = tuple(self.chosen[f] for f in word_features(word) if f in self.chosen)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found
        return found

    def of(self, text: bytes) -> list[int]:
        return sorted({i for t in map(self.__getitem__, text_words(text)) if t for i in t})


def nn_pu_fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk over rows of 0/1 features."""
    row, column = np.nonzero(np.vstack([positive, unlabelled]))
    return fit_marks(row, column, len(positive), len(unlabelled), positive.shape[1], prior)


def fit_marks(row: np.ndarray, column: np.ndarray, p: int, n: int, features: int, prior: float) -> tuple[np.ndarray, float]:
    """The same from the places of the ones; the first ``p`` of the ``p + n`` rows are positive."""
    weight, bias = np.zeros(features), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(features + 1), np.zeros(features + 1)
    for step in range(1, STEPS + 1):
        g = np.bincount(row, weight[column], p + n) + bias
        s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        loss_minus = np.logaddexp(0, g)
        negative_risk = loss_minus[p:].mean() - prior * loss_minus[:p].mean()
        slope = np.concatenate([-prior * s[:p] / p, s[p:] / n])
        if negative_risk < 0:
            slope = -slope
        else:
            slope[:p] += prior * (s[:p] - 1) / p
        grad = np.concatenate([np.bincount(column, slope[row], features) + DECAY * weight / features, [slope.sum()]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        weight, bias = weight - move[:-1], bias - move[-1]
    return weight, float(bias)


def likelihood_ratio(positives: int, unlabelled: int):
    """Column: twice the log likelihood ratio of different against equal shares, from counts p and u."""
    def part(seen, of, share):
        return F.when(seen > 0, seen * F.log(seen / (of * share))).otherwise(0.0)
    p, u = F.col("p"), F.col("u")
    share = (p + u) / (positives + unlabelled)
    rest = F.lit(1) - share
    return 2 * (part(p, positives, share) + part(u, unlabelled, share)
                + part(positives - p, positives, rest) + part(unlabelled - u, unlabelled, rest))


def fit(docs: DataFrame, labels: DataFrame, learn, prior: float | None = None, positives: int = 4_000,
        unlabelled: int = 12_000) -> tuple[dict[int, int], np.ndarray, float] | None:
    """Chosen features, weights and bias; ``learn`` is the condition (on doc_id) for learning rows.

    ``prior`` is the share of toxic documents; by default that of the labelled learning rows.
    """
    known = labels.where(learn & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = known.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not sizes[0] or not sizes[1]:
        return None
    toxic = known.where("toxic = 1").select("doc_id", F.lit(1).alias("_positive"))
    ids = docs.where(learn & F.col("doc_id").isNotNull()).select("doc_id").distinct().join(toxic, "doc_id", "left")
    n_p, n_u = ids.agg(F.count("_positive"), F.count(F.lit(1)) - F.count("_positive")).first()
    if not n_p or not n_u:
        return None
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)
    part = F.when(F.col("_positive") == 1, F.lit(positives / n_p)).otherwise(F.lit(unlabelled / n_u))
    drawn = settle(ids.where(draw < part).select("doc_id", F.coalesce("_positive", F.lit(0)).alias("positive")), "drawn")
    # the drawn ids are about ``positives + unlabelled`` however many documents there are
    sample = settle(texts(docs).join(F.broadcast(drawn), "doc_id").groupBy(F.sha2("text", 256), "positive").agg(
        F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")).select("text", "positive", "copies"), "sample")

    counts = sample.mapInArrow(count_features, "code long, p long, u long")
    counts = counts.groupBy("code").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    seen = {r.positive: r for r in sample.groupBy("positive").agg(
        F.count(F.lit(1)).alias("n"), F.sum("copies").alias("rows")).collect()}
    if len(seen) < 2:
        return None
    seen_p, seen_u = seen[1].n, seen[0].n
    if prior is None:  # of different texts, as they are fitted
        toxic_texts = sizes[1] / sizes[0] * seen_p / seen[1].rows
        other_texts = (1 - sizes[1] / sizes[0]) * seen_u / seen[0].rows
        prior = min(max(toxic_texts / (toxic_texts + other_texts), 1e-4), 0.5)
    counts = settle(counts, "features")
    least = 2 * math.log(max(counts.count(), 1) / LEVEL)
    often = counts.where((F.col("p") * seen_u > 2 * F.col("u") * seen_p) & (likelihood_ratio(seen_p, seen_u) >= least))
    chosen = {r.code: i for i, r in enumerate(often.select("code").orderBy("code").toLocalIterator())}
    if not chosen:
        return None

    def mark():
        marks = Marks(chosen)
        return lambda batch: ((marks.of(t), p) for t, p in zip(batch["text"], batch["positive"]))
    marked = map_rows(sample, T.StructType([T.StructField("marks", T.ArrayType(T.IntegerType())),
                                            T.StructField("positive", T.IntegerType())]), mark)
    found = sorted(((r.positive, r.marks) for r in marked.toLocalIterator()), key=lambda x: (-x[0], x[1]))
    row = np.repeat(np.arange(len(found)), [len(marks) for _, marks in found])
    column = np.fromiter((i for _, marks in found for i in marks), np.int64, len(row))
    weight, bias = fit_marks(row, column, seen_p, seen_u, len(chosen), prior)
    return chosen, weight, bias


def score(docs: DataFrame, model, *keep: str) -> DataFrame:
    """doc_id, ``keep`` and score (0 to 1) of every text."""
    if model is None:
        return docs.select("doc_id", *keep, F.lit(0.0).alias("score"))
    chosen, weight, bias = model

    def make():
        marks = Marks(chosen)

        def rows(batch):
            for *kept, text in zip(batch["doc_id"], *[batch[c] for c in keep], batch["text"]):
                yield *kept, float(1 / (1 + np.exp(-np.clip(weight[marks.of(text)].sum() + bias, -700, 700))))
        return rows
    return map_rows(texts(docs, *keep), schema_of(docs, "doc_id", *keep, score=T.DoubleType()), make)
