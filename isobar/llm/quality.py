"""Quality classifier: a linear support vector machine on naive Bayes features.

A document is the set of its n-grams: words and word pairs, and shapes of words (letter case,
digits and signs, repeated characters once) and shape pairs, where a word equal to the one
before it has a shape of its own.  Each indicator is scaled by its class log-count ratio, each
document to length 1; a hinge-loss linear model is fitted by dual coordinate descent, and its
margin is turned into a probability on documents kept back from the fit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .shared import Words, fitted, is_held, logistic_fit, mix64, sigmoid, string_hashes, table, with_score

#: Labelled documents that the fit uses at most, and hashed n-gram buckets.
SAMPLE = 6000
BUCKETS = 1 << 20


def _shapes(words: pa.Array) -> pa.Array:
    out = words
    for pattern, to in ((r"\p{Lu}+", "X"), (r"[\p{Ll}\p{Lo}\p{Lm}\p{M}]+", "x"), (r"\p{N}+", "d"), (r"!+", "!"), (r"\.+", ".")):
        out = pc.replace_substring_regex(out, pattern, to)
    return out


def indicators(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(features of all texts one after the other, where each text begins); a text's features are distinct and sorted."""
    words = Words(texts)
    n = len(words.starts) - 1
    row = np.repeat(np.arange(n), np.diff(words.starts))
    code = words.codes
    word = string_hashes(pc.utf8_lower(words.vocab)) if len(words.vocab) else np.zeros(1, np.uint64)
    shape = string_hashes(_shapes(words.vocab)) if len(words.vocab) else np.zeros(1, np.uint64)
    w, s = word[code], shape[code]
    inner = np.zeros(len(code), bool)
    inner[1:] = row[1:] == row[:-1]
    again = inner.copy()
    again[1:] &= code[1:] == code[:-1]
    s = np.where(again, s ^ np.uint64(0x5555), s)
    at = np.flatnonzero(inner)
    with np.errstate(over="ignore"):
        grams = [w, s * np.uint64(3) + np.uint64(1), mix64(w[at - 1] * np.uint64(5) + w[at]), mix64(s[at - 1] * np.uint64(7) + s[at])]
    rows = [row, row, row[at], row[at]]
    keys = np.concatenate([r.astype(np.uint64) << np.uint64(20) | g >> np.uint64(44) for r, g in zip(rows, grams, strict=True)])
    keys.sort()
    if len(keys):
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    starts = np.searchsorted(keys, np.arange(n + 1, dtype=np.uint64) << np.uint64(20))
    return (keys & np.uint64(BUCKETS - 1)).astype(np.int64), starts


def _summed(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    ends = np.concatenate([[0.0], np.cumsum(values)])
    return ends[starts[1:]] - ends[starts[:-1]]


class NaiveBayesSVM:
    """Weights of the scaled indicators and of the margin's logistic curve."""

    def __init__(self, weights: np.ndarray, ratios: np.ndarray, curve: np.ndarray) -> None:
        self.weights, self.ratios, self.curve = weights, ratios, curve

    def margins(self, features: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Margin of each document; 0 for one without n-grams."""
        x = self.ratios[features].astype(np.float64)
        norm = np.sqrt(np.maximum(_summed(x * x, starts), 1e-12))
        return _summed(x * self.weights[features], starts) / norm

    def score(self, texts: pa.Array) -> np.ndarray:
        return sigmoid(self.margins(*indicators(texts)) * self.curve[0] + self.curve[1])


def log_count_ratios(features: np.ndarray, starts: np.ndarray, y: np.ndarray) -> np.ndarray:
    """log of each bucket's share among the class-1 indicators over its share among class 0, both with 1 added."""
    owner = np.repeat(y, np.diff(starts))
    up = 1.0 + np.bincount(features[owner == 1], minlength=BUCKETS)
    down = 1.0 + np.bincount(features[owner != 1], minlength=BUCKETS)
    return np.log((up / up.sum()) / (down / down.sum()))


def dual_descent(features: np.ndarray, starts: np.ndarray, ratios: np.ndarray, y: np.ndarray, c: float, rounds: int, seed: int = 0) -> np.ndarray:
    """Weights of a hinge-loss SVM by dual coordinate descent over documents in random order.

    Each document's dual variable moves to its constrained optimum, 0 to C (times the other
    class's share, so that rare classes count), and the weights follow.
    """
    rng = np.random.default_rng(seed)
    sign = np.where(y == 1, 1.0, -1.0)
    share = np.mean(y == 1)
    most = np.where(y == 1, c * 2 * (1 - share), c * 2 * share)
    w = np.zeros(BUCKETS)
    rows = []
    for i in range(len(y)):
        f = features[starts[i] : starts[i + 1]]
        x = ratios[f]
        rows.append((f, x / np.sqrt(max(float(x @ x), 1e-12))))
    alpha = np.zeros(len(y))
    for _ in range(rounds):
        for i in rng.permutation(len(y)):
            f, x = rows[i]
            if not len(f):
                continue
            gradient = sign[i] * float(w[f] @ x) - 1.0
            new = min(max(alpha[i] - gradient, 0.0), most[i])  # x has length 1
            if new != alpha[i]:
                w[f] += (new - alpha[i]) * sign[i] * x
                alpha[i] = new
    return w


def train(texts: list[str], y: np.ndarray, c: float = 1.0, rounds: int = 12) -> NaiveBayesSVM:
    """Fit on four of five documents, set the probability curve on the fifth; a constant if a class is missing."""
    if len(set(y.tolist())) < 2:
        share = float(np.mean(y)) if len(y) else 0.5
        share = min(max(share, 0.02), 0.98)
        return NaiveBayesSVM(np.zeros(BUCKETS), np.zeros(BUCKETS), np.array([0.0, np.log(share / (1 - share))]))
    parts = [indicators(pa.array(texts[a : a + 500], pa.large_string())) for a in range(0, len(texts), 500)]
    lengths = np.concatenate([np.diff(s) for _, s in parts])
    features, starts = np.concatenate([f for f, _ in parts]), np.concatenate([[0], np.cumsum(lengths)])
    back = np.arange(len(y)) % 5 == 4
    fit = np.flatnonzero(~back)
    inside = np.repeat(~back, lengths)
    own, own_starts = features[inside], np.concatenate([[0], np.cumsum(lengths[fit])])
    ratios = log_count_ratios(own, own_starts, y[fit])
    model = NaiveBayesSVM(dual_descent(own, own_starts, ratios, y[fit], c, rounds), ratios, np.array([1.0, 0.0]))
    margin = model.margins(features, starts)
    use = back if len(set(y[back].tolist())) == 2 else np.ones(len(y), bool)
    model.curve = logistic_fit(margin[use, None], y[use], ridge=0.1)
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held: int = 1, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with ``score``, the probability of label 1 (0 to 1, also for null and empty texts).

    Learns from at most ``sample`` labelled documents outside the held-out fold.  Whole texts of
    any length are read; equal texts and repeated rows get equal scores.  A text without words has
    a margin of 0, the curve's middle.  Without labels of both classes the score is one constant.
    An empty table stays empty; other columns pass through, one named ``score`` is replaced.
    """
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, label, folds, held, sample, train))
    return with_score(docs, lambda batch: model.value.score(batch))


def op2_nbsvm_quality(spark, sf_dir: str) -> DataFrame:
    """Every document's quality score; null, empty and repeated rows as in :func:`quality_scores`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_scores(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", is_held(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
