"""Operator 6: quality by positive-unlabelled learning.

A text becomes a bounded vector of shape features (shares of letters, digits, marks and capitals, marks after words,
bars, repeats of words and lines, spread of words) and hashed character-class trigrams. A two-layer network g is
fitted by minimising the non-negative unbiased risk (Kiryo et al., 2017)

    prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)])

on trusted positives (labelled quality 1) and unlabelled text (any documents but held-out ones, labels unseen). When the
second term turns negative, the step goes up its gradient instead, as published. Scores are calibrated so that the mean
over unlabelled text is the prior.

The class prior is estimated from positives and unlabelled text alone (best bin estimation, Garg et al., 2021): a
network that tells positives from unlabelled text is fitted on half of both; on the other half, the share of unlabelled
text above a score over the share of positives above it bounds the prior, as only positives are found among the best
scores, and the score with the tightest bound is taken; the estimate is the mean of both halves' bounds. No negative label is read.

Bounds: the fit uses at most SAMPLE positives and SAMPLE unlabelled rows (those of smallest hash, however often a
doc_id is repeated); only their feature vectors reach the driver. Scoring is row-wise over whole texts.

Results: null and empty texts score as the feature vector of an empty text does; very long texts are read whole; repeated
rows repeat their result; an empty table gives an empty table; without positives or unlabelled rows every score is 0.5.
Null labels are not used; of several labels of a document the largest counts. Columns of docs other than doc_id and text,
whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, labelled, map_texts, sampled_rows, slices, table

SAMPLE = 12_000
HIDDEN, STEPS, BATCH, RATE, SEED = 16, 800, 256, 4e-3, 3
#: Of the prior's estimate: chance of a wrong bound, and its slack.
DOUBT, MARGIN = 0.1, 0.01
#: Networks whose margins are averaged.
NETWORKS = 3
MARKS = re.compile(r"[^\w\s.,;:'\"()\-]")


def class_table() -> np.ndarray:
    """Character class of each code point below 256: 0 space, 1 lower, 2 capital, 3 digit, 4 full stop or comma, 5 break, 6 mark, 7 other."""
    out = np.full(257, 7, np.int64)
    for o in range(256):
        c = chr(o)
        out[o] = 5 if c == "\n" else 0 if c.isspace() else 2 if c.isupper() else 1 if c.isalpha() else 3 if c.isdigit() else 4 if c in ".,;:'\"()-" else 6
    return out


CLASS = class_table()
N_CLASSES = 8
N_FEATURES = 14 + N_CLASSES**3


def features(text: str) -> np.ndarray:
    """The feature vector of one whole text; its length does not depend on the text."""
    out = np.zeros(N_FEATURES, np.float32)
    words = text.split()
    raw = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    kind = CLASS[np.minimum(raw, 256)]
    n = max(1, len(kind))
    share = np.bincount(kind, minlength=N_CLASSES) / n
    out[:N_CLASSES] = share
    m = max(1, len(words))
    counts = Counter(words)
    lines = text.split("\n")
    out[8] = np.log1p(len(words)) / 8
    out[9] = len(counts) / m
    out[10] = max(counts.values(), default=0) / m
    out[11] = sum(a == b for a, b in zip(words, words[1:], strict=False)) / m
    out[12] = 1 - len(set(lines)) / len(lines)
    out[13] = (n - share[0] * n - share[5] * n) / m / 10
    if len(kind) > 2:
        tri = (kind[:-2] * N_CLASSES + kind[1:-1]) * N_CLASSES + kind[2:]
        out[14:] = np.sqrt(np.bincount(tri, minlength=N_CLASSES**3) / len(tri))
    return out


class Network:
    """Two layers on standardised features; scores are P(quality 1). Networks of one sample add up: their margins' mean."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: list[np.ndarray], shift: float = 0.0):
        self.mean, self.scale, self.weights, self.shift = mean, scale, weights, shift

    def margin(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return (np.tanh(np.clip((x - self.mean) / self.scale, -6, 6) @ a + b) @ c + d[0]).astype(float)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x) + self.shift, -30, 30)))


def sig(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(p: np.ndarray, u: np.ndarray, slopes: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], seed: int) -> Network:
    """A network fitted by Adam over mini-batches. slopes: margins of positives and of unlabelled rows to the slopes of the
    risk by them."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([p, u])
    mean, scale = both.mean(0), both.std(0) + 0.02
    zp, zu = (np.clip((x - mean) / scale, -6, 6) for x in (p, u))
    w = [rng.normal(0, 0.3 / np.sqrt(N_FEATURES), (N_FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]
    w = [x.astype(np.float32) for x in w]
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]

    def forward(x):
        h = np.tanh(x @ w[0] + w[1])
        return h, h @ w[2] + w[3][0]

    def back(x, h, g):
        d = np.outer(g, w[2]) * (1 - h**2)
        return [x.T @ d, d.sum(0), h.T @ g, np.array([g.sum()])]

    for step in range(1, STEPS + 1):
        a, b = zp[rng.integers(0, len(zp), BATCH)], zu[rng.integers(0, len(zu), BATCH)]
        (ha, ga), (hb, gb) = forward(a), forward(b)
        ca, cb = slopes(ga, gb)
        grads = [x + y for x, y in zip(back(a, ha, ca), back(b, hb, cb), strict=True)]
        for i, g in enumerate(grads):
            g = g + 1e-4 * w[i]
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            w[i] -= RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Network(mean, scale, w)


def joined(nets: list[Network]) -> Network:
    """One network with the hidden layers of all, whose margin is the mean of theirs (they share mean and scale)."""
    a, b, c = (np.concatenate([n.weights[i] for n in nets], axis=-1) for i in range(3))
    return Network(nets[0].mean, nets[0].scale, [a, b, c / len(nets), sum(n.weights[3] for n in nets) / len(nets)])


def prior_bound(p: np.ndarray, u: np.ndarray, other_p: np.ndarray, other_u: np.ndarray, seed: int) -> float:
    """An upper bound of the share of positives in other_u, by a network that tells p from u."""
    # logistic loss; both sides weigh the same
    net = train(p, u, lambda ga, gb: (-sig(-ga) / len(ga), sig(gb) / len(gb)), seed)
    mp, mu = np.sort(net.margin(other_p)), np.sort(net.margin(other_u))
    share_p = 1 - np.searchsorted(mp, mp) / len(mp)
    share_u = 1 - np.searchsorted(mu, mp) / len(mu)
    doubt = np.sqrt(np.log(4 / DOUBT) / 2) * (len(mu) ** -0.5 + len(mp) ** -0.5)
    best = np.argmin((share_u + (1 + MARGIN) * doubt) / share_p)
    return float(share_u[best] / share_p[best])


def class_prior(p: np.ndarray, u: np.ndarray, seed: int = SEED) -> float:
    """The share of positives among unlabelled rows: the mean of the bounds that each half gives for the other."""
    rng = np.random.default_rng(seed)
    (p1, p2), (u1, u2) = (np.array_split(x[rng.permutation(len(x))], 2) if len(x) > 1 else (x, x) for x in (p, u))
    return float(np.clip((prior_bound(p1, u1, p2, u2, seed) + prior_bound(p2, u2, p1, u1, seed + 1)) / 2, 0.01, 0.99))


def fit_network(p: np.ndarray, u: np.ndarray, prior: float, seed: int = SEED) -> Network:
    """Minimises the non-negative risk with the sigmoid loss l(g) = sig(-g)."""

    def slopes(ga: np.ndarray, gb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slope_a, slope_b = sig(ga) * (1 - sig(ga)) / len(ga), sig(gb) * (1 - sig(gb)) / len(gb)
        if sig(gb).mean() - prior * sig(ga).mean() >= 0:
            return -2 * prior * slope_a, slope_b
        return prior * slope_a, -slope_b

    net = joined([train(p, u, slopes, seed + i) for i in range(NETWORKS)])
    low, high, g = -20.0, 20.0, net.margin(u)
    for _ in range(60):  # the mean score over unlabelled text becomes the prior
        net.shift = (low + high) / 2
        low, high = (net.shift, high) if sig(g + net.shift).mean() < prior else (low, net.shift)
    return net


def sampled_features(docs: DataFrame, ids: DataFrame, most: int) -> np.ndarray:
    """Feature vectors of at most `most` documents of ids(doc_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([features(t).astype("<f2").tobytes() for t in texts], pa.binary())], names=["x"])

    raw = [r[0] for r in sampled_rows(docs, ids, most).select("text").mapInArrow(run, "x binary").collect()]
    # sorted, so that the fit does not depend on the order in which tasks end
    return np.stack([np.frombuffer(x, "<f2") for x in sorted(raw)]).astype(np.float32) if raw else np.zeros((0, N_FEATURES), np.float32)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network | None:
    """The network; None without positives or unlabelled text. Labels of 0 are not looked at."""
    trusted = labelled(labels.filter(F.col("quality").cast("int") == 1), "quality", sample).select("doc_id")
    # unlabelled text is drawn from all documents, as the risk's second expectation asks
    free = docs.select("doc_id").filter(F.col("doc_id").isNotNull() & ~held_out())
    free = free.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    p, u = sampled_features(docs, trusted, sample), sampled_features(docs, free, sample)
    return fit_network(p, u, class_prior(p, u)) if len(p) and len(u) else None


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    def score(texts: list[str]) -> dict[str, pa.Array]:
        if shared.value is None:
            return {"score": pa.array([0.5] * len(texts), pa.float64())}
        x = np.stack([features(t) for t in texts])
        return {"score": pa.array(shared.value.score(x).astype(float), pa.float64())}

    scored = map_texts(docs, score, "score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
