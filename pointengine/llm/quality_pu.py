"""Operator 7: a quality classifier learned from positive and unlabelled text.

Trusted positives are documents labelled good; everything else is unlabelled web text.  The class
prior is estimated first, then a small network minimises the non-negative unbiased risk
``pi R_p^+ + max(0, R_u^- - pi R_p^-)`` with the logistic loss.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, fold, where_text
from .sampling import FOLDS, labelled, smallest, with_text
from .textbytes import Chunk, chunks
from .textfeatures import TEXT_FEATURES, PROFILE_BYTES, Profile

#: Trusted positives and unlabelled documents that the classifier is fitted on, at most.
FIT_POSITIVE = 4000
FIT_UNLABELLED = 8000
HIDDEN = 16
#: A document is accepted from this score on.
THRESHOLD = 0.3


@dataclass(frozen=True)
class Network:
    """tanh network over standardised text features; parts = (W1, b1, W2, b2)."""

    mean: np.ndarray
    scale: np.ndarray
    parts: tuple[np.ndarray, ...]
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.parts
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ w1 + b1) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def risk(parts: list[np.ndarray], x: np.ndarray, n_pos: int, prior: float | None) -> tuple[float, list[np.ndarray], float]:
    """(value, gradient, negative part) of the non-negative unbiased risk; the first n_pos rows of x are the positives.

    Where the negative part ``R_u^- - pi R_p^-`` is below zero, the gradient steps back along it, as the published method
    does.  Without a prior: plain logistic loss of P against U.
    """
    h = np.tanh(x @ parts[0] + parts[1])
    z = np.clip(h @ parts[2] + parts[3], -30, 30)
    down = 1 / (1 + np.exp(-z))  # derivative of log(1+e^z); that of log(1+e^-z) is down - 1
    up, n_unl = down - 1, len(x) - n_pos
    g = np.zeros(len(x))
    plus, rest = np.logaddexp(0, -z[:n_pos]).mean(), np.logaddexp(0, z[n_pos:]).mean()
    if prior is None:
        value = plus + rest
        g[:n_pos], g[n_pos:] = up[:n_pos] / n_pos, down[n_pos:] / n_unl
    else:
        rest -= prior * np.logaddexp(0, z[:n_pos]).mean()
        value = prior * plus + max(rest, 0.0)
        if rest >= 0:
            g[:n_pos], g[n_pos:] = prior * (up[:n_pos] - down[:n_pos]) / n_pos, down[n_pos:] / n_unl
        else:
            g[:n_pos], g[n_pos:] = prior * down[:n_pos] / n_pos, -down[n_pos:] / n_unl
    dh = g[:, None] * parts[2] * (1 - h * h)
    return float(value), [x.T @ dh, dh.sum(0), h.T @ g, g.sum(keepdims=True)], float(rest)


def _descend(p: np.ndarray, u: np.ndarray, prior: float | None, steps: int, rate: float, seed: int) -> tuple[np.ndarray, ...]:
    """Adam on the risk of P and U; without a prior, on plain P-against-U logistic loss."""
    rng = np.random.default_rng(seed)
    f = p.shape[1]
    parts = [rng.normal(0, 1 / np.sqrt(f), (f, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(q) for q in parts], [np.zeros_like(q) for q in parts]
    x = np.concatenate([p, u])
    for k in range(1, steps + 1):
        for i, gr in enumerate(risk(parts, x, len(p), prior)[1]):
            gr = gr + 1e-4 * parts[i]
            m[i], v[i] = 0.9 * m[i] + 0.1 * gr, 0.999 * v[i] + 0.001 * gr * gr
            parts[i] = parts[i] - rate * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.999**k)) + 1e-8)
    return tuple(parts)


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Share of positives in unlabelled scores: the least ratio of the two tails, each with its sampling error.

    U(s >= t) >= pi P(s >= t) holds for any t, so every ratio bounds pi from above; the bound is tight where
    no negatives score.
    """
    grid = np.unique(np.quantile(pos, np.linspace(0.02, 0.9, 45)))
    p = np.array([(pos >= t).mean() for t in grid])
    u = np.array([(unl >= t).mean() for t in grid])
    slack = 1 / np.sqrt(len(pos)) + 1 / np.sqrt(len(unl))
    at = int(np.argmin((u + slack) / np.maximum(p, 1e-9)))
    return float(np.clip(u[at] / max(p[at], 1e-9), 0.05, 0.98))


def fit_network(pos: np.ndarray, unl: np.ndarray, prior: float | None = None) -> Network:
    """Estimate the prior on one half of the sample against a model of the other, then fit on all of it."""
    both = np.concatenate([pos, unl])
    mean, scale = both.mean(0), both.std(0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (pos, unl))
    if prior is None:
        found = []
        for a, b in ((0, 1), (1, 0)):
            w = _descend(p[a::2], u[a::2], None, 200, 0.02, 7)
            s = lambda x: np.tanh(x @ w[0] + w[1]) @ w[2] + w[3]  # noqa: B023, E731
            found.append(estimate_prior(s(p[b::2]), s(u[b::2])))
        prior = float(np.mean(found))
    return Network(mean, scale, _descend(p, u, prior, 600, 0.01, 11), prior)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in chunks(batch, limit=PROFILE_BYTES):
            x = Profile(c).texts().astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("y").slice(c.row0, c.n), pa.array([r.tobytes() for r in x], pa.binary())], ["y", "x"])


def fit(docs: DataFrame, labels: DataFrame) -> Network | None:
    """Fit on at most FIT_POSITIVE trusted and FIT_UNLABELLED other documents outside fold 0; None without positives."""
    good = labelled(labels, "quality", 1, FIT_POSITIVE)
    anything = smallest(docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), FOLDS) != 0)).distinct(), FIT_UNLABELLED)
    ids = good.unionByName(anything.withColumn("y", F.lit(-1)))
    rows = with_text(docs, ids).mapInArrow(_features, "y int, x binary").collect()
    x = {k: np.array(sorted(np.frombuffer(r.x, np.float32).tolist() for r in rows if r.y == k)) for k in (1, -1)}
    if len(x[1]) < 2 or len(x[-1]) < 2:
        return None
    rng = np.random.default_rng(3)
    return fit_network(*(rng.permutation(x[k]) for k in (1, -1)))


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def _scores(net: Network | None, c: Chunk) -> np.ndarray:
    return net.score(Profile(c).texts()) if net else np.full(c.n, 0.5)


def score_documents(docs: DataFrame, net: Network | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    A null or empty text is scored like any other, by features that are all zero.  Without a fitted network
    every score is 0.5.  Repeated rows each get a row; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch, limit=PROFILE_BYTES):
                s = _scores(net, c)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(c.row0, c.n), batch.column("held_out").slice(c.row0, c.n), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return documents(docs).withColumn("held_out", fold(F.col("doc_id"), FOLDS) == 0).mapInArrow(run, SCHEMA)


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that the classifier accepts, with all their columns; each is judged by its own text, whatever its doc_id."""
    net = fit(docs, labels)

    def accepts(batch: pa.RecordBatch) -> Iterator[list[bool]]:
        for c in chunks(batch, limit=PROFILE_BYTES):
            yield (_scores(net, c) >= THRESHOLD).tolist()

    return where_text(docs, accepts)
