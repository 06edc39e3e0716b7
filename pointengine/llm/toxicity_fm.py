"""Operator 5: toxicity by a factorization machine over hashed terms.

Terms are lower-cased words and their first bytes, hashed to 64 bits.  The machine scores a text by
``w0 + sum w_i + sum_{i<j} <v_i, v_j>`` over the terms present, so a pair of terms, such as an insult
with a mention of a group, can count for more than its parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, fold
from .sampling import FOLDS, labelled, with_text
from .textbytes import Chunk, chunks, mix

#: Labelled documents of either kind that the machine is fitted on, at most.
FIT_TOXIC = 4000
FIT_CLEAN = 8000
#: Terms that get parameters, at most, and the fewest sample documents a term stands in.
TERMS = 4096
LEAST_DOCS = 8
FACTORS = 8
#: Word beginnings, in bytes, that are terms of their own.
PREFIXES = (4, 5, 6)

_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True


@dataclass(frozen=True)
class Machine:
    terms: np.ndarray  # sorted hashes
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logits(self, text: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Of n texts, whose distinct terms are the pairs (text, index of term)."""
        z = self.bias + np.bincount(text, self.weights[term], n)
        for f in self.factors.T:
            s = np.bincount(text, f[term], n)
            z += 0.5 * (s * s - np.bincount(text, f[term] ** 2, n))
        return z


def _terms(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every word and word beginning of a lower-cased chunk, repeats included."""
    s, e, d = c.runs(_LETTER[c.buf])
    texts, hashes = [d], [c.hashes(s, e)]
    for k in PREFIXES:
        long = e - s > k
        texts.append(d[long])
        hashes.append(mix(c.hashes(s[long], s[long] + k) ^ np.uint64(k)))
    return np.concatenate(texts), np.concatenate(hashes)


def _distinct(text: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Positions of the first of every distinct (text, value)."""
    return np.unique(mix(value + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]


def _known(c: Chunk, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, index) of the chunk's terms that are among the sorted terms."""
    text, h = _terms(c)
    at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
    hit = terms[at] == h
    pair = np.unique(text[hit] * np.int64(len(terms)) + at[hit])
    return pair // len(terms), pair % len(terms)


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        y = batch.column("y").to_numpy()
        for c in chunks(batch, lower=True):
            text, h = _terms(c)
            at = _distinct(text, h)
            text, h = text[at], h[at]
            u, back = np.unique(h, return_inverse=True)
            toxic = np.bincount(back, y[c.row0 + text], len(u)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(toxic), pa.array(np.bincount(back, minlength=len(u)) - toxic)], ["h", "p", "n"])


def fit_machine(text: np.ndarray, term: np.ndarray, y: np.ndarray, terms: np.ndarray, steps: int = 150, rate: float = 0.05, decay: float = 1e-3) -> Machine:
    """Logistic loss by Adam over distinct (text, term) pairs; every text counts alike."""
    n, k = len(y), len(terms)
    rng = np.random.default_rng(5)
    parts = [np.zeros(1), np.zeros(k), rng.normal(0, 0.05, (k, FACTORS))]
    m, v = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for step in range(1, steps + 1):
        b, w, f = parts
        sums = np.stack([np.bincount(text, f[term, j], n) for j in range(FACTORS)], 1)
        z = b[0] + np.bincount(text, w[term], n) + 0.5 * ((sums**2).sum(1) - np.bincount(text, (f[term] ** 2).sum(1), n))
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        gt = g[text]
        gf = np.stack([np.bincount(term, gt * (sums[text, j] - f[term, j]), k) for j in range(FACTORS)], 1)
        for i, gr in enumerate((g.sum(keepdims=True), np.bincount(term, gt, k), gf)):
            gr = gr + decay * parts[i] * (i > 0)
            m[i], v[i] = 0.9 * m[i] + 0.1 * gr, 0.999 * v[i] + 0.001 * gr * gr
            parts[i] = parts[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Machine(terms, float(parts[0][0]), parts[1], parts[2])


def fit(docs: DataFrame, labels: DataFrame) -> Machine | None:
    """Fit on at most FIT_TOXIC and FIT_CLEAN labelled documents outside fold 0; None unless both kinds occur.

    Terms are the TERMS with the largest chi-squared statistic among those in LEAST_DOCS sample documents.
    """
    ids = labelled(labels, "toxic", 1, FIT_TOXIC).unionByName(labelled(labels, "toxic", 0, FIT_CLEAN))
    sample = with_text(docs, ids)
    size = {r.y: r.n for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(size) < 2:
        return None
    p, n, big_p, big_n = F.col("p"), F.col("n"), float(size[1]), float(size[0])
    chi = F.pow(p * (big_n - n) - n * (big_p - p), 2) / ((p + n) * (big_p + big_n - p - n + 1))
    counts = sample.mapInArrow(_term_counts, "h long, p long, n long").groupBy("h").agg(F.sum("p").cast("double").alias("p"), F.sum("n").cast("double").alias("n"))
    best = counts.where(p + n >= LEAST_DOCS).orderBy(chi.desc(), "h").limit(TERMS).select("h").collect()
    if not best:
        return None
    terms = np.sort(np.array([r.h for r in best], np.int64).view(np.uint64))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch, lower=True):
                text, term = _known(c, terms)
                cut = np.searchsorted(text, np.arange(c.n + 1))
                parts = [term[cut[i] : cut[i + 1]].astype(np.int32).tobytes() for i in range(c.n)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(c.row0, c.n), batch.column("y").slice(c.row0, c.n), pa.array(parts, pa.binary())], ["doc_id", "y", "t"])

    rows = sorted((r.doc_id, r.y, bytes(r.t)) for r in sample.mapInArrow(known, "doc_id long, y int, t binary").collect())
    lists = [np.frombuffer(t, np.int32) for _, _, t in rows]
    text = np.repeat(np.arange(len(rows)), [len(x) for x in lists])
    return fit_machine(text, np.concatenate(lists).astype(np.int64), np.array([y for _, y, _ in rows], float), terms)


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def score_documents(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    A null or empty text has no terms and gets the score of the bias.  Without a fitted machine every score
    is 0.  Repeated rows each get a row; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch, lower=True):
                s = 1 / (1 + np.exp(-np.clip(machine.logits(*_known(c, machine.terms), c.n), -500, 500))) if machine else np.zeros(c.n)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(c.row0, c.n), batch.column("held_out").slice(c.row0, c.n), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return documents(docs).withColumn("held_out", fold(F.col("doc_id"), FOLDS) == 0).mapInArrow(run, SCHEMA)
