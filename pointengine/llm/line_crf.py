"""Operator 1: quality rules by a linear-chain conditional random field over lines.

Lines are a sequence of content (1) or boilerplate (0).  Unary potentials come from
line features, pairwise ones from neighbouring labels; Viterbi decoding marks the lines
and the share of words in content lines decides whether a document stays.  Only documents are labelled, so
the lines' labels are latent: a document's label bounds the share of content among its lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents, where_text
from .sampling import labelled, with_text
from .textbytes import Chunk, chunks
from .textfeatures import LINE_FEATURES, PROFILE_BYTES, Profile

#: Documents of each label that the field is fitted on, at most, and the lines of a window; longer documents come as several windows.
FIT_DOCS = 1000
FIT_LINES = 40
#: A document stays if this share of its words stands in content lines.
CONTENT_SHARE = 0.5
#: In the fit, a good document has at least this share of content lines, a bad one at most what is left.
MOST = 0.8


@dataclass(frozen=True)
class LineField:
    """score(line) for content over boilerplate, bias last; start[y]; move[y, y']."""

    weights: np.ndarray
    start: np.ndarray
    move: np.ndarray

    @staticmethod
    def plain() -> LineField:
        """The field used without labelled rows: every line is content."""
        w = np.zeros(len(LINE_FEATURES) + 1)
        w[-1] = 1.0
        return LineField(w, np.zeros(2), np.zeros((2, 2)))


def _marginals(un: np.ndarray, start: np.ndarray, move: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward: P(label) of every line, and P(both labels) of neighbouring lines; 0 where there is no line."""
    b, t = mask.shape
    alpha, beta = np.zeros((b, t, 2)), np.zeros((b, t, 2))
    alpha[:, 0] = un[:, 0] + start
    for i in range(1, t):
        step = np.logaddexp(alpha[:, i - 1, :1] + move[0], alpha[:, i - 1, 1:] + move[1]) + un[:, i]
        alpha[:, i] = np.where(mask[:, i, None], step, alpha[:, i - 1])
    for i in range(t - 2, -1, -1):
        nxt = un[:, i + 1] + beta[:, i + 1]
        step = np.logaddexp(nxt[:, :1] + move[:, 0], nxt[:, 1:] + move[:, 1])
        beta[:, i] = np.where(mask[:, i + 1, None], step, beta[:, i + 1])
    z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])[:, None]
    one = np.exp(alpha + beta - z[..., None]) * mask[..., None]
    two = alpha[:, :-1, :, None] + move + (un + beta)[:, 1:, None, :] - z[..., None, None]
    return one, np.exp(np.minimum(two, 0)) * mask[:, 1:, None, None]


def _tilted(un: np.ndarray, start: np.ndarray, move: np.ndarray, mask: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals that keep to the documents' labels: the nearest ones in which a good text has at least MOST of its lines as
    content, and a bad one at most 1 - MOST.  A tilt of all its lines, found by bisection, brings a text there."""
    size = mask.sum(1)
    lo, hi = np.where(good, 0.0, -30.0), np.where(good, 30.0, 0.0)
    far = np.where(good, lo, hi)  # no tilt, if that will do

    def at(tilt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        u = un.copy()
        u[:, :, 1] += tilt[:, None]
        one, two = _marginals(u, start, move, mask)
        return one, two, one[:, :, 1].sum(1) / size

    share = at(far)[2]
    done = np.where(good, share >= MOST, share <= 1 - MOST)
    want = np.where(good, MOST, 1 - MOST)
    for _ in range(14):
        mid = (lo + hi) / 2
        low = at(mid)[2] < want
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    one, two, _ = at(np.where(done, far, (lo + hi) / 2))
    return one, two


def fit_field(x: np.ndarray, mask: np.ndarray, good: np.ndarray, rounds: int = 5, steps: int = 40, rate: float = 0.08, decay: float = 1e-3) -> LineField:
    """Latent line labels under document labels.  x: (texts, lines, features); mask: (texts, lines); good: (texts,).

    First the line scores alone are fitted with each line labelled as its text.  Then rounds of expectation, in which the
    texts' labels only bound the share of content among their lines, and of maximum likelihood of the whole field by
    forward-backward and Adam, so a line of junk in a good text may become boilerplate, and labels may change within a text.
    """
    b, t, f = x.shape
    x = np.concatenate([x, np.ones((b, t, 1))], 2)
    theta, m, v = np.zeros(f + 1 + 2 + 4), np.zeros(f + 7), np.zeros(f + 7)
    k, lines = 0, mask.sum()

    def descend(g: np.ndarray) -> None:
        nonlocal theta, m, v, k
        k += 1
        g = g / lines + decay * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)

    def parts() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.stack([np.zeros((b, t)), x @ theta[: f + 1]], 2), theta[f + 1 : f + 3], theta[f + 3 :].reshape(2, 2)

    def counts(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return np.concatenate([np.einsum("btf,bt->f", x, one[:, :, 1]), one[:, 0].sum(0), two.sum((0, 1)).ravel()])

    for _ in range(2 * steps):
        p = 1 / (1 + np.exp(-(x @ theta[: f + 1])))
        descend(np.append(np.einsum("btf,bt->f", x, mask * (p - good[:, None])), np.zeros(6)))
    for _ in range(rounds):
        real = counts(*_tilted(*parts(), mask, good.astype(bool)))
        for _ in range(steps):
            descend(counts(*_marginals(*parts(), mask)) - real)
    return LineField(theta[: f + 1], theta[f + 1 : f + 3], theta[f + 3 :].reshape(2, 2))


def viterbi(field: LineField, x: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Best labels of the lines x, whose texts are numbered ascending; all texts advance together.  Ties go to content."""
    n = len(x)
    if not n:
        return np.zeros(0, np.int8)
    un = np.column_stack([np.zeros(n), x @ field.weights[:-1] + field.weights[-1]])
    head = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    size = np.diff(np.append(head, n))
    order = np.argsort(-size, kind="stable")
    head, size = head[order], size[order]
    best, back = un[head] + field.start, np.zeros((n, 2), np.int8)
    for i in range(1, int(size[0])):
        live = int(np.searchsorted(-size, -i, "left"))
        come = best[:live, :, None] + field.move
        back[head[:live] + i] = come[:, 1] >= come[:, 0]
        best[:live] = np.maximum(come[:, 0], come[:, 1]) + un[head[:live] + i]
    out = np.zeros(n, np.int8)
    now = (best[:, 1] >= best[:, 0]).astype(np.int8)
    for i in range(int(size[0]) - 1, -1, -1):
        live = int(np.searchsorted(-size, -i, "left"))
        at = head[:live] + i
        out[at] = now[:live]
        now[:live] = back[at, now[:live]]
    return out


def _sample_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ys = batch.column("y").to_numpy()
        for c in chunks(batch, limit=PROFILE_BYTES):
            p = Profile(c)
            x, cut = p.lines().astype(np.float32), np.append(0, np.cumsum(p.n_lines))
            windows = [(i, lo, min(lo + FIT_LINES, int(cut[i + 1]))) for i in range(c.n) for lo in range(int(cut[i]), int(cut[i + 1]), FIT_LINES)]
            yield pa.RecordBatch.from_arrays([pa.array([int(ys[c.row0 + i]) for i, _, _ in windows], pa.int32()), pa.array([x[lo:hi].tobytes() for _, lo, hi in windows], pa.binary())], ["y", "x"])


def fit(docs: DataFrame, labels: DataFrame) -> LineField:
    """Fit on at most FIT_DOCS documents of either quality label outside fold 0, all their lines in windows of FIT_LINES.

    docs has to be the table that was labelled, not one that a filter has been over: what is gone gives no boilerplate
    to learn from.  With no labelled document of either kind, every line is content.
    """
    ids = labelled(labels, "quality", 1, FIT_DOCS).unionByName(labelled(labels, "quality", 0, FIT_DOCS))
    rows = with_text(docs, ids).mapInArrow(_sample_lines, "y int, x binary").collect()
    if len({r.y for r in rows}) < 2:
        return LineField.plain()
    rows.sort(key=lambda r: (r.y, bytes(r.x)))
    seqs = [np.frombuffer(r.x, np.float32).reshape(-1, len(LINE_FEATURES)) for r in rows]
    t = max(map(len, seqs))
    x, mask = np.zeros((len(seqs), t, len(LINE_FEATURES))), np.zeros((len(seqs), t), bool)
    for i, s in enumerate(seqs):
        x[i, : len(s)], mask[i, : len(s)] = s, True
    return fit_field(x, mask, np.array([r.y for r in rows]))


RULES_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, content_lines long, content_words long"


def _verdict(field: LineField, c: Chunk, p: Profile) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(labels of all lines; of each text: words in content lines, whether the base rule fails, whether it is kept)."""
    y = viterbi(field, p.lines(), p.ldoc)
    good = c.per_text(np.repeat(p.ldoc[y == 1], (p.lw1 - p.lw0)[y == 1]))
    failed = (p.n_words < 50) | (100 * p.n_repeat_words > 50 * p.n_words)
    return y, good, failed, ~failed & (good >= CONTENT_SHARE * p.n_words)


def rule_documents(docs: DataFrame, field: LineField) -> DataFrame:
    """One row a document: the base counts, the lines the field calls content, and the verdict.

    kept: not base_failed, and CONTENT_SHARE of the words or more stand in content lines.  A null or empty
    text has no words and fails the base rule.  Repeated rows each get a row; other columns are ignored.
    """
    w = field

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [s.split()[0] for s in RULES_SCHEMA.split(", ")]
        for batch in batches:
            ids = batch.column("doc_id")
            for c in chunks(batch, limit=PROFILE_BYTES):
                p = Profile(c)
                y, good, failed, kept = _verdict(w, c, p)
                cols = [p.n_words, p.word_chars, p.n_symbols, p.n_dup_lines, p.n_repeat_words, failed, kept, p.n_lines, c.per_text(p.ldoc[y == 1]), good]
                yield pa.RecordBatch.from_arrays([ids.slice(c.row0, c.n), *map(pa.array, cols)], names)

    return documents(docs).mapInArrow(score, RULES_SCHEMA)


def content_lines(docs: DataFrame, field: LineField) -> DataFrame:
    """doc_id, line (from 0 among lines with a word), start, end (byte offsets in the text), content: the field's marks."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for c in chunks(batch, limit=PROFILE_BYTES):
                p = Profile(c)
                y = viterbi(field, p.lines(), p.ldoc)
                line = np.arange(len(p.ldoc)) - (np.cumsum(p.n_lines) - p.n_lines)[p.ldoc]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(p.ldoc + c.row0)), pa.array(line), pa.array(p.ls - c.offs[p.ldoc]), pa.array(p.le - c.offs[p.ldoc]), pa.array(y == 1)], ["doc_id", "line", "start", "end", "content"])

    return documents(docs).mapInArrow(mark, "doc_id long, line long, start long, end long, content boolean")


def kept_documents(docs: DataFrame, field: LineField) -> DataFrame:
    """The rows that the rules keep, with all their columns; each is judged by its own text, whatever its doc_id."""

    def accepts(batch: pa.RecordBatch) -> Iterator[list[bool]]:
        for c in chunks(batch, limit=PROFILE_BYTES):
            yield _verdict(field, c, Profile(c))[3].tolist()

    return where_text(docs, accepts)


__all__ = ["LineField", "content_lines", "fit", "fit_field", "kept_documents", "rule_documents", "viterbi"]
