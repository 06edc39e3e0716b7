"""Vectorised views of many texts at once, for use inside Arrow map tasks.

A :class:`Chunk` holds the UTF-8 bytes of consecutive texts of one Arrow batch
without separators.  Words, lines and hashes of arbitrary byte ranges are
computed for the whole chunk with numpy, so no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer single text makes a chunk of its own.
CHUNK_BYTES = 1 << 21

_SEED = np.random.default_rng(20240229)
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}
#: Powers that are added at once, at least.
_POWERS = 1 << 16

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _power(kind: str, n: int) -> np.ndarray:
    """The first n powers modulo 2^64 of the hash base ('up') or its inverse ('down')."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        base = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        size = -(-(n - 1) // _POWERS) * _POWERS + 1
        out = np.full(size, base, np.uint64)
        out[0] = 1
        have = _powers[kind] = np.multiply.accumulate(out)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class Chunk:
    """UTF-8 bytes of texts row0..row0+n-1 of a batch, with their offsets."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, row0: int = 0, lower: bool = False):
        self.buf, self.offs, self.row0, self.n = (_LOWER[buf] if lower else buf), offs, row0, len(offs) - 1
        self._prefix: np.ndarray | None = None

    def prefix(self) -> np.ndarray:
        if self._prefix is None:
            h = np.zeros(len(self.buf) + 1, np.uint64)
            np.cumsum(_BYTE[self.buf] * _power("up", len(self.buf)), out=h[1:])
            self._prefix = h
        return self._prefix

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of buf[start:end]; equal bytes have equal hashes wherever they stand."""
        h = self.prefix()
        return mix((h[end] - h[start]) * _power("down", len(self.buf) + 1)[start] + (end - start).astype(np.uint64))

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, text index) of the maximal runs of bytes where inside holds, cut at text ends."""
        if not len(inside):
            z = np.zeros(0, np.int64)
            return z, z, z
        cut = np.zeros(len(inside) + 1, bool)
        cut[self.offs] = True
        start = inside.copy()
        start[1:] &= ~inside[:-1] | cut[1:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | cut[1:-1]
        s, e = np.flatnonzero(start), np.flatnonzero(last) + 1
        return s, e, np.searchsorted(self.offs, s, "right") - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words ``[^\\x20\\x09-\\x0D]+`` of every text."""
        return self.runs(~SPACE[self.buf])

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r"""(start, end, text index) of the \n-split lines, empty ones included; every text has one at least."""
        nl = np.flatnonzero(self.buf == 10)
        doc = np.searchsorted(self.offs, nl, "right") - 1
        s = np.concatenate([self.offs[:-1], nl + 1])
        d = np.concatenate([np.arange(self.n), doc])
        order = np.lexsort((s, d))
        s, d = s[order], d[order]
        e = np.concatenate([s[1:] - 1, s[:0]])
        e = np.append(e, 0)[: len(s)]
        final = np.append(d[1:] != d[:-1], True)[: len(d)]
        e[final] = self.offs[d[final] + 1]
        return s, e, d

    def per_text(self, doc: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        out = np.bincount(doc, weights, self.n)
        return out if weights is not None and weights.dtype.kind == "f" else out.astype(np.int64)


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty texts."""
    col = batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offs


def chunks(batch: pa.RecordBatch, name: str = "text", lower: bool = False, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The batch's texts in order, in chunks of at most limit bytes or one text."""
    buf, offs = column(batch, name)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n, lo + (1 << 16))
        yield Chunk(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], lo, lower)
        lo = hi


def repeats(group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows (group, key): how many rows share both, and whether an earlier row does."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    k = mix(key + group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(k)
    head = np.flatnonzero(np.append(True, k[order][1:] != k[order][:-1]))
    size = np.diff(np.append(head, len(k)))
    first = np.repeat(np.minimum.reduceat(order, head), size)
    count, later = np.empty(len(k), np.int64), np.empty(len(k), bool)
    count[order] = np.repeat(size, size)
    later[order] = first != order
    return count, later
