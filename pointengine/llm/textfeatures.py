"""Counts and ratios of whole texts and of their lines, for the models that judge quality."""

from __future__ import annotations

import numpy as np

from .textbytes import SPACE, Chunk, mix, repeats

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LEAD = (np.arange(256) & 0xC0) != 0x80

#: Bytes of text profiled at once; the running counts take some 32 bytes for each of them.
PROFILE_BYTES = 1 << 19

#: Names of the columns of Profile.lines(), in order.
LINE_FEATURES = ("symbols a character", "upper-case share of letters", "digits a character", "bars a word", "exclamations a word", "letters a character", "word length", "length", "repeats an earlier line", "repeated words", "ends a sentence")
#: Names of the columns of Profile.texts(), in order.
TEXT_FEATURES = (*LINE_FEATURES[:8], "repeated lines", "repeated words", "lines that end a sentence", "distinct words", "words a line")


class Profile:
    """All counts of a chunk's texts; every array has one entry a text, a line with a word, or a word."""

    def __init__(self, chunk: Chunk):
        self.chunk, buf = chunk, chunk.buf
        n = len(buf)

        def running(mask: np.ndarray) -> np.ndarray:
            out = np.zeros(n + 1, np.int32)  # a column of strings holds less than 2^31 bytes
            np.cumsum(mask, dtype=np.int32, out=out[1:])
            return out

        upper = _UPPER[buf]
        if n > 1:  # capitals of the Latin-1 block: 0xC3 and 0x80 to 0x9E
            upper[:-1] |= (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] < 0x9F)
        self._sum = {"chars": running(_LEAD[buf]), "solid": running(_LEAD[buf] & ~SPACE[buf]), "symbol": running(_SYMBOL[buf]), "upper": running(upper), "digit": running(_DIGIT[buf]), "bar": running(buf == 124), "bang": running(buf == 33), "alpha": running(_ALPHA[buf])}

        self.ws, self.we, self.wdoc = chunk.words()
        wh = chunk.hashes(self.ws, self.we)
        self.n_words = chunk.per_text(self.wdoc)
        _, again = repeats(self.wdoc, wh)
        self.n_distinct = self.n_words - chunk.per_text(self.wdoc[again])
        self.repeated = np.zeros(len(wh), bool)
        if len(wh) >= 3:
            whole = np.flatnonzero(self.wdoc[2:] == self.wdoc[:-2])
            window = mix(mix(wh[whole] + np.uint64(1)) + wh[whole + 1]) + wh[whole + 2]
            twice, _ = repeats(self.wdoc[whole], window)
            at = whole[twice > 1]
            for k in range(3):
                self.repeated[at + k] = True
        self.n_repeat_words = chunk.per_text(self.wdoc[self.repeated])

        ls, le, ld = chunk.lines()
        first = np.searchsorted(self.ws, ls)
        last = np.searchsorted(self.ws, le)
        keep = last > first
        self.ls, self.le, self.ldoc, self.lw0, self.lw1 = ls[keep], le[keep], ld[keep], first[keep], last[keep]
        _, self.line_again = repeats(self.ldoc, chunk.hashes(self.ls, self.le))
        self.n_lines = chunk.per_text(self.ldoc)
        self.n_dup_lines = chunk.per_text(self.ldoc[self.line_again])
        self.word_chars = self._between("solid", chunk.offs[:-1], chunk.offs[1:])
        self.n_symbols = self._between("symbol", chunk.offs[:-1], chunk.offs[1:])
        lastbyte = buf[self.we[self.lw1 - 1] - 1] if len(self.ls) else buf[:0]
        self.ends = np.isin(lastbyte, np.frombuffer(b".?!\"'", np.uint8))

    def _between(self, what: str, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self._sum[what][end] - self._sum[what][start]).astype(np.int64)

    def _ratios(self, s: np.ndarray, e: np.ndarray, words: np.ndarray) -> list[np.ndarray]:
        chars, solid, alpha = self._between("chars", s, e), self._between("solid", s, e), self._between("alpha", s, e)
        w, c, a = np.maximum(words, 1), np.maximum(solid, 1), np.maximum(alpha, 1)
        return [self._between("symbol", s, e) / c, self._between("upper", s, e) / a, self._between("digit", s, e) / c, np.minimum(self._between("bar", s, e) / w, 2), np.minimum(self._between("bang", s, e) / w, 2), alpha / c, np.minimum(solid / w, 30) / 10, np.log1p(chars) / 8]

    def lines(self) -> np.ndarray:
        """One row a line that has a word, in order of text and place."""
        words = self.lw1 - self.lw0
        rep = np.append(0, np.cumsum(self.repeated))
        own = (rep[self.lw1] - rep[self.lw0]) / np.maximum(words, 1)
        return np.column_stack([*self._ratios(self.ls, self.le, words), self.line_again, own, self.ends]).astype(np.float64)

    def texts(self) -> np.ndarray:
        """One row a text; a text without words has zeros."""
        o, w, n = self.chunk.offs, np.maximum(self.n_words, 1), np.maximum(self.n_lines, 1)
        ended = self.chunk.per_text(self.ldoc[self.ends])
        out = np.column_stack([*self._ratios(o[:-1], o[1:], self.n_words), self.n_dup_lines / n, self.n_repeat_words / w, ended / n, self.n_distinct / w, np.log1p(self.n_words / n) / 6])
        return np.where(self.n_words[:, None] > 0, out, 0.0)
