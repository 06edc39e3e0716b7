"""Byte-level BPE by forced-boundary splitting: encoding and decoding as the tokenizers library does with the same file.

A pair of bytes that stands next to each other in no vocabulary token is never merged over, so between its bytes there is a certain cut.
The vocabulary gives a table of 256 x 256 such pairs.  Word boundaries of the library's pre-tokenizer are certain cuts too; they follow from the
classes of characters (letter, number, space, other) by local rules, for a whole chunk of texts at once in numpy.  The fragments
between cuts are short and repeat all the time: each different one is encoded once, on its own, and the ids are concatenated in order of place.

A text of more than SEGMENT bytes is taken in segments that end before white space behind an ASCII letter or digit, which is a
certain cut whatever stands around it; so memory follows the segment and not the text, unless a text has no such place.

No shuffle; a lost task is run again.  The classes of non-ASCII characters are asked of the library itself as they turn up, so its Unicode
version counts.  Fragments are told apart by 128 bits of hashes.

Defined results: a null text is an empty one and has no tokens.  Strings of special tokens in a text become those tokens, as the library's default
has it; leftmost first.  A null doc_id stays null, rows that repeat an id or a text are each encoded.  An empty table gives no rows.  Other
columns than doc_id and text (or ids) are not looked at.  Nothing is ranked, so there are no ties.  decode() leaves out null and unknown ids, as the
library does, and bytes that are no UTF-8 become U+FFFD.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents
from .textbytes import Chunk, chunks, mix

#: Bytes of texts handled at once, and from which a single text is taken in segments.
CHUNK, SEGMENT = 1 << 20, 1 << 20
#: Different fragments whose ids a process remembers.
REMEMBERED = 1 << 20
_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3
_NONE = np.zeros(0, np.int32)


def _byte_alphabet() -> list[str]:
    """The character that stands for each byte in the file's vocabulary: printable Latin-1 ones stand for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, rest = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in out:
            out[b], rest = chr(rest), rest + 1
    return [out[b] for b in range(256)]


class ByteBpe:
    """The content of a tokenizer file of the kind byte-level BPE.  Goes to tasks as text; tables are built there once a process."""

    def __init__(self, text: str):
        self.text = text

    @classmethod
    def load(cls, path: str) -> ByteBpe:
        with open(path, encoding="utf-8") as f:
            return cls(f.read())

    def tables(self) -> _Tables:
        return _tables(self.text)


@lru_cache(maxsize=2)
def _tables(text: str) -> _Tables:
    return _Tables(json.loads(text))


class _Tables:
    def __init__(self, spec: dict):
        from tokenizers import models, pre_tokenizers

        pre, model = spec["pre_tokenizer"], spec["model"]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"] or model["type"] != "BPE" or model.get("ignore_merges"):
            raise ValueError("no byte-level BPE without prefix space and normaliser")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) for t in spec["added_tokens"]):
            raise ValueError("added tokens that look at their surroundings are not supported")
        self.alphabet = _byte_alphabet()
        back = {c: b for b, c in enumerate(self.alphabet)}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.bpe = models.BPE(vocab=model["vocab"], merges=merges)
        self.splitter = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.added = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.added_re = re.compile(b"|".join(map(re.escape, self.added))) if self.added else None
        own = {i: bytes(back[c] for c in s) for s, i in model["vocab"].items() if all(c in back for c in s)}
        tokens = own | {i: s for s, i in self.added.items()}
        size = max(tokens) + 1
        self.known = np.array([i in tokens for i in range(size)])
        lens = np.array([len(tokens.get(i, b"")) for i in range(size)])
        self.token_at = np.concatenate([[0], np.cumsum(lens)])
        self.token_bytes = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(size)), np.uint8)
        self.cut = np.ones((256, 256), bool)
        ids = np.array(sorted(own))
        inside = np.concatenate([np.arange(self.token_at[i], self.token_at[i + 1] - 1) for i in ids if lens[i] > 1])
        self.cut[self.token_bytes[inside], self.token_bytes[inside + 1]] = False
        self.classes = np.full(0x110000, 255, np.uint8)
        self.classify(np.arange(128))
        self.seen = _Seen()

    def classify(self, points: np.ndarray) -> None:
        """Asks the pre-tokenizer what it takes the characters for: they hang together with a letter, a digit, a mark, or none."""
        for p in points:
            c = chr(p)
            kinds = ((_LETTER, "x"), (_NUMBER, "1"), (_OTHER, "!"))
            self.classes[p] = next((k for k, s in kinds if len(self.splitter.pre_tokenize_str(s + c)) == 1), _SPACE)

    def merged(self, raw: bytes) -> list[int]:
        """Ids of one fragment, by merging in order of rank."""
        return [t.id for t in self.bpe.tokenize("".join([self.alphabet[b] for b in raw]))]

    def starts(self, buf: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Where fragments begin in bytes whose texts begin at heads: marks over bytes."""
        out = np.zeros(len(buf) + 1, bool)
        at = np.flatnonzero((buf & 0xC0) != 0x80)  # the first bytes of characters
        kind = self._kinds(buf, at)
        m = len(at)
        first = np.zeros(m + 1, bool)
        first[np.searchsorted(at, heads[heads < len(buf)])] = True
        first[m] = True
        blank = buf[at] == 0x20
        begin = first[:m].copy()
        begin[1:] |= kind[1:] != kind[:-1]
        last = np.append(begin[1:], True)  # of a run of one kind in one text
        space = kind == _SPACE
        follows = ~first[1:]  # the next character is of the same text
        ahead = space & last & follows  # the last space before something else
        begin |= ahead  # stands alone or goes with what follows
        begin[1:] &= ~(ahead & blank)[:-1]
        self._contractions(buf, at, begin, first)
        out[at[begin]] = True
        out[1:-1] |= self.cut[buf[:-1], buf[1:]]
        out[heads[heads < len(buf)]] = True
        out[-1] = True
        return out

    def _kinds(self, buf: np.ndarray, at: np.ndarray) -> np.ndarray:
        lead = buf[at]
        if lead.max(initial=0) < 0x80:
            return self.classes[lead]
        point = lead.astype(np.int32)
        pad = np.concatenate([buf, np.zeros(3, np.uint8)])
        for low, high, keep, n in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
            w = np.flatnonzero((lead >= low) & (lead < high))
            v = point[w] & keep
            for j in range(1, n + 1):
                v = (v << 6) | (pad[at[w] + j] & 0x3F)
            point[w] = v
        new = np.unique(point[self.classes[point] == 255])
        self.classify(new)
        return self.classes[point]

    @staticmethod
    def _contractions(buf: np.ndarray, at: np.ndarray, begin: np.ndarray, first: np.ndarray) -> None:
        """An apostrophe that begins a word goes with s, t, m, d, re, ve or ll behind it."""
        m = len(at)
        k = np.flatnonzero((buf[at] == 0x27) & begin)
        char = lambda i: np.where(i < m, buf[at[np.minimum(i, m - 1)]], 0)
        k = k[(k + 1 < m) & ~first[np.minimum(k + 1, m)]]
        one, two = char(k + 1), char(k + 2)
        two = np.where(first[np.minimum(k + 2, m)], 0, two)
        short = np.isin(one, list(b"stmd"))
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        begin[k[short | long] + 1] = False
        after = np.concatenate([k[short] + 2, k[long] + 3])
        begin[after[after < m]] = True

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts buf[offs[i]:offs[i+1]], concatenated, and where each text's begin."""
        n = len(offs) - 1
        if not len(buf):
            return _NONE, np.zeros(n + 1, np.int64)
        heads, marked = offs[:-1], {}
        if self.added_re:
            raw = buf.tobytes()
            for f in self.added_re.finditer(raw):
                i = int(np.searchsorted(offs, f.start(), "right")) - 1
                if f.end() <= offs[i + 1]:
                    marked[f.start()] = (f.end(), self.added[f.group()])
            if marked:
                heads = np.unique(np.concatenate([heads, list(marked), [e for e, _ in marked.values()]]))
        begin = self.starts(buf, heads)
        for s, (e, _) in marked.items():
            begin[s + 1 : e] = False
        edge = np.flatnonzero(begin)
        lo, hi = edge[:-1], edge[1:]
        chunk = Chunk(buf, np.array([0, len(buf)]))
        h = chunk.hashes(lo, hi)
        other = mix(np.bitwise_xor(_second(buf, lo, hi), h))
        key, rep, which = np.unique(h, return_index=True, return_inverse=True)
        odd = np.flatnonzero(other != other[rep][which])  # other fragments of the same hash
        at, size = self.seen.find(key, other[rep])
        new = np.concatenate([rep[at < 0], odd])
        raw = memoryview(np.ascontiguousarray(buf))
        pieces = [[marked[a][1]] if a in marked else self.merged(bytes(raw[a:b])) for a, b in zip(lo[new].tolist(), hi[new].tolist(), strict=True)]
        own = np.array([len(p) for p in pieces], np.int64)
        put = self.seen.put(np.array([i for p in pieces for i in p], np.int32)) + np.cumsum(own) - own
        k = int((at < 0).sum())
        fresh = np.flatnonzero(at < 0)
        at[fresh], size[fresh] = put[:k], own[:k]
        which[odd] = len(rep) + np.arange(len(odd))
        ids, put2 = _gather(self.seen.ids, np.concatenate([at, put[k:]])[which], np.concatenate([size, own[k:]])[which])
        self.seen.add(key, other[rep], fresh, at, size)
        return ids, put2[np.searchsorted(lo, offs)]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the tokens' bytes; what is no UTF-8 becomes U+FFFD."""
        ids = np.asarray(ids, np.int64)
        ids = ids[(ids >= 0) & (ids < len(self.known))]
        return _gather(self.token_bytes, self.token_at[ids], self.token_at[ids + 1] - self.token_at[ids])[0].tobytes().decode("utf-8", "replace").encode()

    def segments(self, buf: np.ndarray) -> Iterator[np.ndarray]:
        """A long text in parts that are encoded on their own."""
        lo = 0
        while lo < len(buf):
            hi = lo + SEGMENT
            while hi < len(buf):
                part = buf[hi - 1 : hi + (1 << 16)]
                alnum = ((part | 0x20) - 97 < 26) | (part - 48 < 10)
                good = np.flatnonzero(alnum[:-1] & ((part[1:] == 0x20) | (part[1:] == 0x0A)))
                if len(good):
                    hi += int(good[0])
                    break
                hi += 1 << 16
            yield buf[lo:hi]
            lo = hi


def _second(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A hash of byte ranges that has nothing in common with Chunk.hashes: sums of mixed (byte, place) pairs."""
    place = np.arange(len(buf), dtype=np.uint64) - np.repeat(lo, hi - lo).astype(np.uint64)
    return np.add.reduceat(mix((place << np.uint64(8)) | buf.astype(np.uint64)), lo) if len(lo) else np.zeros(0, np.uint64)


def _gather(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[at[i]:at[i]+size[i]] for every i, concatenated, and where each begins."""
    put = np.concatenate([[0], np.cumsum(size)])
    return flat[np.arange(put[-1]) + np.repeat(at - put[:-1], size)], put


class _Seen:
    """Ids of the fragments that a process has met, by their hashes; it starts anew where there are more than REMEMBERED."""

    def __init__(self) -> None:
        self.key = self.other = np.zeros(0, np.uint64)
        self.at = self.size = np.zeros(0, np.int64)
        self.ids = _NONE

    def find(self, key: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of the ids of each fragment; place -1 where it is new."""
        if len(self.key) + len(key) > REMEMBERED:
            self.__init__()
        if not len(self.key):
            return np.full(len(key), -1), np.zeros(len(key), np.int64)
        i = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        same = (self.key[i] == key) & (self.other[i] == other)
        return np.where(same, self.at[i], -1), self.size[i]

    def put(self, ids: np.ndarray) -> int:
        """Keeps ids and gives their place."""
        place, self.ids = len(self.ids), np.concatenate([self.ids, ids])
        return place

    def add(self, key: np.ndarray, other: np.ndarray, new: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
        where = np.searchsorted(self.key, key[new])
        self.key, self.other = np.insert(self.key, where, key[new]), np.insert(self.other, where, other[new])
        self.at, self.size = np.insert(self.at, where, at[new]), np.insert(self.size, where, size[new])


def _encoded(bpe: _Tables, batch: pa.RecordBatch) -> Iterator[list[Iterator[np.ndarray]]]:
    """For every text of the batch, in order, its ids in parts."""
    for chunk in chunks(batch, "text", limit=CHUNK):
        if chunk.n == 1 and len(chunk.buf) > SEGMENT:
            yield [(bpe.encode(s, np.array([0, len(s)]))[0] for s in bpe.segments(chunk.buf))]
        else:
            ids, at = bpe.encode(chunk.buf, chunk.offs)
            yield [iter((ids[a:b],)) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    yield from (batch.slice(k, 1024) for k in range(0, len(batch), 1024))


def encode(docs: DataFrame, bpe: ByteBpe) -> DataFrame:
    """(doc_id, n_tokens, ids): every text's token ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in _pieces(b)):
            ids = [np.concatenate([_NONE, *parts]) for texts in _encoded(bpe.tables(), batch) for parts in texts]
            n = np.array([len(i) for i in ids], np.int64)
            flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.concatenate([_NONE, *ids])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), flat], ["doc_id", "n_tokens", "ids"])

    return documents(docs).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, bpe: ByteBpe) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in _pieces(b)):
            ids = (np.array(v.values.fill_null(-1) if v.is_valid else _NONE, np.int64) for v in batch.column("ids"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([bpe.tables().decode(i).decode() for i in ids], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, bpe: ByteBpe) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode() and decode() in one pass, with SHA-256 sums in place of ids and texts.

    Ids are hashed as little-endian unsigned 32-bit integers, the decoded text as UTF-8; both are hashed as segments go by.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, count, sums, decoded = bpe.tables(), [], [], []
            for parts in (p for texts in _encoded(t, batch) for p in texts):
                n, a, b = 0, hashlib.sha256(), hashlib.sha256()
                for ids in parts:
                    n += len(ids)
                    a.update(ids.astype("<u4"))
                    b.update(t.decode(ids))  # segments end between characters
                count.append(n)
                sums.append(a.hexdigest())
                decoded.append(b.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(sums, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
