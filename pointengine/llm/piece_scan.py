"""Operator 6: SentencePiece encoding and decoding with a max-plus scan for giant documents.

A text, with one space before it and spaces as word marks, is cut into pieces of a public vocabulary so that the sum of
their scores is greatest.  The vocabulary file holds merge ranks, not probabilities, so a piece's score is the logarithm
of Zipf's law at its rank, in whole 65536ths; single bytes are the way out for everything else.  Sums are whole numbers,
so they are exact in any order of adding, and of equal sums the cut with the shorter last piece counts, at every place.
Both ways below give this one cut.

No piece reaches over the start of a word, so words are cut on their own: equal words of a chunk once, all words of a
chunk side by side.  A giant text is cut into chunks, which Spark deals out.  The state between two chunks is how far the
piece on the border reaches; a chunk is a matrix of best scores from state to state, matrices are combined associatively
within a task and again over the chunks of a text, and once the border scores are known every chunk is traced back on
its own, for any state it may be left in.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialise
from .textbytes import Chunk, chunks

#: The vocabulary: a SentencePiece model file, described in the README.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Texts of more bytes are dealt out in chunks; texts with a longer word are scanned in one task.  Neither changes a result.
GIANT = 1 << 16
LONG_WORD = 512
#: Bytes of a chunk that a task gets, and of the parts that it scans side by side.
DEALT = 1 << 16
CHUNK = 512
#: Parts whose tables are held at once.
HELD = 64
#: Units of a score.
QUANTUM = 1 << 16
_NONE, _NONE32 = -(1 << 60), -(1 << 30)


@dataclass(frozen=True)
class Vocabulary:
    """Pieces as bytes with a space for the word mark; scores are natural logarithms."""

    pieces: tuple[bytes, ...]
    scores: np.ndarray
    byte_ids: np.ndarray
    byte_score: float

    @staticmethod
    def load(path: str) -> Vocabulary:
        """From a SentencePiece model file; without it no text can be encoded."""
        import os

        import sentencepiece

        if not os.path.isfile(path):
            raise FileNotFoundError(f"no SentencePiece model at {path}; give the path of one")
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        pieces, scores, byte_ids = [b""] * n, np.full(n, -np.inf), np.zeros(256, np.int64)
        rank = 0
        total = np.log(np.log(n) + 0.5772)
        for i in range(n):
            p = m.id_to_piece(i)
            if m.is_byte(i):
                byte_ids[int(p[3:5], 16)] = i
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                rank += 1
                pieces[i], scores[i] = p.replace("▁", " ").encode(), -np.log(rank) - total
        low = -2 * np.log(n) - total
        for b, i in enumerate(byte_ids):
            pieces[i] = bytes([b])
            scores[i] = low
        return Vocabulary(tuple(pieces), scores, byte_ids, float(low))


class Lattice:
    """Lookup of the pieces that start at any place, prepared once a task."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.units = np.where(np.isfinite(v.scores), np.rint(np.maximum(v.scores, -1e3) * QUANTUM), 0).astype(np.int64)
        self.byte_units = int(round(v.byte_score * QUANTUM))
        real = [i for i, p in enumerate(v.pieces) if p and self.units[i] > self.byte_units and np.isfinite(v.scores[i])]
        self.longest = max((len(v.pieces[i]) for i in real), default=1)
        buf = np.frombuffer(b"".join(v.pieces[i] for i in real), np.uint8)
        size = np.array([len(v.pieces[i]) for i in real], np.int64)
        start = np.cumsum(size) - size
        h = Chunk(buf, np.array([0, len(buf)])).hashes(start, start + size)
        self.tables = {}
        self.maybe = {}  # by a hash's first 18 bits: whether any piece of the length can be meant
        for n in range(1, self.longest + 1):
            own = np.flatnonzero(size == n)
            if len(own):
                order = own[np.argsort(h[own])]
                self.maybe[n] = np.zeros(1 << 18, bool)
                self.maybe[n][h[own] >> np.uint64(46)] = True
                self.tables[n] = (h[order], np.array(real)[order], self.units[np.array(real)[order]])
        self.flat = np.frombuffer(b"".join(v.pieces), np.uint8)
        self.size = np.array([len(p) for p in v.pieces], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def scores(self, c: Chunk, room: np.ndarray, kind: type = np.int64) -> dict[int, np.ndarray]:
        """Length, ascending -> score of the piece of that length at each place; room: bytes up to where pieces must end."""
        none = _NONE if kind is np.int64 else _NONE32
        out = {1: np.full(len(c.buf), self.byte_units, kind)}
        for n, (keys, _, sc) in self.tables.items():
            s = np.full(len(c.buf), none, kind)
            at = np.flatnonzero(room >= n)
            if len(at):
                h = c.hashes(at, at + n)
                may = np.flatnonzero(self.maybe[n][h >> np.uint64(46)])
                at, h = at[may], h[may]
                k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[k] == h
                s[at[hit]] = sc[k[hit]]
            out[n] = np.maximum(s, out[1]) if n == 1 else s
        return out

    def ids(self, c: Chunk, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Ids of the pieces at these places; a byte without a piece of its own has its byte piece."""
        out = self.v.byte_ids[c.buf[start]]
        for n, (keys, ids, _) in self.tables.items():
            own = np.flatnonzero(size == n)
            if len(own):
                h = c.hashes(start[own], start[own] + n)
                k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[k] == h
                out[own[hit]] = ids[k[hit]]
        return out

    def total(self, ids: np.ndarray) -> float:
        return float(self.units[ids].sum()) / QUANTUM

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.size[ids]
        at = np.repeat(self.start[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.flat[at].tobytes()

    # -------------------------------------------------------------------------------------------------- words

    def cut_words(self, c: Chunk, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, place, size) of the pieces of many words of LONG_WORD bytes at most, in order; all words advance together."""
        size = end - start
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        room = np.zeros(len(c.buf), np.int64)
        at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        room[at] = np.repeat(start + size, size) - at
        s = self.scores(c, room, np.int32)
        longest = int(size[0]) if len(size) else 0
        best = np.full((longest + 1, len(size)), _NONE32, np.int32)
        back = np.zeros((longest + 1, len(size)), np.int16)
        best[:1] = 0
        for e in range(1, longest + 1):
            live = int(np.searchsorted(-size, -e, "right"))
            for n in s:
                if n <= e:
                    cand = best[e - n, :live] + s[n][start[:live] + e - n]
                    win = cand > best[e, :live]
                    best[e, :live][win] = cand[win]
                    back[e, :live][win] = n
        word, place, took = [], [], []
        left, who = size.copy(), np.arange(len(size))
        while len(who):
            n = back[left[who], who].astype(np.int64)
            left[who] -= n
            word.append(who), place.append(start[who] + left[who]), took.append(n)
            who = who[left[who] > 0]
        if not word:
            z = np.zeros(0, np.int64)
            return z, z, z
        word, place, took = order[np.concatenate(word)], np.concatenate(place), np.concatenate(took)
        o = np.lexsort((place, word))
        return word[o], place[o], took[o]

    # ------------------------------------------------------------------------------------------- max-plus scan

    def part_size(self, size: int = CHUNK) -> int:
        return max(size, self.longest)

    def _tables(self, text: np.ndarray, lo: int, hi: int, size: int) -> dict[int, np.ndarray]:
        """Piece scores of the parts lo..hi; places behind the text's end cost nothing and take one byte each."""
        a, want = lo * size, (hi - lo) * size
        own = np.ascontiguousarray(text[a : a + want + self.longest])
        out = {}
        for n, v in self.scores(Chunk(own, np.array([0, len(own)])), len(own) - np.arange(len(own))).items():
            v = v[:want]
            out[n] = np.append(v, np.full(want - len(v), 0 if n == 1 else _NONE, np.int64)).reshape(hi - lo, size)
        return out

    def _forward(self, s: dict[int, np.ndarray], init: np.ndarray, size: int, trace: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Best scores at every place of parts, entered with the scores init (state, part, way); back: the size of the last
        piece, 0 where the part was entered."""
        states, k, ways = init.shape
        far = size + self.longest
        best = np.full((far, k, ways), _NONE, np.int64)
        back = np.zeros((far, k, ways), np.int16) if trace else None
        for t in range(far):
            for n in s:
                if 0 <= t - n < size:
                    cand = best[t - n] + s[n][:, t - n, None]
                    if trace:
                        back[t][cand > best[t]] = n
                    best[t] = np.maximum(best[t], cand)
            if t < states:
                if trace:
                    back[t][init[t] > best[t]] = 0
                best[t] = np.maximum(best[t], init[t])
        return best, back

    def matrices(self, text: np.ndarray, k: int, size: int) -> np.ndarray:
        """(part, state before, state behind): best scores of k parts; text goes on behind them as far as pieces reach."""
        states = self.longest
        out = np.empty((k, states, states), np.int64)
        one = np.full((states, 1, states), _NONE, np.int64)
        one[np.arange(states), 0, np.arange(states)] = 0
        for lo in range(0, k, HELD):
            hi = min(k, lo + HELD)
            best, _ = self._forward(self._tables(text, lo, hi, size), np.repeat(one, hi - lo, 1), size, False)
            out[lo:hi] = best[size : size + states].transpose(1, 2, 0)
        return out

    def traced(self, text: np.ndarray, reach: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(back, entry): back pointers of the parts entered with scores reach (part, state), and the state in which a part was
        entered for every state it is left in."""
        k, states = reach.shape
        back = np.empty((size + self.longest, k), np.int16)
        for lo in range(0, k, HELD):
            hi = min(k, lo + HELD)
            _, b = self._forward(self._tables(text, lo, hi, size), reach[lo:hi].T[:, :, None], size, True)
            back[:, lo:hi] = b[:, :, 0]
        t, part = np.repeat(size + np.arange(states)[None], k, 0), np.arange(k)[:, None]
        while True:
            n = back[t, part]
            if not n.any():
                return back, np.where(t < states, t, 0)
            t = t - n

    def pieces(self, back: np.ndarray, entry: np.ndarray, leave: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, size) of the pieces that start in the parts, in order, where the last part is left in state ``leave``."""
        k = entry.shape[0]
        out = np.zeros(k, np.int64)
        for i in range(k - 1, -1, -1):
            out[i] = leave
            leave = int(entry[i, leave])
        t, who, places, sizes = size + out, np.arange(k), [], []
        while len(who):
            n = back[t[who], who].astype(np.int64)
            who, n = who[n > 0], n[n > 0]
            t[who] -= n
            places.append(who * size + t[who]), sizes.append(n)
        place, took = np.concatenate(places), np.concatenate(sizes)
        o = np.argsort(place)
        return place[o], took[o]

    def first(self) -> np.ndarray:
        """Scores of the states at the start of a text."""
        out = np.full(self.longest, _NONE, np.int64)
        out[0] = 0
        return out

    def cut_giant(self, text: np.ndarray, size: int = CHUNK) -> tuple[np.ndarray, np.ndarray, float]:
        """(place, size) of the best pieces of one text, and their score, by transfer matrices of its parts."""
        size = self.part_size(size)
        k = max(1, -(-len(text) // size))
        reach = reaches(self.first(), self.matrices(text, k, size))
        back, entry = self.traced(text, reach[:k], size)
        place, took = self.pieces(back, entry, 0, size)
        real = place < len(text)
        return place[real], took[real], float(reach[k, 0]) / QUANTUM


def combined(m: np.ndarray) -> np.ndarray:
    """The max-plus product of matrices, associatively: neighbours in pairs, until one is left."""
    while len(m) > 1:
        pairs = np.maximum((m[0 : len(m) - 1 : 2, :, :, None] + m[1::2, None]).max(2), _NONE)
        m = np.concatenate([pairs, m[len(m) - 1 :]]) if len(m) % 2 else pairs
    return m[0]


def reaches(start: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Best scores of the states before each matrix and behind the last."""
    out = np.empty((len(m) + 1, len(start)), np.int64)
    out[0] = start
    for i, x in enumerate(m):
        out[i + 1] = np.maximum((out[i][:, None] + x).max(0), _NONE)
    return out


def _marked(c: Chunk) -> Chunk:
    """The chunk with one space before every text that has a byte."""
    size = np.diff(c.offs)
    add = (size > 0).astype(np.int64)
    offs = np.append(0, np.cumsum(size + add))
    out = np.full(offs[-1], 32, np.uint8)
    out[np.arange(len(c.buf)) + np.repeat(np.cumsum(add), size)] = c.buf
    return Chunk(out, offs, c.row0)


def encode_chunk(lat: Lattice, c: Chunk, giant: int = 1 << 62) -> tuple[list[np.ndarray], np.ndarray]:
    """Ids of every text of a chunk, and the score of each text's pieces; texts above ``giant`` bytes are scanned."""
    m = _marked(c)
    space = m.buf == 32
    head = np.zeros(len(m.buf), bool)
    head[m.offs[:-1][np.diff(m.offs) > 0]] = True
    head[1:] |= space[1:] & ~space[:-1]
    start = np.flatnonzero(head)
    end = np.append(start[1:], len(m.buf))
    text = np.searchsorted(m.offs, start, "right") - 1
    scan = np.diff(m.offs) > giant
    scan[text[end - start > LONG_WORD]] = True
    plain = ~scan[text]
    start, end, text = start[plain], end[plain], text[plain]
    h = m.hashes(start, end)
    _, first, kind = np.unique(h, return_index=True, return_inverse=True)
    size = end[first] - start[first]
    edge = np.append(0, np.cumsum(size))
    w = Chunk(m.buf[np.repeat(start[first] - edge[:-1], size) + np.arange(edge[-1])], np.array([0, edge[-1]]))
    word, place, size = lat.cut_words(w, edge[:-1], edge[1:])
    ids = lat.ids(w, place, size)
    cut = np.searchsorted(word, np.arange(len(first) + 1))
    n = np.diff(cut)[kind]
    flat = ids[np.repeat(cut[kind] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    edge = np.searchsorted(np.repeat(text, n), np.arange(c.n + 1))
    out = [flat[edge[i] : edge[i + 1]] for i in range(c.n)]
    for i in np.flatnonzero(scan):
        own = m.buf[m.offs[i] : m.offs[i + 1]]
        place, size, _ = lat.cut_giant(own)
        out[i] = lat.ids(Chunk(own, np.array([0, len(own)])), place, size)
    return out, np.array([lat.total(x) for x in out])


# ------------------------------------------------------------------------------------------------ giant texts


def _deal(longest: int, size: int):
    """Chunks of giant texts: rows (rid, k, part, own): own bytes, and behind them those that a piece can reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, text in zip(batch.column("rid").to_pylist(), batch.column("text"), strict=True):
                b = b" " + text.as_py().encode()
                for k, lo in enumerate(range(0, len(b), size)):
                    yield pa.RecordBatch.from_arrays([pa.array([rid]), pa.array([k], pa.int32()), pa.array([b[lo : lo + size + longest]], pa.binary()), pa.array([min(size, len(b) - lo)], pa.int32())], ["rid", "k", "part", "own"])

    return run


def _reach(table: pa.Table) -> pa.Table:
    """Border scores before each chunk of one text, from the chunks' matrices."""
    t = table.sort_by("k")
    s = int(round((len(t.column("matrix")[0].as_py()) // 8) ** 0.5))
    start = np.full(s, _NONE, np.int64)
    start[0] = 0
    m = np.stack([np.frombuffer(x, np.int64).reshape(s, s) for x in t.column("matrix").to_pylist()])
    return pa.table({"rid": t.column("rid"), "k": t.column("k"), "reach": pa.array([x.tobytes() for x in reaches(start, m)[:-1]], pa.binary())})


def _leaves(table: pa.Table) -> pa.Table:
    """The state that each chunk of one text is left in, from the last chunk back."""
    t = table.sort_by("k")
    out, state = [0] * len(t), 0
    for i, e in reversed(list(enumerate(t.column("entry").to_pylist()))):
        out[i] = state
        state = int(np.frombuffer(e, np.int64)[state])
    return pa.table({"rid": t.column("rid"), "k": t.column("k"), "leave": pa.array(out, pa.int32())})


class _Dealt:
    """The steps over the chunks of giant texts, each one Arrow map."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.lat: Lattice | None = None

    def __getstate__(self) -> dict:
        return {"vocabulary": self.vocabulary, "lat": None}

    def _rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray, int, int]]:
        self.lat = self.lat or Lattice(self.vocabulary)
        size = self.lat.part_size()
        for batch in batches:
            for r in batch.to_pylist():
                yield r, np.frombuffer(r["part"], np.uint8), max(1, -(-r["own"] // size)), size

    def matrix(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, text, k, size in self._rows(batches):
            m = combined(self.lat.matrices(text, k, size))
            yield pa.RecordBatch.from_arrays([pa.array([r["rid"]]), pa.array([r["k"]], pa.int32()), pa.array([m.tobytes()], pa.binary())], ["rid", "k", "matrix"])

    def _trace(self, r: dict, text: np.ndarray, k: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        m = self.lat.matrices(text, k, size)
        return self.lat.traced(text, reaches(np.frombuffer(r["reach"], np.int64), m)[:k], size)

    def entries(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, text, k, size in self._rows(batches):
            _, entry = self._trace(r, text, k, size)
            state = np.arange(entry.shape[1])
            for row in entry[::-1]:
                state = row[state]
            yield pa.RecordBatch.from_arrays([pa.array([r["rid"]]), pa.array([r["k"]], pa.int32()), pa.array([state.astype(np.int64).tobytes()], pa.binary())], ["rid", "k", "entry"])

    def ids(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, text, k, size in self._rows(batches):
            back, entry = self._trace(r, text, k, size)
            place, took = self.lat.pieces(back, entry, r["leave"], size)
            real = place < r["own"]
            ids = self.lat.ids(Chunk(text, np.array([0, len(text)])), place[real], took[real])
            yield pa.RecordBatch.from_arrays([pa.array([r["rid"]]), pa.array([r["k"]], pa.int32()), pa.array([ids.astype(np.int32)], pa.list_(pa.int32())), pa.array([int(self.lat.units[ids].sum())])], ["rid", "k", "ids", "units"])


def giant_ids(big: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(rid, ids, score) of giant texts (rid, text), whose chunks Spark deals out."""
    lat = Lattice(vocabulary)
    size = lat.part_size() * max(1, DEALT // lat.part_size())
    steps = _Dealt(vocabulary)
    wide = 4 * big.sparkSession.sparkContext.defaultParallelism
    parts = materialise(big.select("rid", "text").mapInArrow(_deal(lat.longest, size), "rid long, k int, part binary, own int").repartition(wide, "rid", "k"))
    reach = parts.mapInArrow(steps.matrix, "rid long, k int, matrix binary").groupBy("rid").applyInArrow(_reach, "rid long, k int, reach binary")
    known = materialise(parts.join(reach, ["rid", "k"]))
    leave = known.mapInArrow(steps.entries, "rid long, k int, entry binary").groupBy("rid").applyInArrow(_leaves, "rid long, k int, leave int")
    cut = known.join(leave, ["rid", "k"]).mapInArrow(steps.ids, "rid long, k int, ids array<int>, units long")
    lists = cut.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("x"), F.sum("units").alias("units"))
    return lists.select("rid", F.flatten(F.col("x.ids")).alias("ids"), (F.col("units") / F.lit(float(QUANTUM))).alias("score"))


def _split(docs: DataFrame, giant: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows for one task each, and the giant ones (rid, doc_id, text), None if there are none."""
    d = documents(docs)
    large = F.octet_length("text") >= giant
    big = materialise(d.where(large).select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text"))
    return d.where(~large), big if big.limit(1).count() else None


def encode(docs: DataFrame, vocabulary: Vocabulary, giant: int = GIANT) -> DataFrame:
    """doc_id, ids, score for every row.

    A null or empty text has no ids and score 0.  Repeated rows each get a row; other columns are ignored.  giant: bytes
    from which a text is dealt out in chunks; it does not change the ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = Lattice(vocabulary)
        for batch in batches:
            for c in chunks(batch, limit=1 << 22):
                ids, score = encode_chunk(lat, c)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(c.row0, c.n), pa.array(ids, pa.list_(pa.int32())), pa.array(score)], ["doc_id", "ids", "score"])

    small, big = _split(docs, giant)
    out = small.mapInArrow(run, "doc_id long, ids array<int>, score double")
    return out if big is None else out.unionByName(big.join(giant_ids(big, vocabulary), "rid").select("doc_id", "ids", "score"))


def decode(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, text for rows (doc_id, ids): the exact inverse of encode; null or no ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = Lattice(vocabulary)
        for batch in batches:
            texts = [lat.decode(np.asarray(v, np.int64))[1:] if v else b"" for v in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


_DIGEST = "doc_id long, n_bytes long, n_tokens long, score double, ids_crc32 long, round_trip boolean"


def _digested(lat: Lattice, doc_id: pa.Array, texts: list[bytes], ids: list[np.ndarray], score: np.ndarray) -> pa.RecordBatch:
    same = [lat.decode(x)[1:] == t for x, t in zip(ids, texts, strict=True)]
    crc = [zlib.crc32(x.astype("<i4").tobytes()) for x in ids]
    return pa.RecordBatch.from_arrays([doc_id, pa.array([len(t) for t in texts], pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array(score, pa.float64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], [x.split()[0] for x in _DIGEST.split(", ")])


def digest(docs: DataFrame, vocabulary: Vocabulary, giant: int = GIANT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, score, ids_crc32, round_trip: what encode() gives, and whether decoding gives the text back.

    A null text is an empty one: no bytes, no tokens, score 0.  A null doc_id stays null; repeated rows each get a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = Lattice(vocabulary)
        for batch in batches:
            for c in chunks(batch, limit=1 << 22):
                texts = [c.buf[c.offs[i] : c.offs[i + 1]].tobytes() for i in range(c.n)]
                yield _digested(lat, batch.column("doc_id").slice(c.row0, c.n), texts, *encode_chunk(lat, c))

    def large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = Lattice(vocabulary)
        for batch in batches:
            for i in range(len(batch)):
                yield _digested(lat, batch.column("doc_id").slice(i, 1), [batch.column("text")[i].as_py().encode()], [batch.column("ids")[i].values.to_numpy().astype(np.int64)], batch.column("score").slice(i, 1).to_numpy())

    small, big = _split(docs, giant)
    out = small.mapInArrow(run, _DIGEST)
    return out if big is None else out.unionByName(big.join(giant_ids(big, vocabulary), "rid").mapInArrow(large, _DIGEST))


__all__ = ["Lattice", "Vocabulary", "decode", "digest", "encode", "encode_chunk", "giant_ids"]
