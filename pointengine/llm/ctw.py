"""Operator 10: language-model scores by context-tree weighting over bytes.

Every byte is predicted as eight binary decisions.  Each of the 255 decisions has a context tree over
the DEPTH bytes before; every node of it holds a Krichevsky-Trofimov estimate, and the weighted
probability ``P_w(s) = KT(s)/2 + prod P_w(children)/2`` mixes all depths.  All of it follows from counts
of byte strings of length DEPTH + 1, which Spark gathers; trees are built in parallel below the contexts
of SPLIT bytes, and a text's probability is the product over its bytes.

One change to the textbook's rule: a child without training counts would predict 1/2 with the weight that its parent
gives to deeper contexts; here such a child has no say, and the parent predicts alone.  The weights themselves, and every
prediction below which counts exist, are the textbook's.

A text is its lower-cased words (A to Z only), each with one space behind it, and one end byte, so the model
spreads its probability over token sequences like a model of whole words does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, fold, lean, materialise
from .textbytes import SPACE, Chunk, chunks, mix

DEPTH = 5
SPLIT = 2
END = 10
FOLDS = 10
#: Byte strings, and words, whose counts are broadcast, at most; what is beyond goes through a join.
BROADCAST_GRAMS = 1 << 22
BROADCAST_WORDS = 1 << 20
#: Distinct keys that a map task gathers before it passes them on.
HELD = 1 << 20
#: Bytes of text that are read at once, and byte strings whose trees are built at once, or all below one context of SPLIT bytes, so
#: that a task's Python stays small: its arrays take many times these.
TEXT_BYTES, TREES = 1 << 18, 1 << 17
#: The end of a text as a word's key.
END_KEY = np.int64(-1)

_STIRLING = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 4096)))])  # log k!
_HALF = np.concatenate([[0.5 * np.log(np.pi)], 0.5 * np.log(np.pi) + np.cumsum(np.log(np.arange(4095) + 0.5))])  # log gamma(k + 1/2)


def _lgamma(n: np.ndarray, table: np.ndarray, shift: float) -> np.ndarray:
    """log gamma(n + shift) of whole n, by table and beyond it by Stirling's series."""
    x = np.maximum(n, 4096) + shift
    far = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n < 4096, table[np.minimum(n, 4095).astype(np.int64)], far)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log probability that the Krichevsky-Trofimov estimator gives to a zeros and b ones in any order."""
    return _lgamma(a, _HALF, 0.5) + _lgamma(b, _HALF, 0.5) - _lgamma(a + b, _STIRLING, 1.0) - np.log(np.pi)


def normalised(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Byte strings of length DEPTH + 1 ending at each byte of the chunk's texts as the model reads them.

    Returns (string as a number, text index of each, bytes of each text, the words).  DEPTH end bytes stand
    before each text.
    """
    ws, we, wd = words = c.words()
    solid = np.flatnonzero(~SPACE[c.buf])
    size = we - ws
    at = np.arange(len(solid)) + np.repeat(np.arange(len(ws)) + wd * (DEPTH + 1) + DEPTH, size)
    total = len(solid) + len(ws) + c.n * (DEPTH + 1)
    out = np.full(total, END, np.uint8)
    out[at] = c.buf[solid]
    out[at[np.cumsum(size) - 1] + 1] = 32
    each = c.per_text(wd, size.astype(float)).astype(np.int64) + c.per_text(wd) + 1
    first = np.cumsum(each + DEPTH) - each
    g = np.zeros(total - DEPTH, np.uint64)
    for k in range(DEPTH + 1):
        g = (g << np.uint64(8)) | out[k : total - DEPTH + k]
    text = np.repeat(np.arange(c.n), each)
    place = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(first, each) - DEPTH
    return g[place], text, each, words


class _Held:
    """Counts of 64-bit keys, merged as they come."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, weight: np.ndarray | None = None) -> None:
        """weight: of each key, or 1."""
        if weight is None:
            u, n = np.unique(keys, return_counts=True)
        else:
            u, back = np.unique(keys, return_inverse=True)
            n = np.bincount(back, weight, len(u)).astype(np.int64)
        self.parts.append((u, n))
        self.size += len(u)
        if self.size > HELD and len(self.parts) > 1:
            self.merge()

    def merge(self) -> None:
        keys, n = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1))
        order = np.argsort(keys)
        keys = keys[order]
        head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        self.parts = [(keys[head], np.add.reduceat(n[order], head))]
        self.size = len(head)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self.merge()
        out, self.parts, self.size = self.parts[0], [], 0
        return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams, tokens, ends = _Held(), _Held(), 0

    def rows(held: _Held, kind: int) -> Iterator[pa.RecordBatch]:
        if held.parts:
            k, n = held.take()
            for i in range(0, len(k), 1 << 16):
                part = k[i : i + (1 << 16)].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int8)), pa.array(part), pa.array(n[i : i + (1 << 16)])], ["kind", "key", "n"])

    for batch in batches:
        train = ~batch.column("held_out").to_numpy(zero_copy_only=False)
        for c in chunks(batch, lower=True, limit=TEXT_BYTES):
            t = train[c.row0 : c.row0 + c.n]
            g, text, _, (ws, we, wd) = normalised(c)
            seen = t[text]
            grams.add(g[seen])
            if not seen.all():  # strings of held-out texts are scored too: they get a count of 0
                u = np.unique(g[~seen])
                grams.add(u, np.zeros(len(u)))
            own = t[wd]
            tokens.add(c.hashes(ws[own], we[own]))
            ends += int(t.sum())
            for held, kind in ((grams, 0), (tokens, 1)):
                if held.size > HELD:
                    yield from rows(held, kind)
    yield from rows(grams, 0)
    yield from rows(tokens, 1)
    if ends:
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int8()), pa.array([END_KEY]), pa.array([ends])], ["kind", "key", "n"])


class _Levels:
    """Nodes (context, decision) of all depths from DEPTH down to SPLIT over some strings, for the bit-th decision of each."""

    def __init__(self, gram: np.ndarray, n: np.ndarray, bit: int):
        sym = (gram & 255).astype(np.int64)
        self.bits = (sym >> (7 - bit)) & 1
        key, self.at = np.unique((gram >> 8).astype(np.int64) << 8 | (1 << bit) | (sym >> (8 - bit)), return_inverse=True)
        ones = np.bincount(self.at, self.bits * n, len(key))
        a, b = np.bincount(self.at, n, len(key)) - ones, ones
        self.depth, weighted = [], log_kt(a, b)
        up = np.arange(len(key))
        for d in range(DEPTH, SPLIT - 1, -1):
            if d < DEPTH:
                parent, back = np.unique(((key >> 8) & ((1 << 8 * d) - 1)) << 8 | key & 255, return_inverse=True)
                a, b, below = (np.bincount(back, x, len(parent)) for x in (a, b, weighted))
                key, up = parent, back[up]
                weighted = np.logaddexp(log_kt(a, b), below) - np.log(2)
            own = log_kt(a, b) - np.log(2) - weighted if d < DEPTH else np.zeros(len(key))
            self.depth.append((up, a, b, own))
        self.key, self.a, self.b, self.weighted = key, a, b, weighted

    def log10(self, shallow: dict[int, tuple[np.ndarray, ...]]) -> np.ndarray:
        """Log10 probability of this decision on the last byte of each string; shallow: (keys, P(1), weight) of depths below SPLIT."""
        up, a, b, _ = self.depth[0]
        q, seen = (b + 0.5) / (a + b + 1), a + b > 0
        for up, a, b, own in self.depth[1:]:
            q, seen = _mixed(q, seen, (b + 0.5)[up] / (a + b + 1)[up], np.exp(np.minimum(own, 0))[up], (a + b > 0)[up])
        leaf = self.key[self.depth[-1][0]]
        for d in range(SPLIT - 1, -1, -1):
            keys, p, own, any_ = shallow[d]
            i = np.searchsorted(keys, ((leaf >> 8) & ((1 << 8 * d) - 1)) << 8 | leaf & 255)
            q, seen = _mixed(q, seen, p[i], own[i], any_[i])
        p = np.where(self.bits == 1, q[self.at], 1 - q[self.at])
        return np.log10(p)


def _mixed(q, child_seen, p, own, seen):
    """A node's prediction: its own estimate and its child's by posterior weight; a child never trained on has no say."""
    return np.where(child_seen, own * p + (1 - own) * q, p), seen


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(strings, counts) of a task, about TREES at once: all strings below a context of SPLIT bytes come together."""
    got = [(b.column("key").to_numpy(), b.column("n").to_numpy()) for b in batches]
    got = [x for x in got if len(x[0])]
    if not got:
        return
    gram, n = np.concatenate([g for g, _ in got]), np.concatenate([n for _, n in got])
    got.clear()
    root = ((gram >> 8) & ((1 << 8 * SPLIT) - 1)).astype(np.int32)
    order = np.argsort(root, kind="stable")
    cut = np.append(np.flatnonzero(np.diff(root[order])) + 1, len(gram))
    lo = 0
    while lo < len(gram):
        hi = int(cut[max(np.searchsorted(cut, lo + TREES, "right") - 1, np.searchsorted(cut, lo, "right"))])
        yield gram[order[lo:hi]], n[order[lo:hi]]
        lo = hi


def _top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for got in _trees(batches):
        for bit in range(8):
            t = _Levels(*got, bit)
            yield pa.RecordBatch.from_arrays([pa.array((t.key >> 8 & ((1 << 8 * (SPLIT - 1)) - 1)) << 8 | t.key & 255), pa.array(t.a), pa.array(t.b), pa.array(t.weighted)], ["key", "a", "b", "w"])


def _shallow(rows: list) -> dict[int, tuple[np.ndarray, ...]]:
    """Depths below SPLIT, from sums over their children: at most 256 contexts of one byte x 255 decisions."""
    key, a, b, w = (np.array([r[i] for r in rows], t) for i, t in enumerate((np.int64, float, float, float)))
    out = {}
    for d in range(SPLIT - 1, -1, -1):
        if d < SPLIT - 1:
            key, back = np.unique((key >> 8 & ((1 << 8 * d) - 1)) << 8 | key & 255, return_inverse=True)
            a, b, w = (np.bincount(back, x, len(key)) for x in (a, b, w))
        kt = log_kt(a, b)
        w = np.logaddexp(kt, w) - np.log(2)
        out[d] = (key, (b + 0.5) / (a + b + 1), np.exp(np.minimum(kt - np.log(2) - w, 0)), a + b > 0)
    return out


def log_table(grams: DataFrame) -> DataFrame:
    """key, n, lp: the log10 probability of the last byte of every counted string.

    Strings are dealt by the last SPLIT bytes of their context, whose subtrees are built on their own.
    """
    spark = grams.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    dealt = grams.repartition(parts, F.shiftrightunsigned("key", 8).bitwiseAND((1 << 8 * SPLIT) - 1))
    top = dealt.mapInArrow(lean(_top), "key long, a double, b double, w double").groupBy("key").agg(F.sum("a"), F.sum("b"), F.sum("w"))
    shallow = _shallow(sorted(top.collect()))

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in _trees(batches):
            lp = np.zeros(len(got[0]))
            for bit in range(8):
                lp += _Levels(*got, bit).log10(shallow)
            for i in range(0, len(lp), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)]) for x in (*got, lp)], ["key", "n", "lp"])

    return dealt.mapInArrow(lean(evaluate), "key long, n long, lp double")


def _sorted_arrays(df: DataFrame, *names: str) -> list[np.ndarray]:
    t = df.toArrow()
    cols = [t.column(n).to_numpy() for n in names]
    order = np.argsort(cols[0].view(np.uint64))
    return [cols[0][order].view(np.uint64), *(c[order] for c in cols[1:])]


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


SCORES = "rid long, doc_id long, held_out boolean, n_tokens long, n_bytes long, n_known long, base double, score double, gram_keys array<long>, gram_times array<long>, word_keys array<long>, word_times array<long>"


def _lists(text: np.ndarray, key: np.ndarray, times: np.ndarray, n: int) -> list[pa.Array]:
    """Keys and their numbers of each of n texts, as list columns."""
    order = np.argsort(text, kind="stable")
    cut = pa.array(np.searchsorted(text[order], np.arange(n + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(cut, pa.array(x[order].astype(np.uint64).view(np.int64))) for x in (key, times)]


def score_documents(docs: DataFrame, broadcast_grams: int = BROADCAST_GRAMS, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every row.

    Training rows are those whose crc32(doc_id as text) mod 10 is not 0.  A null or empty text is its end alone.
    Repeated rows count and are scored each; other columns are ignored.  Without training rows every estimate
    is 1/2 a bit.  Counts of at most ``broadcast_grams`` strings and ``broadcast_words`` words are sent to all
    tasks; where there are more, those are the ones above an equal share of the total, and the rest is joined.
    """
    spark = docs.sparkSession
    d = documents(docs).withColumn("held_out", fold(F.col("doc_id"), FOLDS) == 0)
    counts = materialise(d.mapInArrow(lean(_count), "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    size = {r.kind: (r.d, int(r.n or 0)) for r in counts.groupBy("kind").agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("n")).collect()}
    (n_grams, gram_total), (distinct, total) = size.get(0, (0, 0)), size.get(1, (0, 0))
    table = materialise(log_table(counts.where("kind = 0").select("key", "n")))
    tokens = counts.where("kind = 1").select("key", "n")
    near = table if n_grams <= broadcast_grams else table.where(F.col("n") > gram_total // broadcast_grams)
    often = tokens if distinct <= broadcast_words else tokens.where(F.col("n") > total // broadcast_words)
    sent = spark.sparkContext.broadcast((*_sorted_arrays(near.select("key", "lp"), "key", "lp"), *_sorted_arrays(often, "key", "n")))
    all_words = distinct <= broadcast_words

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram_keys, gram_lp, word_keys, word_n = sent.value
        log_n = np.log10(word_n + 0.1)
        unknown = np.log10(0.1)
        _, has_end = _find(word_keys, np.array([END_KEY]).view(np.uint64))
        for batch in batches:
            for c in chunks(batch, lower=True, limit=TEXT_BYTES):
                g, text, each, (ws, we, wd) = normalised(c)
                # The strings of a chunk in order, each with its texts: 48 and 16 bits.
                key = np.sort((g << np.uint64(16)) | text.astype(np.uint64))
                head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                times, of, gram = np.diff(np.append(head, len(key))), (key[head] & np.uint64(0xFFFF)).astype(np.int64), key[head] >> np.uint64(16)
                at, hit = _find(gram_keys, gram)
                lp = np.bincount(of[hit], gram_lp[at[hit]] * times[hit], c.n).astype(float)  # of nothing, bincount gives whole numbers
                rest = _lists(of[~hit], gram[~hit], times[~hit], c.n)

                h = np.append(c.hashes(ws, we), np.full(c.n, END_KEY).view(np.uint64))
                wt = np.append(wd, np.arange(c.n))
                k = mix(h + wt.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                order = np.argsort(k)
                head = np.flatnonzero(np.append(True, k[order][1:] != k[order][:-1]))
                times, of, word = np.diff(np.append(head, len(k))), wt[order[head]], h[order[head]]
                at, hit = _find(word_keys, word)
                known = np.bincount(of[hit], times[hit] * (word_n[at[hit]] > 0), c.n).astype(np.int64)
                base = np.bincount(of[hit], log_n[at[hit]] * times[hit], c.n).astype(float)
                if all_words:
                    base += np.bincount(of[~hit], unknown * times[~hit], c.n)
                    hit[:] = True
                rest += _lists(of[~hit], word[~hit], times[~hit], c.n)
                own = [batch.column(n).slice(c.row0, c.n) for n in ("rid", "doc_id", "held_out")]
                yield pa.RecordBatch.from_arrays([*own, *map(pa.array, (c.per_text(wd) + 1, each, known, base, lp)), *rest], [x.split()[0] for x in SCORES.split(", ")])

    first = materialise(d.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(lean(score), SCORES))
    main = first.select("rid", "doc_id", "held_out", "n_tokens", "n_bytes", "n_known", "base", "score")
    if n_grams > broadcast_grams or not all_words:
        def rest(kind: str, values: DataFrame) -> DataFrame:
            flat = first.select("rid", F.explode(F.arrays_zip(F.col(f"{kind}_keys").alias("key"), F.col(f"{kind}_times").alias("times"))).alias("x")).select("rid", "x.*")
            return flat.join(values, "key", "left")

        unseen = F.log10(F.lit(0.1))
        none = F.lit(None)
        grams = rest("gram", table.select("key", "lp")).groupBy("rid").agg(F.sum(F.col("lp") * F.col("times")).alias("s"))
        words = rest("word", tokens).groupBy("rid").agg(F.sum(F.coalesce(F.log10(F.col("n") + F.lit(0.1)), unseen) * F.col("times")).alias("b"), F.sum(F.when(F.col("n") > 0, F.col("times"))).alias("k"))
        sums = grams.select("rid", "s", none.cast("double").alias("b"), none.cast("long").alias("k")).unionByName(words.select("rid", none.cast("double").alias("s"), "b", "k"))
        sums = sums.groupBy("rid").agg(F.sum("s").alias("s"), F.sum("b").alias("b"), F.sum("k").alias("k"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        main = main.join(sums, "rid", "left").withColumns({"base": F.col("base") + zero("b"), "score": F.col("score") + zero("s"), "n_known": F.col("n_known") + zero("k")})
    scale = float(np.log10(total + 0.1 * (distinct + 1)))
    return main.select(
        "doc_id",
        "held_out",
        F.col("n_tokens").cast("long").alias("n_tokens"),
        F.col("n_known").cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(scale)).alias("base_score"),
        "score",
        (-F.col("score") * F.lit(float(np.log2(10))) / F.col("n_bytes")).alias("bits_per_byte"),
    )
