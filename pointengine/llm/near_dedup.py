"""Operator 4: near duplicates by improved consistent weighted sampling over TF-IDF shingles.

Shingles are five consecutive words, weighted by their number in the text times a damped inverse document frequency.
Frequencies come from a count-mean-min sketch over all documents: a table of fixed size whose background noise is
taken off, so a rare shingle weighs the same at any size of the corpus.  Consistent weighted samples are banded; pairs that
share a band are verified by the exact weighted Jaccard similarity of their whole texts; verified links make classes.

Pairs within a bucket are never made as rows.  Members are held against the bucket's most central member first.  Where
a bucket still has members of several classes, those outside its largest class are held against all others in cells of
bounded size, each pair in the first band that it shares.  Signatures go first, and texts only follow where a
pair can still be one.  So every pair that shares a band is linked, compared, or already in one class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_counted, lean, materialise, text_key, whole_groups
from .components import connected_components
from .textbytes import Chunk, chunks, mix

WORDS = 5
SIMILARITY = 0.8
#: A pair of similarity 0.8 shares one of 18 bands of 4 samples with probability 0.9999.
BANDS, ROWS = 18, 4
#: Rows and columns of the sketch that counts the documents of a shingle.
SKETCH_ROWS, BUCKETS = 2, 1 << 18
#: Of the 72 samples, those that a pair must share before its texts are compared; a pair of similarity 0.8 shares fewer
#: once in 10^8.  With 0 every pair that shares a band is compared.
AGREE = 36
#: Bytes of text of one side of a cell, about, and members that are held against one central member at once.
CELL_BYTES = 4 << 20
CELL_ROWS = 1024
#: Bytes of text that are shingled at once, and different texts of a batch that are copied out of it at once, so that a task's Python
#: stays small: its arrays take many times the text.
TEXT_BYTES, TEXT_ROWS = 1 << 19, 512
#: Ids of texts to compare that are sent to all tasks, at most; beyond it they are joined.
BROADCAST_IDS = 1 << 20

_SAMPLES = BANDS * ROWS
_RNG = np.random.default_rng(41)
_ODD = _RNG.integers(1, 2**62, _SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Draws of r and ln c from Gamma(2, 1) and of beta from U(0, 1); a shingle's hash picks its entry in each sample.
_R = _RNG.gamma(2, 1, 1 << 16).astype(np.float32)
_LN_C = np.log(_RNG.gamma(2, 1, 1 << 16)).astype(np.float32)
_BETA = _RNG.random(1 << 16).astype(np.float32)


def shingles(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, times) of the distinct shingles, by text; a text of fewer than five words is one shingle."""
    ws, we, wd = c.words()
    if not len(ws):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = c.hashes(ws, we)
    n = len(h)
    head = np.searchsorted(wd, wd)
    tail = np.searchsorted(wd, wd, "right")
    whole = np.flatnonzero((np.arange(n) + WORDS <= tail) | ((np.arange(n) == head) & (tail - head < WORDS)))
    out = np.zeros(len(whole), np.uint64)
    for k in range(WORDS):
        at = np.minimum(whole + k, n - 1)
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + np.where(whole + k < tail[whole], h[at], np.uint64(0)))
    text = wd[whole]
    key = mix(out + text.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    order = np.argsort(key)
    first = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
    times = np.diff(np.append(first, len(key)))
    text, out = text[order[first]], out[order[first]]
    by = np.argsort(text, kind="stable")
    return text[by], out[by], times[by]


def _bucket(h: np.ndarray, row: int) -> np.ndarray:
    return ((h if row == 0 else mix(h)) >> np.uint64(46)).astype(np.int64)


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((SKETCH_ROWS, BUCKETS), np.int64)
    texts = 0
    for batch in batches:
        for c in chunks(batch, limit=TEXT_BYTES):
            _, h, _ = shingles(c)
            for row in range(SKETCH_ROWS):
                total[row] += np.bincount(_bucket(h, row), minlength=BUCKETS)
            texts += c.n
    for lo in range(0, total.size, 1 << 16):
        n = total.ravel()[lo : lo + (1 << 16)]
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at + lo), pa.array(n[at])], ["bucket", "n"])
    yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([texts])], ["bucket", "n"])


def damped_idf(counts: np.ndarray, texts: int) -> np.ndarray:
    """1 + ln(N / df) / (2 ln N), between 1 and 1.5, of every cell of the sketch.

    df is the cell's count less its row's median, which is what rare shingles put into any cell; what lies within four
    deviations of that noise counts as a document frequency of 1.
    """
    noise = np.median(counts, axis=1, keepdims=True)
    df = np.where(counts > noise + 4 * np.sqrt(noise), counts - noise, 1.0)
    texts = max(texts, 2)
    return (1 + np.log(np.clip(texts / np.maximum(df, 1.0), 1.0, None)) / (2 * np.log(texts))).astype(np.float32)


def shingle_weights(docs: DataFrame) -> np.ndarray:
    """The damped inverse document frequency of every cell of the sketch: 2 MB at any size of the corpus."""
    rows = docs.select("text").mapInArrow(lean(_bucket_counts), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = rows.column("bucket").to_numpy(), rows.column("n").to_numpy()
    counts = np.zeros(SKETCH_ROWS * BUCKETS)
    counts[bucket[bucket >= 0]] = n[bucket >= 0]
    return damped_idf(counts.reshape(SKETCH_ROWS, BUCKETS), int(n[bucket < 0].sum()))


def _weights(h: np.ndarray, times: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """A shingle's frequency is the least of its cells, so its weight is the largest."""
    return times * np.max([idf[row][_bucket(h, row)] for row in range(SKETCH_ROWS)], axis=0)


def samples(text: np.ndarray, h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts with a shingle, their samples): two texts agree in a sample as often as they are similar.

    For weight w, t = floor(ln w / r + beta) and ln a = ln c - r (t - beta + 1); the shingle with the least a and its
    t are the sample.
    """
    head = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    ln_w = np.log(w).astype(np.float32)
    low = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    out = np.empty((len(head), _SAMPLES), np.uint32)
    for j, odd in enumerate(_ODD):
        i = ((h * odd) >> np.uint64(48)).astype(np.int64)
        r, beta = _R[i], _BETA[i]
        t = np.floor(ln_w / r + beta)
        a = _LN_C[i] - r * (t - beta + np.float32(1))
        bits = a.view(np.uint32)
        bits = np.where(bits >> np.uint32(31) == 1, ~bits, bits | np.uint32(0x80000000))
        tag = low ^ (t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1))
        best = np.minimum.reduceat(bits.astype(np.uint64) << np.uint64(32) | tag, head)
        out[:, j] = (best & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return text[head], out


#: Entries that are sampled at once: what fits a processor's cache.
SAMPLED = 1 << 15
_SIGNED = "node binary, bands array<long>, sig binary, weight double, n_bytes long"


def _signed(idf: np.ndarray):
    """Bands, and as one blob bands and samples, of the different texts of a batch; texts without words have none."""

    def sign(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for c in chunks(batch, limit=TEXT_BYTES):
            text, h, times = shingles(c)
            w = _weights(h, times, idf)
            cut = np.searchsorted(text, np.arange(c.n + 1))
            lo = 0
            while lo < c.n:
                hi = max(lo + 1, int(np.searchsorted(cut, cut[lo] + SAMPLED, "right")) - 1)
                own = slice(cut[lo], cut[hi])
                lo = hi
                if own.start == own.stop:
                    continue
                has, s = samples(text[own], h[own], w[own])
                band = np.zeros((len(s), BANDS), np.uint64)
                for k in range(ROWS):
                    band = mix(band * np.uint64(31) + s[:, k::ROWS] + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                sig = np.concatenate([band.view(np.uint32), s], 1)
                at = pa.array(np.arange(len(s) + 1, dtype=np.int32) * BANDS)
                weight = np.bincount(text[own] - has[0], w[own])[has - has[0]]
                yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(has + c.row0)), pa.ListArray.from_arrays(at, pa.array(band.ravel().view(np.int64))), pa.array([x.tobytes() for x in sig], pa.binary()), pa.array(weight), pa.array(np.diff(c.offs)[has])], [x.split()[0] for x in _SIGNED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column("node").dictionary_encode()
            first = np.sort(np.unique(node.indices.to_numpy(), return_index=True)[1]) if len(batch) else []
            for own in range(0, len(first), TEXT_ROWS):
                yield from sign(batch.take(pa.array(first[own : own + TEXT_ROWS], pa.int64())))

    return run


def weighted_jaccard(a: Chunk, b: Chunk, idf: np.ndarray) -> np.ndarray:
    """Exact similarity of the texts of two chunks, one pair a row."""
    parts = []
    for side, c in enumerate((a, b)):
        text, h, times = shingles(c)
        parts.append((text, h, _weights(h, times, idf), np.full(len(h), side)))
    text, h, w, side = (np.concatenate([p[i] for p in parts]) for i in range(4))
    order = np.lexsort((side, h, text))
    text, h, w = text[order], h[order], w[order]
    twin = np.append((text[1:] == text[:-1]) & (h[1:] == h[:-1]), False) if len(text) else np.zeros(0, bool)
    at = np.flatnonzero(twin)
    least = np.bincount(text[at], np.minimum(w[at], w[at + 1]), a.n)
    total = np.bincount(text, w, a.n)
    return least / np.maximum(total - least, 1e-12)


#: side 0 is held against side 1; open rows are those outside their bucket's largest class; first is the band's number, or -1
#: where a cell's pairs occur in no other cell.
_CELL = "cell long, side byte, node binary, comp binary, open boolean, first int"


class _Cells:
    """The rows of some whole cells: which pairs of each can still be links."""

    def __init__(self, batch: pa.RecordBatch, agree: int):
        self.batch, self.agree, n = batch, agree, len(batch)
        self.side, self.open = batch.column("side").to_numpy(), batch.column("open").to_numpy(zero_copy_only=False)
        self.first, self.weight = batch.column("first").to_numpy(), batch.column("weight").to_numpy()
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(n, 2 * BANDS + _SAMPLES)
        self.bands, self.samples = np.ascontiguousarray(sig[:, : 2 * BANDS]).view(np.uint64), sig[:, 2 * BANDS :]
        self.node, self.comp = (batch.column(x).dictionary_encode().indices.to_numpy() for x in ("node", "comp"))
        self.head = np.frombuffer(b"".join(v[:8] for v in batch.column("node").to_pylist()), ">u8")
        cell = batch.column("cell").to_numpy()
        self.cuts = np.append(np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), n)

    def hopeful(self, x: int, y: np.ndarray) -> np.ndarray:
        """Of the rows y of x's cell, those that may be alike to x and of another class, and meet it in no earlier band."""
        ok = (self.comp[y] != self.comp[x]) & (self.node[y] != self.node[x])
        if self.open[x]:  # both sides hold such rows: one turn of each pair is enough
            ok &= ~self.open[y] | (self.head[x] <= self.head[y])
        ok &= np.minimum(self.weight[y], self.weight[x]) >= SIMILARITY * (1 - 1e-6) * np.maximum(self.weight[y], self.weight[x])
        y = y[ok]
        if self.agree:
            y = y[(self.samples[y] == self.samples[x]).sum(1) >= self.agree]
        if self.first[x] > 0:
            b = int(self.first[x])
            y = y[~(self.bands[y, :b] == self.bands[x, :b]).any(1)]
        return y

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for lo, hi in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            own = np.arange(lo, hi)
            yield own[self.side[lo:hi] == 0], own[self.side[lo:hi] == 1]


def _hopeful(agree: int):
    """The rows that still have a partner in their cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, "cell"):
            cells, keep = _Cells(batch, agree), np.zeros(len(batch), bool)
            for xs, ys in cells:
                for x in xs:
                    y = cells.hopeful(x, ys)
                    keep[y] = True
                    keep[x] |= len(y) > 0
            yield batch.select([c.split()[0] for c in _CELL.split(", ")]).filter(pa.array(keep))

    return run


def _links_of(idf: np.ndarray, agree: int):
    """Exact links (a, b, similarity) of the cells' rows; links that would close a circle within a cell are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, "cell", 512):
            cells, found = _Cells(batch, agree), []
            parts = [shingles(c) + (c.row0,) for c in chunks(batch, limit=TEXT_BYTES)]
            text, h, times = np.concatenate([t + r for t, _, _, r in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
            w = _weights(h, times, idf)
            cut = np.searchsorted(text, np.arange(len(batch) + 1))
            for xs, ys in cells:
                if not len(xs) or not len(ys):
                    continue
                lo, hi = cut[ys[0]], cut[ys[-1] + 1]
                order = np.argsort(h[lo:hi])
                th, hh, wh = text[lo:hi][order] - ys[0], h[lo:hi][order], w[lo:hi][order]
                up: dict[int, int] = {}

                def root(c: int, up: dict[int, int] = up) -> int:
                    while up.get(c, c) != c:
                        c = up[c]
                    return c

                for x in xs:
                    y = cells.hopeful(x, ys)
                    y = y[[root(c) != root(int(cells.comp[x])) for c in cells.comp[y].tolist()]] if up and len(y) else y
                    if not len(y):
                        continue
                    own = slice(cut[x], cut[x + 1])
                    left, right = np.searchsorted(hh, h[own]), np.searchsorted(hh, h[own], "right")
                    n = right - left
                    at = np.repeat(left - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    least = np.bincount(th[at], np.minimum(np.repeat(w[own], n), wh[at]), len(ys))[y - ys[0]]
                    sim = least / np.maximum(cells.weight[x] + cells.weight[y] - least, 1e-12)
                    for m in np.flatnonzero(sim >= SIMILARITY):
                        p, q = root(int(cells.comp[x])), root(int(cells.comp[y[m]]))
                        if p != q:
                            up[max(p, q)] = min(p, q)
                            found.append((int(x), int(y[m]), float(sim[m])))
            node = batch.column("node")
            yield pa.RecordBatch.from_arrays([*(node.take(pa.array([f[i] for f in found], pa.int64())) for i in (0, 1)), pa.array([f[2] for f in found], pa.float64())], ["a", "b", "similarity"])

    return run


def _links(cells: DataFrame, signed: DataFrame, texts: DataFrame, idf: np.ndarray, agree: int) -> DataFrame:
    """Verified links of the cells' pairs: signatures first, then the texts of what is left; written to the shared folder."""
    sig = signed.select("node", "sig", "weight")
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deal = lambda df: df.repartition(parts, "cell").sortWithinPartitions("cell", "side")
    left = materialise(deal(cells.join(sig, "node")).mapInArrow(lean(_hopeful(agree)), _CELL))
    out = materialise(deal(left.join(sig, "node").join(texts, "node")).mapInArrow(lean(_links_of(idf, agree)), "a binary, b binary, similarity double"))
    discard(left)
    return out


def _central_cells(members: DataFrame) -> DataFrame:
    """Cells of a bucket's most central member and the others, CELL_ROWS about at a time.

    Most central is the one whose own buckets hold the most members: where many copies were made of one text, that
    text, to which they are all closer than to each other.
    """
    rank = members.groupBy("node").agg(F.sum("n").alias("rank"))
    top = members.join(rank, "node").groupBy("band").agg(F.max(F.struct("rank", "node")).alias("top")).select("band", F.col("top.node").alias("hub"))
    pairs = materialise(members.join(top, "band").where("node <> hub").select("hub", "node").distinct())
    ways = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(CELL_ROWS))).cast("int").alias("ways"))
    cell = lambda part: F.xxhash64("hub", part)
    row = lambda c, side, node: (c.alias("cell"), F.lit(side).cast("byte").alias("side"), node.alias("node"), node.alias("comp"), F.lit(False).alias("open"), F.lit(-1).alias("first"))
    own = pairs.join(ways, "hub").select(*row(cell(F.pmod(F.xxhash64("node"), F.col("ways")).cast("int")), 1, F.col("node")))
    hubs = ways.select("hub", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("part")).select(*row(cell(F.col("part")), 0, F.col("hub")))
    return own.unionByName(hubs)


def _open_cells(members: DataFrame, comp: DataFrame) -> DataFrame:
    """Cells of the buckets that have members of several classes: blocks of those outside the largest class, each with
    every block of the bucket."""
    at = members.join(comp, "node", "left").select("band", "first", "node", "n_bytes", F.coalesce("comp", "node").alias("comp"))
    of = at.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("b"))
    of = of.groupBy("band").agg(F.count(F.lit(1)).alias("classes"), F.sum("b").alias("all"), F.max(F.struct("n", "b", "comp")).alias("big")).where("classes > 1")
    blocks = lambda b: F.ceil(b / F.lit(float(CELL_BYTES))).cast("int")
    of = of.select("band", F.col("big.comp").alias("big"), blocks(F.col("all")).alias("rows"), blocks(F.greatest(F.col("all") - F.col("big.b"), F.lit(1))).alias("cols"))
    at = at.join(of, "band").withColumn("open", F.col("comp") != F.col("big"))
    at = materialise(at.select("band", "first", "node", "comp", "open", "cols", "rows", F.pmod(F.xxhash64("node"), F.col("rows")).cast("int").alias("row"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("cols")).cast("int").alias("col")))
    cell = F.xxhash64("band", "row", "col").alias("cell")
    rest = ("node", "comp", "open", "first")
    ones = at.withColumn("col", F.explode(F.sequence(F.lit(0), F.col("cols") - 1))).select(cell, F.lit(1).cast("byte").alias("side"), *rest)
    zeros = at.where("open").withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).select(cell, F.lit(0).cast("byte").alias("side"), *rest)
    return ones.unionByName(zeros)


def _joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """Components of all links so far: those found before, joined by links between their members."""
    old = lambda n: comp.select(F.col("node").alias(n), F.col("comp").alias(f"c{n}"))
    merged = links.join(old("a"), "a", "left").join(old("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    up = connected_components(merged)
    moved = comp.join(up.select(F.col("node").alias("comp"), F.col("comp").alias("_up")), "comp", "left").select("node", F.coalesce("_up", "comp").alias("comp"))
    new = up.join(comp.select("node"), "node", "left_anti")
    out = materialise(moved.unionByName(new))
    discard(up)
    return out


def components(texts: DataFrame, agree: int = AGREE) -> DataFrame:
    """(node, comp) of the different texts (node, text) that are alike to another: comp is the least node of the class.

    Texts without words are alike to none.
    """
    idf = shingle_weights(texts)
    signed = materialise(texts.mapInArrow(lean(_signed(idf)), _SIGNED).dropDuplicates(["node"]))
    each = signed.select("node", "n_bytes", F.posexplode("bands").alias("first", "band"))
    size = each.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialise(each.join(size, "band"))
    ids = materialise(members.select("node").distinct())
    some = texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "node", "left_semi")
    some = materialise(some.dropDuplicates(["node"]))
    first = _links(_central_cells(members), signed, some, idf, agree)
    comp = connected_components(first)
    rest = _links(_open_cells(members, comp), signed, some, idf, agree)
    out = _joined(comp, rest)
    discard(signed, members, ids, some, first, comp, rest)
    return out


def _classes(rows: DataFrame, agree: int) -> DataFrame:
    """(node, comp, n) of every different text of rows (doc_id, node, text), n rows hold it."""
    comp = components(rows.select("node", "text"), agree)
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    return nodes.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("node"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def near_duplicates(docs: DataFrame, agree: int = AGREE) -> DataFrame:
    """doc_id, class_id, class_size for every row: class_id is the least doc_id of the row's class.

    Equal texts, null and empty ones included, are one class; a class of rows with null doc_ids only has a null
    class_id.  Repeated rows each get a row; other columns are ignored.  An empty table gives no rows.  With agree = 0
    every pair that shares a band is verified, however little its samples agree.
    """
    rows = _rows(docs)
    nodes = materialise(_classes(rows, agree))
    least = nodes.groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.sum("n").alias("class_size"))
    named = materialise(nodes.join(least, "comp").select("node", "class_id", "class_size", "n"))
    return join_counted(rows.select("doc_id", "node"), named, "node", "n").select("doc_id", "class_id", "class_size")


def kept_documents(docs: DataFrame, agree: int = AGREE) -> DataFrame:
    """One row of every class with all its columns: one with the least doc_id, nulls last, and of several texts the least key."""
    plain = _rows(docs)
    nodes = materialise(_classes(plain, agree))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    best = nodes.groupBy("comp").agg(F.min(first).alias("best"), F.sum("n").alias("size")).where("size > 1")
    told = materialise(nodes.join(best, "comp").select(F.col("node").alias("_node"), (F.col("node") == F.col("best.node")).alias("_stays"), F.col("doc_id").alias("_first")))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(row, F.col("doc_id").cast("long").alias("_id"), text_key(F.col("text")).alias("_node"))
    small = told.count() <= BROADCAST_IDS
    alone = rows.join(F.broadcast(told.select("_node")) if small else told.select("_node"), "_node", "left_anti")
    stay = told.where("_stays")
    several = rows.join(F.broadcast(stay) if small else stay, "_node").where(F.col("_id").eqNullSafe(F.col("_first"))).dropDuplicates(["_node"])
    return alone.select("_row.*").unionByName(several.select("_row.*"))
