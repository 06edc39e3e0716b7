"""Operator 3: exact removal of byte strings that an earlier document holds, by suffix arrays.

A byte goes if it lies in a WIDTH-byte string that also starts in a document with a smaller doc_id.

1. Prefilter.  Every WIDTH-byte window has an anchor: its 16-byte string of least hash.  Neighbouring windows with one
   anchor are a fragment.  Equal windows have equal anchors, and SIDE equal bytes on one side of it at least, so a fragment is
   asked for only if its anchor and one such side occur in another document too.  Fragments of one anchor meet in a shard;
   those of hot anchors meet by anchor and side, of which a task passes on its least and largest document alone.  This step
   settles nothing.
2. Suffix arrays.  The bytes of the fragments that are asked for are dealt to shards by anchor.  Each shard builds a suffix
   array by Larsson-Sadakane refinement and common prefixes by Kasai's method; windows with a common prefix of WIDTH
   bytes form groups, settled by their least document.
3. Merging.  An anchor with many fragments is dealt over several shards.  Each of those passes on one holder of each of
   its different windows; the shards' sorted windows are merged, and every holder is located in them by binary search.

A text that equals that of an earlier document goes whole; where it is among the commonest it needs no fragments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lean, materialise, text_key, whole_groups
from .textbytes import Chunk, chunks, column, mix

WIDTH = 50
GRAM = 16
#: Bytes of text whose anchors make a shard of the prefilter, and bytes of text a task, at least.
SHARD_BYTES, TASK_BYTES = 2 << 20, 64 << 20
#: Bytes of text whose fragments are found at once, and texts of a batch that are copied out of it at once, so that a task's Python
#: stays small: its arrays take many times the text.
TEXT_BYTES, TEXT_ROWS = 1 << 18, 512
#: Fragments that a task gathers before it deals them to shards, and bytes of fragments that are cut out at once.
DEALT, CUT_BYTES = 1 << 17, 1 << 20
#: One text in so many tells which anchors are hot: those with so many fragments there, and of these the commonest at most.  That
#: decides where fragments meet and never what is found.
TOLD, HOT_TOLD, HOT_LIST = 64, 256, 1 << 20
#: Sides of hot anchors that a task gathers before it passes them on.
HELD = 1 << 20
#: Fragments of one anchor in a shard of suffixes, about, and all fragments of one suffix array.
HOT_ANCHOR, ARRAY_PARTS = 2048, 1 << 13
#: Keys that are sent to all tasks, at most; with more of them a join takes their place.
BROADCAST_IDS = 1 << 20
#: Commonest texts whose later copies are settled at once.
COMMON_TEXTS = 1 << 18
#: Windows that a task merges, about.
MERGED = 1 << 20
_SPAN = WIDTH - GRAM + 1
#: Bytes beside the anchor that a shared window holds on one side at least.
SIDE = (WIDTH - GRAM) // 2


# ---------------------------------------------------------------------------------------------- suffix arrays


def suffix_array(text: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes text[i:end[i]], none of which is longer than depth; equal ones by place.

    Larsson-Sadakane: a suffix's rank is the last place of its group; each pass sorts the members of groups of more
    than one by the rank of the suffix h further on, and h doubles.  Finished suffixes are not touched again.
    Rank, further rank and place are one 64-bit number, which bounds the text to 2^21 - 1 bytes.
    """
    n = len(text)
    if n >= 1 << 21:
        raise ValueError("a suffix array takes less than 2 MiB of text")
    bits = np.uint64(max(n, 1).bit_length())
    at = np.arange(n)
    room, code = end - at, np.append(text, np.zeros(5, np.uint8)).astype(np.uint64) + np.uint64(1)
    key = np.zeros(n, np.uint64)
    for k in range(5):  # the first five bytes at once; a suffix that ends sorts first
        key *= np.uint64(257)
        key += code[k : k + n] * (room > k)
    low = (np.uint64(1) << bits) - np.uint64(1)
    order = np.sort(key << bits | at.astype(np.uint64))
    sa, rank, open_, h = (order & low).astype(np.int64), np.zeros(n, np.int64), at, 5
    group = order >> bits
    while True:
        head = np.flatnonzero(np.append(True, group[1:] != group[:-1])[: len(group)])
        size = np.diff(np.append(head, len(group)))
        rank[sa[open_]] = np.repeat(open_[head + size - 1], size)
        open_ = open_[np.repeat(size > 1, size)]
        if h >= depth or not len(open_):
            return sa
        pos = sa[open_]
        far = pos + h
        nxt = np.where(far < end[pos], rank[np.minimum(far, n - 1)] + 1, 0)
        order = np.sort(((rank[pos].astype(np.uint64) << (bits + np.uint64(1)) | nxt.astype(np.uint64)) << bits) | pos.astype(np.uint64))
        sa[open_] = (order & low).astype(np.int64)
        group, h = order >> bits, 2 * h


def kasai(text: np.ndarray, start: np.ndarray, length: np.ndarray, sa: np.ndarray, end: np.ndarray, most: int = WIDTH) -> np.ndarray:
    """lcp[j]: common prefix of suffixes sa[j-1] and sa[j], up to ``most``.

    Kasai: going one byte on in the text shortens the prefix by one at most.  The texts of a shard are walked side by
    side, one place of each at a time.
    """
    n = len(text)
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    h = np.zeros(len(start), np.int64)
    for step in range(int(length[0]) if len(length) else 0):
        live = int(np.searchsorted(-length, -step, "left"))
        i = start[:live] + step
        at = place[i]
        j = np.where(at > 0, sa[at - 1], i)
        hh = np.maximum(h[:live] - 1, 0)
        hh[at == 0] = 0
        go = np.flatnonzero((at > 0) & (hh < most))
        while len(go):
            p, q = i[go] + hh[go], j[go] + hh[go]
            same = (p < end[i[go]]) & (q < end[j[go]])
            same[same] = text[p[same]] == text[q[same]]
            go = go[same]
            hh[go] += 1
            go = go[hh[go] < most]
        lcp[at] = hh
        h[:live] = hh
    return lcp


def window_groups(text: np.ndarray, start: np.ndarray, length: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """(place, part, group, least document of the group) of every WIDTH-byte window of the parts, in suffix order."""
    part = np.repeat(np.arange(len(start)), length)
    end = (start + length)[part]
    sa = suffix_array(text, end, int(length.max()))
    group = np.cumsum(kasai(text, start, length, sa, end) < WIDTH)
    whole = sa + WIDTH <= end[sa]
    at, group = sa[whole], group[whole]
    least = np.full(int(group[-1]) + 1 if len(group) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, group, doc[part[at]])
    return at, part[at], group, least[group]


def repeated_windows(parts: list[bytes], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(part, offset) of every WIDTH-byte window of the parts that also stands in a part of a smaller document."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    length = np.array([len(p) for p in parts], np.int64)
    start = np.cumsum(length) - length
    at, part, _, least = window_groups(np.frombuffer(b"".join(parts), np.uint8), start, length, doc)
    hit = np.sort(at[doc[part] > least])
    part = np.searchsorted(start, hit, "right") - 1
    return part, hit - start[part]


# ------------------------------------------------------------------------------------------------- prefilter


def fragments(c: Chunk) -> tuple[np.ndarray, ...]:
    """(anchor, start, end, text, left, right) of all fragments of a chunk; start and end are places in its bytes.

    left and right: tags of the SIDE bytes before and behind the anchor, 0 where the text has fewer.  A window that two
    fragments share holds SIDE bytes or more on one side of the anchor, so it shows in one of the tags.
    """
    n = len(c.buf)
    none = np.zeros(0, np.int64)
    if n < WIDTH:
        return none.astype(np.uint64), none, none, none, none.astype(np.uint16), none.astype(np.uint16)
    v = np.ndarray((n - 7,), "<u8", np.ascontiguousarray(c.buf), strides=(1,)).copy()
    h = mix(v[: n - GRAM + 1] * np.uint64(0x9E3779B97F4A7C15) + mix(v[8 : n - GRAM + 9] + np.uint64(0x632BE59BD9B4E019)))
    bits = np.uint64(int(n).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while size * 2 <= _SPAN:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    rest = _SPAN - size
    m = np.minimum(m[: len(m) - rest], m[rest:]) if rest else m
    anchor = (m & low).astype(np.int64)  # of the window starting at each place
    text = np.repeat(np.arange(c.n), np.diff(c.offs))[: len(anchor)]
    ok = np.arange(len(anchor)) + WIDTH <= c.offs[text + 1]
    turn = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first, last = ok.copy(), ok.copy()
    first[1:] &= ~ok[:-1] | turn
    last[:-1] &= ~ok[1:] | turn
    s, e = np.flatnonzero(first), np.flatnonzero(last) + WIDTH
    at, t = anchor[s], text[s]

    def tag(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        there = (lo >= c.offs[t]) & (hi <= c.offs[t + 1])
        out = np.zeros(len(at), np.uint16)
        out[there] = (c.hashes(lo[there], hi[there]) % np.uint64(65535)).astype(np.uint16) + np.uint16(1)
        return out

    return h[at], s, e, t, tag(at - SIDE, at), tag(at + GRAM, at + GRAM + SIDE)


#: A fragment: anchor, document, hash of its text (the two name the text), where it starts, its size, tags of its sides.
_ENTRY = (("a", np.uint64), ("doc", np.int64), ("h", np.int64), ("start", np.uint32), ("size", np.uint8), ("left", np.uint16), ("right", np.uint16))
_ASKED = "doc long, h long, a long, start int, end int"
_RUNS = "doc long, h long, start int, end int"


def _unpack(blobs: list[bytes]) -> list[np.ndarray]:
    width = sum(np.dtype(t).itemsize for _, t in _ENTRY)
    out: list[list[np.ndarray]] = [[] for _ in _ENTRY]
    for b in blobs:
        n, at = len(b) // width, 0
        for i, (_, t) in enumerate(_ENTRY):
            out[i].append(np.frombuffer(b, t, n, at))
            at += n * np.dtype(t).itemsize
    return [np.concatenate(o) for o in out]


def _anchor_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in chunks(batch, limit=TEXT_BYTES):
            a, n = np.unique(fragments(c)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(n)], ["a", "n"])


def _hot_anchors(texts: DataFrame) -> np.ndarray:
    """Anchors whose fragments would fill a shard of their own, ascending; 8 MB at most."""
    some = texts.where(F.pmod(F.xxhash64("doc", "h"), F.lit(TOLD)) == 0).select("text")
    count = some.mapInArrow(lean(_anchor_counts), "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_TOLD)
    top = count.orderBy(F.desc("n"), "a").limit(HOT_LIST).toArrow()
    return np.sort(top.column("a").to_numpy().view(np.uint64))


def _side_key(cols: list[np.ndarray]) -> np.ndarray:
    """Anchor and tag of entries with one tag."""
    left, right = cols[5].astype(np.uint64), cols[6].astype(np.uint64)
    return mix(cols[0] + (left + (right << np.uint64(16))) * np.uint64(0x9E3779B97F4A7C15))


def _sides(cols: list[np.ndarray]) -> list[np.ndarray]:
    """Entries of one tag each of some fragments: those with a left tag, then those with a right one."""
    own = [np.flatnonzero(cols[5]), np.flatnonzero(cols[6])]
    out = [np.concatenate([x[at] for at in own]) for x in cols]
    out[5][len(own[0]) :] = 0
    out[6][: len(own[0])] = 0
    return out


def _combined(cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(entries whose key occurs in several documents of these, entries to pass on).

    What others need of a key that is known to be shared is its least and largest document; entries of other keys all go on.
    """
    key, doc = _side_key(cols), cols[1]
    order = np.lexsort((doc, key))
    head = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])[: len(key)])
    tail = np.append(head[1:], len(key)) - 1
    shared = np.repeat(doc[order[head]] < doc[order[tail]], tail - head + 1)
    ends = np.zeros(len(key), bool)
    ends[head] = ends[tail] = True
    return order[shared], order[~shared | ends]


def _dealt(cols: list[np.ndarray], shard: np.ndarray, tasks: int) -> pa.RecordBatch:
    """One row a shard."""
    order = np.argsort(shard, kind="stable")
    cols, shard = [np.ascontiguousarray(x[order], t) for x, (_, t) in zip(cols, _ENTRY, strict=True)], shard[order]
    cut = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])[: len(shard)]), len(shard))
    own = shard[cut[:-1]]
    blobs = [b"".join(x[lo:hi].tobytes() for x in cols) for lo, hi in zip(cut[:-1], cut[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array((own % tasks).astype(np.int32)), pa.array(own), pa.array(blobs, pa.binary())], ["task", "shard", "entries"])


def _anchors(shards: int, tasks: int, hot: np.ndarray):
    """Each block's fragments, one row a shard; a text that a document holds in several rows of a batch counts once.

    Shards below 0 hold sides of hot anchors that a task knows to be shared.
    """

    def passed(held: list[list[np.ndarray]], last: bool) -> Iterator[pa.RecordBatch]:
        """What is known to be shared; the rest goes on at the end, and where holding it would take too much."""
        cols = [np.concatenate(x) for x in zip(*held, strict=True)]
        asked, rest = _combined(cols)
        known, cols = [x[asked] for x in cols], [x[rest] for x in cols]
        held[:] = [cols]
        if len(asked):
            yield _dealt(known, -1 - (known[2] & 0xFFFF), tasks)
        if last or len(rest) > HELD // 2:
            held.clear()
            yield _dealt(cols, (_side_key(cols) % np.uint64(shards)).astype(np.int64), tasks)

    def deal(found: list[list[np.ndarray]]) -> pa.RecordBatch:
        cols = [np.concatenate(x) for x in zip(*found, strict=True)]
        found.clear()
        return _dealt(cols, (cols[0] % np.uint64(shards)).astype(np.int64), tasks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        found: list[list[np.ndarray]] = []
        for batch in batches:
            docs, hs = batch.column("doc").to_numpy(), batch.column("h").to_numpy()
            order = np.lexsort((docs, hs))
            one = np.sort(order[np.append(True, (hs[order][1:] != hs[order][:-1]) | (docs[order][1:] != docs[order][:-1]))[: len(batch)]])
            for lo in range(0, len(one), TEXT_ROWS):
                own = one[lo : lo + TEXT_ROWS]
                for c in chunks(batch.select(["text"]).take(pa.array(own)), limit=TEXT_BYTES):
                    a, s, e, text, left, right = fragments(c)
                    row = own[c.row0 + text]
                    cols = [x.astype(t, copy=False) for x, (_, t) in zip((a, docs[row], hs[row], s - c.offs[text], e - s, left, right), _ENTRY, strict=True)]
                    if len(hot) and len(a):
                        is_hot = hot[np.minimum(np.searchsorted(hot, a), len(hot) - 1)] == a
                        if is_hot.any():
                            held.append(_sides([x[is_hot] for x in cols]))
                            cols = [x[~is_hot] for x in cols]
                            if sum(len(x[0]) for x in held) > HELD:
                                yield from passed(held, False)
                    if len(cols[0]):
                        found.append(cols)
                        if sum(len(x[0]) for x in found) > DEALT:
                            yield deal(found)
        if found:
            yield deal(found)
        if held:
            yield from passed(held, True)

    return run


def _shared(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which rows have a key that occurs in several documents."""
    order = np.argsort(key)
    head = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])[: len(key)])
    lo, hi = np.minimum.reduceat(doc[order], head), np.maximum.reduceat(doc[order], head)
    out = np.zeros(len(key), bool)
    out[order] = np.repeat(lo < hi, np.diff(np.append(head, len(key))))
    return out


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fragments whose anchor and one of its sides occur in several documents; one shard at a time."""
    for batch in whole_groups(batches, "shard", 1):
        a, doc, h, start, size, left, right = _unpack(batch.column("entries").to_pylist())
        known = batch.column("shard")[0].as_py() < 0
        some = np.flatnonzero(_shared(a, doc)) if len(a) and not known else np.arange(len(a) if known else 0)
        ask = np.full(len(some), known)
        for tag in (left[some], right[some]) if not known else ():
            own = np.flatnonzero(tag)
            if len(own):
                ask[own] |= _shared(mix(a[some[own]] + tag[own] * np.uint64(0x9E3779B97F4A7C15)), doc[some[own]])
        at = some[ask]
        yield pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(h[at]), pa.array(a[at].view(np.int64)), pa.array(start[at].astype(np.int32)), pa.array((start[at] + size[at]).astype(np.int32))], [x.split()[0] for x in _ASKED.split(", ")])


# --------------------------------------------------------------------------------------------------- settling


def _runs(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of the union of the ranges of each text; ranges that touch are joined."""
    order = np.lexsort((start, text))
    text, start, end = text[order], start[order], end[order]
    if not len(text):
        return text, start, end
    lift = np.cumsum(np.append(True, text[1:] != text[:-1])) * (np.int64(end.max()) + 2)  # each text on a stretch of its own
    reach = np.maximum.accumulate(end + lift)
    head = np.flatnonzero(np.append(True, start[1:] + lift[1:] > reach[:-1]))
    tail = np.append(head[1:], len(text)) - 1
    return text[head], start[head], (reach - lift)[tail]


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the fragments that have to be compared."""
    for batch in batches:
        if not len(batch):
            continue
        buf, offs = column(batch, "text")
        lists = batch.column("asked")
        n = lists.value_lengths().to_numpy(zero_copy_only=False)
        row, flat = np.repeat(np.arange(len(batch)), n), lists.flatten()
        start = flat.field("start").to_numpy().astype(np.int64)
        one = np.unique(row << 32 | start, return_index=True)[1]  # a side of a hot anchor may be asked for more than once
        row, start, flat = row[one], start[one], flat.take(pa.array(one))
        end = flat.field("end").to_numpy().astype(np.int64)
        cut = np.append(0, np.cumsum(end - start))
        lo = 0
        while lo < len(row):
            hi = max(lo + 1, int(np.searchsorted(cut, cut[lo] + CUT_BYTES, "right")) - 1)
            size = end[lo:hi] - start[lo:hi]
            edge = cut[lo : hi + 1] - cut[lo]
            at = np.repeat(offs[row[lo:hi]] + start[lo:hi] - edge[:-1], size) + np.arange(edge[-1])
            part = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(buf[at])])
            own = pa.array(row[lo:hi])
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(own), batch.column("h").take(own), flat.field("a").slice(lo, hi - lo), flat.field("start").slice(lo, hi - lo), part], ["doc", "h", "a", "start", "part"])
            lo = hi


_SETTLED = _RUNS + ", window binary"


def _settled(doc: np.ndarray, h: np.ndarray, start: np.ndarray, end: np.ndarray, windows: list[bytes] | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(h), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(windows or [None] * len(doc), pa.binary())], [x.split()[0] for x in _SETTLED.split(", ")])


def _named(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Numbers of the texts (doc, h) of some rows, equal for equal ones."""
    order = np.lexsort((h, doc))
    out = np.empty(len(doc), np.int64)
    out[order] = np.cumsum(np.append(False, (doc[order][1:] != doc[order][:-1]) | (h[order][1:] != h[order][:-1]))[: len(doc)])
    return out


def _covered(doc: np.ndarray, h: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges of the texts of some rows (doc, h), as runs."""
    name = _named(doc, h)
    one = np.empty(len(doc), np.int64)
    one[name] = np.arange(len(doc))
    t, s, e = _runs(name[row], start, end)
    return doc[one[t]], h[one[t]], s, e


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffix arrays over whole shards: runs that are covered, and a holder of each window of an anchor with several shards.

    Fragments of equal bytes are one string of the array, held by the least of their documents; those of other documents are
    covered whole.
    """
    for batch in whole_groups(batches, "shard", ARRAY_PARTS):
        docs, hs, places = batch.column("doc").to_numpy(), batch.column("h").to_numpy(), batch.column("start").to_numpy().astype(np.int64)
        splits = batch.column("split").to_numpy(zero_copy_only=False)
        for lo in range(0, len(batch), ARRAY_PARTS + HOT_ANCHOR * 4):  # whole groups are smaller but for a freak of dealing
            hi = min(len(batch), lo + ARRAY_PARTS + HOT_ANCHOR * 4)
            doc, h, at, split = (x[lo:hi] for x in (docs, hs, places, splits))
            coded = batch.column("part").slice(lo, hi - lo).dictionary_encode()
            code = coded.indices.to_numpy()
            buf, offs = column(pa.RecordBatch.from_arrays([coded.dictionary], ["part"]), "part")
            text, head, size = buf[offs[0] : offs[-1]], offs[:-1] - offs[0], np.diff(offs)
            first = np.full(len(size), np.iinfo(np.int64).max)
            np.minimum.at(first, code, doc)
            place, part, _, least = window_groups(text, head, size, first)
            by = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[by], np.arange(len(size) + 1))
            later, own = np.flatnonzero(doc > first[code]), np.flatnonzero(doc == first[code])
            n = np.diff(cut)[code[own]]
            row = np.repeat(own, n)
            win = by[np.repeat(cut[code[own]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            start = at[row] + place[win] - head[part[win]]
            gone = doc[row] > least[win]
            ends = np.append(at[later] + size[code[later]], start[gone] + WIDTH)
            yield _settled(*_covered(doc, h, np.append(later, row[gone]), np.append(at[later], start[gone]), ends))
            ask = np.flatnonzero(~gone & (split[row] | (hi - lo < len(batch))))
            if len(ask):
                data = text.tobytes()
                yield _settled(doc[row[ask]], h[row[ask]], start[ask], start[ask] + WIDTH, [data[p : p + WIDTH] for p in place[win[ask]].tolist()])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Holders of equal windows from several shards: all but those of the least document are covered."""
    got = [b for b in batches if len(b)]
    if not got:
        return
    t = pa.Table.from_batches(got)
    doc, h, start = (t.column(n).to_numpy() for n in ("doc", "h", "start"))
    buf, offs = column(t.select(["window"]).combine_chunks().to_batches()[0], "window")
    windows = buf[offs[0] : offs[-1]].view(f"S{WIDTH}")  # all of one length, so padding tells nothing apart
    merged = np.unique(windows)
    at = np.searchsorted(merged, windows)
    least = np.full(len(merged), np.iinfo(np.int64).max)
    np.minimum.at(least, at, doc)
    gone = doc > least[at]
    start = start[gone].astype(np.int64)
    yield _settled(*_covered(doc, h, np.flatnonzero(gone), start, start + WIDTH))


# ---------------------------------------------------------------------------------------------------- results


def _finish(texts: bool):
    """The results of each text; with texts, also what is left of it, without characters that were cut through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, TEXT_ROWS) for b in batches for lo in range(0, len(b), TEXT_ROWS)):
            cols: list[list] = [[] for _ in range(5)]
            buf, offs = column(batch, "text")
            for i, (copy, r) in enumerate(zip(batch.column("copy").to_pylist(), batch.column("runs"), strict=True)):
                b = buf[offs[i] : offs[i + 1]].tobytes()
                s = e = np.zeros(0, np.int64)
                if copy and len(b) >= WIDTH:
                    s, e = np.zeros(1, np.int64), np.array([len(b)])
                elif r.is_valid:
                    x = r.values
                    s, e = x.field("start").to_numpy(), x.field("end").to_numpy()
                    _, s, e = _runs(np.zeros(len(s), np.int64), s.astype(np.int64), e.astype(np.int64))
                at, left = 0, []
                for x, y in zip(s.tolist(), e.tolist(), strict=True):
                    left.append(b[at:x])
                    at = y
                kept = b"".join([*left, b[at:]])
                for col, v in zip(cols, (len(b), len(b) - len(kept), len(s), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if texts else None), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], ["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _covered_runs(texts: DataFrame, total: int) -> DataFrame:
    """(doc, h, runs) of the texts (doc, h, text) that lose bytes; written to the shared folder."""
    spark = texts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, -(-total // SHARD_BYTES))
    tasks = max(min(parts, shards), -(-total // TASK_BYTES))
    prints = texts.mapInArrow(lean(_anchors(shards, tasks, _hot_anchors(texts))), "task int, shard long, entries binary")
    asked = materialise(prints.repartition(tasks, "task").sortWithinPartitions("shard").mapInArrow(lean(_ask), _ASKED))
    many = asked.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(HOT_ANCHOR))).cast("int").alias("ways")).where("ways > 1")
    many = materialise(many)
    lists = asked.groupBy("doc", "h").agg(F.collect_list(F.struct("a", "start", "end")).alias("asked"))
    lists = materialise(lists)
    some = texts.join(_few(lists.select("doc", "h")), ["doc", "h"], "left_semi").dropDuplicates(["doc", "h"])
    cut = lists.join(some, ["doc", "h"]).select("doc", "h", "asked", "text").mapInArrow(lean(_cut_out), "doc long, h long, a long, start int, part binary")
    dealt = cut.join(_few(many), "a", "left").withColumn("split", F.col("ways").isNotNull())
    dealt = dealt.withColumn("shard", F.when(F.col("split"), F.xxhash64("a", F.pmod(F.xxhash64("doc", "h", "start"), F.col("ways")))).otherwise(F.col("a")))
    found = dealt.select("shard", "split", "doc", "h", "start", "part").repartition(max(parts, -(-total // TASK_BYTES)), "shard").sortWithinPartitions("shard").mapInArrow(lean(_compare), _SETTLED)
    found = materialise(found)
    held = found.where("window is not null")
    merged = held.repartition(max(parts, -(-held.count() // MERGED)), "window").mapInArrow(lean(_merge), _SETTLED)
    runs = found.where("window is null").unionByName(merged).groupBy("doc", "h").agg(F.collect_list(F.struct("start", "end")).alias("runs"))
    runs = materialise(runs)
    discard(asked, many, lists, found)
    return runs


def stripped(docs: DataFrame, row: list[str], keep_text: bool = False) -> DataFrame:
    """row (a struct of these columns), n_bytes, n_removed, n_spans, kept_sha256, kept (null unless asked for) of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    last = F.lit((1 << 63) - 1).cast("long")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in row]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), last).alias("doc"), F.xxhash64(text).alias("h"), text_key(text).alias("key"), text.alias("text"))
    total, n = rows.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    common = rows.groupBy("key").agg(F.min("doc").alias("_first"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max(1, (n or 0) // COMMON_TEXTS))
    common = F.broadcast(materialise(common.select("key", "_first")))
    rows = rows.join(common, "key", "left").withColumn("copy", F.coalesce(F.col("doc") > F.col("_first"), F.lit(False))).drop("key", "_first")
    runs = _covered_runs(rows.where("not copy").select("doc", "h", "text"), total or 0)
    cols = ("row", "text", "copy", "runs")
    none = F.lit(None).cast(runs.schema["runs"].dataType)
    if runs.count() <= BROADCAST_IDS:  # only texts that lose something are shuffled
        ids = F.broadcast(runs.select("doc", "h"))
        whole = rows.join(ids, ["doc", "h"], "left_anti").withColumn("runs", none).select(*cols)
        cut = rows.join(ids, ["doc", "h"], "left_semi").join(runs, ["doc", "h"]).select(*cols).unionByName(whole)
    else:
        cut = rows.join(runs, ["doc", "h"], "left").select(*cols)
    kind = rows.schema["row"].dataType.simpleString()
    return cut.mapInArrow(lean(_finish(keep_text)), f"row {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")


def dedup_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row.

    A null text is an empty one.  Texts below WIDTH bytes lose nothing.  Rows of one doc_id take nothing from each
    other.  A null doc_id counts as 2^63 - 1, the largest there is.  Other columns are ignored.
    """
    out = stripped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"])
    return out.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def kept_documents(docs: DataFrame) -> DataFrame:
    """All rows and columns; text without the removed bytes, what is left of a cut character dropped.

    A text of which nothing but white space is left goes with its row; n_chars, where it is a column, follows the text.
    """
    out = stripped(docs, docs.columns, True)
    own = lambda c: F.col("row").getField(c)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(own("text"))
    left = out.where((F.col("n_removed") == 0) | (F.trim(F.col("kept")) != ""))
    cols = {"text": text.alias("text")} | ({"n_chars": F.char_length(F.coalesce(text, F.lit(""))).cast(dict(docs.dtypes)["n_chars"]).alias("n_chars")} if "n_chars" in docs.columns else {})
    return left.select(*[cols.get(c, own(c).alias(c)) for c in docs.columns])
