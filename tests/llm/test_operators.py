"""Operators against brute force, and the odd inputs every one of them takes: nulls, empties, repeats, extra columns."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from pointengine.llm import ctw, line_crf, near_dedup, nn_descent, packing, piece_scan, quality_pu, sharding, suffix_dedup, toxicity_fm
from pointengine.llm.textbytes import Chunk

WORDS = "the of and river stone light paper garden winter market silver copper window bridge letter".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(i, text(rng, rng.randrange(60, 160))) for i in range(60)]
    passage = text(rng, 60)
    out += [(100 + i, text(rng, 40) + "\n" + passage + "\n" + text(rng, 30)) for i in range(6)]
    base = out[3][1].split()
    for i in range(8):
        w = list(base)
        w[rng.randrange(len(w))] = f"edit{i}"
        out.append((200 + i, " ".join(w)))
    out += [(300, out[0][1]), (301, out[0][1]), (302, None), (303, ""), (304, " \n\t "), (305, "é" * 80), (305, "é" * 80), (None, out[5][1]), (306, text(rng, 9000)), (307, "BUY!! NOW!!\n" * 60)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in rows], "doc_id long, text string, rid string, node long, y int, score int")


@pytest.fixture(scope="module")
def labels(spark, rows):
    return spark.createDataFrame([(i, int(i < 300), int(i % 7 == 0)) for i, _ in rows if i is not None], "doc_id long, quality int, toxic int")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")


def test_empty_tables(spark):
    d, lab = empty(spark)
    assert line_crf.rule_documents(d, line_crf.fit(d, lab)).count() == 0
    assert suffix_dedup.dedup_documents(d).count() == 0
    assert near_dedup.near_duplicates(d).count() == 0
    assert toxicity_fm.score_documents(d, toxicity_fm.fit(d, lab)).count() == 0
    assert quality_pu.score_documents(d, quality_pu.fit(d, lab)).count() == 0
    assert packing.pack(d).count() == 0
    assert sharding.shard_documents(d).count() == 0
    assert ctw.score_documents(d).count() == 0
    assert nn_descent.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_rules(docs, labels, rows):
    got = line_crf.rule_documents(docs, line_crf.fit(docs, labels)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        tri = list(zip(w, w[1:], w[2:]))
        rep = {k + j for k, x in enumerate(tri) if tri.count(x) > 1 for j in range(3)} if len(w) < 2000 else None
        r = by[i][0]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")))
        if rep is not None:
            assert r.n_repeat_words == len(rep)
            assert r.base_failed == (len(w) < 50 or 100 * len(rep) > 50 * len(w))


def test_viterbi_is_best():
    rng = np.random.default_rng(1)
    f = line_crf.LineField(rng.normal(size=4), rng.normal(size=2), rng.normal(size=(2, 2)))
    sizes = [1, 7, 3, 5]
    x, of = rng.normal(size=(sum(sizes), 3)), np.repeat(np.arange(4), sizes)
    got, at = line_crf.viterbi(f, x, of), 0
    for n in sizes:
        un = x[at : at + n] @ f.weights[:-1] + f.weights[-1]
        score = lambda y: f.start[y[0]] + sum(un[i] * y[i] for i in range(n)) + sum(f.move[a, b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
        best = max(itertools.product((0, 1), repeat=n), key=score)
        assert tuple(got[at : at + n]) == best
        at += n


def test_suffix_dedup(docs, rows):
    got = {}
    for r in suffix_dedup.dedup_documents(docs).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    order = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    first = {}
    for i, t in order:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    for i, t in rows:
        b = (t or "").encode()
        cov = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 49):
            f = first[b[k : k + 50]]
            if f != i and (i is None or f is not None and f < i):
                cov[k : k + 50] = True
        kept = bytes(x for x, c in zip(b, cov) if not c)
        assert (len(b), int(cov.sum()), int((cov & ~np.append(False, cov[:-1])).sum()), hashlib.sha256(kept).hexdigest()) in got[i]


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(2)
    t = rng.integers(97, 99, 200).astype(np.uint8)
    end = np.repeat([120, 200], [120, 80])
    sa = suffix_dedup.suffix_array(t, end, 120)
    suf = [t[i : end[i]].tobytes() for i in range(200)]
    assert [suf[i] for i in sa] == sorted(suf)
    lcp = suffix_dedup.kasai(t, np.array([0, 120]), np.array([120, 80]), sa, end)
    for j in range(1, 200):
        a, b = suf[sa[j - 1]], suf[sa[j]]
        n = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert lcp[j] == min(n, 50)


def test_near_duplicates(docs, rows):
    got = {}
    for r in near_dedup.near_duplicates(docs).collect():
        got.setdefault(r.doc_id, r.class_id)
    assert {got[k] for k in (0, 300, 301)} == {0} and {got[200 + i] for i in range(8)} == {3} == {got[3]}
    assert got[302] == got[303] and got[100] == 100 and got[101] == 101 and got[305] == 305
    kept = [r.doc_id for r in near_dedup.kept_documents(docs).select("doc_id", "rid").collect()]
    assert len(kept) == len(set(kept)) and 3 in kept and 200 not in kept and 305 in kept


def test_packing(docs, rows):
    got = packing.pack(docs, 4, 4096).collect()
    assert len(got) == len(rows) and all(r.n_tokens <= r.boundary for r in got)
    for key in {(r.bucket, r.batch) for r in got}:
        own = [r for r in got if (r.bucket, r.batch) == key]
        assert sorted(r.slot for r in own) == list(range(len(own))) and (len(own) == 1 or len(own) * own[0].boundary <= 4096)


def test_padding_is_least_over_raw_lengths(spark, docs, rows):
    got = packing.pack(docs, 3, 4096).collect()
    sizes = sorted(len((t or "").encode()) + 1 for _, t in rows)
    edges = sorted(set(sizes))
    pad = lambda cut: sum(min(b for b in cut if b >= n) - n for n in sizes)
    best = min(pad([*c, edges[-1]]) for k in range(3) for c in itertools.combinations(edges[:-1], k))
    assert sum(r.boundary - r.n_tokens for r in got) == best and {r.boundary for r in got} <= set(edges)
    own = spark.createDataFrame([(i, n) for i, n in enumerate([7, 7, 9, 100, 101, None, 0])], "doc_id long, n int").withColumn("text", F.lit("x"))
    assert sorted({(r.boundary, r.bucket) for r in packing.pack(own, 3, 64, length="n").collect()}) == [(0, 0), (9, 1), (101, 2)]


def test_bins_ascend_with_lengths(spark):
    sizes = sorted({x + d for e in range(13, 40) for x in (2**e, 2**e * 5 // 4) for d in (-1, 0, 1)} | set(range(8000, 9000)))
    bins = [r[0] for r in spark.createDataFrame([(n,) for n in sizes], "n long").coalesce(1).select(packing._bin(F.col("n"))).collect()]
    assert bins == sorted(bins) and len(set(bins)) < 15000


def test_boundaries_are_optimal():
    rng = np.random.default_rng(3)
    for _ in range(20):
        n = 8
        edge = np.cumsum(rng.integers(1, 9, n))
        count = rng.integers(1, 9, n)
        sums = count * edge - rng.integers(0, 2, n)
        bounds, pad = packing.optimal_boundaries(edge, count, sums, 3)
        cost = lambda cut: sum(count[i] * min(b for b in cut if b >= edge[i]) for i in range(n)) - sums.sum()  # noqa: B023, E731
        assert pad == cost(bounds) == min(cost([*c, edge[-1]]) for k in range(3) for c in itertools.combinations(edge[:-1], k))
    n = 400
    edge, count = np.cumsum(rng.integers(1, 9, n)), rng.integers(1, 99, n)
    docs, best = np.append(0, np.cumsum(count)), edge * np.cumsum(count)
    for _ in range(9):
        best = np.array([min([best[j], *(best[i] + edge[j] * (docs[j + 1] - docs[i + 1]) for i in range(j))]) for j in range(n)])
    assert packing.optimal_boundaries(edge, count, edge * count, 10)[1] == best[-1] - (edge * count).sum()


def test_sharding(docs, rows):
    got = sharding.shard_documents(docs).collect()
    assert len(got) == len(rows)
    for s in range(16):
        own = [r.slot for r in got if r.shard == s]
        assert sorted(own) == list(range(len(own)))
    assert all(r.grown_shard in (r.shard, 16) for r in got)
    texts = {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows}
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == texts


def test_classifiers(docs, labels, rows):
    for op in (toxicity_fm, quality_pu):
        got = op.score_documents(docs, op.fit(docs, labels)).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
        assert all(r.held_out == (i is None or zlib.crc32(str(i).encode()) % 5 == 0) for r in got for i in [r.doc_id])


def test_machine_learns_a_pair():
    rng = np.random.default_rng(4)
    has = rng.random((2000, 2)) < 0.5
    y = (has[:, 0] & has[:, 1]).astype(float)
    t, k = np.nonzero(has)
    m = toxicity_fm.fit_machine(t, k, y, np.arange(2, dtype=np.uint64), 400)
    assert ((m.logits(t, k, 2000) > 0) == (y > 0)).mean() > 0.98


def test_prior_estimate():
    rng = np.random.default_rng(6)
    good, bad = rng.normal(3, 1, (3000, 4)), rng.normal(-3, 1, (600, 4))
    net = quality_pu.fit_network(good[:1000], np.concatenate([good[1000:], bad]))
    assert abs(net.prior - 2000 / 2600) < 0.08 and (net.score(bad) < 0.3).mean() > 0.95 and (net.score(good) >= 0.3).mean() > 0.98


def _ctw_brute(train, query):
    """Context-tree weighting with counts in dictionaries, straight from the definition."""
    from math import exp, lgamma, log, log10, pi

    def form(t):
        return b"\n" * ctw.DEPTH + b"".join(w + b" " for w in (t or "").encode().lower().split()) + b"\n"

    n = {}
    for t in train:
        b = form(t)
        for i in range(ctw.DEPTH, len(b)):
            for k in range(8):
                node, bit = (1 << k) | (b[i] >> (8 - k)), b[i] >> (7 - k) & 1
                for d in range(ctw.DEPTH + 1):
                    n.setdefault((node, b[i - d : i]), [0, 0])[bit] += 1
    kids = {}
    for node, s in n:
        if s:
            kids.setdefault((node, s[1:]), set()).add((node, s))
    kt = lambda c: lgamma(c[0] + 0.5) + lgamma(c[1] + 0.5) - lgamma(sum(c) + 1) - log(pi)
    memo = {}

    def weighted(key):
        if key not in memo:
            if len(key[1]) == ctw.DEPTH:
                memo[key] = kt(n[key])
            else:
                a, b = kt(n[key]), sum(weighted(c) for c in kids[key])
                memo[key] = max(a, b) + log(1 + exp(-abs(a - b))) - log(2)
        return memo[key]

    b, total = form(query), 0.0
    for i in range(ctw.DEPTH, len(b)):
        for k in range(8):
            node, bit = (1 << k) | (b[i] >> (8 - k)), b[i] >> (7 - k) & 1
            q = None
            for d in range(ctw.DEPTH, -1, -1):
                c = n.get((node, b[i - d : i]))
                if c:
                    p = (c[1] + 0.5) / (sum(c) + 1)
                    own = exp(kt(c) - log(2) - weighted((node, b[i - d : i]))) if d < ctw.DEPTH and q is not None else 1
                    q = p if q is None else own * p + (1 - own) * q
            q = 0.5 if q is None else q
            total += log10(q if bit else 1 - q)
    return total


def test_context_tree(docs, rows):
    small = docs.where("doc_id < 12 or doc_id in (302, 305)")
    mine = {r.doc_id: r for r in ctw.score_documents(small).collect()}
    joined = {r.doc_id: r for r in ctw.score_documents(small, 200, 50).collect()}
    own = [(i, t) for i, t in rows if i is not None and (i < 12 or i in (302, 305))]
    train = [t for i, t in own if zlib.crc32(str(i).encode()) % 10]
    for i, t in own[:5] + own[-3:]:
        assert mine[i].score == pytest.approx(_ctw_brute(train, t), rel=1e-9)
    for i, r in mine.items():
        assert joined[i].score == pytest.approx(r.score) and joined[i].base_score == pytest.approx(r.base_score) and joined[i].n_known == r.n_known


def test_neighbours(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 12)).astype(np.float32)
    x[50:80] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1020, [0.0] * 12), (1040, [float("nan")] * 12), (1060, [1.0, None] * 6)]
    got = {}
    for r in nn_descent.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 400, 20))
    x = x.astype(float)
    for q, found in got.items():
        s = x @ x[q]
        want = sorted((i for i in range(400) if i != q), key=lambda i: (-s[i], i))[:20]
        assert [v for _, v, _ in sorted(found)] == want


def test_the_descent_makes_the_graph(spark, monkeypatch):
    """Links and search with and without its rounds; the trees of the start measure few of the pairs."""
    n = 3000
    x = np.random.default_rng(6).normal(size=(n, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    best = np.argsort(-s, 1)[:, :20]
    vecs = spark.createDataFrame([(i, v.astype(np.float16).tobytes()) for i, v in enumerate(x)], "node long, vec binary").cache()
    asked = vecs.where("node % 20 = 0").select(F.col("node").alias("query"), F.col("vec").alias("qvec"), "node")
    monkeypatch.setattr(nn_descent, "BEAM", 24)
    monkeypatch.setattr(nn_descent, "OPENED", 4)

    def recalls():
        graph = nn_descent.build_graph(vecs, n, 24)
        links = np.mean([len(set(r.ids[:20]) & set(best[r.node].tolist())) for r in graph.collect()]) / 20
        walks = np.mean([len(set(r.ids[:20]) & set(best[r.query].tolist())) for r in nn_descent.search(graph, vecs, asked).collect()]) / 20
        return links, walks

    links, walks = recalls()
    monkeypatch.setattr(nn_descent, "ITERATIONS", 0)
    links0, walks0 = recalls()
    assert links >= 0.9 and walks >= 0.9 and links0 < 0.35 and walks0 < 0.75
    for size in (500, 2000, 10_000, 51_282, 10**7):
        leaf = min(nn_descent.LEAF, max(nn_descent.LEAST_LEAF, size // nn_descent.START))
        assert nn_descent.TREES * leaf < 0.1 * size


def test_a_round_of_blocks(monkeypatch):
    """A round of the descent by its definition: all that meet are measured and the best kept; what blocks tell each other are few messages; a
    second round measures new pairs only."""
    for name, v in (("NEIGHBOURS", 6), ("FORWARD", 6), ("BACKWARD", 500), ("PARTNERS", 500)):
        monkeypatch.setattr(nn_descent, name, v)
    n, blocks, rng = 240, 4, np.random.default_rng(12)
    x = rng.normal(size=(n, 8)).astype(np.float16)
    s = x.astype(np.float32) @ x.astype(np.float32).T
    lists = {v: {m: s[v, m] for m in rng.permutation([m for m in range(n) if m != v])[:6].tolist()} for v in range(n)}
    sent = []

    def exchange(messages, act):
        told, out = {}, nn_descent._Out()
        for block, kind, k, *parts in sorted(messages, key=lambda r: r[:3]):
            told.setdefault(block, nn_descent._Told(block)).add(kind, k, tuple(parts))
        for t in told.values():
            act(t, out)
        sent.append(len(out.rows))
        return out.rows

    only = lambda rows, *kinds: [r for r in rows if r[1] in kinds]
    d, first = nn_descent, nn_descent._Out()
    node = np.arange(n)
    first.spread(d._block_of(node, blocks), blocks, d.NODE, 0, node, x)
    pairs = [(v, m, w) for v in lists for m, w in lists[v].items()]
    own, other, score = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]), np.array([p[2] for p in pairs], np.float32)
    first.spread(d._block_of(own, blocks), blocks, d.PUT, 0, own, other, score)
    state = exchange(first.rows, d._merge)
    measured = []
    for _ in range(2):
        back = exchange(only(state, d.LIST), d._backward(blocks))
        met = exchange(only(state, d.LIST) + back, d._gather(blocks))
        told = exchange(only(state, d.NODE) + only(met, d.ASK), d._tell)
        puts = exchange(told + only(met, d.MET), d._meet(blocks))
        measured.append(sum(len(r[3]) // 8 for r in puts))
        state = exchange(only(state, d.NODE, d.LIST) + puts, d._merge)
        meet = {v: {v, *lists[v], *(u for u in lists if v in lists[u])} for v in lists}
        best = {v: dict(lists[v]) for v in lists}
        for group in meet.values():
            for a in group:
                best[a] |= {b: s[a, b] for b in group if b != a}
        lists = {v: dict(sorted(c.items(), key=lambda e: (-e[1], e[0]))[:6]) for v, c in best.items()}
        got = {}
        for r in only(state, d.LIST):
            ids, of = np.frombuffer(r[3], np.int64).reshape(-1, 6), np.frombuffer(r[6], np.int64)
            got |= dict(zip(of.tolist(), ids.tolist(), strict=True))
        assert got == {v: list(c) for v, c in lists.items()}
    assert max(sent) <= blocks * blocks + 4 * blocks and measured[1] < measured[0]


def test_nearest_over_many_leaves(spark):
    """More rows than a leaf takes, so trees, descent and search all have their part: recall against brute force."""
    x = np.random.default_rng(4).normal(size=(3000, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in nn_descent.nearest(rows).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    x = x.astype(float)
    met = 0
    for q in range(0, 3000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        met += len(set(np.lexsort((np.arange(3000), -s))[:20].tolist()) & got[q])
    assert met / (20 * 150) >= 0.9


@pytest.fixture(scope="module")
def vocabulary():
    pieces = [bytes([i]) for i in range(256)] + [w.encode() for w in (" ", " the", "t", "h", "e", " of", "he", "ri", "ver", " river", "er", "1", "2", "12", "  ", "st", "one", " stone")]
    scores = np.concatenate([np.full(256, -30.0), -np.linspace(5, 12, len(pieces) - 256)])
    return piece_scan.Vocabulary(tuple(pieces), scores, np.arange(256), -30.0)


def _best_cut(v, b):
    best = [0.0] + [-1e30] * len(b)
    table = {p: s for p, s in zip(v.pieces, v.scores)}
    for e in range(1, len(b) + 1):
        for n in range(1, min(8, e) + 1):
            p = b[e - n : e]
            if p in table:
                best[e] = max(best[e], best[e - n] + table[p])
    return best[-1]


def test_pieces(spark, docs, rows, vocabulary):
    got = {}
    for r in piece_scan.encode(docs, vocabulary).collect():
        got.setdefault(r.doc_id, r)
    for i, t in rows:
        b = (" " + t).encode() if t else b""
        assert b"".join(vocabulary.pieces[k] for k in got[i].ids) == b
        if len(b) < 3000:
            assert got[i].score == pytest.approx(_best_cut(vocabulary, b), rel=1e-5)
    back = piece_scan.decode(piece_scan.encode(docs, vocabulary), vocabulary).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(i), t or "") for i, t in rows)


def test_scan_equals_words(vocabulary, rows):
    lat = piece_scan.Lattice(vocabulary)
    for _, t in rows[:12]:
        b = (" " + t).encode()
        place, size, score = lat.cut_giant(np.frombuffer(b, np.uint8), 16)
        assert score == pytest.approx(_best_cut(vocabulary, b), rel=1e-4)
        assert place.tolist() == np.append(0, np.cumsum(size)[:-1]).tolist() and size.sum() == len(b)


def test_pipeline(spark, docs, labels, tmp_path):
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [r.doc_id for r in out]
    assert len(ids) == len(set(ids)) and not {300, 301} & set(ids) and {0, 3, 100} <= set(ids)


def _labelled_lines():
    """Good prose, and boilerplate that passes the base rule: 45 lines each, more than a window of the fit."""
    rng = random.Random(11)
    good = [(i, "\n".join(text(rng, 9).capitalize() + "." for _ in range(45))) for i in range(60)]
    bad = [(100 + i, "\n".join(f"{a.upper()}!!! $$$ {rng.randrange(999)} | {rng.choice(WORDS).upper()}{rng.randrange(999)} >>>" for a in rng.choices(WORDS, k=45))) for i in range(60)]
    return good, bad


def test_rules_stage_learns_from_the_labelled_table(spark, tmp_path):
    """What the classifier has let through holds one boilerplate text only; the stage removes it all the same."""
    import corpus_pipeline

    good, bad = _labelled_lines()
    spark.createDataFrame(good + bad, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 100), 0) for i, _ in good + bad], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    held_out = next(r for r in bad if zlib.crc32(str(r[0]).encode()) % 5 == 0)
    docs = spark.createDataFrame([*good, held_out], "doc_id long, text string")
    assert not line_crf.rule_documents(docs, line_crf.LineField.plain()).where(f"doc_id = {held_out[0]} and not kept").count()  # the base rule lets it pass
    assert {r.doc_id for r in corpus_pipeline.rules(spark, docs, str(tmp_path)).collect()} == {i for i, _ in good}


def test_filter_stages_judge_rows(spark):
    """Rows that share a doc_id, or have none, do not save each other."""
    good, bad = _labelled_lines()
    labelled = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in good + bad], "doc_id long, quality int")
    rows = [(i, t, k, k) for k, (i, t) in enumerate([(None, good[0][1]), (None, bad[0][1]), (None, None), (7, good[1][1]), (7, bad[1][1])])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long, _text long")
    assert sorted(r.n for r in line_crf.kept_documents(docs, line_crf.fit(labelled, labels)).collect()) == [0, 3]
    both = labelled.selectExpr("doc_id", "text", "-1L as n", "0L as _text").unionByName(docs)
    got = quality_pu.kept_documents(both, labels).where("n >= 0")
    assert got.columns == docs.columns and sorted(r.n for r in got.collect() if r.n != 2) == [0, 3]


def test_chunk_edges():
    c = Chunk(np.frombuffer(b"a b\n\nc", np.uint8), np.array([0, 3, 3, 6]))
    assert c.lines()[2].tolist() == [0, 1, 2, 2, 2] and c.words()[2].tolist() == [0, 0, 2]


def test_near_dedup_arrays_stay_small():
    """A worker's arrays follow TEXT_BYTES and not the Arrow batch; what is signed is the same, each different text once."""
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(3)
    texts = [" ".join(str(rng.randrange(10**6)) for _ in range(150)) for _ in range(4000)]
    texts += texts[:40]
    batch = pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(t.encode()).digest()[:16] for t in texts]), pa.array(texts)], ["node", "text"])
    idf = np.ones((near_dedup.SKETCH_ROWS, near_dedup.BUCKETS), np.float32)
    for run in (near_dedup._bucket_counts, near_dedup._signed(idf)):
        list(run(iter([batch.slice(0, 10)])))  # tables that stay
        tracemalloc.start()
        for _ in run(iter([batch])):
            pass
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        print(run.__name__, peak / 1e6)
        assert peak < 40e6
    nodes = [n for out in near_dedup._signed(idf)(iter([batch])) for n in out.column("node").to_pylist()]
    assert nodes == batch.column("node").to_pylist()[:4000]


def test_suffix_dedup_arrays_stay_small():
    """A worker's arrays follow TEXT_BYTES and CUT_BYTES and not the Arrow batch; each different fragment is passed on once."""
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(4)
    texts = [" ".join(str(rng.randrange(10**6)) for _ in range(150)) for _ in range(6000)]
    ids = [*range(6000), *range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids), pa.array(texts + texts[:40])], ["doc", "h", "text"])
    asked = pa.array([[{"a": p, "start": p, "end": p + 200} for p in range(0, len(t) - 200, 200)] for t in texts])
    cut = pa.RecordBatch.from_arrays([*(c.slice(0, 6000) for c in batch.columns), asked], ["doc", "h", "text", "asked"])
    find = suffix_dedup._anchors(8, 4, np.zeros(0, np.uint64))
    for run, table, most in ((find, batch, 45e6), (suffix_dedup._cut_out, cut, 40e6)):
        list(run(iter([table.slice(0, 10)])))  # tables that stay
        tracemalloc.start()
        for _ in run(iter([table])):
            pass
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        print(run.__name__, peak / 1e6)
        assert peak < most
    a, doc, _, start, size, *_ = suffix_dedup._unpack([b for out in find(iter([batch])) for b in out.column("entries").to_pylist()])
    assert len(set(zip(a.tolist(), doc.tolist(), start.tolist(), strict=True))) == len(a) and set(doc.tolist()) == set(range(6000))
    assert (start + size <= np.array([len(t) for t in texts])[doc]).all()


def test_ctw_arrays_stay_small():
    """A worker's arrays follow TEXT_BYTES and TREES and not the Arrow batch; every string has the same counts and tree as when taken at once."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(5)
    texts = [text(random.Random(i), 200) for i in range(5000)]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(5000) % 10 == 0), pa.array(texts)], ["held_out", "text"])
    sym = rng.integers(97, 123, (500_000, 6), dtype=np.uint64)
    gram = np.unique(sum(sym[:, k] << np.uint64(8 * (5 - k)) for k in range(6))).view(np.int64)
    grams = pa.RecordBatch.from_arrays([pa.array(rng.permutation(gram)), pa.array(rng.integers(0, 50, len(gram)))], ["key", "n"])
    for run, table, most in ((ctw._count, batch, 60e6), (ctw._top, grams, 80e6)):
        list(run(iter([table.slice(0, 10)])))  # tables that stay
        tracemalloc.start()
        for _ in run(iter([table])):
            pass
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        print(run.__name__, peak / 1e6)
        assert peak < most
    out = pa.Table.from_batches(list(ctw._count(iter([batch]))))
    byte_strings = sum(len(t) + 2 for t, h in zip(texts, batch.column("held_out").to_pylist(), strict=True) if not h)  # a space and an end more
    assert sum(n for k, n in zip(out.column("kind").to_pylist(), out.column("n").to_pylist(), strict=True) if k == 0) == byte_strings


def test_ctw_trees_come_whole(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(6)
    gram = rng.permutation(np.unique(rng.integers(0, 3, (400, 6)) @ (256 ** np.arange(5, -1, -1))))
    batch = pa.RecordBatch.from_arrays([pa.array(gram), pa.array(rng.integers(1, 9, len(gram)))], ["key", "n"])
    root = lambda g: {int(x) >> 8 & 0xFFFF for x in g}
    for size in (1, 60, 1 << 17):
        monkeypatch.setattr(ctw, "TREES", size)
        parts = list(ctw._trees(iter([batch.slice(0, 150), batch.slice(150), batch.slice(0, 0)])))
        assert sorted(np.concatenate([g for g, _ in parts])) == sorted(gram) and sum(n.sum() for _, n in parts) == sum(batch.column("n").to_pylist())
        assert sum(len(root(g)) for g, _ in parts) == len(root(gram)) and all(len(g) <= size or len(root(g)) == 1 for g, _ in parts)
        assert len(parts) == {1: 9, 1 << 17: 1}.get(size, len(parts))
    assert not list(ctw._trees(iter([])))
