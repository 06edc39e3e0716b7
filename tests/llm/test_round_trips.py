"""Fill-in-middle and byte-level BPE against brute force, the library, and their own inverses."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pointengine.llm import byte_bpe, fill_middle

BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "extra int, doc_id long, text string, batch string, n int"  # columns that clash with an operator's own
PARTS = ["a", "s", "t", "re", "ve", "ll", "don", "'", "''", " ", "  ", "\n", "\r\n", "\t", "é", "中", "😀", "1", "²", "!", "-", "　", "\u0085", "\x1c", "\0", "ſ", "́", "क", "ा", "<|endoftext|>", "<|endoftext", "|>", "<P>", "<S>", "<M>", "<", "P>", " the", "http://"]


def made(n, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.choice([0, 1, 2, 3, 7, 63, 64, 65, 130]))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(0, i, t, "x", 7) for i, t in rows], SCHEMA)


def filled(doc_id, text):
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    t = text or ""
    n = len(t)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, t
    p, m, s = t[:a], t[a:b], t[b:]
    return (doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


ODD = [(None, "text of no id"), (None, None), (3, None), (4, ""), (4, "same id"), (4, "same id"), (-9, "é" * 700_000 + "\n <中>" * 200_000), (2**62, "big id")]


def test_fill_middle(spark):
    rows = [*enumerate(made(1500)), *ODD]
    got = fill_middle.transform(frame(spark, rows))
    assert sorted(map(tuple, got.collect()), key=str) == sorted((filled(*r) for r in rows), key=str)
    assert {r.form for r in got.select("form").collect()} == {"plain", "psm", "spm"}
    back = fill_middle.restore(got)
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=str) == sorted(((i, t or "") for i, t in rows), key=str)


def test_fill_middle_digest(spark):
    rows = [*enumerate(made(300, 8)), *ODD]
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    got = fill_middle.digest(frame(spark, rows))
    want = [(*(w := filled(*r))[:5], sha(w[5]), sha(r[1])) for r in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert fill_middle.digest(frame(spark, [])).collect() == [] == fill_middle.transform(frame(spark, [])).collect()


def test_fill_middle_other_draws(spark):
    rows = list(enumerate(["some text", "another"] * 40))
    assert {r.form for r in fill_middle.transform(frame(spark, rows), plain_from=100, spm_below=100).collect()} == {"spm"}
    one, two = ({(r.doc_id, r.output) for r in fill_middle.transform(frame(spark, rows), seed=s).collect()} for s in (1, 2))
    assert one != two


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE)


@pytest.fixture(scope="module")
def tables():
    return byte_bpe.ByteBpe.load(BPE).tables()


def ids_of(tables, texts):
    raw = [t.encode() for t in texts]
    ids, at = tables.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]


def test_cuts_are_never_inside_a_token(tables):
    """The table against a plain walk over the vocabulary."""
    inside = {(a, b) for i in range(50256) for t in (tables.token_bytes[tables.token_at[i] : tables.token_at[i + 1]].tolist(),) for a, b in zip(t, t[1:], strict=False)}
    assert {tuple(p) for p in np.argwhere(~tables.cut).tolist()} == inside and 0.9 < tables.cut.mean() < 1


def test_bpe_as_the_library(tables, library):
    texts = made(4000)
    assert ids_of(tables, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(PARTS), max_size=12).map("".join)), max_size=8))
def test_bpe_of_any_text(texts):
    t, lib = byte_bpe.ByteBpe.load(BPE).tables(), Tokenizer.from_file(BPE) if not hasattr(test_bpe_of_any_text, "lib") else test_bpe_of_any_text.lib
    test_bpe_of_any_text.lib = lib
    assert ids_of(t, texts) == [lib.encode(x, add_special_tokens=False).ids for x in texts]


def test_bpe_forgets(tables, library, monkeypatch):
    """A memory that is full starts anew, in the middle of a text or between two."""
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 50)
    for k in range(5):
        texts = made(40, 100 + k)
        assert ids_of(tables, texts) == [library.encode(x, add_special_tokens=False).ids for x in texts]


def test_bpe_hashes_that_collide(tables, library, monkeypatch):
    """Fragments that agree in the first hash are told apart by the second."""
    monkeypatch.setattr(byte_bpe.Chunk, "hashes", lambda self, s, e: (e - s).astype(np.uint64))
    tables.seen = byte_bpe._Seen()
    texts = made(60, 77)
    assert ids_of(tables, texts) == [library.encode(x, add_special_tokens=False).ids for x in texts]
    tables.seen = byte_bpe._Seen()


def test_bpe_digest_and_inverse(spark, library):
    long_one = "".join(made(4000, 9)) + "x" * 1_500_000 + " end\n\n  " * 30_000
    rows = [*enumerate(made(400, 6)), *ODD, (999, long_one)]
    bpe = byte_bpe.ByteBpe.load(BPE)
    ids = {t: library.encode(t or "", add_special_tokens=False).ids for _, t in rows}
    back = {t: library.decode(ids[t], skip_special_tokens=False) for t in ids}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(i, len(ids[t]), sha(np.array(ids[t], "<u4").tobytes()), sha(back[t].encode())) for i, t in rows]
    assert sorted(map(tuple, byte_bpe.digest(frame(spark, rows), bpe).collect()), key=str) == sorted(want, key=str)
    enc = byte_bpe.encode(frame(spark, rows), bpe)
    assert sorted(((r.doc_id, r.n_tokens, list(r.ids)) for r in enc.collect()), key=str) == sorted(((i, len(ids[t]), ids[t]) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.text) for r in byte_bpe.decode(enc, bpe).collect()), key=str) == sorted(((i, t or "") for i, t in rows), key=str)


def test_bpe_odd_ids(spark, library):
    bpe = byte_bpe.ByteBpe.load(BPE)
    rows = [(1, None), (2, []), (3, [50256, 5, None, 99999, -1]), (4, [161, 0])]
    got = {r.doc_id: r.text for r in byte_bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), bpe).collect()}
    assert got == {1: "", 2: "", 3: "<|endoftext|>&", 4: library.decode([161, 0], skip_special_tokens=False)}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.digest(empty, bpe).collect() == [] == byte_bpe.encode(empty, bpe).collect()


def test_bpe_other_files():
    with pytest.raises(ValueError):
        byte_bpe.ByteBpe.load(public_tokenizers.path("word_bpe_49k.json")).tables()
