"""Whole-text encoding and packing."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orgweave.llm import bpe, packing
from orgweave.llm.settings import tokenizer_file

pytest.importorskip("tiktoken")
NAME = "byte_bpe_50k"
try:
    open(tokenizer_file(NAME)).close()
except OSError:
    pytest.skip("no tokenizer files", allow_module_level=True)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("abA'st 1\n\téあ株😀.,"), max_size=200), st.integers(4, 40))
def test_tree_equals_whole(text, leaf):
    assert bpe.encode_text(text, NAME, leaf) == bpe.encoding(NAME).encode_ordinary(text)
    assert "".join(bpe.segments(text, leaf)) == text
    assert sum((bpe.encoding(NAME).encode_ordinary(s) for s in bpe.segments(text, leaf)), []) == bpe.encoding(NAME).encode_ordinary(text)


def test_distributed(spark):
    texts = {1: "あいう" * 4000 + " x", 2: "ab c d " * 3000, 3: None, 4: "", 5: "データ、株式。" * 3000, 6: " ", 7: "<|endoftext|>", 8: "z" * 9000, 9: "x1" * 4000, 10: "aaa\n\n" + "z" * 2000, 11: " \n" * 900 + "z" * 9000}
    df = spark.createDataFrame([(k, t, 0) for k, t in texts.items()] + [(4, "", 0), (9, "x1" * 4000, 0), (9, "x2" * 4000, 0)], "doc_id long, text string, ids int")
    got = bpe.encode_column(df, "doc_id", "text", NAME, segment_chars=500)
    enc = bpe.encoding(NAME)
    rows = [(r.doc_id, list(r.ids)) for r in got.collect()]
    assert sorted(rows) == sorted([(k, enc.encode_ordinary(t) if t else []) for k, t in texts.items()] + [(4, []), (9, enc.encode_ordinary("x1" * 4000)), (9, enc.encode_ordinary("x2" * 4000))])
    n = {(r.doc_id, r.n_tokens) for r in bpe.encode_column(df, "doc_id", "text", NAME, count_only=True, segment_chars=500).collect()}
    assert n == {(k, len(v)) for k, v in rows}
    assert bpe.encode_column(df.limit(0), "doc_id", "text", NAME).count() == 0


_WHITE = st.text(alphabet=st.sampled_from(" \n\t\u3000\xa0"), min_size=0, max_size=60)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(_WHITE, st.sampled_from(["z", "あい", "9", "!?", "a'sx", "x1"]), st.integers(0, 60)), max_size=5), _WHITE, st.integers(3, 12))
def test_long_stretches_after_white_space(runs, tail, size):
    text = "".join(white + word * n for white, word, n in runs) + tail
    enc, ids = bpe.encoding(NAME), []
    for part in bpe.segments(text, size):
        for leaves in bpe._runs(part, size):
            if len(part) <= 2 * size:
                ids += bpe.encode_text(leaves[0][0], NAME, 8)
            elif len(leaves) == 1:
                ids += [i for piece in leaves[0] for i in bpe.tree_encode(piece.encode(), bpe.pieces(NAME), enc.decode_bytes, 8)]
            else:
                row = [bpe.tree_encode(leaf[0].encode(), bpe.pieces(NAME), enc.decode_bytes, 8) for leaf in leaves]
                while len(row) > 1:
                    row = [bpe.join_tokens(row[k], row[k + 1], enc.decode_bytes, bpe.pieces(NAME)) if k + 1 < len(row) else row[k] for k in range(0, len(row), 2)]
                ids += row[0]
    assert ids == enc.encode_ordinary(text)


def test_long_rows_of_production_length(spark):
    long = "aaa\n\n" + "z" * 600_000
    texts = [(1, long), (1, long), (1, "b " * 150_000), (None, "\n" * 500_000 + "q"), (None, "short"), (2, "あ。" * 250_000)]
    df = spark.createDataFrame([(k, t, 0) for k, t in texts], "doc_id long, text string, sha int")
    enc = bpe.encoding(NAME)
    got = sorted(((r.doc_id, list(r.ids)) for r in bpe.encode_column(df, "doc_id", "text", NAME).collect()), key=repr)
    assert got == sorted(((k, enc.encode_ordinary(t)) for k, t in texts), key=repr)


def test_patterns_and_nnls():
    p = packing.patterns(6, 3)
    assert sorted(tuple(np.repeat(np.arange(7), r.astype(int))) for r in p) == [(1, 1, 4), (1, 2, 3), (1, 5), (2, 2, 2), (2, 4), (3, 3), (6,)]
    a = np.abs(np.random.default_rng(0).normal(size=(8, 12)))
    x = packing.nnls(a, a @ np.array([1.0, 0, 2, 0, 0, 3, 0, 0, 0, 0, 0, 0]))
    assert (x >= 0).all()
    gradient = a.T @ (a @ x - a @ np.array([1.0, 0, 2, 0, 0, 3, 0, 0, 0, 0, 0, 0]))
    assert (gradient > -1e-6).all() and np.abs(gradient[x > 0]).max() < 1e-6


@pytest.mark.parametrize("cap, seed", [(1, 0), (7, 1), (64, 2), (300, 3)])
def test_plan_holds_every_item_once(cap, seed):
    rng = np.random.default_rng(seed)
    counts = np.bincount(np.minimum(rng.geometric(4 / cap if cap > 4 else 0.5, 2000), cap), minlength=cap + 1)
    groups = packing.plan(counts, cap)
    held = Counter()
    for n, sizes in groups:
        assert n > 0 and sum(sizes) <= cap
        for s in sizes:
            held[s] += n
    assert held == Counter({s: int(c) for s, c in enumerate(counts) if c and s})
    used = sum(s * c for s, c in held.items())
    assert used / (cap * sum(n for n, _ in groups)) > 0.97
    assert packing.plan(np.zeros(cap + 1, np.int64), cap) == []


def test_pack(spark, scratch):
    rng = random.Random(2)
    sizes = [(n, rng.choice([0, 1, 5, 5, 9, 10, 23, 30])) for n in range(300)] + [(1000, None), (5, 5)]
    df = spark.createDataFrame(sizes, "k long, n int")
    rows = packing.pack(df, "k", "n", [(1, 10), (2, 40)], scratch, ranked_per_task=50).collect()
    for spec, cap in ((1, 10), (2, 40)):
        mine = [r for r in rows if r.spec_id == spec]
        fill = Counter()
        whole = Counter()
        for r in mine:
            fill[r.container_id] += r.n_tokens
            whole[r.k] += r.n_tokens
            assert r.first_token == r.piece_no * cap
        assert max(fill.values()) <= cap and all(whole[k] == (n or 0) for k, n in sizes if k != 5)
        pieces = Counter(r.k for r in mine)
        assert all(pieces[k] == max(1, -(-(n or 0) // cap)) for k, n in sizes if k != 5)
        assert sum(fill.values()) / (cap * len(fill)) > 0.9
    assert packing.pack(df.limit(0), "k", "n", [(1, 10)], scratch).count() == 0
