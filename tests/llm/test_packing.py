from __future__ import annotations

import random
import zlib
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from viewloom.llm import op9_packing as P


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(P.tokenizer_file())


@pytest.fixture(scope="module")
def ids_of():
    return P.Ids(P.tokenizer_file())


@settings(max_examples=300, deadline=None)
@given(text=st.text(st.sampled_from("ab 's\t\n é1.!日😀 A"), max_size=40) | st.text(max_size=40))
def test_ids_are_the_tokenizers(ids_of, tok, text):
    want = np.asarray(tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    assert ids_of(text) == want


def test_special_and_long_runs(ids_of, tok):
    for text in ("a <|endoftext|> b", "x" * 120_000, " " * 120_000 + "a"):
        assert ids_of(text) == np.asarray(tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40), st.dictionaries(st.integers(1, 40), st.integers(1, 3), max_size=5))
def test_fullest_by_brute_force(capacity, counts):
    combo = P.fullest(capacity, counts)
    assert all(0 < k <= counts[x] for x, k in combo.items())
    keys = list(counts)
    sums = [sum(x * k for x, k in zip(keys, ks)) for ks in product(*(range(counts[x] + 1) for x in keys))]
    assert sum(x * k for x, k in combo.items()) == max(s for s in sums if s <= capacity)


@pytest.mark.parametrize("capacity", [10, 2048])
def test_plan_uses_every_piece_once(capacity):
    r = random.Random(capacity)
    histogram = {x: r.randint(1, 30) for x in r.sample(range(1, capacity + 1), min(capacity, 300))}
    bins = P.plan(dict(histogram), capacity)
    used = {}
    for times, combo in bins:
        assert times > 0 and sum(x * k for x, k in combo.items()) <= capacity
        for x, k in combo.items():
            used[x] = used.get(x, 0) + times * k
    assert used == histogram
    total, n = sum(x * c for x, c in histogram.items()), sum(t for t, _ in bins)
    large = sum(c for x, c in histogram.items() if 2 * x > capacity)
    assert n <= 1.1 * max(total / capacity, large) + 2


def test_cut():
    assert list(P.cut(5, 10)) == [(0, 5)] and list(P.cut(10, 10)) == [(0, 10)] and list(P.cut(25, 10)) == [(0, 5), (5, 10), (15, 10)] and list(P.cut(20, 10)) == [(0, 10), (10, 10)]


def test_query_rows(make, odd_rows, tok):
    rows = [*odd_rows, *((100 + i, "word " * (37 * i % 900)) for i in range(80))]
    out = P.pack(make(rows), P.tokenizer_file()).collect()
    want = []
    for d, t in rows:
        ids = np.asarray([*tok.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for k, (s, n) in enumerate(P.cut(len(ids), P.CAPACITY)):
            want.append((d, k, s, n, zlib.crc32(ids[s : s + n].tobytes())))
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out), key=str) == sorted(want, key=str)
    sequences = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= P.CAPACITY
    assert len(sequences) <= 1.05 * sum(r["length"] for r in out) / P.CAPACITY + 1
    assert P.pack(make([]), P.tokenizer_file()).count() == 0
