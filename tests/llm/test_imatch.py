from __future__ import annotations

import hashlib
import os
import re

import pytest
import xxhash

from viewloom.llm import op10_imatch as I

from .conftest import prose


def h64(value, seed=42):
    """The engine's xxhash64 of a string, or of a hash already made (a long)."""
    return xxhash.xxh64(value.encode() if isinstance(value, str) else value.to_bytes(8, "little"), seed=seed).intdigest()


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def fingerprint(text, lexicon):
    """Brute force: each subset decided for each term alone, the terms of a subset hashed in order."""
    def part(holds):
        out = 0
        for t in sorted({w for w in re.split(r"[^0-9A-Za-z\x80-\U0010ffff]+", text or "") if w}, key=str.encode):
            if t in lexicon and holds(h64(t)):
                out = h64(h64(t), seed=h64(out))
        return f"{out:X}".lower() if out else "-"

    def in_subset(h, k):
        return all(xxhash.xxh64(j.to_bytes(4, "little"), seed=h64(h)).intdigest() >> k & 1 for j in range(1, I.SCALES[k // I.PER_SCALE] + 1))

    return [part(lambda h: True), *[part(lambda h, k=k: in_subset(h, k)) for k in range(I.SUBSETS)]]


def nexts(rows):
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), signed(h64(r[1] or "")), r[1] or ""))
    return [(r, order[(i + 1) % len(order)]) for i, r in enumerate(order)]


def edited(text, following):
    text, following = text or "", following or ""
    h = len(text) // 2
    return text[: len(text) - h] + following[:h]


def check(make, rows):
    out = I.fingerprints(make(rows)).collect()
    want = sorted(((d, len(t or ""), hashlib.sha256(edited(t, n[1]).encode()).hexdigest()) for (d, t), n in nexts(rows)), key=str)
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in out), key=str) == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)
    return out


def test_query_rows(make, odd_rows):
    out = check(make, odd_rows)
    by_text = {}
    for r in out:
        by_text.setdefault((r["n_chars"], r["doc_id"] in (5, 6)), set()).add(r["fingerprint"])
    assert len(by_text[7, True]) == 1
    empty = next(r for r in out if r["doc_id"] == 1)
    assert set(empty["fingerprint"].split(".")) == {"-"}


@pytest.mark.parametrize("n", [1, 2, 200, 700])
def test_many_ranges(make, n):
    rows = [((i * 7919) % 100_003 - 500, prose(i % 50, 12 + i % 9)) for i in range(n)]
    check(make, rows)


def test_sparse_and_tied_ids(make):
    check(make, [(i // 40 * 10**15, prose(i, 6)) for i in range(300)])
    check(make, [(None, prose(i, 6)) for i in range(150)] + [(-(2**63), "a b"), (2**63 - 1, "c d")])


def test_empty(make):
    assert I.fingerprints(make([])).count() == 0


def test_likeness(make):
    base = prose(3, 400).split()
    changed = [*base[:399], "zzz"]
    rows = [(3, " ".join(base)), (2, " ".join(changed)), (1, prose(4, 400)), (0, prose(4, 400))]
    out = {r["doc_id"]: r for r in I.fingerprints(make(rows), band=(0.0, 1.0)).collect()}
    assert out[3]["near_next"] > 0.8 and out[2]["near_next"] < 0.2
    assert out[1]["near_next"] == 1.0 and out[1]["fingerprint"] == out[0]["fingerprint"]
    assert out[1]["near_edited"] < 1


def test_terms_are_those_of_the_band(make):
    rows = [(i, "common " + f"rare{i} " + ("mid " if i % 4 == 0 else "")) for i in range(40)]
    assert I.lexicon_of(make(rows), 40, (0.1, 0.5)) == ["mid"]
    assert I.lexicon_of(make(rows), 40, (0.1, 1.0)) == ["common", "mid"]


def test_fingerprints_by_brute_force(make):
    rows = [(i, prose(i % 30, 5 + 13 * (i % 20))) for i in range(60)] + [(100, None), (101, ""), (102, "é " * 3)]
    lexicon = set(I.lexicon_of(make(rows), len(rows), (0.02, 0.9)))
    assert lexicon
    following = {r: n for r, n in nexts(rows)}
    for r in I.fingerprints(make(rows), (0.02, 0.9)).collect():
        row = next(x for x in rows if x[0] == r["doc_id"])
        near = following[row]
        own, other, changed = (fingerprint(t, lexicon) for t in (row[1], near[1], edited(row[1], near[1])))
        assert r["fingerprint"] == ".".join(own) and r["edited_fingerprint"] == ".".join(changed)
        for name, b in (("near_next", other), ("near_edited", changed)):
            used = [(x, y) for x, y in zip(own, b) if (x, y) != ("-", "-")]
            assert r[name] == pytest.approx(sum(x == y for x, y in used) / len(used) if used else 1.0)


def test_one_id_for_a_third_of_the_rows_is_split(make):
    rows = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, prose(i, 6)) for i in range(3000)]
    check(make, rows)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_recall(spark):
    rows = I.query(spark, "/root/testdata/sf0.01").select("near_edited", "near_next").collect()
    assert sum(r["near_edited"] >= I.NEAR for r in rows) >= 0.9 * len(rows)
    assert sum(r["near_next"] >= I.NEAR for r in rows) <= 0.05 * len(rows)
