from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from viewloom.llm import op4_jaccard as J
from viewloom.llm.components import components

from .conftest import prose


def shingle_set(t):
    w = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def linked(a, b):
    return bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    part = list(range(len(rows)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if linked(sets[i], sets[j]):
            part[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def family(r, base, copies, most):
    out = []
    for _ in range(copies):
        w = base.split()
        for _ in range(r.randint(0, most)):
            w[r.randrange(len(w))] = prose(r.random(), 1)
        out.append(" ".join(w[r.randint(0, 3) : len(w) - r.randint(0, 3)]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components_by_brute_force(make, seed):
    r = random.Random(seed)
    texts = [prose(seed * 100 + i, r.choice([3, 5, 8, 9, 30, 120])) for i in range(40)]
    common = prose(99, 60)
    texts += [f"{prose(seed * 1000 + i, 25)} {common} {prose(seed * 2000 + i, 5)}" for i in range(60)]  # a passage that many share
    texts += family(r, prose(7, 150), 120, 8) + family(r, prose(8, 12), 30, 1) + [common] * 5
    rows = list(enumerate(texts))
    r.shuffle(rows)
    assert got(J.join(make(rows))) == brute(rows)


@pytest.mark.parametrize("heavy", [1, 3])
def test_heavy_signatures(make, heavy, monkeypatch):
    """Rare signatures of more than HEAVY sets become frequent, round after round: the components stay the same."""
    monkeypatch.setattr(J, "HEAVY", heavy)
    r = random.Random(heavy)
    common = prose(99, 40)
    texts = family(r, prose(7, 80), 25, 5) + family(r, prose(8, 14), 12, 1) + [f"{prose(3000 + i, 9)} {common}" for i in range(15)] + [prose(i, 30) for i in range(8)]
    rows = list(enumerate(texts))
    assert got(J.join(make(rows))) == brute(rows)


def test_odd_rows(make, odd_rows, spark):
    assert got(J.join(make(odd_rows))) == brute(odd_rows)
    assert J.join(make([])).count() == 0
    assert got(J.join(make([(1, "A b"), (2, "a B\t"), (3, None)]))) == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]


def test_threshold_is_exact(make):
    w = [f"w{i}" for i in range(200)]
    # One word changed at the end: n - 1 shared of n + 1; linked from n = 9 shingles on.
    for n in (8, 9, 10):
        a, b = " ".join(w[: n + 4]), " ".join([*w[: n + 3], "x"])
        rows = [(1, a), (2, b)]
        assert got(J.join(make(rows))) == brute(rows)
        assert (brute(rows)[1][2] == 1) == (n >= 9)


@settings(max_examples=150, deadline=None)
@given(st.integers(4, 400), st.integers(0, 10_000), st.floats(0, 1), st.floats(0, 0.25))
def test_linked_sets_share_a_signature(n, seed, often, changed):
    r = np.random.default_rng(seed)
    universe = np.unique(r.integers(0, 2**63, 4 * n, dtype=np.uint64) * np.uint64(2))
    frequent = r.random(1 << J.SKETCH_BITS) < often
    a = np.sort(r.choice(universe, n, replace=False))
    keep = a[r.random(n) >= changed / 2]
    rest = np.setdiff1d(universe, a)
    b = np.sort(np.concatenate([keep, r.choice(rest, min(len(rest), int(changed / 2 * n)), replace=False)]))
    shared = len(np.intersect1d(a, b))
    if len(b) and 100 * shared >= 80 * (len(a) + len(b) - shared) and len(np.setxor1d(a, b)):
        heavy = np.sort(r.choice(universe, int(r.random() * n), replace=False))
        (sa, pa, ka), (sb, pb, kb) = J.signatures(a, frequent, heavy), J.signatures(b, frequent, heavy)
        at, to = dict(zip(sa.tolist(), pa.tolist())), dict(zip(sb.tolist(), pb.tolist()))
        both = at.keys() & to.keys()
        # A rare shingle is shared, or a combination whose places leave room for the overlap.
        room = [min(len(a) - at[x], len(b) - to[x]) for x in both]
        assert any(at[x] < ka or 100 * m >= 80 * (len(a) + len(b) - m) for x, m in zip(both, room))
        # The first shared signature leaves room, and so does the number of shared rare shingles.
        assert max(100 * m - 80 * (len(a) + len(b) - m) for m in room) >= 0
        rest = (len(a) - ka, len(b) - kb)
        whole = ka < J.slack(len(a)) + 1 and kb < J.slack(len(b)) + 1
        assert sum(at[x] < ka for x in both) + (min(rest) if whole else max(rest)) >= shared


def test_deduplicate(make, odd_rows):
    rows = [*odd_rows, (20, "x y z a b c d"), (21, "x y z a b c d"), (21, "x y z a b c d")]
    docs = make(rows)
    kept = J.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] or -1, (r["text"] or "")[:13]) for r in kept.collect())
    assert ids == sorted((d or -1, (t or "")[:13]) for d, t in [rows[0], rows[1], rows[2], rows[3], rows[4], rows[7], rows[8], rows[9], rows[10], rows[11], rows[12], rows[13]])


def test_equal_rows_meet_once(make):
    """Many rows with one text, with null ids and with one id: one stays; rows without words all stay."""
    same = prose(9, 40)
    rows = [(None, same)] * 200 + [(7, same)] * 200 + [(8, same + " end")] + [(9, " \t")] * 3 + [(None, None)] * 2
    kept = J.deduplicate(make(rows, 7))
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in kept.collect()) == [(-1, ""), (-1, ""), (7, same), (9, " \t"), (9, " \t"), (9, " \t")]
    only_null = J.deduplicate(make([(None, same)] * 20)).collect()
    assert [(r["doc_id"], r["text"]) for r in only_null] == [(None, same)]


def test_connected_components(spark):
    r = random.Random(4)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 40)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)] + [(5, 5)]
    part = {x: x for p in pairs for x in p}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        part[b] = a
    want = {x: find(x) for p in pairs for x in p if p[0] != p[1]}
    got = {row["node"]: row["root"] for row in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
