from __future__ import annotations

import hashlib
import re

import pytest

from viewloom.llm import op7_decontam as D

from .conftest import prose

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def brute(rows, items):
    out = []
    for d, t in rows:
        w, hit, ids = words(t), set(), set()
        for item, text in items:
            b = words(text)
            n = min(10, len(b))
            for s in range(len(b) - n + 1) if n else []:
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == b[s : s + n]:
                        hit |= set(range(at, at + n))
                        ids.add(str(item))
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def items():
    same = "the " * 14
    return [(1, prose(50, 25)), (2, prose(51, 10)), (10, "Éa b, C"), (3, same), (4, None), (5, " ?! "), (6, prose(50, 25)), (7, "one two"), (7, "one two")]


@pytest.fixture(scope="module")
def rows(odd_rows, items):
    a, b = items[0][1].split(), items[1][1]
    texts = ["x " + " ".join(a) + " y", " ".join(a[3:13]).upper() + " " + " ".join(a[8:20]), " ".join(a[:9]), b + " " + b, "q éA? B--c! Éa b c", "the " * 30, "the " * 9, "one. two", "one,three two"]
    return [*odd_rows[:3], *odd_rows[4:], *((100 + i, t) for i, t in enumerate(texts)), (100, texts[0])]


def _items(spark, items):
    return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")


def test_query_rows(spark, make, rows, items):
    out = D.judge(make(rows), _items(spark, items)).drop("text_hash", "spans")
    assert out.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows, items)


def test_without_broadcast(spark, make, rows, items, monkeypatch):
    monkeypatch.setattr(D, "MAX_BYTES", 0)
    out = D.judge(make(rows), _items(spark, items)).drop("text_hash", "spans")
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows, items)


def test_empty_tables(spark, make, items):
    assert D.judge(make([]), _items(spark, items)).count() == 0
    assert D.judge(make([(1, "a b")]), _items(spark, [(1, None)])).first()["contaminated"] is False
    assert D.decontaminate(make([(1, "a b")]), _items(spark, items).filter("false")).count() == 1


def test_long_text(spark, make, items):
    text = prose(9, 40_000) + " " + items[0][1]
    assert D.judge(make([(1, text)]), _items(spark, items)).first()["n_hit"] == 25


def test_documents_go(spark, make, rows, items):
    docs = make(rows)
    kept = D.decontaminate(docs, _items(spark, items))
    assert kept.columns == docs.columns
    clean = [r[0] for r in brute(rows, items) if not r[-1]]
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted(clean, key=str)


def test_spans_go(spark, make, items):
    a = items[0][1]
    docs = make([(1, f"(x, {a}; y!"), (2, "one three"), (3, "One two"), (4, None)])
    got = {r["doc_id"]: r["text"] for r in D.decontaminate(docs, _items(spark, items), remove="spans").collect()}
    assert got == {1: "(x, y!", 2: "one three", 3: "", 4: None}
