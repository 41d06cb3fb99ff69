from __future__ import annotations

import math
import os
import re
import zlib
from collections import Counter

import pytest

from viewloom.llm import op3_langid as L

SF = "/root/testdata/sf0.01"
EN = "the cat and the dog went to the house with another friend of the man "
DE = "der hund und die katze gingen mit einem freund in das haus von dem mann "
FR = "le chien et le chat vont dans la maison avec un ami de la femme "


def labelled():
    return [(i, (EN, DE, FR)[i % 3] * (1 + i % 4), ("en", "de", "fr")[i % 3]) for i in range(120)]


def test_learns_and_predicts(make):
    model = L.fit(make(labelled()))
    score = L.Scorer(model)
    assert model.langs == ["de", "en", "fr"]
    for text, lang in [(EN, "en"), (DE, "de"), (FR, "fr"), ("friendly doghouse", "en"), ("hunde und katzen", "de")]:
        assert score(text)[0] == lang
    for text in (None, "", "123 !? ²½", "\u0000"):
        assert score(text) == (L.UND, 0.0)
    assert 0 <= score("日本語")[1] <= 1


def test_backoff_takes_the_longest_known_grams():
    model = L.Model(["a", "b"], {(0, "xy"): [5, 5], (0, "o"): [5, 5], (1, "x"): [9, 1], (1, "z"): [9, 1], (1, "o"): [2, 18], (2, "^z"): [1, 9], (2, "oo"): [9, 1]})
    assert model.word("xy")[0] == model.word("xy")[1]  # known as a word
    assert model.word("zq")[1] > model.word("zq")[0]  # ^z before z
    assert model.word("qx")[0] > model.word("qx")[1]  # x alone
    assert not model.word("qq").any()


def test_held_out_rows_are_never_learned_from(make):
    rows = [(i, "zzz " * 20 if zlib.crc32(str(i).encode()) % 5 == 0 else EN, "xx" if zlib.crc32(str(i).encode()) % 5 == 0 else "en") for i in range(200)]
    assert L.fit(make(rows)).langs == ["en"]


def brute_model(rows):
    """Counts of all labelled rows outside the held-out fifth, and the score of a word by backoff, in plain Python."""
    learned = [(t, x) for i, t, x in rows if x is not None and zlib.crc32(str(i).encode()) % 5]
    langs = sorted({x for _, x in learned})
    counts = {}
    for text, lang in learned:
        for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
            keys = [(0, w)] + [(n, f"^{w}$"[i : i + n]) for n in range(1, 6) for i in range(len(w) + 3 - n)]
            for k in keys:
                counts.setdefault(k, Counter())[lang] += 1
    counts = {k: c for k, c in counts.items() if sum(c.values()) >= 2}
    totals = {(n, x): sum(c[x] for (m, _), c in counts.items() if m == n) + 0.1 * max(1, sum(m == n for m, _ in counts)) for n in range(6) for x in langs}

    def relative(key):
        logs = [math.log((counts[key][x] + 0.1) / totals[key[0], x]) for x in langs]
        return [v - sum(logs) / len(logs) for v in logs]

    def word(w):
        if (0, w) in counts:
            return relative((0, w))
        for n in range(5, 0, -1):
            known = [relative((n, g)) for i in range(len(w) + 3 - n) if (n, g := f"^{w}$"[i : i + n]) in counts]
            if known:
                return [sum(v) / len(known) for v in zip(*known)]
        return [0.0] * len(langs)

    def predict(text):
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        if not words:
            return L.UND, 0.0
        mean = [sum(v) / len(words) for v in zip(*map(word, words))]
        z = [v * min(len(words), 20) for v in mean]
        p = [math.exp(v - max(z)) for v in z]
        return langs[p.index(max(p))], max(p) / sum(p)

    return predict


def test_predictions_by_brute_force(make, monkeypatch):
    """Also with counts handed on after every batch, and with room for one word's scores."""
    monkeypatch.setattr(L, "TRAIN_DOCS", 10_000)
    rows = [*labelled(), (500, "unseen hundehaus catdog lechat", "en"), (501, "123", "fr"), (502, None, "de"), (503, "wohnung the le", None)]
    predict = brute_model(rows)
    for keys, scores in ((100_000, 1_000_000), (1, 1)):
        monkeypatch.setattr(L, "TASK_KEYS", keys)
        monkeypatch.setattr(L, "CACHE_SCORES", scores)
        model = L.fit(make(rows), 10_000)
        score = L.Scorer(model)
        for _, text, _ in rows + [(0, "zug nach xylophon", None), (0, "Ünïcode 日本語 q", None)]:
            lang, p = predict(text)
            got = score(text)
            assert got[0] == lang and abs(got[1] - p) < 1e-3, text


def test_bounds_are_of_each_language(make, monkeypatch):
    monkeypatch.setattr(L, "MAX_WORDS", 2)
    monkeypatch.setattr(L, "TRAIN_DOCS", 10_000)
    rows = [(i, "the the the and and of", "en") for i in range(200)] + [(1000 + i, "die die die und und von", "de") for i in range(20)]
    model = L.fit(make(rows))
    assert sorted(model.index[0]) == ["and", "die", "the", "und"]
    en, de = (sum(x == lang and not zlib.crc32(str(i).encode()) % 5 == 0 for i, _, x in rows) for lang in ("en", "de"))
    counts = {"the": (0, 3 * en), "and": (0, 2 * en), "die": (3 * de, 0), "und": (2 * de, 0)}
    want = L.Model(["de", "en"], {(0, k): list(c) for k, c in counts.items()})
    assert (model.scores[0] == want.scores[0]).all()


def test_query_rows(make, odd_rows):
    docs = make([*labelled(), *[(1000 + i, t, None) for i, (_, t) in enumerate(odd_rows)]])
    out = L.identify(docs.withColumn("held_out", L.held_out()), L.fit(docs), ["doc_id", "held_out"]).collect()
    assert len(out) == 120 + len(odd_rows)
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        if r["doc_id"] < 1000:
            assert r["lang_pred"] == ("en", "de", "fr")[r["doc_id"] % 3]
    und = {r["doc_id"] for r in out if r["lang_pred"] == L.UND}
    assert {1000, 1001, 1002, 1009} <= und
    assert L.identify(make([]), L.fit(make([]))).count() == 0
    assert {r["lang_pred"] for r in L.identify(make(odd_rows), L.fit(make([]))).collect()} == {L.UND}


def test_keep_identified(make):
    docs = make([(1, EN, "en"), (2, "123", "en"), (3, None, "en")])
    kept = L.keep_identified(docs, L.fit(make(labelled())), 0.5)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [1]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = [r for r in L.query(spark, SF).collect() if r["held_out"]]
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)
