"""Personal data by candidate gradient boosting.

Generators of high recall propose spans of four kinds (email, ip, card, phone), which may overlap. Spans of
the base patterns are always taken. The other candidates are scored by boosted trees on features of their
format (lengths, groups, separators, check digits) and context (words before, neighbouring characters); the
scores are calibrated on a held-out fold, and a candidate is taken from its kind's threshold on, which is
the least with the precision MIN_PRECISION on that fold. Of taken candidates that overlap one another or a
base span, base spans come first, then higher scores.

The trees are trained on TRAIN_TEXTS generated labelled lines (formats of personal data and look-alikes in
carrier words), the same for every corpus; no row of the corpus is used for training.

Defined results: null text is empty; texts without candidates have no spans; repeated rows are judged each; very long
texts are judged whole, in time linear in their length, with SLICE candidates in memory at once; an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .boosting import BoostedTrees
from .common import arrow_map, read_table

KINDS = ["email", "ip", "card", "phone"]
TRAIN_TEXTS = 6_000
MIN_PRECISION = 0.99
#: The lowest threshold that is tried.
MIN_PROBABILITY = 0.3
#: Groups of digits that a written phone number has at most.
MAX_GROUPS = 6
#: Candidates that are scored at once.
SLICE = 4096
#: Characters of context on each side that the features see.
CONTEXT = 32

Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The leftmost start is that of a digit run, whose digits are taken whole: no backtracking over long runs.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_AT = re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\]|\{at\}|(?<=\x20)at(?=\x20))\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|(?<=\x20)dot(?=\x20)|\.)\x20?[A-Za-z0-9-]{1,63}){1,4}", re.IGNORECASE)
_IP6 = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f:]{0,4}:[0-9A-Fa-f:]*+(?![0-9A-Za-z])")
_CHAIN = re.compile(r"[0-9](?:[\x20()./+-]{0,3}[0-9])++")
_GROUP = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Matches of the base patterns: leftmost and non-overlapping within a kind, those that fail their check dropped."""
    out: list[Span] = []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(d := p.lstrip("0")) <= 3 and int(d or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if len(m[0]) >= 14 and 14 <= len(d := _only_digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_only_digits(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def _is_ip6(s: str) -> bool:
    """Eight groups of up to four hexadecimal digits, or fewer with one '::'."""
    if len(s) > 39 or s.count("::") > 1 or ":::" in s:
        return False
    groups = s.split(":")
    if any(len(g) > 4 for g in groups):
        return False
    if "::" in s:
        return len(s) > 2 and len(groups) <= 8 + (s.startswith("::") or s.endswith("::"))
    return len(groups) == 8 and all(groups)


def candidates(text: str) -> Iterator[Span]:
    """Spans that may be personal data, beyond the base patterns; they overlap freely."""
    low = text.lower() if " at " in text or "(" in text or "[" in text or "{" in text else ""
    if "at" in low and ("(at)" in low or "[at]" in low or "{at}" in low or " at " in low) and ("dot" in low or "." in low):
        for m in _AT.finditer(text):
            yield "email", m.start(), m.end()
    if text.count(":") >= 2:
        for m in _IP6.finditer(text):
            end = m.end() - (text[m.end() - 1] == ":" and text[m.end() - 2 : m.end()] != "::")  # a colon after an address
            if _is_ip6(text[m.start() : end]):
                yield "ip", m.start(), end
    for m in _CHAIN.finditer(text):
        # Numbers that stand next to each other make one chain: every run of its groups is proposed that has enough digits, and
        # not too many. A start has as many runs as there are digits at most, so long chains stay linear.
        groups = [g.span() for g in _GROUP.finditer(text, *m.span())]
        for i, (start, _) in enumerate(groups):
            n, left = 0, start
            if left and text[left - 1] == "(":
                left -= 1
            if left and text[left - 1] == "+":
                left -= 1
            for j in range(i, len(groups)):
                end = groups[j][1]
                n += end - groups[j][0]
                if n > 19:
                    break
                if 7 <= n <= 15 and j - i < MAX_GROUPS:
                    yield "phone", left, end
                if 13 <= n and luhn(_only_digits(text[start:end])):  # other numbers are no cards
                    yield "card", start, end


# Words before a span that speak for or against a kind.
FOR = {
    "email": ("email", "e-mail", "mail", "contact", "write", "reach"),
    "ip": ("ip", "host", "server", "address", "addr", "client", "from"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "pay"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "cell", "contact", "telefon", "telephone", "handy", "dial", "sms", "whatsapp", "ring"),
}
ENDINGS = frozenset("com org net edu gov io de fr es uk it nl eu info co us ch at be pl".split())
AGAINST = ("order", "invoice", "isbn", "version", "item", "sku", "serial", "total", "ref", "ticket", "page", "date", "score", "v")


def features(text: str, span: Span) -> list[float]:
    kind, start, end = span
    s = text[start:end]
    digits = _only_digits(s)
    groups = [len(g) for g in re.findall(r"[0-9]+", s)]
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    words = re.findall(r"[a-z-]+", before.lower())
    prev, nxt = before[-1:], after[:1]
    return [
        KINDS.index(kind), len(s), len(digits), len(groups), max(groups, default=0), min(groups, default=0),
        float(len(digits) >= 13 and luhn(digits)), float(s.startswith("+")), float("(" in s), s.count("-"), s.count("."), s.count(" "), s.count(":"),
        float(groups[-3:] in ([3, 3, 4],)), float(len(groups) == 4 and set(groups) == {4}), float(groups[:1] == [4] and len(groups) == 3 and groups[1:] == [2, 2]),
        float(len(set(digits)) <= 2), float(digits[:2] in ("97", "19", "20")), float(any(c in s for c in "([{")),
        float("dot" in s.lower()), float("[at]" in s.lower() or "(at)" in s.lower() or "{at}" in s.lower()),
        float(prev.isalnum()), float(nxt.isalnum()), float(prev in "$€£#"), float(prev in "=/_"), float(nxt in "%/_"),
        float(any(w in FOR[kind] for w in words[-3:])), float(any(w in AGAINST for w in words[-3:])), len(words),
        float(digits[:1] in ("4", "5", "3", "6")), len(re.findall(r"[a-fA-F]", s)), float(bool(re.search(r"[0-9]{5,}", s))),
        float(s.count("(") != s.count(")")), float(before.rstrip(" ().+-")[-1:].isdigit()), float(after.lstrip(" ().+-")[:1].isdigit()),
        float(bool(re.fullmatch(r"\+1 ?\(?[0-9]{3}\)? ?[0-9]{3}[- ][0-9]{4}", s))), float(len(groups) == 1),
        float(re.split(r"[^a-z]+", s.lower())[-1] in ENDINGS), float("::" in s), float(digits.startswith("00")), float(s.startswith("0")), float(any(w in FOR[kind] for w in words[-2:])),
    ]


# --- generated training lines -------------------------------------------------------------------------

_CARRIERS = "the of and to in was that is for on le la et de der die und el los por near with from this there we".split()


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _card_digits(r: random.Random, n: int, valid: bool) -> str:
    while True:
        d = r.choice("3456") + _digits(r, n - 1)
        if luhn(d) == valid:
            return d


def _word(r: random.Random) -> str:
    return "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(3, 9)))


def _grouped(d: str, sizes: list[int], sep: str) -> str:
    out, at = [], 0
    for n in sizes:
        out.append(d[at : at + n])
        at += n
    return sep.join(out)


def _positive(r: random.Random) -> tuple[str, str, bool]:
    """kind, span, whether a word for it must stand before."""
    kind = r.choice(KINDS)
    if kind == "email":
        at, dot = r.choice([("[at]", "[dot]"), ("(at)", "(dot)"), ("{at}", "{dot}"), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("(at)", "."), ("[at]", "."), (" at ", " dot ")])
        name = r.choice([_word(r), f"{_word(r)}.{_word(r)}", f"{_word(r)}{r.randint(1, 99)}"])
        return kind, f"{name}{at}{_word(r)}{dot}{r.choice(sorted(ENDINGS))}", at == " at " and r.random() < 0.3
    if kind == "ip":
        n = r.choice([8, 8, 1, 2, 3, 4, 5, 6])
        parts = [r.choice(["2001", "2a02", "fe80", "fd00", "db8", "1", "0", f"{r.randrange(65536):x}", f"{r.randrange(65536):x}"]) for _ in range(n)]
        cut = r.randint(0, n - 1)
        return kind, ":".join(parts) if n == 8 else ":".join(parts[:cut]) + "::" + ":".join(parts[cut:]), n < 8 and r.random() < 0.3
    if kind == "card":
        d = _card_digits(r, r.choice([15, 16, 16]), True)
        sizes = [4, 6, 5] if len(d) == 15 else [4, 4, 4, 4]
        return kind, _grouped(d, sizes, r.choice([".", "  ", ". "])), False
    area, mid, end = str(r.randint(200, 999)), str(r.randint(200, 999)), _digits(r, 4)
    style = r.randrange(8)
    if style == 4:
        return kind, _grouped("0" + _digits(r, 9), [2] * 5, r.choice([" ", ".", "-"])), True
    if style == 5:
        return kind, _grouped("00" + r.choice(["49", "33", "34", "44", "1"]) + _digits(r, 9), [4, r.choice([2, 3]), 7] if r.random() < 0.5 else [4, 3, 3, 3], r.choice([" ", "-"])), True
    if style == 6:
        return kind, _grouped("0" + _digits(r, 10), r.choice([[3, 8], [4, 7], [3, 4, 4], [5, 6]]), r.choice([" ", "/", "-"])), True
    if style == 7:
        return kind, _digits(r, r.choice([9, 10, 11])), True
    return kind, (f"({area}) {mid}-{end}", f"{area}-{mid}-{end}", f"{area}.{mid}.{end}", f"({area}){mid}-{end}")[style], style in (1, 2)


def _side_by_side(r: random.Random) -> list[tuple[str, str]]:
    """Two numbers with a blank between them, as (kind, span); kind is '' for a look-alike."""
    phone = ("phone", f"+1 ({r.randint(200, 999)}) {r.randint(200, 999)}-{_digits(r, 4)}")
    card = ("card", _grouped(_card_digits(r, 16, True), r.choice([[16], [4, 4, 4, 4]]), r.choice([" ", "-"])))
    others = [("", ".".join(str(r.randint(0, 255)) for _ in range(4))), ("", _card_digits(r, 16, False)), ("", _digits(r, r.randint(2, 9))), card, phone]
    out = [r.choice([phone, card]), r.choice(others)]
    r.shuffle(out)
    return out


def _negative(r: random.Random) -> str:
    return r.choice([
        lambda: _digits(r, r.randint(7, 19)),
        lambda: f"{r.choice(AGAINST)} {_digits(r, r.randint(7, 16))}",
        lambda: f"{r.choice(AGAINST)} {r.randint(100, 999)}-{r.randint(100, 999)}-{_digits(r, 4)}",
        lambda: _card_digits(r, 16, False),
        lambda: _grouped(_card_digits(r, 16, False), [4, 4, 4, 4], r.choice([" ", "-", "."])),
        lambda: f"{r.randint(1900, 2099)}-{r.randint(10, 12)}-{r.randint(10, 28)}",
        lambda: f"{r.randint(1900, 2099)}.{r.randint(10, 12)}.{r.randint(10, 28)} {r.randint(10, 23)}",
        lambda: f"{r.randint(1900, 2099)}-{r.randint(1900, 2099)}",
        lambda: f"978-{r.randint(0, 9)}-{_digits(r, 4)}-{_digits(r, 4)}-{r.randint(0, 9)}",
        lambda: f"{r.choice('$€£')}{_digits(r, 7)}.{_digits(r, 2)}",
        lambda: f"{r.randint(1, 9)}.{_digits(r, 9)}",
        lambda: " ".join(str(r.randint(1, 999)) for _ in range(r.randint(3, 7))),
        lambda: f"{_word(r)} at {_word(r)}. {_word(r).title()} {_word(r)}",
        lambda: f"{_word(r)} at the {_word(r)}.",
        lambda: f"{_word(r)} at {_word(r)} dot {_word(r)} {_word(r)}" if r.random() < 0.2 else f"look at {_word(r)}.{_word(r)}",
        lambda: ":".join(_digits(r, 2) for _ in range(r.randint(3, 6))),
        lambda: "".join(r.choice("abcdef") for _ in range(r.randint(1, 4))) + "::" + "".join(r.choice("abcdef") for _ in range(r.randint(2, 4))),
        lambda: "::",
        lambda: ":".join(f"{r.randrange(256):02x}" for _ in range(6)),
        lambda: "".join(r.choice("0123456789abcdef") for _ in range(40)),
        lambda: f"{r.choice(['page', 'score', 'total'])} {r.randint(1, 99)}-{_digits(r, 5)} ({_digits(r, 4)})",
    ])()


@functools.lru_cache(maxsize=1)
def trained(texts: int = TRAIN_TEXTS, seed: int = 11) -> tuple[BoostedTrees, tuple[float, float], dict[str, float]]:
    """The trees, the calibration (slope, shift) of their log odds, and the probability threshold of each kind."""
    r = random.Random(seed)
    rows, labels, kinds, folds = [], [], [], []
    for i in range(texts):
        lead = [r.choice(_CARRIERS) if r.random() < 0.6 else _word(r) for _ in range(r.randint(0, 6))]
        spans: list[tuple[str, str]]
        draw = r.random()
        if draw < 0.2:
            spans = _side_by_side(r)
        elif draw < 0.55:
            kind, span, keyword = _positive(r)
            if keyword or r.random() < 0.3:
                lead.append(r.choice(FOR[kind]) + r.choice(["", ":"]))
            spans = [(kind, span)]
        else:
            spans = [("", _negative(r))]
        tail = [r.choice(_CARRIERS) for _ in range(r.randint(0, 4))]
        at = len(" ".join(lead)) + (1 if lead else 0)
        text = " ".join([*lead, *(span for _, span in spans), *tail])
        gold = set()
        for kind, span in spans:
            gold.add((kind, at, at + len(span)))
            at += len(span) + 1
        for c in candidates(text):
            rows.append(features(text, c))
            labels.append(float(c in gold))
            kinds.append(c[0])
            folds.append(i % 3 == 0)
    x, y, kind, held = np.array(rows), np.array(labels), np.array(kinds), np.array(folds)
    trees = BoostedTrees().fit(x[~held], y[~held])
    z, t = trees.score(x[held]), y[held]
    slope, shift = 1.0, 0.0
    for _ in range(200):  # Platt scaling by gradient steps
        p = 1 / (1 + np.exp(-(slope * z + shift)))
        slope, shift = slope - 0.05 * float(np.mean((p - t) * z)), shift - 0.05 * float(np.mean(p - t))
    p = 1 / (1 + np.exp(-(slope * z + shift)))
    thresholds = {}
    for k in KINDS:
        own = kind[held] == k
        thresholds[k] = 2.0  # none is taken if no threshold is precise enough
        for cut in np.linspace(0.999, MIN_PROBABILITY, 100):
            taken = own & (p >= cut)
            if taken.any() and t[taken].mean() >= MIN_PRECISION:
                thresholds[k] = float(cut)
            elif taken.any():
                break
    return trees, (slope, shift), thresholds


def find(text: str, model) -> tuple[list[Span], list[Span]]:
    """(base spans, all taken spans), each by start and then kind."""
    trees, (slope, shift), thresholds = model
    base = base_spans(text)
    taken = list(base)
    known = set(base)
    starts, ends = zip(*sorted((s, e) for _, s, e in base)) if base else ((), ())
    reach = np.maximum.accumulate(ends) if base else ends
    proposed, good = candidates(text), []
    while part := list(itertools.islice(proposed, SLICE)):
        # Candidates inside or across base spans can't be taken: leave them out before scoring.
        at = np.searchsorted(starts, [e for _, _, e in part], side="left") - 1
        part = [c for c, i in zip(part, at) if (i < 0 or reach[i] <= c[1]) and c not in known]
        if part:
            p = 1 / (1 + np.exp(-(slope * trees.score(np.array([features(text, c) for c in part])) + shift)))
            good += [(-q, c) for q, c in zip(p, part) if q >= thresholds[c[0]]]
    used: list[tuple[int, int]] = []
    for _, c in sorted(good, key=lambda x: (x[0], x[1][1], x[1][2], x[1][0])):
        i = bisect.bisect_left(used, (c[2], -1))
        if i == 0 or used[i - 1][1] <= c[1]:
            bisect.insort(used, (c[1], c[2]))
            taken.append(c)
    order = lambda x: (x[1], KINDS.index(x[0]), x[2])
    return sorted(base, key=order), sorted(taken, key=order)


def digest(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by [KIND]; where spans overlap, their union is one span."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"


def find_pii(docs: DataFrame, redacted: bool = False) -> DataFrame:
    """doc_id, counts, base_sha256, spans, n_spans, and the redacted text if asked for, of every document."""
    model = trained()
    key = docs.schema["doc_id"].dataType.simpleString()
    schema = SCHEMA + (", redacted string" if redacted else "")
    names = ["doc_id", *(x.split()[0] for x in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column("text"):
                text = value.as_py() or ""
                base, spans = find(text, model)
                kinds = [k for k, _, _ in base]
                sha = hashlib.sha256(digest(base).encode()).hexdigest()
                rows.append((*map(kinds.count, KINDS), sha, digest(spans), len(spans), *([redact(text, spans)] if redacted else [])))
            cols = list(zip(*rows)) or [()] * (len(names) - 1)
            arrays = [pa.array(c, pa.string() if n in ("base_sha256", "spans", "redacted") else pa.int64()) for n, c in zip(names[1:], cols)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=names)

    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {key}, {schema}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(read_table(spark, sf_dir, "documents"))
