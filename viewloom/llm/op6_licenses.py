"""Licence scans by a trained paragraph classifier. DataFrame operations only on the corpus.

Judged are the paragraphs of a text (the lines between blank lines, joined, so that notices may be wrapped) and, of paragraphs
of more than one line, each line as well. Their distinct word 1- to 3-grams are joined with the sparse weights of a
multinomial logistic regression; the class with the highest score is the predicted family. The class `unknown` is
calibrated: a prediction counts only from the probability on that keeps MIN_PRECISION on the held-out part of the training lines. A
predicted family is confirmed by template comparison: of the word 2-grams of one of the family's templates, and of
those of the judged text, whichever are fewer, MIN_COVER are shared, MIN_SHARED at least or all of the template's. So a template
is found in a longer paragraph, and a part of a long template, such as one line of it, is found too.

Texts, paragraphs and lines that the comparison can't confirm are dropped first, and no others (`needed`): what is confirmed shares
at least k = min(MIN_SHARED, all) 2-grams with a template, so it holds one of those that are left when k - 1 of the template's are
taken away. Taken away are the most usual ones.

The regression is trained on the driver, on TRAIN_LINES generated lines: templates (notices and the licences' own texts, below)
and random parts of them in carrier words, and lines that speak of licences or rights without granting one. Its weights are a
table of fixed size, which is broadcast.

Defined results: null or empty text has no paragraphs; lines of white space aren't paragraphs; repeated rows are judged
each; a very long paragraph is judged whole, by its distinct n-grams; an empty table gives an empty result; other input columns
are ignored.
"""

from __future__ import annotations

import functools
import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, read_table, written

MIN_PRECISION = 0.98
MIN_COVER = 0.75
MIN_SHARED = 5
TRAIN_LINES = 6_000
UNKNOWN = "unknown"

# Notices by family, in the words of the licences and of the usual phrases.
NOTICES: dict[str, list[str]] = {
    "agpl": ["licensed under the gnu affero general public license version 3", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", "spdx license identifier agpl 3.0 only", "spdx license identifier agpl 3.0 or later"],
    "apache-2.0": ["licensed under the apache license version 2.0", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "spdx license identifier apache 2.0"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", "released under the bsd 3 clause license", "licensed under the bsd license", "spdx license identifier bsd 3 clause", "spdx license identifier bsd 2 clause"],
    "cc-by": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license", "spdx license identifier cc by 4.0"],
    "cc-by-nc": ["licensed under cc by nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license", "spdx license identifier cc by nc 4.0"],
    "cc-by-sa": ["licensed under cc by sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license", "spdx license identifier cc by sa 4.0"],
    "cc0": ["licensed under cc0 1.0 universal", "dedicated to the public domain under the cc0 license", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "spdx license identifier cc0 1.0"],
    "epl": ["made available under the terms of the eclipse public license 2.0", "licensed under the eclipse public license version 2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license which accompanies this distribution", "spdx license identifier epl 2.0"],
    "gpl": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "see the gnu general public license for more details", "you should have received a copy of the gnu general public license along with this program", "spdx license identifier gpl 3.0 or later", "spdx license identifier gpl 2.0 only", "spdx license identifier gpl 2.0 or later", "spdx license identifier gpl 3.0 only"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", "licensed under the isc license", "spdx license identifier isc"],
    "lgpl": ["licensed under the gnu lesser general public license version 3", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version", "see the gnu lesser general public license for more details", "spdx license identifier lgpl 2.1 or later", "spdx license identifier lgpl 3.0 only"],
    "mit": ["permission is hereby granted free of charge to any person obtaining a copy of this software", "released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", "spdx license identifier mit"],
    "mpl": ["subject to the terms of the mozilla public license version 2.0", "licensed under the mozilla public license 2.0", "this source code form is subject to the terms of the mozilla public license v. 2.0 if a copy of the mpl was not distributed with this file you can obtain one at", "spdx license identifier mpl 2.0"],
    "proprietary": ["all rights reserved", "copyright all rights reserved", "all rights reserved no part of this publication may be reproduced", "unauthorized copying of this file via any medium is strictly prohibited", "unauthorized copying is prohibited all rights reserved", "proprietary and confidential all rights reserved", "copyright c 2020 all rights reserved", "all rights reserved worldwide"],
    "unlicense": ["this is free and unencumbered software released into the public domain", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "released into the public domain without any license", "spdx license identifier unlicense"],
    "zlib": ["this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "licensed under the zlib license", "spdx license identifier zlib"],
}
# Lines that speak of licences, rights or software and grant nothing.
_OTHER = [
    "the driver must show a license at the gate", "a fishing license is sold in the shop", "license plate", "his poetic license went too far", "the licence fee rose again", "they licensed the song to a studio",
    "the general reserved the public rights of way", "table reserved for the rights group", "the contract grants all rights reserved to us", "all rights reserved to the tenants are listed in the annex",
    "the apache helicopter flew under license of the state", "students at mit got a parking license", "the mozilla foundation met the public about a license", "a creative license of commons people", "a member of the gnu project spoke",
    "the version 2.0 of the license exam", "the terms of the deal", "licensed electrician", "a license to kill", "rights reserved for members only not all", "the software is provided to students free of charge", "permission is granted to park here",
    "the software was distributed to all offices last week", "you can obtain a copy of the report at the desk", "the warranty covers any damages for two years", "this publication may be ordered by mail", "copyright law protects the author", "the authors of the report were not liable",
    "the public domain holds many old songs", "use of this room is subject to the following conditions", "see the notice for more details", "the names of the contributors are listed below", "copying of keys is prohibited", "the license of the bar was not renewed",
]
#: Order in which families own sentences that they share.
FIRST = ["gpl", *sorted(set(NOTICES) - {"gpl"})]
_CARRIERS = "the of and to in was that is for on le la et de der die und el los por near with from this there we".split()
#: Usual words: the 2-grams made of them are the first that `witnesses` takes away. They decide the speed, not the result.
_USUAL = "the and of to in that for with is by it from or this a as an on not at be are".split()
NOT_WORD = r"[^a-z0-9.]+"
#: Blank lines.
BLANK = r"\n[ \t\r\f\x0b]*(?:\n[ \t\r\f\x0b]*)+"


def norm_words(line: str) -> list[str]:
    """Words of a paragraph as `words` takes them."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)
    return [w for x in re.split(NOT_WORD, low) if (w := x.strip("."))]


def grams(words: list[str], n_max: int = 3) -> set[str]:
    return {" ".join(words[i : i + n]) for n in range(1, n_max + 1) for i in range(len(words) - n + 1)}


def pairs_of(words: list[str]) -> list[str]:
    return sorted({" ".join(words[i : i + 2]) for i in range(len(words) - 1)})


def templates() -> list[tuple[str, list[str]]]:
    """(family, 2-grams) of every template."""
    return [(name, pairs_of(norm_words(n))) for name in sorted(NOTICES) for n in NOTICES[name]]


def _lines(seed: int = 5) -> list[tuple[str, str]]:
    r = random.Random(seed)
    families, out = sorted(NOTICES), []
    for i in range(TRAIN_LINES):
        lead = [r.choice(_CARRIERS) for _ in range(r.choice([0, 0, 0, 2, 8]))]
        tail = [r.choice(_CARRIERS) for _ in range(r.choice([0, 0, 0, 2, 8]))]
        if i % 5:
            family = families[i % len(families)]
            notices = NOTICES[family]
            words = r.choices(notices, [len(n) for n in notices])[0].split() if r.random() < 0.5 else r.choice(notices).split()
            if len(words) > 12 and r.random() < 0.6:  # a line of a wrapped text
                n = r.randint(8, len(words))
                at = r.randint(0, len(words) - n)
                words = words[at : at + n]
                # Families share sentences: such a part speaks for the first family that has it.
                part = f" {' '.join(words)} "
                family = next(f for f in FIRST for notice in NOTICES[f] if part in f" {notice} ")
            if len(words) > 6 and r.random() < 0.2:  # a word is changed
                words[r.randrange(len(words))] = r.choice(_CARRIERS)
        else:
            family, words = UNKNOWN, r.choice(_OTHER).split()
            if r.random() < 0.1:  # a notice's words in disorder
                words = r.choice([n for f in families for n in NOTICES[f] if 7 < len(n.split()) <= 14]).split()
                r.shuffle(words)
                words = words[: len(words) // 2]
        out.append((family, " ".join([*lead, *words, *tail])))
    return out


@functools.lru_cache(maxsize=1)
def trained() -> tuple[list[str], dict[str, np.ndarray], np.ndarray, float]:
    """(classes, weights by n-gram, bias, least probability of a prediction)."""
    lines = _lines()
    classes = [UNKNOWN, *sorted(NOTICES)]
    known = sorted(set().union(*(grams(norm_words(n)) for ns in NOTICES.values() for n in ns)) | set().union(*(grams(o.split()) for o in _OTHER)))
    index = {g: i for i, g in enumerate(known)}
    x = np.zeros((len(lines), len(known)), np.float32)
    y = np.zeros((len(lines), len(classes)), np.float32)
    for i, (family, line) in enumerate(lines):
        for g in grams(norm_words(line)):
            if g in index:
                x[i, index[g]] = 1
        y[i, classes.index(family)] = 1
    held = np.arange(len(lines)) % 7 == 0
    xt, yt = x[~held], y[~held]
    w, b = np.zeros((len(known), len(classes)), np.float32), np.zeros(len(classes), np.float32)
    step, l1, momentum = np.float32(0.5), 2e-5, 1.0
    wv, bv = w, b
    for _ in range(300):  # accelerated proximal gradient: the L1 penalty keeps the weights sparse
        z = xt @ wv + bv
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = (p - yt) / len(xt)
        new = wv - step * (xt.T @ g)
        new, newb = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0), bv - step * g.sum(axis=0)
        nxt = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        wv, bv = new + (momentum - 1) / nxt * (new - w), newb + (momentum - 1) / nxt * (newb - b)
        w, b, momentum = new, newb, nxt
    z = x[held] @ w + b
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    best, right = p.argmax(axis=1), y[held].argmax(axis=1)
    cut = 0.99
    for c in np.linspace(0.99, 0.3, 70):
        taken = (p.max(axis=1) >= c) & (best != 0)
        if taken.any() and (best[taken] == right[taken]).mean() < MIN_PRECISION:
            break
        cut = float(c)
    weights = {g: np.round(w[i].astype(float), 5) for g, i in index.items() if np.any(np.round(w[i], 5))}
    return classes, weights, np.round(b.astype(float), 5), cut


def witnesses() -> set[str]:
    """2-grams of which every confirmed text holds at least one: of each template all but one less than it must share."""
    rank = {w: i for i, w in enumerate(_USUAL)}
    usual = lambda pair: sum(rank.get(w, 10 * len(rank)) for w in pair.split())
    return {p for _, two in templates() for p in sorted(two, key=lambda p: (usual(p), p))[min(MIN_SHARED, len(two)) - 1 :]}


@functools.lru_cache(maxsize=1)
def needed() -> str:
    """A pattern that is found in every text with one of `witnesses` among its 2-grams: words may have anything but letters and digits between them."""
    after: dict[str, dict[str, list[str]]] = {}
    for pair in sorted(witnesses()):
        a, b = pair.split()
        after.setdefault(a[0], {}).setdefault(a[1:], []).append(re.escape(b))
    firsts = (a + "(?:" + "|".join(f"{re.escape(rest)}[^a-z0-9]++(?:{'|'.join(seconds)})" for rest, seconds in by.items()) + ")" for a, by in after.items())
    return "(?i)(?<![a-z0-9])(?:" + "|".join(firsts) + ")(?![a-z0-9])"


def classify(unit: str) -> str | None:
    """The confirmed family of one line or paragraph, or None: the rules of `scan`, one text at a time and without `needed`."""
    classes, weights, bias, cut = trained()
    words = norm_words(unit)
    z = bias + sum((weights[g] for g in sorted(grams(words)) if g in weights), np.zeros(len(classes)))
    p = np.exp(z - z.max())
    best = int(p.argmax())
    if best == 0 or p[best] / p.sum() < cut:
        return None
    own = set(pairs_of(words))
    for name, two in templates():
        shared = len(own.intersection(two))
        if name == classes[best] and shared >= min(MIN_SHARED, len(two)) and shared >= MIN_COVER * min(len(two), len(own)):
            return name
    return None


def _words(line: Column) -> Column:
    parts = F.transform(F.split(lower_ascii(line), NOT_WORD), lambda x: F.btrim(x, F.lit(".")))
    return F.filter(parts, lambda x: x != "")


def _grams(w: Column, n: int) -> Column:
    # By element: a slice copies the whole array for every n-gram, which long paragraphs don't allow.
    firsts = F.slice(w, 1, F.greatest(F.size(w) - (n - 1), F.lit(0)))
    return F.transform(firsts, lambda x, i: F.concat_ws(" ", x, *(F.get(w, i + k) for k in range(1, n))))


def _model(spark: SparkSession) -> DataFrame:
    """(gram, slot, weight): the weights of the classes in slots from 0, and a 1 in a slot of its own for each template that has the gram."""
    classes, weights, _, _ = trained()
    rows = [(g, c, float(x)) for g, v in sorted(weights.items()) for c, x in enumerate(v) if x]
    rows += [(g, len(classes) + t, 1.0) for t, (_, two) in enumerate(templates()) for g in two]
    return spark.createDataFrame(rows, "gram string, slot int, weight double")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs, n_license, licenses (distinct families, sorted), notices (paragraph:family) of every document."""
    spark = docs.sparkSession
    classes, _, bias, cut = trained()
    text_hash = F.xxhash64("text").alias("text_hash")
    key = ["doc_id", "text_hash", "par", "line"]
    # Every split is followed by a generator: as a column it would be made again for each use. Outer generators, since for
    # others the optimizer adds a filter that splits once more.
    held = docs.select("doc_id", "text", text_hash).filter(F.col("text").rlike(needed()))
    blocks = held.select("doc_id", "text_hash", F.posexplode_outer(F.split("text", BLANK)).alias("par", "block")).filter(F.col("block").rlike(needed()))
    several = F.instr(F.btrim(F.col("block")), "\n") > 0
    lines = F.when(several, F.split("block", "\n")).otherwise(F.array().cast("array<string>"))
    units = blocks.select("doc_id", "text_hash", "par", F.posexplode_outer(F.concat(F.array("block"), lines)).alias("line", "unit"))
    units = units.filter(F.col("unit").rlike(needed())).dropDuplicates(key).select(*key, F.explode_outer(F.array(_words(F.col("unit")))).alias("w"))
    every_gram = F.array_distinct(F.concat(_grams(F.col("w"), 1), _grams(F.col("w"), 2), _grams(F.col("w"), 3)))
    units = units.select(*key, F.explode_outer(F.array(F.struct(F.size(F.array_distinct(_grams(F.col("w"), 2))).alias("pairs"), every_gram.alias("grams")))).alias("u"))
    units = units.select(*key, F.col("u.pairs").alias("pairs"), F.explode_outer("u.grams").alias("gram"))
    sums = units.join(F.broadcast(_model(spark)), "gram").groupBy(*key, "pairs", "slot").agg(F.sum("weight").alias("x"))
    # At most a number for each class and each template.
    judged = sums.groupBy(*key, "pairs").agg(F.map_from_entries(F.collect_list(F.struct("slot", "x"))).alias("m"))
    score = F.array(*[F.coalesce(F.try_element_at("m", F.lit(c)), F.lit(0.0)) + float(b) for c, b in enumerate(bias)])
    judged = judged.select(*key, "pairs", "m", F.explode_outer(F.array(score)).alias("z"))
    top = F.array_max("z")
    odds = F.aggregate("z", F.lit(0.0), lambda a, z: a + F.exp(z))
    best = F.struct((F.exp(top) / odds).alias("p"), (F.array_position("z", top).cast("int") - 1).alias("class"))
    judged = judged.select(*key, "pairs", "m", F.explode_outer(F.array(best)).alias("best")).filter((F.col("best.class") > 0) & (F.col("best.p") >= cut))
    judged = judged.select(*key, "pairs", "m", F.explode_outer(F.array("best.class")).alias("class"))
    # The family's templates, as (slot, size): at most a handful.
    own = [F.array(*[F.struct(F.lit(len(classes) + t).alias("slot"), F.lit(len(two)).alias("n")) for t, (name, two) in enumerate(templates()) if name == c]) for c in classes[1:]]

    def enough(x: Column) -> Column:
        shared = F.coalesce(F.try_element_at("m", x["slot"]), F.lit(0.0))
        return (shared >= F.least(F.lit(MIN_SHARED), x["n"])) & (shared >= MIN_COVER * F.least(x["n"], F.col("pairs")))

    confirmed = F.exists(F.element_at(F.array(*own), F.col("class")), enough)
    family = F.element_at(F.array(*map(F.lit, classes)), F.col("class") + 1).alias("family")
    notices = judged.filter(confirmed).select(*key, family)
    # A paragraph is named once for each family that it or one of its lines has.
    said = F.struct("par", "family")
    by_doc = notices.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("family")).alias("families"), F.array_sort(F.collect_set(said)).alias("said"))
    by_doc = written(by_doc.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "families", "said"), "notices")
    full = F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\r\n\f\x0b"))
    every = docs.select("doc_id", text_hash, F.when(full == "", F.lit(0)).otherwise(F.regexp_count(full, F.lit(BLANK)) + 1).cast("long").alias("n_paragraphs"))
    joined = every.join(by_doc, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    text = F.transform("said", lambda x: F.concat_ws(":", x["par"].cast("string"), x["family"]))
    return joined.select(
        "doc_id", "n_paragraphs", F.coalesce(F.size("said"), F.lit(0)).cast("long").alias("n_license"),
        F.coalesce(F.array_join("families", ","), F.lit("")).alias("licenses"), F.coalesce(F.array_join(text, ","), F.lit("")).alias("notices"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))
