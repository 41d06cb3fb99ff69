from __future__ import annotations

import re

import pytest

from viewloom.llm import op6_licenses as L

from .conftest import prose


@pytest.mark.parametrize(
    ("line", "family"),
    [
        ("Licensed under the Apache License, Version 2.0.", "apache-2.0"), ("Released under the MIT License.", "mit"), ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
        ("All rights reserved.", "proprietary"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), ("licensed under cc by-sa 4.0", "cc-by-sa"), ("Licensed under the GNU Lesser General Public License version 3", "lgpl"),
        ("the and of Released under the MIT License. of the", "mit"), ("driver's license", None), ("He got a license to fish.", None), ("reserved rights", None), ("plain words", None), ("", None),
    ],
)
def test_lines(line, family):
    assert L.classify(line) == family


# Not lines of the trainer: as they stand in files.
HELD_OUT = [
    ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit"), ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING', "mit"), ("it under the terms of the GNU General Public License as published by", "gpl"),
    ("SPDX-License-Identifier: GPL-2.0-only", "gpl"), ("Permission to use, copy, modify, and/or distribute this software for any", "isc"), ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("This software is provided 'as-is', without any express or implied warranty.", "zlib"), ("// SPDX-License-Identifier: MIT", "mit"), ("Copyright 2019 Foo Inc. All rights reserved.", "proprietary"),
    ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions", "bsd"), ("to deal in the Software without restriction, including without limitation the rights", "mit"),
    ("you may not use this file except in compliance with the License.", "apache-2.0"), ("Unauthorized copying of this file, via any medium is strictly prohibited", "proprietary"), ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl"),
    (" * You should have received a copy of the GNU General Public License along with this program.", "gpl"), ("Altered source versions must be plainly marked as such, and must not be", "zlib"),
]
NO_NOTICE = ["the contract grants all rights reserved to us", "the software is provided to staff", "A driving license was lost in the street", "The new GNU compiler is fast software", "The rights of the people were reserved by law", "permission to land was given", "copyright is a broad topic", "apache helicopters flew over the eclipse of the sun", "The committee discussed software warranties at length", "a license to print money"]


def test_held_out_lines():
    assert sum(L.classify(t) == f for t, f in HELD_OUT) >= 0.9 * len(HELD_OUT), [t for t, f in HELD_OUT if L.classify(t) != f]
    assert [t for t in NO_NOTICE if L.classify(t)] == []


def test_every_template_and_every_line_of_one_holds_a_key_word():
    assert all(re.search(L.needed(), n) for notices in L.NOTICES.values() for n in notices)


def units(text):
    for par, block in enumerate(re.split(L.BLANK, text)):
        yield par, block
        if "\n" in block.strip(" "):
            for line in block.split("\n"):
                yield par, line


def test_query_rows_by_brute_force(make, odd_rows):
    texts = [prose(5, 20) + "\n" + n.upper() + ".\n \n" + prose(6, 4) for ns in L.NOTICES.values() for n in ns]
    texts += ["Released under the MIT License.\nAll rights reserved.\nReleased under the MIT License.", "license plate\nlicense", "  \n\t\n", "\n\nx\n\n", *(t for t, _ in HELD_OUT), *NO_NOTICE]
    rows = [*odd_rows, *((100 + i, t) for i, t in enumerate(texts)), (100, texts[0])]
    out = L.scan(make(rows)).collect()
    assert len(out) == len(rows)
    want = []
    for d, t in rows:
        found = sorted({(par, f) for par, u in units(t or "") if (f := L.classify(u))})
        full = (t or "").strip(" \t\r\n\f\x0b")
        want.append((d, len(re.split(L.BLANK, full)) if full else 0, len(found), ",".join(sorted({f for _, f in found})), ",".join(f"{i}:{f}" for i, f in found)))
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)
    assert sum(r["n_license"] > 0 for r in out) > 40
    assert L.scan(make([])).count() == 0


MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction"
GPL = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by"


def test_wrapped_notices(make):
    texts = [MIT, GPL, "First.\n\n" + GPL + "\n\t\nReleased under the MIT\nLicense.\n", "Released under\n\nthe MIT License", prose(3, 4000) + "\n" + MIT + "\n" + prose(4, 3000)]
    out = {r["doc_id"]: r["notices"] for r in L.scan(make(list(enumerate(texts)))).collect()}
    assert out == {0: "0:mit", 1: "0:gpl", 2: "1:gpl,2:mit", 3: "", 4: "0:mit"}


# Parts of templates without any word that names a licence, software or a right.
PLAIN = [
    ("list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "bsd"),
    ("and/or other materials provided with the distribution", "bsd"), ("Anyone is free to copy, modify, publish, use, compile, sell, or", "unlicense"),
]


def test_parts_without_telling_words_are_judged(make):
    texts = [f"{prose(7, 30)}\n\n{t}\n{prose(8, 12)}" for t, _ in PLAIN]
    assert [L.classify(t) for t, _ in PLAIN] == [f for _, f in PLAIN]
    out = {r["doc_id"]: r["licenses"] for r in L.scan(make(list(enumerate(texts)))).collect()}
    assert out == dict(enumerate(f for _, f in PLAIN))


def test_what_is_dropped_unjudged_is_never_confirmed():
    kept = L.witnesses()
    assert all(len(set(two) - kept) < min(L.MIN_SHARED, len(two)) for _, two in L.templates())
    for notice in (n for ns in L.NOTICES.values() for n in ns):
        words = notice.split()
        parts = (words[i:j] for i in range(len(words)) for j in range(i + 3, min(len(words), i + 16) + 1))
        for part in parts:
            line = "\u00e9...".join(part).upper()
            assert re.search(L.needed(), line, re.ASCII) or L.classify(line) is None, line
