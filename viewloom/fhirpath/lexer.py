"""Tokens of FHIRPath."""

from __future__ import annotations

import re
from typing import NamedTuple

from ..errors import FhirPathError


class Token(NamedTuple):
    kind: str  # name, delimited, string, number, long, date, op, end
    text: str
    at: int


_CLOCK = r"\d\d(?::\d\d(?::\d\d(?:\.\d+)?)?)?"
_PATTERNS = [
    ("skip", r"\s+|//[^\r\n]*|/\*.*?\*/"),
    ("date", rf"@T{_CLOCK}|@\d{{4}}(?:-\d\d(?:-\d\d)?)?(?:T(?:{_CLOCK}(?:Z|[+-]\d\d:\d\d)?)?)?"),
    ("long", r"\d+L\b"),
    ("number", r"\d+(?:\.\d+)?"),
    ("string", r"'(?:[^'\\]|\\.)*'"),
    ("delimited", r"`(?:[^`\\]|\\.)*`"),
    ("name", r"[A-Za-z_][A-Za-z0-9_]*"),
    ("var", r"\$[a-z]+"),
    ("op", r"<=|>=|!=|!~|[-+*/&|<>=~.,()\[\]{}%]"),
]
_TOKEN = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _PATTERNS), re.DOTALL)
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "f": "\f"}


def unescape(body: str) -> str:
    """Decodes the escapes of a quoted token's body."""

    def one(m: re.Match) -> str:
        s = m[1]
        return chr(int(s[1:], 16)) if s[0] == "u" and len(s) == 5 else _ESCAPES.get(s, s)

    return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", one, body, flags=re.DOTALL)


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise FhirPathError(f"unexpected character {text[at]!r} at {at} in {text!r}")
        if m.lastgroup != "skip":
            out.append(Token(m.lastgroup, m[0], at))
        at = m.end()
    return [*out, Token("end", "", len(text))]
