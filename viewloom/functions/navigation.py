"""Navigation of VARIANT documents in SQL.

A FHIRPath collection is an array of variants, without NULLs and JSON nulls. A member step takes an array's
elements, or a single value as one element, so it needs no schema.
"""

from __future__ import annotations

import itertools

from ..errors import FhirPathError

#: Marks a number that was quoted to keep its digits: a private-use character that no JSON number starts with.
NUMBER_MARK = "\ue000"
#: Numbers outside strings, with what stands before them.
_NUMBERS = r"\\G((?:[^\"0-9\\-]++|\"(?:[^\"\\\\]++|\\\\.)*+\")*+)(-?[0-9]+(?:\\.[0-9]+)?(?:[eE][+\\-]?[0-9]+)?)"

_ids = itertools.count(1)


def fresh(prefix: str = "v_") -> str:
    """A new name for a lambda variable."""
    return f"{prefix}{next(_ids)}"


def quoted_numbers(json: str, names: frozenset[str] | None = None) -> str:
    """JSON text with its numbers as marked strings; only those of members with one of the names, if there are any given.

    A quote inside a JSON string has a backslash before it, so a name with its two quotes and a colon after it is a member.
    """
    if names and all(n.isalnum() for n in names):
        number = r"(-?[0-9]+(?:\\.[0-9]+)?(?:[eE][+\\-]?[0-9]+)?)(?=\\s*+[,}\\]])"
        return f"regexp_replace({json}, '(\"(?:{'|'.join(sorted(names))})\"\\\\s*+:\\\\s*+){number}', '$1\"{NUMBER_MARK}$2\"')"
    return f"regexp_replace({json}, '{_NUMBERS}', '$1\"{NUMBER_MARK}$2\"')"


def plain_json(json: str) -> str:
    """JSON text with marked strings as numbers again."""
    return f"regexp_replace({json}, '\"{NUMBER_MARK}([^\"]*)\"', '$1')"


def _key(name: str) -> str:
    if '"' in name or "\\" in name or "'" in name:
        raise FhirPathError(f"element name {name!r} has a quote")
    return f"""'$["{name}"]'"""


def _present(array: str) -> str:
    y = fresh()
    return f"filter({array}, {y} -> {y} IS NOT NULL AND NOT is_variant_null({y}))"


def _step(x: str, name: str) -> str:
    key = _key(name)
    return f"coalesce(try_variant_get({x}, {key}, 'array<variant>'), array(try_variant_get({x}, {key}, 'variant')))"


def member_of_one(x: str, name: str) -> str:
    """The collection at a member of one variant."""
    return _present(_step(x, name))


def path_of_one(x: str, names: list[str]) -> str:
    """The collection at a path of members of one variant.

    Where all steps but the last are single objects, which the path itself tells, it is one step; else each step takes the elements of the one before.
    """
    if len(names) == 1:
        return member_of_one(x, names[0])
    whole = "'$" + "".join(_key(n)[2:-1] for n in names) + "'"
    direct = f"coalesce(try_variant_get({x}, {whole}, 'array<variant>'), array(try_variant_get({x}, {whole}, 'variant')))"
    return f"CASE WHEN try_variant_get({x}, {whole}, 'variant') IS NOT NULL THEN {_present(direct)} ELSE {member_of_many(path_of_one(x, names[:-1]), names[-1])} END"


def member_of_many(collection: str, name: str) -> str:
    """The collection at a member of every element of a collection."""
    x = fresh()
    return _present(f"flatten(transform({collection}, {x} -> {_step(x, name)}))")


def text_of(x: str, lexemes: bool) -> str:
    """The text of a variant: a scalar's own, JSON for objects and arrays."""
    text = f"CAST({x} AS STRING)"
    return f"ltrim('{NUMBER_MARK}', {text})" if lexemes else text


def one(value: str) -> str:
    """The collection of one scalar, empty if it is NULL."""
    return f"array_compact(array({value}))"
