"""The parser alone."""

from __future__ import annotations

import pytest

from viewloom.errors import FhirPathError
from viewloom.fhirpath import ast as A
from viewloom.fhirpath import parse


def test_precedence():
    assert parse("1 + 2 * 3") == A.Binary("+", A.Literal("integer", 1), A.Binary("*", A.Literal("integer", 2), A.Literal("integer", 3)))
    e = parse("a or b and c implies d")
    assert e.op == "implies" and e.left.op == "or" and e.left.right.op == "and"
    assert parse("a = b | c").right.op == "|"
    assert parse("a is b | c").op == "|"
    assert parse("-a.b * c").left == A.Unary("-", A.Member(A.Member(None, "a"), "b"))


def test_left_associative():
    e = parse("a - b - c")
    assert e.left == A.Binary("-", A.Member(None, "a"), A.Member(None, "b"))


def test_calls_and_indexes():
    e = parse("name.where(use = 'official').given[0]")
    assert isinstance(e, A.Index) and e.base.name == "given" and e.base.base.name == "where"
    assert parse("exists()") == A.Call(None, "exists", ())


@pytest.mark.parametrize(
    ("text", "kind", "value"),
    [("{}", "empty", None), ("true", "boolean", True), ("'a\\'b\\n\\u0041'", "string", "a'b\nA"), ("5L", "integer", 5), ("1.50", "decimal", "1.50"), ("@2020-01", "date", "2020-01"), ("@2020-01-02T10:00Z", "dateTime", "2020-01-02T10:00Z"), ("@T10:30", "time", "10:30"), ("5 'mg'", "integer", 5), ("3 days", "integer", 3)],
)
def test_literals(text, kind, value):
    assert parse(text) == A.Literal(kind, value)


def test_names_that_are_operators():
    assert parse("a.contains") == A.Member(A.Member(None, "a"), "contains")
    assert parse("`div`") == A.Member(None, "div")


@pytest.mark.parametrize("text", ["", "a.", "a..b", "@@", "a +", "(a", "a[", "f(a,", "'open", "$that", "a b", "@20"])
def test_errors(text):
    with pytest.raises(FhirPathError):
        parse(text)
