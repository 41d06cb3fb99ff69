"""Syntax tree of FHIRPath expressions."""

from __future__ import annotations

from dataclasses import dataclass


class Expr:
    """Any expression."""


@dataclass(frozen=True)
class Literal(Expr):
    """kind: empty, boolean, string, integer, decimal, date, dateTime or time; value: the Python value or the lexeme."""

    kind: str
    value: object


@dataclass(frozen=True)
class Constant(Expr):
    name: str


@dataclass(frozen=True)
class Variable(Expr):
    """this, index or total."""

    name: str


@dataclass(frozen=True)
class Member(Expr):
    base: Expr | None
    name: str


@dataclass(frozen=True)
class Index(Expr):
    base: Expr
    index: Expr


@dataclass(frozen=True)
class Call(Expr):
    base: Expr | None
    name: str
    args: tuple[Expr, ...]


@dataclass(frozen=True)
class Unary(Expr):
    op: str
    operand: Expr


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class TypeTest(Expr):
    """op: is or as."""

    op: str
    operand: Expr
    type_name: str
