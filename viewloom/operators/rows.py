"""Rows as arrays of structs: concatenation and cross products within one resource."""

from __future__ import annotations

from ..functions.navigation import fresh

#: An array of structs in SQL and the names of their fields.
Rows = tuple[str, list[str]]


def one_row(cells: list[tuple[str, str]]) -> Rows:
    fields = ", ".join(f"'{name}', {sql}" for name, sql in cells)
    return f"array(named_struct({fields}))", [name for name, _ in cells]


def cross(a: Rows, b: Rows) -> Rows:
    """Every row of a with every row of b."""
    x, y = fresh(), fresh()
    fields = ", ".join([f"'{n}', {x}.`{n}`" for n in a[1]] + [f"'{n}', {y}.`{n}`" for n in b[1]])
    return f"flatten(transform({a[0]}, {x} -> transform({b[0]}, {y} -> named_struct({fields}))))", a[1] + b[1]


def union(branches: list[Rows]) -> Rows:
    return f"concat({', '.join(sql for sql, _ in branches)})", branches[0][1]


def per_element(collection: str, x: str, i: str, rows: str) -> str:
    return f"flatten(transform({collection}, ({x}, {i}) -> {rows}))"


def blocks(rows: str, size: int) -> str:
    """An array's elements as arrays of at most so many; NULL if there are none. The array is built once."""
    x, y, i = fresh(), fresh(), fresh()
    cut = f"transform(sequence(1, size({x}), {size}), {i} -> slice({x}, {i}, {size}))"
    return f"aggregate(array(0), {rows}, ({x}, {y}) -> {x}, {x} -> CASE WHEN size({x}) > 0 THEN {cut} END)"
