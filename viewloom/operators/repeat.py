"""`repeat`: recursive flattening of a document, in one expression and without a shuffle.

The nodes of a document are found level by level: a fold over as many steps as the document's objects are
nested carries the nodes found so far and the last level's. Every node carries a key, made of its path's
number and its position at each level, by which the nodes are put into pre-order at the end. So there is no limit
to the depth, and a document never leaves its row.
"""

from __future__ import annotations

from collections.abc import Callable

from ..functions.navigation import fresh


def depth(json: str) -> str:
    """How deep the objects of a JSON text are nested: the number of steps after which no level is left."""
    a, c = fresh(), fresh()
    strings = r"""regexp_replace({}, '"(?:[^"\\\\\\\\]++|\\\\\\\\.)*+"', '')""".replace("\\\\\\\\", "\\\\").format(json)
    braces = f"regexp_extract_all({strings}, '[{{}}]', 0)"
    step = f"({a}.d + IF({c} = '{{', 1, -1))"
    return (
        f"aggregate({braces}, named_struct('d', 0, 'm', 0), ({a}, {c}) -> named_struct('d', {step}, 'm', greatest({a}.m, {step})), {a} -> {a}.m)"
    )


def flattened(this: str, paths: list[Callable[[str], str]], levels: str) -> str:
    """The variants below `this` that any of the paths reach again and again, in pre-order.

    paths: SQL of the collection at a path of a variant; levels: an upper bound of the depth, at least 1.
    """

    def children(x: str, key: str) -> str:
        parts = []
        for j, path in enumerate(paths):
            c, i = fresh(), fresh()
            at = f"concat({key}, '.{j:03d}', lpad(CAST({i} AS STRING), 9, '0'))"
            parts.append(f"transform({path(x)}, ({c}, {i}) -> named_struct('k', {at}, 'v', {c}))")
        return parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"

    start = children(this, "''")
    a, n, e, x, y, z = (fresh() for _ in range(6))
    below = f"flatten(transform({a}.f, {e} -> {children(f'{e}.v', f'{e}.k')}))"
    step = f"named_struct('f', {below}, 'o', concat({a}.o, {a}.f))"
    found = f"aggregate(sequence(1, {levels}), named_struct('f', {start}, 'o', slice({start}, 1, 0)), ({a}, {n}) -> {step}, {a} -> concat({a}.o, {a}.f))"
    in_order = f"array_sort({found}, ({x}, {y}) -> CASE WHEN {x}.k < {y}.k THEN -1 WHEN {x}.k > {y}.k THEN 1 ELSE 0 END)"
    return f"transform({in_order}, {z} -> {z}.v)"
