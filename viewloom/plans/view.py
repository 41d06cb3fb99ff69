"""ViewDefinitions to one Spark SQL SELECT.

The resource table is filtered by resource type (a partition filter), the documents are parsed once, the
view's conditions are applied, and only then do generators make rows: a LATERAL VIEW for each iteration, an
inline() over an array of structs for unions. No step needs a shuffle.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from ..errors import FhirPathError, ViewDefinitionError
from ..fhirpath import ast as A
from ..fhirpath import parse
from ..functions import navigation as N
from ..identifiers import literal, quoted
from ..model import ColumnDef, ConstantDef, SelectNode, ViewDefinition
from ..operators import repeat, rows
from ..types import cast_text, column_type
from . import expressions as X

#: About so many rows are held at once where rows side by side are crossed.
BLOCK = 256


@dataclass(frozen=True)
class ColumnInfo:
    name: str
    type: str
    nullable: bool = True
    description: str | None = None


@dataclass(frozen=True)
class CompiledView:
    """One SELECT, without a terminator, and its columns."""

    sql: str
    columns: list[ColumnInfo]


@dataclass(frozen=True)
class Table:
    """Where the resources are: a table name as SQL, its columns, and whether the JSON column is VARIANT."""

    name: str = "fhir_resources"
    id_column: str = "id"
    json_column: str = "json"
    variant: bool = False
    test_id: str | None = None


def _constant(c: ConstantDef) -> A.Literal:
    if c.value is None:
        return A.Literal("empty", None)
    if c.type == "boolean":
        return A.Literal("boolean", c.value in (True, "true"))
    if c.type == "integer":
        return A.Literal("integer", int(c.value))
    if c.type == "decimal":
        return A.Literal("decimal", c.value if isinstance(c.value, str) else json.dumps(c.value))
    return A.Literal(c.type, str(c.value))


def _paths(nodes: tuple[SelectNode, ...]):
    for n in nodes:
        yield from (c.path for c in n.columns)
        yield from (p for p in (n.for_each, n.for_each_or_null, *n.repeat) if p)
        yield from _paths(n.selects)
        yield from _paths(n.union_all)


def _columns(nodes: tuple[SelectNode, ...]):
    for n in nodes:
        yield from n.columns
        yield from _columns(n.selects)
        yield from _columns(n.union_all)


def needs_lexemes(view: ViewDefinition) -> bool:
    """Whether the digits of numbers matter as they are written: in text columns and for boundaries."""
    paths = [*_paths(view.selects), *view.where]
    text_columns = any((c.type or "decimal").lower() == "decimal" or column_type(c).startswith("DECIMAL") for c in _columns(view.selects))
    return text_columns or any("Boundary" in p for p in paths)


def _names(e) -> set[str]:
    """The members that an expression names, with the names that ofType() makes of them."""
    out: set[str] = set()
    if isinstance(e, A.Member):
        out.add(e.name)
    if isinstance(e, A.TypeTest) or isinstance(e, A.Call) and e.name == "ofType":
        base = e.operand if isinstance(e, A.TypeTest) else e.base
        kind = e.type_name if isinstance(e, A.TypeTest) else X._type_name(e.args[0])
        if isinstance(base, A.Member):
            out.add(base.name + kind[0].upper() + kind[1:])
    for x in vars(e).values():
        for y in x if isinstance(x, (tuple, list)) else [x]:
            if isinstance(y, A.Expr):
                out |= _names(y)
    return out


def lexeme_names(view: ViewDefinition) -> frozenset[str] | None:
    """The members whose numbers keep their digits: all that the view's paths name; None for all numbers, where a collection's JSON shows others."""
    if any(c.collection for c in _columns(view.selects)):
        return None
    try:
        names = frozenset().union(*(_names(parse(p)) for p in [*_paths(view.selects), *view.where]))
    except FhirPathError:
        return None  # reported where the path is compiled
    return names or None


class _Compiler:
    def __init__(self, view: ViewDefinition, table: Table, strict: bool):
        self.view, self.table, self.strict = view, table, strict
        self.generators: list[str] = []
        #: Cells, [name, SQL], that are still to be computed above all generators; arrays whose rows are still to be crossed.
        self.open: list[list[str]] = []
        self.arrays: list[str] = []
        constants = {c.name: _constant(c) for c in view.constants}
        self.scope = X.Scope("_doc", resource=view.resource, lexemes=needs_lexemes(view) and not table.variant, constants=constants)

    def expression(self, path: str, scope: X.Scope, where: str) -> X.Value:
        try:
            return X.compile_expr(parse(path), scope)
        except FhirPathError as e:
            raise FhirPathError(f"{where}, path '{path}': {e}") from e

    def cell(self, c: ColumnDef, scope: X.Scope, like: ColumnDef | None = None) -> str:
        """SQL of a column; like: the column whose type it takes."""
        v = self.expression(c.path, scope, f"column '{c.name}'")
        kind = like or c
        if c.collection:
            return cast_text(X.json_array(v, scope), kind) if kind.tags else X.json_array(v, scope)
        if column_type(kind) == "BOOLEAN":
            sql = X.boolean(v, scope)
            if v.type != "boolean":
                sql = cast_text(X.text(v, scope), kind)
        elif v.type in X.NUMBERS and column_type(kind) in ("INT", "BIGINT"):
            sql = f"try_cast({X.first(v)} AS {column_type(kind)})"
        else:
            sql = cast_text(X.text(v, scope), kind)
        if self.strict and v.many:
            message = literal(f"column '{c.name}', path '{c.path}': several values")
            sql = f"CASE WHEN size({v.sql}) > 1 THEN CAST(raise_error({message}) AS {column_type(kind)}) ELSE {sql} END"
        return sql

    def repeated(self, n: SelectNode, scope: X.Scope) -> str:
        def at(path: str):
            def step(x: str) -> str:
                inner = scope.element(x, "0", "1")
                return X.as_variants(self.expression(path, inner, "repeat"))

            return step

        return repeat.flattened(scope.this, [at(p) for p in n.repeat], "_levels")

    def iterated(self, n: SelectNode, scope: X.Scope) -> str | None:
        """The collection that a node iterates over."""
        if n.repeat:
            return self.repeated(n, scope)
        path = n.for_each_or_null or n.for_each
        if not path:
            return None
        return X.as_variants(self.expression(path, scope, "forEachOrNull" if n.for_each_or_null else "forEach"))

    # Rows by generators, for everything outside unions.

    def node(self, n: SelectNode, scope: X.Scope) -> list[list[str]]:
        """[name, SQL] of the columns of a node; its generators are added to the list."""
        items = self.iterated(n, scope)
        if items is not None:
            g = f"g{len(self.generators) + 1}"
            outer = "OUTER " if n.for_each_or_null else ""
            self.generators.append(f"LATERAL VIEW {outer}posexplode({items}) {g} AS {g}_i, {g}_v")
            scope = scope.element(f"{g}_v", f"coalesce({g}_i, 0)", f"size({items})", f"coalesce({g}_i, 0)")
        out = [[c.name, self.cell(c, scope)] for c in n.columns]
        self.open += out
        out += self.siblings(n.selects, scope)
        if n.union_all:
            sql, names = self.union(n, scope, {})
            g = f"g{len(self.generators) + 1}"
            self.generators.append(f"LATERAL VIEW inline({sql}) {g} AS {', '.join(f'{g}_c{i}' for i in range(len(names)))}")
            out += [[name, f"{g}_c{i}"] for i, name in enumerate(names)]
        return out

    def siblings(self, nodes: tuple[SelectNode, ...], scope: X.Scope) -> list[list[str]]:
        """The columns of nodes side by side. If several of them make rows, the rows of those that only have columns are built once,
        before any generator: below another one's rows they would be built again for each of these."""
        nested = [k for k, n in enumerate(nodes) if n.columns and not n.selects and not n.union_all and (n.for_each or n.for_each_or_null or n.repeat)]
        if sum(map(_makes_rows, nodes)) < 2 or not nested:
            return [c for n in nodes for c in self.node(n, scope)]
        size = max(2, round(BLOCK ** (1 / len(nested))))
        ready: dict[int, tuple[str, list[str]]] = {}
        for k in nested:
            sql, names = self.rows(nodes[k], scope, {})
            g = f"g{len(self.generators) + 1}"
            # OUTER: for other generators the optimizer adds a filter that builds the array once more.
            self.generators.append(f"LATERAL VIEW OUTER explode(array({rows.blocks(sql, size)})) {g} AS {g}_r")
            ready[k] = f"{g}_r", names
        arrays = [array for array, _ in ready.values()]
        self.arrays += arrays
        done = {k: self.node(n, scope) for k, n in enumerate(nodes) if k not in ready}
        self.settle()
        self.arrays = self.arrays[: -len(arrays)]
        # All combinations of blocks, one at a time, by folds that return the arrays as they are: with bare columns these generators
        # would be compiled together with the next ones into one loop, which keeps the whole cross product of a document in memory.
        for k, (array, names) in ready.items():
            x, y = N.fresh(), N.fresh()
            g = f"g{len(self.generators) + 1}"
            self.generators.append(f"LATERAL VIEW explode(aggregate(array(0), {array}, ({x}, {y}) -> {x})) {g} AS {g}_b")
            ready[k] = f"{g}_b", names
        # The rows of a combination, in one compiled loop.
        for k, (block, names) in ready.items():
            g = f"g{len(self.generators) + 1}"
            self.generators.append(f"LATERAL VIEW inline({block}) {g} AS {', '.join(f'{g}_c{i}' for i in range(len(names)))}")
            done[k] = [[name, f"{g}_c{i}"] for i, name in enumerate(names)]
        return [c for k in range(len(nodes)) for c in done[k]]

    def settle(self) -> None:
        """Computes the cells so far, once for all combinations of the arrays' rows and only if there are any: above the generators
        to come they would be computed for each row, and each would carry the document."""
        if not self.open:
            return
        g = f"g{len(self.generators) + 1}"
        some = " AND ".join(f"size({a}) > 0" for a in self.arrays)
        fields = ", ".join(f"'c{i}', CASE WHEN {some} THEN {sql} END" for i, (_, sql) in enumerate(self.open))
        self.generators.append(f"LATERAL VIEW OUTER inline(array(named_struct({fields}))) {g} AS {', '.join(f'{g}_c{i}' for i in range(len(self.open)))}")
        for i, c in enumerate(self.open):
            c[1] = f"{g}_c{i}"
        self.open = []

    # Rows as arrays of structs, for branches of unions and for siblings.

    def union(self, n: SelectNode, scope: X.Scope, types: dict[str, ColumnDef]) -> rows.Rows:
        """The rows of all branches; a column has the type that types or else the first branch gives it."""
        types = {c.name: c for c in n.union_all[0].column_defs()} | types
        return rows.union([self.rows(b, scope, types) for b in n.union_all])

    def rows(self, n: SelectNode, scope: X.Scope, types: dict[str, ColumnDef]) -> rows.Rows:
        items = self.iterated(n, scope)
        if items is None:
            return self.body(n, scope, types)
        x, i = N.fresh(), N.fresh()
        sql, names = self.body(n, scope.element(x, i, f"size({items})", i), types)
        out = rows.per_element(items, x, i, sql)
        if n.for_each_or_null:
            none, _ = self.body(n, scope.element("CAST(NULL AS VARIANT)", "0", "0", "0"), types)
            out = f"CASE WHEN coalesce(size({items}), 0) = 0 THEN {none} ELSE {out} END"
        return out, names

    def body(self, n: SelectNode, scope: X.Scope, types: dict[str, ColumnDef]) -> rows.Rows:
        parts: list[rows.Rows] = []
        if n.columns:
            parts.append(rows.one_row([(c.name, self.cell(c, scope, types.get(c.name))) for c in n.columns]))
        parts += [self.rows(s, scope, types) for s in n.selects]
        if n.union_all:
            parts.append(self.union(n, scope, types))
        out = parts[0]
        for p in parts[1:]:
            out = rows.cross(out, p)
        return out

    def condition(self, path: str) -> str:
        v = self.expression(path, self.scope, "where")
        if v.type == "boolean":
            return X.first(v)
        message = literal(f"where, path '{path}': not a boolean")
        t = X.text(v, self.scope)
        return f"CASE {t} WHEN 'true' THEN true WHEN 'false' THEN false ELSE IF({t} IS NULL, CAST(NULL AS BOOLEAN), CAST(raise_error({message}) AS BOOLEAN)) END"

    def compile(self) -> CompiledView:
        cells = self.siblings(self.view.selects, self.scope)
        conditions = [self.condition(p) for p in self.view.where]
        t, json_column = self.table, quoted(self.table.json_column)
        if t.variant:
            doc, as_text = f"r.{json_column}", f"to_json(r.{json_column})"
        else:
            as_text = f"r.{json_column}"
            # A document that isn't JSON is an error; NULL is a document without members.
            doc = f"parse_json({N.quoted_numbers(as_text, lexeme_names(self.view)) if self.scope.lexemes else as_text})"
        # A generator of one row, so that a document is parsed once: a plain column would be put into each condition above it.
        parsed = f"LATERAL VIEW explode(array({doc})) d AS _doc"
        base = [f"r.{quoted(t.id_column)} AS _id", "r.resource_type AS _rt", "d._doc"]
        if any(n.repeat for n in _all(self.view.selects)):
            base.append(f"greatest(1, {repeat.depth(as_text)}) AS _levels")
        keep = [f"r.resource_type = {literal(self.view.resource)}"]
        if t.test_id is not None:
            keep.append(f"r.test_id = {literal(t.test_id)}")
        sql = f"WITH docs AS (SELECT {', '.join(base)} FROM {t.name} r {parsed} WHERE {' AND '.join(keep)})"
        source = "docs"
        if conditions:
            sql += f", kept AS (SELECT * FROM docs WHERE {' AND '.join(f'({c})' for c in conditions)})"
            source = "kept"
        out = ", ".join(f"{cell} AS {quoted(name)}" for name, cell in cells)
        sql = "\n".join([sql, f"SELECT {out}", f"FROM {source}", *self.generators])
        return CompiledView(sql, [ColumnInfo(c.name, column_type(c), True, c.description) for c in self.view.column_defs()])


def _makes_rows(n: SelectNode) -> bool:
    return bool(n.for_each or n.for_each_or_null or n.repeat or n.union_all) or any(map(_makes_rows, n.selects))


def _all(nodes: tuple[SelectNode, ...]):
    for n in nodes:
        yield n
        yield from _all(n.selects)
        yield from _all(n.union_all)


def compile_view(view: ViewDefinition, table: Table | None = None, strict: bool = False) -> CompiledView:
    """The SELECT of a view. strict: a column that isn't a collection raises an error if it has several values."""
    if not view.column_defs():
        raise ViewDefinitionError("a view must have a column")
    return _Compiler(view, table or Table(), strict).compile()
