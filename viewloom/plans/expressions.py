"""FHIRPath syntax trees to Spark SQL expressions.

Every subexpression is a Value: SQL for a scalar or for a collection, and what is known of its type. SQL
text is only ever built from the tree, never read back.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from ..errors import FhirPathError
from ..fhirpath import ast as A
from ..functions import boundary
from ..functions import navigation as N
from ..identifiers import literal
from ..model import RESOURCE_TYPES

NUMBERS = ("integer", "decimal")
DECIMAL = "DECIMAL(38,18)"
#: Operands of products and quotients, if they fit: narrower, so that these keep their digits; and the type of those of wider ones.
OPERAND = "DECIMAL(20,8)"
WIDE = "DECIMAL(38,13)"


@dataclass(frozen=True)
class Value:
    """sql: an array if many, else a scalar; type: variant, or the type of a scalar; hint: a FHIR type from ofType."""

    sql: str
    many: bool
    type: str
    hint: str | None = None


@dataclass(frozen=True)
class Scope:
    """What the names of an expression stand for."""

    this: str
    root: str = "_doc"
    at_root: bool = True
    resource: str = ""
    resource_type: str = "_rt"
    row_index: str = "0"
    index: str = "0"
    total: str = "1"
    lexemes: bool = False
    constants: dict[str, A.Literal] = field(default_factory=dict)

    def element(self, this: str, index: str, total: str, row_index: str | None = None) -> Scope:
        return replace(self, this=this, at_root=False, index=index, total=total, row_index=self.row_index if row_index is None else row_index)


def _scalar(sql: str, kind: str) -> Value:
    return Value(sql, False, kind)


def collection(v: Value) -> str:
    return v.sql if v.many else N.one(v.sql)


def first(v: Value) -> str:
    return f"get({v.sql}, 0)" if v.many else v.sql


def _text_of_element(x: str, kind: str, s: Scope) -> str:
    if kind == "variant":
        return N.text_of(x, s.lexemes)
    if kind == "decimal":
        return boundary.number_text(x)
    return x if kind not in ("integer", "boolean") else f"CAST({x} AS STRING)"


def text(v: Value, s: Scope) -> str:
    """The text of the first element."""
    return _text_of_element(first(v), v.type, s)


def texts(v: Value, s: Scope) -> str:
    """The texts of all elements, as an array."""
    x = N.fresh()
    return f"transform({collection(v)}, {x} -> {_text_of_element(x, v.type, s)})"


def boolean(v: Value, s: Scope) -> str:
    """The first element as a BOOLEAN; NULL if it isn't one."""
    if v.type == "boolean":
        return first(v)
    return f"CASE {text(v, s)} WHEN 'true' THEN true WHEN 'false' THEN false END"


def number(v: Value, s: Scope, kind: str = DECIMAL) -> str:
    if v.type in NUMBERS:
        return f"try_cast({first(v)} AS {kind})"
    return f"try_cast({text(v, s)} AS {kind})"


def as_variants(v: Value) -> str:
    """The collection with variants for elements, to iterate over."""
    if v.type == "variant":
        return collection(v)
    x = N.fresh()
    return f"transform({collection(v)}, {x} -> CAST({x} AS VARIANT))"


def json_array(v: Value, s: Scope) -> str:
    """The collection as JSON text."""
    if v.type == "decimal":
        return f"concat('[', array_join({texts(v, s)}, ','), ']')"
    out = f"to_json({collection(v)})"
    return N.plain_json(out) if s.lexemes and v.type == "variant" else out


def compile_literal(e: A.Literal) -> Value:
    if e.kind == "empty":
        return Value("CAST(array() AS ARRAY<VARIANT>)", True, "variant")
    if e.kind == "boolean":
        return _scalar("true" if e.value else "false", "boolean")
    if e.kind == "integer":
        return _scalar(f"{e.value}" if abs(int(e.value)) < 2**31 else f"{e.value}L", "integer")
    if e.kind == "decimal":
        return _scalar(f"CAST('{e.value}' AS {DECIMAL})", "decimal")
    if e.value is None:
        return _scalar("CAST(NULL AS STRING)", "string")
    return Value(literal(str(e.value)), False, "string", e.kind if e.kind != "string" else None)


def compile_expr(e: A.Expr, s: Scope) -> Value:
    """The value of an expression in a scope."""
    match e:
        case A.Literal():
            return compile_literal(e)
        case A.Constant(name):
            return _constant(name, s)
        case A.Variable("this"):
            return Value(N.one(s.this), True, "variant")
        case A.Variable("index"):
            return _scalar(s.index, "integer")
        case A.Variable("total"):
            return _scalar(s.total, "integer")
        case A.Member(base, name):
            return _member(base, name, s)
        case A.Index(base, index):
            return _index(base, index, s)
        case A.Call():
            return _call(e, s)
        case A.Unary(op, operand):
            v = compile_expr(operand, s)
            if v.type == "integer":
                return _scalar(f"({op}{first(v)})", "integer")
            return _scalar(f"({op}{number(v, s)})", "decimal")
        case A.TypeTest(op, operand, name):
            typed = _of_type(operand, name, s)
            return typed if op == "as" else _scalar(f"(size({collection(typed)}) > 0)", "boolean")
        case A.Binary(op, left, right):
            return _binary(op, compile_expr(left, s), compile_expr(right, s), s)
    raise FhirPathError(f"unsupported expression: {e}")


def _constant(name: str, s: Scope) -> Value:
    if name == "rowIndex":
        return _scalar(s.row_index, "integer")
    if name in ("resource", "context"):
        return Value(N.one(s.root), True, "variant")
    if name in s.constants:
        return compile_literal(s.constants[name])
    raise FhirPathError(f"constant '%{name}' is not defined")


def _member(base: A.Expr | None, name: str, s: Scope) -> Value:
    if base is None:
        if s.at_root and name == s.resource:
            return Value(N.one(s.this), True, "variant")
        return Value(N.member_of_one(s.this, name), True, "variant")
    if isinstance(base, A.Variable) and base.name == "this":
        return Value(N.member_of_one(s.this, name), True, "variant")
    names = _chain(base, s)
    if names:
        return Value(N.path_of_one(s.this, [*names, name]), True, "variant")
    v = compile_expr(base, s)
    if v.type != "variant":
        raise FhirPathError(f"a {v.type} has no member '{name}'")
    return Value(N.member_of_many(collection(v), name), True, "variant")


def _chain(e: A.Expr | None, s: Scope) -> list[str]:
    """The names of a path of members from $this; none for other expressions."""
    names: list[str] = []
    while isinstance(e, A.Member):
        names.append(e.name)
        e = e.base
    if s.at_root and e is None and names and names[-1] == s.resource:
        names.pop()
    return names[::-1] if e is None or isinstance(e, A.Variable) and e.name == "this" else []


def _index(base: A.Expr, index: A.Expr, s: Scope) -> Value:
    v = compile_expr(base, s)
    if not v.many:
        raise FhirPathError("only a collection can be indexed")
    if isinstance(index, A.Literal) and index.kind == "integer":
        return replace(v, sql=f"slice({v.sql}, {int(index.value) + 1}, 1)")
    at = f"coalesce(CAST({number(compile_expr(index, s), s)} AS INT), -1)"
    return replace(v, sql=f"CASE WHEN {at} < 0 THEN slice({v.sql}, 1, 0) ELSE slice({v.sql}, {at} + 1, 1) END")


# --- operators -----------------------------------------------------------------------------------------


def _binary(op: str, a: Value, b: Value, s: Scope) -> Value:
    if op in ("and", "or"):
        return _scalar(f"({boolean(a, s)} {op.upper()} {boolean(b, s)})", "boolean")
    if op == "xor":
        return _scalar(f"({boolean(a, s)} <> {boolean(b, s)})", "boolean")
    if op == "implies":
        return _scalar(f"((NOT {boolean(a, s)}) OR {boolean(b, s)})", "boolean")
    if op in ("=", "~"):
        return _scalar(_equal(a, b, s), "boolean")
    if op in ("!=", "!~"):
        return _scalar(f"(NOT {_equal(a, b, s)})", "boolean")
    if op in ("<", "<=", ">", ">="):
        return _scalar(_ordered(op, a, b, s), "boolean")
    if op == "in":
        return _scalar(_within(a, b, s), "boolean")
    if op == "contains":
        return _scalar(_within(b, a, s), "boolean")
    if op == "|":
        return _union(a, b, s)
    if op == "&":
        return _scalar(f"concat(coalesce({text(a, s)}, ''), coalesce({text(b, s)}, ''))", "string")
    if op == "+" and "string" in (a.type, b.type):
        return _scalar(f"concat({text(a, s)}, {text(b, s)})", "string")
    return _arithmetic(op, a, b, s)


def _equal_elements(x: str, xt: str, y: str, yt: str, s: Scope) -> str:
    a, b = Value(x, False, xt), Value(y, False, yt)
    if "boolean" in (xt, yt):
        return f"({boolean(a, s)} = {boolean(b, s)})"
    if xt in NUMBERS or yt in NUMBERS:
        return f"({number(a, s)} = {number(b, s)})"
    if xt == yt == "variant" and s.lexemes:
        marked = " AND ".join(f"startswith(CAST({z} AS STRING), '{N.NUMBER_MARK}')" for z in (x, y))
        return f"(CASE WHEN {marked} THEN {number(a, s)} = {number(b, s)} ELSE {text(a, s)} = {text(b, s)} END)"
    return f"({text(a, s)} = {text(b, s)})"


def _equal(a: Value, b: Value, s: Scope) -> str:
    """Equality of collections: the same elements in the same order; empty if one is."""
    if not a.many and not b.many:
        return _equal_elements(a.sql, a.type, b.sql, b.type, s)
    if a.many and b.many:
        x, y, p, q = N.fresh(), N.fresh(), N.fresh(), N.fresh()
        same = _equal_elements(p, a.type, q, b.type, s)
        # Lambda variables, so that a collection is made once.
        t = N.fresh()
        both = f"CASE WHEN size({x}) = 0 OR size({y}) = 0 THEN CAST(NULL AS BOOLEAN) WHEN size({x}) <> size({y}) THEN false ELSE forall(zip_with({x}, {y}, ({p}, {q}) -> {same}), {t} -> {t}) END"
        return f"get(transform(array({a.sql}), {x} -> get(transform(array({b.sql}), {y} -> {both}), 0)), 0)"
    many, other = (a, b) if a.many else (b, a)
    x = N.fresh()
    one = _equal_elements(f"get({x}, 0)", many.type, other.sql, other.type, s)
    return f"get(transform(array({many.sql}), {x} -> CASE WHEN size({x}) > 1 THEN IF({other.sql} IS NULL, CAST(NULL AS BOOLEAN), false) ELSE {one} END), 0)"


def _ordered(op: str, a: Value, b: Value, s: Scope) -> str:
    if a.type in NUMBERS or b.type in NUMBERS:
        return f"({number(a, s)} {op} {number(b, s)})"
    x, y, n, m = text(a, s), text(b, s), number(a, s), number(b, s)
    if "string" in (a.type, b.type):
        return f"({x} {op} {y})"
    return f"(CASE WHEN {n} IS NOT NULL AND {m} IS NOT NULL THEN {n} {op} {m} ELSE {x} {op} {y} END)"


def _within(needle: Value, hay: Value, s: Scope) -> str:
    x = N.fresh()
    found = f"exists({collection(hay)}, {x} -> {_equal_elements(x, hay.type, first(needle), needle.type, s)})"
    return f"CASE WHEN {first(needle)} IS NULL THEN CAST(NULL AS BOOLEAN) ELSE coalesce({found}, false) END"


def _union(a: Value, b: Value, s: Scope) -> Value:
    x, y, i = N.fresh(), N.fresh(), N.fresh()
    if a.type != b.type or a.type != "variant":
        return Value(f"array_distinct(concat({texts(a, s)}, {texts(b, s)}))", True, "string")
    both = f"concat({collection(a)}, {collection(b)})"
    keys = f"transform({both}, {y} -> {_text_of_element(y, a.type, s)})"
    return Value(f"filter({both}, ({x}, {i}) -> array_position({keys}, {_text_of_element(x, a.type, s)}) = {i} + 1)", True, a.type)


def _arithmetic(op: str, a: Value, b: Value, s: Scope) -> Value:
    whole = a.type == b.type == "integer"
    if whole and op in ("+", "-", "*"):
        return _scalar(f"(CAST({first(a)} AS BIGINT) {op} {first(b)})", "integer")
    x, y = number(a, s), number(b, s)
    if op in ("+", "-"):
        return _scalar(f"({x} {op} {y})", "decimal")
    if op in ("*", "/"):
        n, m = number(a, s, OPERAND), number(b, s, OPERAND)
        # What fits neither way is an error of the session (ANSI), never silently no value.
        narrow, wide = (f"({n} * {m})", f"({x} * {y})") if op == "*" else (f"try_divide({n}, {m})", f"try_divide({x}, {y})")
        return _scalar(f"CASE WHEN {n} IS NULL OR {m} IS NULL THEN CAST({wide} AS {WIDE}) ELSE CAST({narrow} AS DECIMAL(38,16)) END", "decimal")
    if op == "div":
        return _scalar(f"CAST(try_divide({x}, {y}) AS BIGINT)", "integer")
    rest = f"try_mod({x}, {y})"
    return _scalar(f"CAST({rest} AS BIGINT)", "integer") if whole else _scalar(rest, "decimal")


# --- functions -----------------------------------------------------------------------------------------

# Type names whose suffix isn't the name itself.
_PRIMITIVES = frozenset("integer string boolean decimal dateTime date time instant uri url canonical uuid oid id code markdown base64Binary positiveInt unsignedInt integer64".split())


def _suffix(type_name: str) -> str:
    return type_name[0].upper() + type_name[1:] if type_name in _PRIMITIVES else type_name


def _type_name(e: A.Expr) -> str:
    """The type that an argument names."""
    if isinstance(e, A.Member) and (e.base is None or isinstance(e.base, A.Member) and e.base.base is None and e.base.name in ("FHIR", "System")):
        return e.name
    if isinstance(e, A.Literal) and e.kind == "string":
        return str(e.value)
    raise FhirPathError("expected the name of a type")


def _of_type(operand: A.Expr, name: str, s: Scope) -> Value:
    """`x.value.ofType(Quantity)` is the member valueQuantity of x; resources are told by their resourceType.

    A member without a choice of types (`valueQuantity.value.ofType(decimal)`) is itself: documents have one or the other.
    """
    if isinstance(operand, A.Member):
        v, plain, x = _member(operand.base, operand.name + _suffix(name), s), _member(operand.base, operand.name, s).sql, N.fresh()
        if name in RESOURCE_TYPES:
            plain = f"filter({plain}, {x} -> try_variant_get({x}, '$.resourceType', 'string') = {literal(name)})"
        return replace(v, sql=f"concat({v.sql}, {plain})", hint=name)
    return replace(compile_expr(operand, s), hint=name)


def _subject(e: A.Call, s: Scope) -> Value:
    return compile_expr(e.base, s) if e.base is not None else Value(N.one(s.this), True, "variant")


def _arity(e: A.Call, least: int, most: int) -> None:
    if not least <= len(e.args) <= most:
        wanted = str(least) if least == most else f"{least} to {most}"
        raise FhirPathError(f"{e.name}() takes {wanted} argument{'s' * (most != 1)}, not {len(e.args)}")


def _per_element(v: Value, arg: A.Expr, s: Scope) -> tuple[str, str, Value]:
    """Lambda variables for an element of v and its index, and the argument's value there."""
    x, i = N.fresh(), N.fresh()
    this = x if v.type == "variant" else f"CAST({x} AS VARIANT)"
    return x, i, compile_expr(arg, s.element(this, i, f"size({collection(v)})"))


def _where(e: A.Call, s: Scope) -> Value:
    _arity(e, 1, 1)
    if e.base is None and s.at_root:
        return _scalar(boolean(compile_expr(e.args[0], s), s), "boolean")
    v = _subject(e, s)
    x, i, c = _per_element(v, e.args[0], s)
    return Value(f"filter({collection(v)}, ({x}, {i}) -> {boolean(c, s)})", True, v.type, v.hint)


def _exists(e: A.Call, s: Scope) -> Value:
    _arity(e, 0, 1)
    v = _subject(e, s)
    if not e.args:
        return v if not v.many and v.type == "boolean" else _scalar(f"(size({collection(v)}) > 0)", "boolean")
    x, i, c = _per_element(v, e.args[0], s)
    if i in c.sql:
        return _scalar(f"(size(filter({collection(v)}, ({x}, {i}) -> {boolean(c, s)})) > 0)", "boolean")
    return _scalar(f"coalesce(exists({collection(v)}, {x} -> {boolean(c, s)}), false)", "boolean")


def _empty(e: A.Call, s: Scope) -> Value:
    _arity(e, 0, 0)
    v = _subject(e, s)
    if not v.many and v.type == "boolean":
        return _scalar(f"(NOT {v.sql})", "boolean")
    return _scalar(f"(size({collection(v)}) = 0)", "boolean")


def _first(e: A.Call, s: Scope) -> Value:
    _arity(e, 0, 0)
    v = _subject(e, s)
    return replace(v, sql=f"slice({collection(v)}, 1, 1)", many=True)


def _last(e: A.Call, s: Scope) -> Value:
    _arity(e, 0, 0)
    v = _subject(e, s)
    c = collection(v)
    return replace(v, sql=f"slice({c}, greatest(size({c}), 1), 1)", many=True)


def _count(e: A.Call, s: Scope) -> Value:
    _arity(e, 0, 0)
    return _scalar(f"size({collection(_subject(e, s))})", "integer")


def _join(e: A.Call, s: Scope) -> Value:
    _arity(e, 0, 1)
    v = _subject(e, s)
    separator = text(compile_expr(e.args[0], s), s) if e.args else "''"
    return _scalar(f"CASE WHEN size({collection(v)}) > 0 THEN array_join({texts(v, s)}, {separator}) END", "string")


def _select(e: A.Call, s: Scope) -> Value:
    _arity(e, 1, 1)
    v = _subject(e, s)
    x, i, c = _per_element(v, e.args[0], s)
    if c.many:
        return Value(f"flatten(transform({collection(v)}, ({x}, {i}) -> {c.sql}))", True, c.type)
    return Value(f"array_compact(transform({collection(v)}, ({x}, {i}) -> {c.sql}))", True, c.type)


def _not(e: A.Call, s: Scope) -> Value:
    _arity(e, 0, 0)
    return _scalar(f"(NOT {boolean(_subject(e, s), s)})", "boolean")


def _extension(e: A.Call, s: Scope) -> Value:
    _arity(e, 1, 1)
    v, x = _subject(e, s), N.fresh()
    url = text(compile_expr(e.args[0], s), s)
    inner = N.member_of_one(s.this, "extension") if e.base is None else N.member_of_many(collection(v), "extension")
    return Value(f"filter({inner}, {x} -> try_variant_get({x}, '$.url', 'string') = {url})", True, "variant")


def _resource_key(e: A.Call, s: Scope) -> Value:
    _arity(e, 0, 0)
    return _scalar(f"concat({s.resource_type}, '/', {text(Value(N.member_of_one(s.root, 'id'), True, 'variant'), s)})", "string")


def _reference_key(e: A.Call, s: Scope) -> Value:
    _arity(e, 0, 1)
    v = _subject(e, s)
    inner = N.member_of_one(s.this, "reference") if e.base is None else N.member_of_many(collection(v), "reference")
    keys = Value(inner, True, "variant")
    if not e.args:
        return keys
    key = text(keys, s)
    return _scalar(f"CASE WHEN startswith({key}, {literal(_type_name(e.args[0]) + '/')}) THEN {key} END", "string")


def _boundary(e: A.Call, s: Scope) -> Value:
    high = e.name == "highBoundary"
    if e.args:
        raise FhirPathError(f"{e.name}() with a precision is not supported")
    v = _subject(e, s)
    kind = v.hint if v.hint is not None else {"decimal": "decimal", "integer": "decimal"}.get(v.type)
    t = text(v, s)
    if kind == "decimal":
        return _scalar(boundary.decimal_value(t, high), "decimal")
    if kind is None:
        marked = f"startswith(CAST({first(v)} AS STRING), '{N.NUMBER_MARK}')" if v.type == "variant" and s.lexemes else None
        return _scalar(boundary.by_lexeme(t, high, marked), "string")
    by_kind: dict[str, Callable[[str, bool], str]] = {"date": boundary.date, "dateTime": boundary.date_time, "instant": boundary.date_time, "time": boundary.time}
    if kind not in by_kind:
        raise FhirPathError(f"{e.name}() is not defined for type {kind}")
    return _scalar(by_kind[kind](t, high), "string")


def _of_type_call(e: A.Call, s: Scope) -> Value:
    _arity(e, 1, 1)
    return _of_type(e.base if e.base is not None else A.Variable("this"), _type_name(e.args[0]), s)


FUNCTIONS: dict[str, Callable[[A.Call, Scope], Value]] = {
    "where": _where, "exists": _exists, "empty": _empty, "first": _first, "last": _last, "count": _count, "join": _join, "select": _select,
    "ofType": _of_type_call, "not": _not, "extension": _extension, "getResourceKey": _resource_key, "getReferenceKey": _reference_key,
    "lowBoundary": _boundary, "highBoundary": _boundary,
}


def _call(e: A.Call, s: Scope) -> Value:
    if e.name not in FUNCTIONS:
        raise FhirPathError(f"Unsupported FHIRPath function: {e.name}")
    return FUNCTIONS[e.name](e, s)
