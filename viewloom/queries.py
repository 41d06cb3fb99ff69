"""Queries over the test data: a view over resources for each operator, and the same rows in SQL over the tables."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import ViewEngine
from .sources.sample import BUILDERS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_TAGGED = {"name": "ansi/type", "value": ""}
_CUSTOMER = "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_LINES = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus) - 1 AS i FROM lineitem)"
_TRIM_MONEY = "regexp_replace(regexp_replace(CAST(CAST(c_acctbal AS DECIMAL(18,2)) + 1234567890123.5 AS VARCHAR), '([.][0-9]*?)0+$', '\\1'), '[.]$', '')"
_MONEY = "CAST(CAST({} AS DECIMAL(18,2)) AS VARCHAR)"


#: Where the queries get the resources of a kind from.
_source: Callable[[str], Callable[[SparkSession, str], DataFrame]] = BUILDERS.__getitem__


def over(name: str, source: Callable[[str], Callable[[SparkSession, str], DataFrame]]) -> Query:
    """A query with its resources from another source."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        global _source
        before, _source = _source, source
        try:
            return QUERIES[name](spark, sf_dir)
        finally:
            _source = before

    return query


def col(name: str, path: str, kind: str | None = None, **more) -> dict:
    return {"name": name, "path": path, **({"type": kind} if kind else {}), **more}


def view(resource: str, *select: dict, where: tuple[str, ...] = (), constant: list[dict] | None = None) -> dict:
    out: dict = {"resourceType": "ViewDefinition", "resource": resource, "select": list(select)}
    if where:
        out["where"] = [{"path": p} for p in where]
    if constant:
        out["constant"] = constant
    return out


def cols(*columns: dict, **more) -> dict:
    return {"column": list(columns), **more}


def register(name: str, definition: dict, sql: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ViewEngine(spark).run(definition, _source(definition["resource"])(spark, sf_dir))

    QUERIES[name], SQL[name] = query, sql


ID = col("id", "id", "id")

# --- scans, projection, types, conditions ------------------------------------------------------------


def _all_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(DataFrame.unionByName, (_source(k)(spark, sf_dir) for k in BUILDERS))


def scan_filter_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    definition = view("Organization", cols(ID, col("key", "getResourceKey()"), col("name", "name")))
    return ViewEngine(spark).run(definition, _all_resources(spark, sf_dir))


QUERIES["scan_filter_type"] = scan_filter_type
SQL["scan_filter_type"] = "SELECT CAST(s_suppkey AS VARCHAR) AS id, 'Organization/' || s_suppkey AS key, s_name AS name FROM supplier"

register(
    "project_scalars",
    view("Patient", cols(ID, col("active", "active", "boolean"), col("gender", "gender", "code"), col("birth", "birthDate", "date"), col("balance", "balance", "decimal"))),
    f"SELECT CAST(c_custkey AS VARCHAR) AS id, c_acctbal > 0 AS active, CASE c_custkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' END AS gender, "
    f"CASE c_custkey % 3 WHEN 0 THEN '1970' WHEN 1 THEN '1970-02' ELSE '1970-02-15' END AS birth, {_MONEY.format('c_acctbal')} AS balance FROM customer",
)
register(
    "cast_types",
    view("Claim", cols(ID, col("status", "status", "code"), col("created", "created", "date"), col("n", "item.first().sequence", "integer"), col("big", "id", "integer64"), col("text", "total.currency"))),
    f"SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS status, strftime(o_orderdate, '%Y-%m-%d') AS created, "
    f"(SELECT min(l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey) AS n, o_orderkey AS big, 'USD' AS text FROM orders",
)
register(
    "tag_types",
    view(
        "Claim",
        cols(
            ID,
            col("total", "total.value", "decimal", tag=[{"name": "ansi/type", "value": "DECIMAL(18,2)"}]),
            col("created", "created", "date", tag=[{"name": "oracle/type", "value": "DATE"}]),
            col("number", "id", "string", tag=[{"name": "ansi/type", "value": "BIGINT"}]),
            col("approx", "total.value", "decimal", tag=[{"name": "spark/type", "value": "DOUBLE"}]),
        ),
    ),
    "SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_totalprice AS DECIMAL(18,2)) AS total, CAST(o_orderdate AS DATE) AS created, o_orderkey AS number, "
    "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS approx FROM orders",
)
register(
    "view_where",
    view("Claim", cols(ID, col("price", "total.value", "decimal")), where=("status = 'O'", "total.value > 100000")),
    f"SELECT CAST(o_orderkey AS VARCHAR) AS id, {_MONEY.format('o_totalprice')} AS price FROM orders WHERE o_orderstatus = 'O' AND CAST(o_totalprice AS DECIMAL(18,2)) > 100000",
)
register(
    "view_where_bool",
    view("Patient", cols(ID), where=("active", "deceased.ofType(boolean).not()")),
    "SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_acctbal > 0 AND c_custkey % 2 = 1 AND NOT c_custkey % 7 = 0",
)
register(
    "constants",
    view(
        "Patient", cols(ID, col("name", "name.where(use = %kind).family", "string"), col("k", "%number", "integer")), where=("birthDate = %born",),
        constant=[{"name": "kind", "valueCode": "usual"}, {"name": "number", "valueInteger": 7}, {"name": "born", "valueDate": "1970"}],
    ),
    "SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 2 = 0 THEN n_name END AS name, 7 AS k FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 = 0",
)

# --- iteration ---------------------------------------------------------------------------------------

_ITEM = [col("seq", "sequence", "integer"), col("part", "productOrService.coding[0].code", "code"), col("price", "net.value", "decimal")]
_ITEM_SQL = f"l_linenumber AS seq, 'P' || l_partkey AS part, {_MONEY.format('l_extendedprice')} AS price"

register(
    "foreach",
    view("Claim", cols(ID), cols(*_ITEM, forEach="item")),
    f"SELECT CAST(o_orderkey AS VARCHAR) AS id, {_ITEM_SQL} FROM orders JOIN lineitem ON l_orderkey = o_orderkey",
)
register(
    "foreach_or_null",
    view("Claim", cols(ID), cols(*_ITEM, forEachOrNull="item")),
    f"SELECT CAST(o_orderkey AS VARCHAR) AS id, {_ITEM_SQL} FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey",
)
register(
    "foreach_where",
    view("Claim", cols(ID), cols(*_ITEM, forEach="item.where(status = 'F' and net.value > 50000)")),
    f"SELECT CAST(o_orderkey AS VARCHAR) AS id, {_ITEM_SQL} FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linestatus = 'F' AND CAST(l_extendedprice AS DECIMAL(18,2)) > 50000",
)
register(
    "foreach_where_first",
    view("Claim", cols(ID), cols(*_ITEM, forEach="item.where(status = 'F').first()")),
    f"SELECT CAST(l_orderkey AS VARCHAR) AS id, {_ITEM_SQL} FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY i) AS k FROM {_LINES} WHERE l_linestatus = 'F') WHERE k = 1",
)
register(
    "foreach_index",
    view("Claim", cols(ID), cols(*_ITEM, forEach="item[1]")),
    f"SELECT CAST(l_orderkey AS VARCHAR) AS id, {_ITEM_SQL} FROM {_LINES} WHERE i = 1",
)
register(
    "foreach_nested",
    view("Claim", cols(ID), {"forEach": "item", "column": [col("seq", "sequence", "integer")], "select": [cols(col("code", "code", "code"), forEach="productOrService.coding")]}),
    "SELECT CAST(l_orderkey AS VARCHAR) AS id, l_linenumber AS seq, code FROM (SELECT l_orderkey, l_linenumber, unnest(['P' || l_partkey, l_returnflag]) AS code FROM lineitem)",
)
register(
    "foreach_siblings",
    view("Patient", cols(ID), cols(col("use", "use", "code"), forEach="name"), cols(col("value", "value", "string"), forEach="telecom")),
    "SELECT CAST(c_custkey AS VARCHAR) AS id, use, value FROM customer, (VALUES ('official'), ('usual')) u(use), (VALUES ('p'), ('e')) t(v), LATERAL (SELECT v || c_custkey AS value) "
    "WHERE (use = 'official' OR c_custkey % 2 = 0) AND c_custkey % 10 <> 0 AND (v = 'e' OR c_custkey % 4 <> 0)",
)
register(
    "foreach_multi_segment",
    view("Patient", cols(ID), cols(col("given", "$this", "string"), forEach="name.given")),
    "SELECT CAST(c_custkey AS VARCHAR) AS id, given FROM (SELECT c_custkey, unnest(CASE WHEN c_custkey % 2 = 0 THEN [c_mktsegment, n_name, c_mktsegment] ELSE [c_mktsegment, n_name] END) AS given "
    "FROM customer JOIN nation ON c_nationkey = n_nationkey)",
)
register(
    "row_index",
    view("Claim", cols(ID, col("root", "%rowIndex", "integer")), cols(col("i", "%rowIndex", "integer"), col("seq", "sequence", "integer"), forEachOrNull="item")),
    f"SELECT CAST(o_orderkey AS VARCHAR) AS id, 0 AS root, CAST(coalesce(i, 0) AS INTEGER) AS i, l_linenumber AS seq FROM orders LEFT JOIN {_LINES} ON l_orderkey = o_orderkey",
)
register(
    "row_index_nested",
    view("Claim", cols(ID), {"forEach": "item", "column": [col("i", "%rowIndex", "integer")], "select": [cols(col("j", "%rowIndex", "integer"), col("code", "code"), forEach="productOrService.coding")]}),
    f"SELECT CAST(l_orderkey AS VARCHAR) AS id, CAST(i AS INTEGER) AS i, j, CASE j WHEN 0 THEN 'P' || l_partkey ELSE l_returnflag END AS code FROM {_LINES}, (VALUES (0), (1)) v(j)",
)
register(
    "index_total",
    view("Claim", cols(ID, col("t0", "$total", "integer")), cols(col("i", "$index", "integer"), col("n", "$total", "integer"), col("seq", "sequence", "integer"), forEach="item")),
    f"SELECT CAST(l_orderkey AS VARCHAR) AS id, 1 AS t0, CAST(i AS INTEGER) AS i, CAST(count(*) OVER (PARTITION BY l_orderkey) AS INTEGER) AS n, l_linenumber AS seq FROM {_LINES}",
)
register(
    "this_scalar",
    view("Patient", cols(ID), {"forEach": "name", "select": [cols(col("given", "$this", "string"), col("same", "$this = %segment", "boolean"), forEach="given")]}, constant=[{"name": "segment", "valueString": "BUILDING"}]),
    "SELECT CAST(c_custkey AS VARCHAR) AS id, given, given = 'BUILDING' AS same FROM (SELECT c_custkey, unnest(CASE WHEN c_custkey % 2 = 0 THEN [c_mktsegment, n_name, c_mktsegment] ELSE [c_mktsegment, n_name] END) AS given "
    "FROM customer JOIN nation ON c_nationkey = n_nationkey)",
)

register(
    "foreach_where_false",
    view("Patient", cols(ID), cols(col("use", "use", "code"), forEachOrNull="name.where(false)")),
    "SELECT CAST(c_custkey AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS use FROM customer",
)

# --- unions ------------------------------------------------------------------------------------------

_PHONES = (
    "SELECT c_custkey, 'p' || c_custkey AS value FROM customer WHERE c_custkey % 10 <> 0 AND c_custkey % 4 <> 0 UNION ALL SELECT c_custkey, 'e' || c_custkey FROM customer WHERE c_custkey % 10 <> 0"
)
_CONTACTS = "SELECT c_custkey, 'c' || c_custkey AS value FROM customer WHERE c_custkey % 3 = 0"
_BRANCHES = [cols(col("value", "value", "string"), forEach="telecom"), cols(col("value", "value", "string"), forEach="contact.telecom")]

register("union_all", view("Patient", cols(ID), {"unionAll": _BRANCHES}), f"SELECT CAST(c_custkey AS VARCHAR) AS id, value FROM ({_PHONES} UNION ALL {_CONTACTS})")
register(
    "union_all_nested",
    view("Patient", cols(ID), {"unionAll": [{"unionAll": _BRANCHES}, cols(col("value", "birthDate", "string"))]}),
    f"SELECT CAST(c_custkey AS VARCHAR) AS id, value FROM ({_PHONES} UNION ALL {_CONTACTS} UNION ALL "
    "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '1970' WHEN 1 THEN '1970-02' ELSE '1970-02-15' END FROM customer)",
)
register(
    "union_all_siblings",
    view("Patient", cols(ID), cols(col("use", "use", "code"), forEach="name"), {"unionAll": _BRANCHES}),
    f"SELECT CAST(c_custkey AS VARCHAR) AS id, use, value FROM ({_PHONES} UNION ALL {_CONTACTS}), (VALUES ('official'), ('usual')) u(use) WHERE use = 'official' OR c_custkey % 2 = 0",
)
register(
    "union_all_in_foreach",
    view("Claim", cols(ID), {"forEach": "item", "column": [col("seq", "sequence", "integer")], "unionAll": [cols(col("kind", "'price'"), col("v", "net.value", "decimal")), cols(col("kind", "'quantity'"), col("v", "quantity.value", "decimal"))]}),
    f"SELECT CAST(l_orderkey AS VARCHAR) AS id, l_linenumber AS seq, 'price' AS kind, {_MONEY.format('l_extendedprice')} AS v FROM lineitem UNION ALL "
    f"SELECT CAST(l_orderkey AS VARCHAR), l_linenumber, 'quantity', {_MONEY.format('l_quantity')} FROM lineitem",
)
register(
    "union_all_twice",
    view("Patient", cols(ID), {"unionAll": _BRANCHES}, {"unionAll": [cols(col("w", "gender")), cols(col("w", "birthDate"))]}, where=("active",)),
    f"SELECT CAST(p.c_custkey AS VARCHAR) AS id, value, w FROM ({_PHONES} UNION ALL {_CONTACTS}) p JOIN (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' END AS w FROM customer UNION ALL "
    "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '1970' WHEN 1 THEN '1970-02' ELSE '1970-02-15' END FROM customer) q ON p.c_custkey = q.c_custkey JOIN customer c ON c.c_custkey = p.c_custkey WHERE c_acctbal > 0",
)

# --- repeat ------------------------------------------------------------------------------------------

_TREE = (
    "SELECT r_regionkey, lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS n, '' AS s, 'N' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS link, n_name AS label FROM region JOIN nation ON n_regionkey = r_regionkey "
    "UNION ALL SELECT n_regionkey, lpad(CAST(n_nationkey AS VARCHAR), 3, '0'), 'S' || s_suppkey, 'S' || s_suppkey, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey"
)
register("repeat_simple", view("Questionnaire", cols(ID), cols(col("link", "linkId", "string"), col("label", "text", "string"), repeat=["item"])), f"SELECT CAST(r_regionkey AS VARCHAR) AS id, link, label FROM ({_TREE})")
register(
    "repeat_row_index",
    view("Questionnaire", cols(ID), cols(col("link", "linkId", "string"), col("i", "%rowIndex", "integer"), repeat=["item"])),
    f"SELECT CAST(r_regionkey AS VARCHAR) AS id, link, CAST(row_number() OVER (PARTITION BY r_regionkey ORDER BY n, s) - 1 AS INTEGER) AS i FROM ({_TREE})",
)
register(
    "repeat_multi_path",
    view("Patient", cols(ID), cols(col("url", "url", "uri"), col("s", "value.ofType(string)", "string"), repeat=["extension", "contact.telecom"])),
    "SELECT CAST(c_custkey AS VARCHAR) AS id, url, s FROM (SELECT c_custkey, 'urn:nation' AS url, n_name AS s FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT c_custkey, 'urn:region', NULL FROM customer "
    "UNION ALL SELECT c_custkey, 'code', NULL FROM customer "
    f"UNION ALL SELECT c_custkey, 'name', r_name FROM {_CUSTOMER} UNION ALL SELECT c_custkey, NULL, 'c' || c_custkey FROM customer WHERE c_custkey % 3 = 0)",
)
register(
    "repeat_nested",
    view("Questionnaire", cols(ID), {"repeat": ["item"], "column": [col("link", "linkId", "string")], "select": [cols(col("below", "linkId", "string"), repeat=["item"])]}),
    "SELECT CAST(n_regionkey AS VARCHAR) AS id, 'N' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS link, 'S' || s_suppkey AS below FROM supplier JOIN nation ON s_nationkey = n_nationkey",
)
register(
    "repeat_foreach",
    view("Questionnaire", cols(ID), {"repeat": ["item"], "column": [col("link", "linkId", "string")], "select": [cols(col("below", "linkId", "string"), col("j", "%rowIndex", "integer"), forEachOrNull="item")]}),
    "SELECT CAST(n_regionkey AS VARCHAR) AS id, 'N' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS link, 'S' || s_suppkey AS below, "
    "CAST(CASE WHEN s_suppkey IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY n_nationkey ORDER BY 'S' || s_suppkey, s_name) - 1 END AS INTEGER) AS j FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey "
    "UNION ALL SELECT CAST(n_regionkey AS VARCHAR), 'S' || s_suppkey, NULL, 0 FROM supplier JOIN nation ON s_nationkey = n_nationkey",
)
register(
    "repeat_union",
    view("Questionnaire", cols(ID), {"repeat": ["item"], "unionAll": [cols(col("v", "linkId")), cols(col("v", "text"))]}),
    f"SELECT CAST(r_regionkey AS VARCHAR) AS id, link AS v FROM ({_TREE}) UNION ALL SELECT CAST(r_regionkey AS VARCHAR), label FROM ({_TREE})",
)

register(
    "repeat_twice",
    view("Questionnaire", cols(ID), cols(col("a", "linkId", "string"), repeat=["item"]), cols(col("b", "linkId", "string"), repeat=["item"])),
    f"SELECT CAST(x.r_regionkey AS VARCHAR) AS id, x.link AS a, y.link AS b FROM ({_TREE}) x JOIN ({_TREE}) y ON x.r_regionkey = y.r_regionkey",
)

# --- functions ---------------------------------------------------------------------------------------


def _patient(name: str, path: str, kind: str | None, sql: str) -> None:
    register(name, view("Patient", cols(ID, col("v", path, kind))), f"SELECT CAST(c_custkey AS VARCHAR) AS id, {sql} AS v FROM {_CUSTOMER}")


_patient("fn_where", "name.where(use = 'usual').family", "string", "CASE WHEN c_custkey % 2 = 0 THEN n_name END")
_patient("fn_exists", "telecom.exists()", "boolean", "c_custkey % 10 <> 0")
_patient("fn_exists_criteria", "telecom.exists(system = 'phone')", "boolean", "c_custkey % 10 <> 0 AND c_custkey % 4 <> 0")
_patient("fn_empty", "contact.empty()", "boolean", "c_custkey % 3 <> 0")
_patient("fn_first", "name.given.first()", "string", "c_mktsegment")
_patient("fn_last", "name.family.last()", "string", "CASE WHEN c_custkey % 2 = 0 THEN n_name ELSE c_name END")
_patient("fn_count", "name.given.count()", "integer", "CASE WHEN c_custkey % 2 = 0 THEN 3 ELSE 2 END")
_patient("fn_join", "name.given.join('|')", "string", "c_mktsegment || '|' || n_name || CASE WHEN c_custkey % 2 = 0 THEN '|' || c_mktsegment ELSE '' END")
_patient("fn_select", "name.select(use & ':' & family).join(',')", "string", "'official:' || c_name || CASE WHEN c_custkey % 2 = 0 THEN ',usual:' || n_name ELSE '' END")
_patient("fn_oftype", "multipleBirth.ofType(integer)", "integer", "CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey % 5 AS INTEGER) END")
_patient("fn_not", "active.not()", "boolean", "NOT c_acctbal > 0")
_patient("fn_extension", "extension('urn:region').extension('name').value.ofType(string)", "string", "r_name")
_patient("fn_resource_key", "getResourceKey()", "string", "'Patient/' || c_custkey")
_patient("fn_reference_key", "managingOrganization.getReferenceKey(Organization)", "string", "'Organization/' || c_nationkey")
_patient("fn_reference_key_other", "managingOrganization.getReferenceKey(Patient)", "string", "CAST(NULL AS VARCHAR)")
_patient("indexer", "name[1].given[0]", "string", "CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END")
register(
    "collection_column",
    view("Patient", cols(ID, col("given", "name.given", "string", collection=True), col("phones", "telecom.where(system = 'phone').value", "string", collection=True))),
    "SELECT CAST(c_custkey AS VARCHAR) AS id, '[\"' || c_mktsegment || '\",\"' || n_name || '\"' || CASE WHEN c_custkey % 2 = 0 THEN ',\"' || c_mktsegment || '\"' ELSE '' END || ']' AS given, "
    "CASE WHEN c_custkey % 10 <> 0 AND c_custkey % 4 <> 0 THEN '[\"p' || c_custkey || '\"]' ELSE '[]' END AS phones FROM customer JOIN nation ON c_nationkey = n_nationkey",
)


def key_join_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views joined on resource key and reference key: spending by segment and region."""
    engine = ViewEngine(spark)
    claims = engine.run(view("Claim", cols(col("patient", "patient.getReferenceKey(Patient)"), col("total", "total.value", tag=[{"name": "ansi/type", "value": "DECIMAL(18,2)"}]))), _source("Claim")(spark, sf_dir))
    patients = engine.run(
        view("Patient", cols(col("key", "getResourceKey()"), col("segment", "name.first().given.first()"), col("region", "extension('urn:region').extension('name').value.ofType(string)"))), _source("Patient")(spark, sf_dir)
    )
    # Both sides grow with the data, and their sizes are guessed from compressed files: neither may be broadcast.
    return claims.join(patients.hint("merge"), claims["patient"] == patients["key"]).groupBy("segment", "region").agg(F.count(F.lit(1)).alias("n"), F.sum("total").cast("decimal(28,2)").alias("total"))


QUERIES["key_join_views"] = key_join_views
SQL["key_join_views"] = (
    f"SELECT c_mktsegment AS segment, r_name AS region, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total FROM orders JOIN customer ON c_custkey = o_custkey "
    "JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2"
)

# --- boundaries --------------------------------------------------------------------------------------

_VALUE = "CAST(value AS DECIMAL(18,3))"
_TRIM = "regexp_replace(regexp_replace(CAST({} AS VARCHAR), '([.][0-9]*?)0+$', '\\1'), '[.]$', '')"


def _bound(high: bool) -> tuple[dict, str]:
    f, day, clock = ("highBoundary", "1970-12-31", "59.999") if high else ("lowBoundary", "1970-01-01", "00.000")
    definition = view("Observation", cols(
        ID, col("d", f"value.ofType(Quantity).value.ofType(decimal).{f}()", "decimal"), col("dt", f"effective.ofType(dateTime).{f}()", "dateTime"),
        col("day", f"@1970.{f}()", "date"),
    ))
    zone = "-12:00" if high else "+14:00"
    sql = (
        f"SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 3 = 0 THEN {_TRIM.format(f'{_VALUE} ' + ('+' if high else '-') + ' 0.0005')} END AS d, "
        f"strftime(ts, '%Y-%m-%dT%H:%M') || ':{clock}{zone}' AS dt, '{day}' AS day FROM events"
    )
    return definition, sql


register("low_boundary", *_bound(False))
register("high_boundary", *_bound(True))
register(
    "date_boundary",
    view("Patient", cols(ID, col("lo", "birthDate.lowBoundary()", "date"), col("hi", "birthDate.highBoundary()", "date"))),
    "SELECT CAST(c_custkey AS VARCHAR) AS id, CASE c_custkey % 3 WHEN 0 THEN '1970-01-01' WHEN 1 THEN '1970-02-01' ELSE '1970-02-15' END AS lo, "
    "CASE c_custkey % 3 WHEN 0 THEN '1970-12-31' WHEN 1 THEN '1970-02-28' ELSE '1970-02-15' END AS hi FROM customer",
)
register(
    "time_boundary",
    view("Observation", cols(ID, col("lo", "clock.lowBoundary()", "time"), col("hi", "clock.highBoundary()", "time"))),
    "SELECT CAST(event_id AS VARCHAR) AS id, strftime(ts, '%H:%M:%S') || '.000' AS lo, strftime(ts, '%H:%M:%S') || '.999' AS hi FROM events",
)

# --- operators ---------------------------------------------------------------------------------------

_DEC = {"tag": [{"name": "ansi/type", "value": "DECIMAL(30,4)"}]}
register(
    "op_arith",
    view("Claim", cols(ID), cols(col("p", "net.value * quantity.value", "decimal", **_DEC), col("s", "net.value + 1.5", "decimal", **_DEC), col("m", "quantity.value - sequence", "decimal", **_DEC), col("neg", "-quantity.value", "decimal", **_DEC), col("seq", "sequence", "integer"), forEach="item")),
    "SELECT CAST(l_orderkey AS VARCHAR) AS id, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_quantity AS DECIMAL(18,2)) AS DECIMAL(30,4)) AS p, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) + 1.5 AS DECIMAL(30,4)) AS s, "
    "CAST(CAST(l_quantity AS DECIMAL(18,2)) - l_linenumber AS DECIMAL(30,4)) AS m, CAST(-CAST(l_quantity AS DECIMAL(18,2)) AS DECIMAL(30,4)) AS neg, l_linenumber AS seq FROM lineitem",
)
register(
    "op_div_mod",
    view("Claim", cols(ID), cols(col("d", "quantity.value div 7", "integer"), col("m", "quantity.value mod 7", "decimal", **_DEC), col("z", "quantity.value / 0", "decimal"), col("seq", "sequence", "integer"), forEach="item")),
    "SELECT CAST(l_orderkey AS VARCHAR) AS id, CAST(trunc(CAST(l_quantity AS DECIMAL(18,2)) / 7) AS INTEGER) AS d, CAST(CAST(l_quantity AS DECIMAL(18,2)) % 7 AS DECIMAL(30,4)) AS m, CAST(NULL AS VARCHAR) AS z, l_linenumber AS seq FROM lineitem",
)
_patient("op_concat", "gender & '/' & name.first().family", "string", "coalesce(CASE c_custkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' END, '') || '/' || c_name")
_patient("op_equality", "gender = 'male'", "boolean", "CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END")
_patient("literal_boolean", "active = true", "boolean", "c_acctbal > 0")
_patient("literal_empty", "({}).exists()", "boolean", "false")
_patient("delimited_name", "`gender` = 'male'", "boolean", "CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END")
_patient("constant_resource", "%resource.gender", "string", "CASE c_custkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' END")
_patient("root_where", "where(gender = 'male')", "boolean", "CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END")
_patient("op_equivalence", "gender ~ 'male'", "boolean", "CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END")
_patient("op_not_equivalent", "gender !~ 'male'", "boolean", "CASE c_custkey % 3 WHEN 0 THEN false WHEN 1 THEN true END")
_patient("literal_quantity", "balance > 5000 'USD'", "boolean", "CAST(c_acctbal AS DECIMAL(18,2)) > 5000")
_patient("literal_long", "multipleBirth.ofType(integer) * 5000000000L", "integer64", "CASE WHEN c_custkey % 2 = 0 THEN (c_custkey % 5) * 5000000000 END")
_patient("literal_dates", "birthDate >= @1970-02", "boolean", "c_custkey % 3 <> 0")
_patient("op_equality_of_collections", "name.use = 'official'", "boolean", "c_custkey % 2 <> 0")
_patient("op_arith_large", "balance + 1234567890123.5", "string", _TRIM_MONEY)
_patient("op_inequality", "gender != 'male'", "boolean", "CASE c_custkey % 3 WHEN 0 THEN false WHEN 1 THEN true END")
_patient("op_compare", "balance >= 5000.5", "boolean", "CAST(c_acctbal AS DECIMAL(18,2)) >= 5000.5")
_patient("op_logic", "active and gender = 'male' or multipleBirth.ofType(integer) > 2", "boolean", "(c_acctbal > 0 AND CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END) OR CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 5 > 2 END")
_patient("op_xor_implies", "(active xor contact.exists()) and (active implies telecom.exists())", "boolean", "((c_acctbal > 0) <> (c_custkey % 3 = 0)) AND ((NOT c_acctbal > 0) OR c_custkey % 10 <> 0)")
_patient("op_union", "(gender | birthDate).first()", "string", "coalesce(CASE c_custkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' END, '1970-02-15')")
_patient("op_membership", "'usual' in name.use", "boolean", "c_custkey % 2 = 0")
_patient("op_contains", "name.use contains 'usual'", "boolean", "c_custkey % 2 = 0")
register(
    "op_is_as",
    view("Observation", cols(ID, col("q", "value is Quantity", "boolean"), col("s", "value as string", "string"), col("n", "(value as integer)", "integer"))),
    "SELECT CAST(event_id AS VARCHAR) AS id, event_id % 3 = 0 AS q, CASE WHEN event_id % 3 = 1 THEN event_type END AS s, CASE WHEN event_id % 3 = 2 THEN CAST(user_id AS INTEGER) END AS n FROM events",
)

# --- other resources ---------------------------------------------------------------------------------

register(
    "long_strings",
    view("DocumentReference", cols(ID, col("text", "content.attachment.data", "string")), cols(col("quality", "quality", "integer"), col("toxic", "toxic", "integer"), forEachOrNull="category")),
    "SELECT CAST(d.doc_id AS VARCHAR) AS id, text, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
)


def turns_by_sender(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = ViewEngine(spark).run(view("Communication", cols(col("conversation", "subject.getReferenceKey()"), col("sender", "sender.getReferenceKey(Practitioner)")), where=("payload.content.ofType(string).exists()",)), _source("Communication")(spark, sf_dir))
    return turns.groupBy("conversation", "sender").agg(F.count(F.lit(1)).alias("n"))


QUERIES["turns_by_sender"] = turns_by_sender
SQL["turns_by_sender"] = "SELECT 'Group/' || conv_id AS conversation, 'Practitioner/' || role AS sender, count(*) AS n FROM conversations WHERE text IS NOT NULL GROUP BY 1, 2"

# --- load and export ---------------------------------------------------------------------------------


def load_export_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resources of all kinds in a partitioned table, exported by all tasks, and read back by type."""
    from .sources.export import export_dataset, reread
    from .sources.table import ResourceTable

    folder = f"{shared_folder(spark)}/roundtrip-{uuid.uuid4().hex}"
    table = ResourceTable(spark, f"{folder}/table")
    table.append(_all_resources(spark, sf_dir))
    export_dataset(table.read(), f"{folder}/export")
    return reread(spark, f"{folder}/export").groupBy("resource_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.get_json_object("json", "$.id")).alias("ids"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from the session; one of this machine only where none is set and all is one JVM."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir is not set: on {master} a folder is needed that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="viewloom-")
    return where.rstrip("/")


QUERIES["load_export_roundtrip"] = load_export_roundtrip
#: Kind, key and table of the documents that BUILDERS make.
_KINDS = [
    ("Patient", "c_custkey", "customer"), ("Organization", "s_suppkey", "supplier"), ("Claim", "o_orderkey", "orders"), ("Observation", "event_id", "events"),
    ("Communication", "conv_id || '-' || turn", "conversations"), ("Questionnaire", "r_regionkey", "region"), ("DocumentReference", "d.doc_id", "documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
]
SQL["load_export_roundtrip"] = " UNION ALL ".join(f"SELECT '{kind}' AS resource_type, count(*) AS n, count(DISTINCT {key}) AS ids FROM {table}" for kind, key, table in _KINDS)


def ndjson_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resources of all kinds, exported to one NDJSON file for each kind, loaded from these files into a new table, and compared line by line."""
    from .sources.export import export_ndjson
    from .sources.load import load_ndjson
    from .sources.table import ResourceTable

    folder = f"{shared_folder(spark)}/ndjson-{uuid.uuid4().hex}"
    table = ResourceTable(spark, f"{folder}/table")
    for kind in BUILDERS:
        table.append(_source(kind)(spark, sf_dir))
    export_ndjson(table.read(), f"{folder}/files".removeprefix("file://"))
    load_ndjson(spark, f"{folder}/files", f"{folder}/loaded")
    line = F.sha2("json", 256).alias("line")
    before = table.read().select("resource_type", line).distinct().withColumn("same", F.lit(1))
    after = ResourceTable(spark, f"{folder}/loaded").read().select("resource_type", line, F.get_json_object("json", "$.id").alias("key"))
    both = after.join(before, ["resource_type", "line"], "left")
    return both.groupBy("resource_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("ids"), F.count("same").alias("same"))


QUERIES["ndjson_roundtrip"] = ndjson_roundtrip
SQL["ndjson_roundtrip"] = " UNION ALL ".join(f"SELECT '{kind}' AS resource_type, count(*) AS n, count(DISTINCT {key}) AS ids, count(*) AS same FROM {table}" for kind, key, table in _KINDS)


def _exported(spark: SparkSession, *resources: DataFrame) -> str:
    """A new folder whose `files` are the NDJSON files of the resources."""
    from .sources.export import export_ndjson

    folder = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    for r in resources:
        export_ndjson(r, f"{folder}/files".removeprefix("file://"))
    return folder


def _with_bad_lines(spark: SparkSession, sf_dir: str) -> str:
    """Files of patients, a tenth of whose lines lack the last brace, and of organizations, whose lines are all good."""
    patients = _source("Patient")(spark, sf_dir)
    cut = F.expr("left(json, length(json) - 1)")
    return _exported(spark, patients.withColumn("json", F.when(F.get_json_object("json", "$.id").cast("long") % 10 == 0, cut).otherwise(F.col("json"))), _source("Organization")(spark, sf_dir))


def _by_type(spark: SparkSession, path: str) -> DataFrame:
    from .sources.table import ResourceTable

    return ResourceTable(spark, path).read().groupBy("resource_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"))


def _made(spark: SparkSession, folder: str, rows: list, schema: str) -> DataFrame:
    """The few rows of a report, whose files are no longer needed."""
    from .sources.files import Files

    Files(spark).delete(folder)
    return spark.createDataFrame(rows, schema)


def load_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with bad lines, of which the good ones are loaded: what the load reports, and the rows that are there."""
    from .sources.load import load_ndjson

    folder = _with_bad_lines(spark, sf_dir)
    done = load_ndjson(spark, f"{folder}/files", f"{folder}/table", continue_on_error=True)
    there = {r["resource_type"]: (r["n"], r["ids"]) for r in _by_type(spark, f"{folder}/table").collect()}
    rows = [(f.resource_type, f.rows_loaded, f.rows_failed, len(f.errors), done.failed, *there[f.resource_type]) for f in done.files]
    return _made(spark, folder, rows, "resource_type string, loaded long, bad long, errors int, failed boolean, n long, ids long")


QUERIES["load_salvage"] = load_salvage
SQL["load_salvage"] = (
    "SELECT 'Patient' AS resource_type, count_if(c_custkey % 10 <> 0) AS loaded, count_if(c_custkey % 10 = 0) AS bad, CAST(1 AS INTEGER) AS errors, true AS failed, count_if(c_custkey % 10 <> 0) AS n, count_if(c_custkey % 10 <> 0) AS ids FROM customer "
    "UNION ALL SELECT 'Organization', count(*), 0, 0, true, count(*), count(*) FROM supplier"
)


def load_whole_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without salvage, a file with a bad line is left out as a whole."""
    from .sources.load import load_ndjson

    folder = _with_bad_lines(spark, sf_dir)
    load_ndjson(spark, f"{folder}/files", f"{folder}/table")
    return _made(spark, folder, _by_type(spark, f"{folder}/table").collect(), "resource_type string, n long, ids long")


QUERIES["load_whole_files"] = load_whole_files
SQL["load_whole_files"] = "SELECT 'Organization' AS resource_type, count(*) AS n, count(*) AS ids FROM supplier"


def load_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load into a new table, a second one that appends, and one that truncates first; before them a dry run, which writes nothing."""
    from .sources.load import load_ndjson
    from .sources.table import ResourceTable

    folder = _exported(spark, _source("Organization")(spark, sf_dir), _source("Questionnaire")(spark, sf_dir))
    files, table = f"{folder}/files", f"{folder}/table"
    dry = load_ndjson(spark, files, table, dry_run=True)
    rows = [("dry run", f.resource_type, f.rows_loaded) for f in dry.files if not ResourceTable(spark, table).exists()]
    for step, options in [("new", {}), ("append", {"create_table": False}), ("one type", {"resource_type": "Organization"}), ("truncate", {"truncate": True})]:
        load_ndjson(spark, files, table, **options)
        rows += [(step, r["resource_type"], r["ids"]) for r in _by_type(spark, table).collect()]
    return _made(spark, folder, rows, "step string, resource_type string, n long")


QUERIES["load_again"] = load_again
SQL["load_again"] = " UNION ALL ".join(
    f"SELECT '{step}' AS step, '{kind}' AS resource_type, {times} * count(*) AS n FROM {table}"
    for kind, table, counts in [("Organization", "supplier", (1, 1, 2, 3, 1)), ("Questionnaire", "region", (1, 1, 2, 2, 1))]
    for step, times in zip(("dry run", "new", "append", "one type", "truncate"), counts)
)


def load_into_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load as VARIANT; a later load as STRING warns and keeps the table's type. The table's types are listed, and a view runs over it."""
    from .sources.export import resource_types
    from .sources.load import load_ndjson
    from .sources.table import ResourceTable

    folder = _exported(spark, _source("Organization")(spark, sf_dir))
    table = ResourceTable(spark, f"{folder}/table")
    load_ndjson(spark, f"{folder}/files", table.path, json_data_type="JSON")
    warnings = load_ndjson(spark, f"{folder}/files", table.path, json_data_type="STRING").warnings
    rows = ViewEngine(spark).run(view("Organization", cols(ID, col("city", "address.city"))), table.read())
    return rows.select("id", "city", F.lit(table.json_type()).alias("type"), F.lit(len(warnings)).alias("warnings"), F.lit(",".join(resource_types(table.read()))).alias("types"))


QUERIES["load_into_variant"] = load_into_variant
SQL["load_into_variant"] = (
    "SELECT CAST(s_suppkey AS VARCHAR) AS id, n_name AS city, 'VARIANT' AS type, CAST(1 AS INTEGER) AS warnings, 'Organization' AS types FROM supplier JOIN nation ON s_nationkey = n_nationkey, (VALUES (1), (2)) v(i)"
)


def export_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exported files' lines, numbered as they stand there: in order of the table's ids, each once, the last one ended too."""
    folder = _exported(spark, _all_resources(spark, sf_dir).filter(F.col("resource_type").isin("Organization", "Patient")))
    rows = []
    for kind in ("Organization", "Patient"):
        with open(f"{folder}/files/{kind}.ndjson".removeprefix("file://"), encoding="utf-8", newline="") as f:
            last, n, ordered = -1, 0, True
            for line in f:  # one line at a time
                at = int(json.loads(line)["id"])
                last, n, ordered = at, n + 1, ordered and at > last and line.endswith("}\n")
            rows.append((kind, n, last, ordered))
    return _made(spark, folder, rows, "resource_type string, n long, last_id long, ordered boolean")


QUERIES["export_order"] = export_order
SQL["export_order"] = "SELECT 'Patient' AS resource_type, count(*) AS n, max(c_custkey) AS last_id, true AS ordered FROM customer UNION ALL SELECT 'Organization', count(*), max(s_suppkey), true FROM supplier"


def streamed_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view over a stream of NDJSON files, written as it comes and read back."""
    from .streaming import ndjson_stream, stream_view

    folder = _exported(spark, _source("Patient")(spark, sf_dir), _source("Organization")(spark, sf_dir))
    rows = stream_view(ndjson_stream(spark, f"{folder}/files"), view("Patient", cols(ID), cols(col("use", "use", "code"), col("family", "family"), forEach="name")))
    run = rows.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{folder}/rows")


QUERIES["streamed_view"] = streamed_view
SQL["streamed_view"] = (
    "SELECT CAST(c_custkey AS VARCHAR) AS id, use, CASE use WHEN 'official' THEN c_name ELSE n_name END AS family FROM customer JOIN nation ON c_nationkey = n_nationkey, (VALUES ('official'), ('usual')) u(use) "
    "WHERE use = 'official' OR c_custkey % 2 = 0"
)


def filter_by_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table shared by several tests: a view sees one test's resources only."""
    resources = _source("Patient")(spark, sf_dir).withColumn("test_id", F.concat(F.lit("test-"), F.col("id") % 4))
    return ViewEngine(spark).run(view("Patient", cols(ID, col("gender", "gender", "code"))), resources, test_id="test-1")


QUERIES["filter_by_test"] = filter_by_test
SQL["filter_by_test"] = "SELECT CAST(c_custkey AS VARCHAR) AS id, CASE c_custkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' END AS gender FROM customer WHERE c_custkey % 4 = 1"

# Paths and table names that must be errors, not columns of no values.
_REJECTED = ["birthDate.lowBoundary(4)", "birthDate.highBoundary(4)", "name.repeat(given)", "%unknown", "gender.", "where(", "name.first(1)", "'open"]


def rejected_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that aren't supported, or no paths at all, are errors before anything runs."""
    from .errors import FhirPathError

    rows = []
    for path in _REJECTED:
        try:
            ViewEngine(spark).transpile(view("Patient", cols(col("v", path))))
            rows.append((path, False))
        except FhirPathError:
            rows.append((path, True))
    return spark.createDataFrame(rows, "path string, rejected boolean")


QUERIES["rejected_paths"] = rejected_paths
SQL["rejected_paths"] = " UNION ALL ".join("SELECT '{}' AS path, true AS rejected".format(path.replace("'", "''")) for path in _REJECTED)


def variant_storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same view over a VARIANT column."""
    resources = _source("Claim")(spark, sf_dir).withColumn("json", F.parse_json("json"))
    return ViewEngine(spark).run(view("Claim", cols(ID), cols(col("seq", "sequence", "integer"), col("flag", "productOrService.coding[1].code"), forEach="item")), resources)


QUERIES["variant_storage"] = variant_storage
SQL["variant_storage"] = "SELECT CAST(l_orderkey AS VARCHAR) AS id, l_linenumber AS seq, l_returnflag AS flag FROM lineitem"
