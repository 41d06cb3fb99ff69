"""Views: the suite files, types and metadata, plans, API."""

from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from viewloom.api import Options, ViewEngine, storage_type
from viewloom.errors import FhirPathError, IdentifierError, ViewDefinitionError
from viewloom.model import parse_view
from viewloom.suite import run_suite, same_rows

SUITES = sorted((Path(__file__).parent / "suites").glob("*.json"))
SIMPLE = {"resourceType": "ViewDefinition", "resource": "Patient", "select": [{"column": [{"name": "id", "path": "id", "type": "id"}]}]}


@pytest.mark.parametrize("path", SUITES, ids=[p.stem for p in SUITES])
def test_suite(spark, path):
    failed = [f"{o.test}: {o.message[:300]}" for o in run_suite(spark, str(path)) if not o.passed]
    assert not failed


def _patients(spark, *docs):
    rows = [(i, "Patient", d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, "id long, resource_type string, json string")


def _one(spark, doc, *columns):
    view = {"resource": "Patient", "select": [{"column": list(columns)}]}
    return ViewEngine(spark).run(view, _patients(spark, doc)).first().asDict()


def test_types_and_metadata(spark):
    columns = [
        {"name": "a", "path": "a", "type": "boolean"}, {"name": "b", "path": "b", "type": "integer"}, {"name": "c", "path": "c", "type": "integer64"},
        {"name": "d", "path": "d", "type": "decimal"}, {"name": "e", "path": "e", "type": "date"}, {"name": "f", "path": "f"},
        {"name": "g", "path": "d", "type": "decimal", "tag": [{"name": "ansi/type", "value": "DECIMAL(10,2)"}]},
        {"name": "h", "path": "b", "tag": [{"name": "oracle/type", "value": "NUMBER(19)"}, {"name": "ansi/type", "value": "DATE"}]},
        {"name": "i", "path": "e", "tag": [{"name": "ansi/type", "value": "DATE"}], "description": "a day"},
        {"name": "j", "path": "b", "tag": [{"name": "ansi/type", "value": "INTEGER(5)"}]},
    ]
    view = {"resource": "Patient", "select": [{"column": columns}]}
    info = ViewEngine().transpile(view).columns
    kinds = ["BOOLEAN", "INT", "BIGINT", "STRING", "STRING", "STRING", "DECIMAL(10,2)", "DECIMAL(19,0)", "DATE", "INT"]
    assert [c.type for c in info] == kinds and info[8].description == "a day" and all(c.nullable for c in info)
    df = ViewEngine(spark).run(view, _patients(spark, '{"a":true,"b":7,"c":12345678901,"d":1.50,"e":"2020-01-02T03","f":"x"}'))
    assert [d for _, d in df.dtypes] == ["boolean", "int", "bigint", "string", "string", "string", "decimal(10,2)", "decimal(19,0)", "date", "int"]
    row = df.first()
    assert row["d"] == "1.50" and row["e"] == "2020-01-02" and str(row["g"]) == "1.50" and str(row["i"]) == "2020-01-02" and row["c"] == 12345678901


def test_values_of_other_types_are_null(spark):
    row = _one(spark, {"a": "x", "b": "y", "c": None}, {"name": "a", "path": "a", "type": "integer"}, {"name": "b", "path": "b", "type": "boolean"}, {"name": "c", "path": "c"})
    assert row == {"a": None, "b": None, "c": None}


def test_lexemes_are_kept(spark):
    doc = '{"n":12345678901234567890123.4500,"e":1.50e2,"s":"1.0 and 2","neg":-0.10,"arr":[1.0,{"x":2.00}]}'
    row = _one(spark, doc, *[{"name": c, "path": c} for c in ("n", "e", "s", "neg")], {"name": "arr", "path": "arr", "collection": True})
    assert row == {"n": "12345678901234567890123.4500", "e": "1.50e2", "s": "1.0 and 2", "neg": "-0.10", "arr": '[1.0,{"x":2.00}]'}


def test_odd_documents(spark):
    view = {"resource": "Patient", "select": [{"column": [{"name": "id", "path": "id"}]}, {"forEachOrNull": "name", "column": [{"name": "f", "path": "family"}]}]}
    with pytest.raises(Exception, match="MALFORMED"):
        ViewEngine(spark).run(view, _patients(spark, "{broken")).collect()
    df = _patients(spark, "{}", '{"id":"a","name":{"family":"one"}}', '{"id":"b","name":[null,{"family":""}]}', '{"id":"ü😀","name":[]}')
    rows = sorted((r["id"] or "", r["f"]) for r in ViewEngine(spark).run(view, df).collect())
    assert rows == [("", None), ("a", "one"), ("b", ""), ("ü😀", None)]


def test_deep_repeat(spark):
    doc = {"linkId": "300"}
    for i in range(299, 0, -1):
        doc = {"linkId": str(i), "item": [doc]}
    view = {"resource": "Patient", "select": [{"repeat": ["item"], "column": [{"name": "l", "path": "linkId"}, {"name": "i", "path": "%rowIndex", "type": "integer"}]}]}
    rows = ViewEngine(spark).run(view, _patients(spark, {"id": "p", "item": [doc], "text": "{{{ \" }"})).orderBy("i").collect()
    assert [r["l"] for r in rows] == [str(i) for i in range(1, 301)]


def test_strict(spark):
    view = {"resource": "Patient", "select": [{"column": [{"name": "f", "path": "name.family"}]}]}
    one, two = _patients(spark, {"name": [{"family": "a"}]}), _patients(spark, {"name": [{"family": "a"}, {"family": "b"}]})
    engine = ViewEngine(spark, strict=True)
    assert engine.run(view, one).first()["f"] == "a"
    assert ViewEngine(spark).run(view, two).first()["f"] == "a"
    with pytest.raises(Exception, match="several values"):
        engine.run(view, two).collect()


def test_plan_is_pruned_and_has_no_shuffle(spark, tmp_path):
    df = _patients(spark, {"id": "a", "name": [{"family": "x"}]}).union(spark.createDataFrame([(9, "Claim", "{}")], "id long, resource_type string, json string"))
    df.write.partitionBy("resource_type").parquet(str(tmp_path / "t"))
    view = {"resource": "Patient", "select": [{"column": [{"name": "id", "path": "id"}]}, {"forEach": "name", "column": [{"name": "f", "path": "family"}]}]}
    out = ViewEngine(spark).run(view, spark.read.parquet(str(tmp_path / "t")))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(resource_type" in plan and "Exchange" not in plan and "Python" not in plan
    assert plan.count("parse_json") + plan.count("parseJson") <= 3  # once, written in the plan as one expression
    assert out.count() == 1


def test_sql_runs_over_a_table(spark):
    _patients(spark, {"id": "a"}, {"id": "b"}).createOrReplaceTempView("fhir_resources")
    compiled = ViewEngine(spark).transpile(SIMPLE)
    assert not compiled.sql.rstrip().endswith(";")
    assert spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW v AS {compiled.sql}") is not None
    assert sorted(r["id"] for r in spark.table("v").collect()) == ["a", "b"]
    assert ViewEngine(spark).run(json.dumps(SIMPLE)).count() == 2


def test_options():
    sql = ViewEngine(options=Options("t1", "s1", "rid", "doc")).transpile(SIMPLE, test_id="a-1").sql
    assert "`s1`.`t1`" in sql and "r.`rid`" in sql and "r.`doc`" in sql and "r.test_id = 'a-1'" in sql
    with pytest.raises(IdentifierError):
        ViewEngine(options=Options("t; DROP")).transpile(SIMPLE)
    with pytest.raises(IdentifierError):
        ViewEngine(options=Options("select")).transpile(SIMPLE)
    with pytest.raises(ViewDefinitionError):
        ViewEngine().transpile(SIMPLE, test_id="a'b")
    assert [storage_type(x) for x in (" blob ", "Json", "STRING", "variant")] == ["STRING", "VARIANT", "STRING", "VARIANT"]
    with pytest.raises(ViewDefinitionError):
        storage_type("XML")


def test_input_forms(tmp_path):
    path = tmp_path / "v.json"
    path.write_text(json.dumps(SIMPLE))
    assert parse_view(SIMPLE) == parse_view(json.dumps(SIMPLE)) == parse_view(path) == parse_view(str(path))
    assert parse_view(SIMPLE).status == "active" and "status" not in SIMPLE


def test_errors_name_column_and_path():
    view = {"resource": "Patient", "select": [{"column": [{"name": "bad", "path": "name.resolve()"}]}]}
    with pytest.raises(FhirPathError, match="'bad'.*name.resolve.*Unsupported FHIRPath function: resolve"):
        ViewEngine().transpile(view)


def test_variant_storage(spark):
    df = _patients(spark, {"id": "a", "n": 2, "name": [{"family": "x"}]}).withColumn("json", F.parse_json("json"))
    view = {"resource": "Patient", "select": [{"column": [{"name": "n", "path": "n", "type": "integer"}]}, {"repeat": ["name"], "column": [{"name": "f", "path": "family"}]}]}
    assert [tuple(r) for r in ViewEngine(spark).run(view, df).collect()] == [(2, "x")]


def test_comparator():
    assert same_rows([{"a": "1.0", "b": ""}], [{"a": 1, "b": None}])
    assert same_rows([{"a": True}, {"a": "x"}], [{"a": "x"}, {"a": 1}])
    assert same_rows([{"a": '["x"]'}], [{"a": ["x"]}])
    assert not same_rows([{"a": 1}], [{"a": 1}, {"a": 1}]) and not same_rows([{"a": 1}], [{"a": 1.1}])


def test_stream(spark, tmp_path):
    from viewloom.streaming import ndjson_stream, stream_view

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "Patient.ndjson").write_text('{"id":"a","name":[{"family":"x"},{"family":"y"}]}\r\n\n{"id":"b"}\n')
    view = {"resource": "Patient", "select": [{"column": [{"name": "id", "path": "id"}]}, {"forEachOrNull": "name", "column": [{"name": "f", "path": "family"}]}]}
    rows = stream_view(ndjson_stream(spark, str(tmp_path / "in")), view)
    assert rows.isStreaming
    q = rows.writeStream.format("memory").queryName("out").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(((r["id"], r["f"]) for r in spark.table("out").collect()), key=str) == [("a", "x"), ("a", "y"), ("b", None)]
    assert spark.table("out").count() == 3


def test_values_keep_their_digits(spark):
    """Numbers named in paths keep their digits, strings that look like members stay, large numbers aren't lost, offsets stay."""
    doc = {"v": 1234567890123.5, "t": "2010-10-10T10:10:10+02:00", "n": {"g": ["a", "b"], "h": "a"}, "k": [{"m": {"z": 1}}, {"m": {"z": 'x "z": 5'}}], "s": 'y "v": 5, "d": 1'}
    paths = [("v + 1", None, "1234567890124.5"), ("v * 2", "decimal", "2469135780247"), ("t.lowBoundary()", None, "2010-10-10T10:10:10.000+02:00"), ("n.g = 'a'", "boolean", False), ("n.h = 'a'", "boolean", True), ("n.g = n.g", "boolean", True), ("n.x = 'a'", "boolean", None)]
    paths += [("k.m.z.last()", None, 'x "z": 5'), ("s", "string", 'y "v": 5, "d": 1'), ("k.m.z.first()", None, "1")]
    view = {"resource": "Patient", "select": [{"column": [{"name": f"c{i}", "path": p, **({"type": t} if t else {})} for i, (p, t, _) in enumerate(paths)]}]}
    assert list(ViewEngine(spark).run(view, _patients(spark, doc)).first()) == [x for _, _, x in paths]


def test_rows_of_siblings_are_built_once(spark):
    select = [
        {"column": [{"name": "id", "path": "id"}]}, {"repeat": ["item"], "column": [{"name": "a", "path": "linkId"}, {"name": "i", "path": "%rowIndex", "type": "integer"}]},
        {"forEachOrNull": "code", "column": [{"name": "c", "path": "$this"}, {"name": "j", "path": "$total", "type": "integer"}]}, {"repeat": ["item"], "column": [{"name": "b", "path": "linkId"}]},
    ]
    view = {"resource": "Patient", "select": select}
    lines = [x for x in ViewEngine().transpile(view).sql.splitlines() if x.startswith("LATERAL VIEW")]
    first = next(k for k, x in enumerate(lines) if "explode(array(" not in x)
    assert first == 3 and not any("transform(" in x for x in lines[first:])

    def tree(depth, name):
        return [{"linkId": f"{name}{k}", **({"item": tree(depth - 1, f"{name}{k}")} if depth else {})} for k in range(2)]

    def links(items):
        return [y for x in items for y in [x["linkId"], *links(x.get("item", []))]]

    docs = [{"id": "x", "item": tree(2, "n"), "code": ["u", "v"]}, {"id": "y", "item": tree(0, "m")}, {"id": "z", "code": ["w"]}]
    want = [(d["id"], a, i, c, len(d.get("code", [])), b) for d in docs for i, a in enumerate(links(d.get("item", []))) for c in d.get("code", [None]) for b in links(d["item"])]
    got = [tuple(r) for r in ViewEngine(spark).run(view, _patients(spark, *docs)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) == 14 * 2 * 14 + 2 * 2


def test_crossed_rows_carry_no_document(spark):
    select = [
        {"column": [{"name": "id", "path": "id"}]}, {"repeat": ["item"], "column": [{"name": "a", "path": "linkId"}]},
        {"forEach": "name", "column": [{"name": "use", "path": "use"}], "select": [{"forEachOrNull": "given", "column": [{"name": "given", "path": "$this"}]}]},
        {"column": [{"name": "code", "path": "code"}]}, {"repeat": ["item"], "column": [{"name": "b", "path": "linkId"}]},
    ]
    view = {"resource": "Patient", "select": select}
    lines = ViewEngine().transpile(view).sql.splitlines()
    last = max(k for k, x in enumerate(lines) if "_doc" in x)
    assert "_doc" not in next(x for x in lines if x.startswith("SELECT")) and all("inline(g" in x or "explode(aggregate(array(0), g" in x for x in lines[last + 1 :])
    assert sum("LATERAL VIEW inline(g" in x for x in lines[last + 1 :]) == 2

    # Several blocks of rows, with a part left over, without, with one row left over, and none.
    def doc(name, n, names, **more):
        return {"id": name, "item": [{"linkId": f"{name}{k}"} for k in range(n)], "name": names, **more}

    names = [{"use": "u", "given": ["x", "y"]}, {"use": "v"}]
    docs = [doc("p", 70, names, code="c"), doc("q", 32, names), doc("r", 33, names[:1]), doc("s", 0, names), doc("t", 5, [])]
    want = [(d["id"], x["linkId"], m["use"], g, d.get("code"), y["linkId"]) for d in docs for x in d["item"] for m in d["name"] for g in m.get("given", [None]) for y in d["item"]]
    got = [tuple(r) for r in ViewEngine(spark).run(view, _patients(spark, *docs)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) == 70**2 * 3 + 32**2 * 3 + 33**2 * 2
    # Strictly, too, a cell is computed only for rows that there are.
    several = [doc("t", 5, [], code=["c", "d"]), doc("s", 0, names, code=["c", "d"])]
    assert ViewEngine(spark, strict=True).run(view, _patients(spark, *several)).collect() == []
    with pytest.raises(Exception, match="several values"):
        ViewEngine(spark, strict=True).run(view, _patients(spark, doc("p", 1, names, code=["c", "d"]))).collect()


def test_large_documents_are_dealt_out(spark):
    from viewloom.sources.sample import questionnaires

    def held(rows):
        yield len(list(rows))

    assert max(questionnaires(spark, "/root/testdata/sf0.001").select("id").rdd.mapPartitions(held).collect()) <= -(-5 // spark.sparkContext.defaultParallelism)


def test_joined_views_are_not_broadcast(spark):
    from viewloom.queries import QUERIES

    plan = QUERIES["key_join_views"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().treeString()
    joins = [x for x in plan.splitlines() if "Join [patient" in x]
    assert len(joins) == 1 and "SortMergeJoin" in joins[0]
