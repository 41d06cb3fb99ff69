"""NDJSON load and export."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from viewloom.cli import main
from viewloom.errors import ExportError, LoadError
from viewloom.sources.export import export_dataset, export_ndjson, plan, reread
from viewloom.sources.load import discover, load_ndjson
from viewloom.sources.table import ResourceTable

PATIENTS = ['{"resourceType":"Patient","id":"p1","name":[{"family":"O\'Brien","given":["Zoë","😀"]}],"n":1.50}', '{"resourceType":"Patient","id":"p2", "active":true}']
OBSERVATIONS = ['{"resourceType":"Observation","id":"o1","valueInteger":3}']


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "Patient.ndjson").write_text(PATIENTS[0] + "\r\n\n  \n" + PATIENTS[1], encoding="utf-8")
    (d / "Observation.ndjson").write_text(OBSERVATIONS[0] + "\n")
    (d / "notes.txt").write_text("x")
    (d / "patient.ndjson.bak").write_text("x")
    (d / "Sub.ndjson").mkdir()
    return d


def test_discovery(spark, folder):
    found = discover(spark, str(folder))
    assert [(e.name, t) for e, t in found.files] == [("Observation.ndjson", "Observation"), ("Patient.ndjson", "Patient")]
    assert {s.file for s in found.skipped} == {"notes.txt", "patient.ndjson.bak"}
    assert [t for _, t in discover(spark, str(folder), "Patient").files] == ["Patient"]
    with pytest.raises(LoadError):
        discover(spark, str(folder / "none"))


def test_load_and_export_keep_the_lines(spark, folder, tmp_path):
    table = str(tmp_path / "t")
    out = load_ndjson(spark, str(folder), table)
    assert (out.total_rows, out.failed) == (3, False) and [f.rows_loaded for f in out.files] == [1, 2]
    rows = ResourceTable(spark, table).read()
    assert rows.filter("resource_type = 'Patient'").select("id").distinct().count() == 2
    done = export_ndjson(rows, str(tmp_path / "out"))
    assert done.total_rows == 3 and [f.rows_written for f in done.files] == [1, 2]
    assert (tmp_path / "out" / "Patient.ndjson").read_text(encoding="utf-8") == "\n".join(PATIENTS) + "\n"
    again = load_ndjson(spark, str(tmp_path / "out"), str(tmp_path / "t2"))
    assert again.total_rows == 3
    export_dataset(rows, str(tmp_path / "ds"))
    assert sorted(r["json"] for r in reread(spark, str(tmp_path / "ds")).collect()) == sorted(PATIENTS + OBSERVATIONS)


def test_ids_go_on(spark, folder, tmp_path):
    table = str(tmp_path / "t")
    load_ndjson(spark, str(folder), table)
    load_ndjson(spark, str(folder), table)
    ids = [r["id"] for r in ResourceTable(spark, table).read().collect()]
    assert len(ids) == len(set(ids)) == 6
    load_ndjson(spark, str(folder), table, truncate=True)
    assert ResourceTable(spark, table).read().count() == 3


def test_salvage(spark, folder, tmp_path):
    (folder / "Broken.ndjson").write_text('{definitely not json\n{"id":"b"}\n[1]\n{"a":1} x\n')
    strict = load_ndjson(spark, str(folder), str(tmp_path / "t1"))
    by = {f.resource_type: f for f in strict.files}
    assert strict.failed and by["Broken"].rows_loaded == 0 and by["Broken"].errors and by["Patient"].rows_loaded == 2
    loose = load_ndjson(spark, str(folder), str(tmp_path / "t2"), continue_on_error=True)
    by = {f.resource_type: f for f in loose.files}
    assert loose.failed and by["Broken"].rows_loaded == 1 and by["Broken"].rows_failed == 3 and "definitely" in by["Broken"].errors[0]
    assert ResourceTable(spark, str(tmp_path / "t2")).read().filter("resource_type = 'Broken'").count() == 1


def test_dry_run_and_table_checks(spark, folder, tmp_path):
    table = str(tmp_path / "t")
    out = load_ndjson(spark, str(folder), table, dry_run=True)
    assert out.total_rows == 3 and not (tmp_path / "t").exists()
    with pytest.raises(LoadError):
        load_ndjson(spark, str(folder), table, create_table=False)
    with pytest.raises(ValueError, match="resource_json_data_type"):
        load_ndjson(spark, str(folder), table, json_data_type="XML")
    with pytest.raises(LoadError):
        load_ndjson(spark, str(folder), table, batch_size=0)
    load_ndjson(spark, str(folder), table)
    warned = load_ndjson(spark, str(folder), table, json_data_type="JSON", truncate=True)
    assert warned.warnings and ResourceTable(spark, table).json_type() == "STRING"


def test_variant_table(spark, folder, tmp_path):
    from viewloom.api import ViewEngine

    table = str(tmp_path / "t")
    load_ndjson(spark, str(folder), table, json_data_type="VARIANT", resource_type="Patient")
    rows = ResourceTable(spark, table).read()
    view = {"resource": "Patient", "select": [{"column": [{"name": "id", "path": "id"}]}]}
    assert sorted(r["id"] for r in ViewEngine(spark).run(view, rows).collect()) == ["p1", "p2"]
    export_ndjson(rows, str(tmp_path / "out"))
    assert [json.loads(x)["id"] for x in (tmp_path / "out" / "Patient.ndjson").read_text().splitlines()] == ["p1", "p2"]


def _rows(spark, *rows):
    return spark.createDataFrame(list(rows), "id long, resource_type string, json string")


def test_export_checks(spark, tmp_path):
    with pytest.raises(ExportError):
        plan(["patient"], str(tmp_path), False)
    with pytest.raises(ExportError):
        plan(["Patient", "PATIENT"], str(tmp_path), False)
    (tmp_path / "Patient.ndjson").write_text("old")
    with pytest.raises(ExportError):
        plan(["Patient"], str(tmp_path), False)
    assert plan(["Patient"], str(tmp_path), True)
    bad = _rows(spark, (1, "Account", "{}"), (2, "Patient", '{"a":\n1}'))
    with pytest.raises(ExportError, match="line break"):
        export_ndjson(bad, str(tmp_path), overwrite=True)
    assert (tmp_path / "Account.ndjson").read_text() == "{}\n" and (tmp_path / "Patient.ndjson").read_text() == "old" and not list(tmp_path.glob("*.part"))
    with pytest.raises(ExportError, match="no JSON"):
        export_ndjson(_rows(spark, (1, "Patient", None)), str(tmp_path / "x"))
    assert export_ndjson(_rows(spark, (1, "Patient", "{}")).filter(F.lit(False)), str(tmp_path / "y")).total_rows == 0


def test_cli(folder, tmp_path, capsys, spark):
    view = tmp_path / "v.json"
    view.write_text(json.dumps({"resource": "Patient", "select": [{"column": [{"name": "id", "path": "id"}]}]}))
    assert main(["transpile", "-i", str(view), "-o", str(tmp_path / "v.sql")]) == 0
    assert (tmp_path / "v.sql").read_text().startswith("WITH docs AS")
    view.write_text("{}")
    assert main(["transpile", "-i", str(view), "-o", str(tmp_path / "w.sql")]) == 1
    assert not (tmp_path / "w.sql").exists()
    table = str(tmp_path / "t")
    assert main(["load", str(folder), "--warehouse", table, "--dry-run"]) == 0
    assert main(["load", str(folder), "--warehouse", table]) == 0
    assert main(["export", str(tmp_path / "out"), "--warehouse", table, "--resource-type", "Patient"]) == 0
    assert main(["export", str(tmp_path / "out"), "--warehouse", table]) == 1
    (folder / "Bad.ndjson").write_text("nope\n")
    assert main(["load", str(folder), "--warehouse", table]) == 1
    assert "loaded 3 rows of 2 files" in capsys.readouterr().out
