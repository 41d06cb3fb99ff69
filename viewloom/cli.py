"""Command line: transpile, load and export."""

from __future__ import annotations

import argparse
import sys

from .api import Options, ViewEngine


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("viewloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="viewloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    t = sub.add_parser("transpile", help="a ViewDefinition to Spark SQL")
    t.add_argument("-i", "--input", help="file of the ViewDefinition; standard input if not given")
    t.add_argument("-o", "--output", help="file for the SQL; standard output if not given")
    t.add_argument("--table-name", default="fhir_resources")
    t.add_argument("--schema-name")
    t.add_argument("--resource-id-column", default="id")
    t.add_argument("--resource-json-column", default="json")
    t.add_argument("--resource-json-data-type", default="STRING", help="STRING (BLOB) or VARIANT (JSON)")

    r = sub.add_parser("load", help="NDJSON files into the resource table")
    r.add_argument("directory")
    r.add_argument("--warehouse", required=True, help="folder of the resource table")
    r.add_argument("--resource-type")
    r.add_argument("--resource-json-data-type", default="STRING", help="STRING (BLOB) or VARIANT (JSON)")
    r.add_argument("--batch-size", type=int, default=1000)
    r.add_argument("--parallel", type=int, default=4)
    r.add_argument("--no-create-table", action="store_true")
    r.add_argument("--truncate", action="store_true")
    r.add_argument("--continue-on-error", action="store_true")
    r.add_argument("--dry-run", action="store_true")
    r.add_argument("--verbose", action="store_true")

    e = sub.add_parser("export", help="the resource table into NDJSON files")
    e.add_argument("directory")
    e.add_argument("--warehouse", required=True, help="folder of the resource table")
    e.add_argument("--resource-type")
    e.add_argument("--overwrite", action="store_true")
    e.add_argument("--verbose", action="store_true")
    return p


def _transpile(a: argparse.Namespace) -> int:
    if a.input:
        with open(a.input, encoding="utf-8") as f:
            source = f.read()
    else:
        source = sys.stdin.read()
    options = Options(a.table_name, a.schema_name, a.resource_id_column, a.resource_json_column, a.resource_json_data_type)
    sql = ViewEngine(options=options).transpile(source).sql
    if a.output:
        with open(a.output, "w", encoding="utf-8") as f:
            f.write(sql + "\n")
    else:
        print(sql)
    return 0


def _load(a: argparse.Namespace) -> int:
    from .sources.load import load_ndjson

    log = (lambda x: print(x, file=sys.stderr)) if a.verbose else (lambda _: None)
    out = load_ndjson(
        _session(), a.directory, a.warehouse, resource_type=a.resource_type, json_data_type=a.resource_json_data_type, create_table=not a.no_create_table,
        truncate=a.truncate, continue_on_error=a.continue_on_error, dry_run=a.dry_run, batch_size=a.batch_size, parallel=a.parallel, log=log,
    )
    for s in out.skipped:
        print(f"skipped {s.file}: {s.reason}")
    for f in out.files:
        print("; ".join([f"{f.file}: {f.rows_loaded} rows", *f.errors]))
    rate = out.total_rows / out.duration_s if out.duration_s else 0
    print(f"{'would load' if a.dry_run else 'loaded'} {out.total_rows} rows of {len(out.files)} files in {out.duration_s:.1f} s ({rate:.0f} rows a second)")
    return int(out.failed)


def _export(a: argparse.Namespace) -> int:
    from .sources.export import export_ndjson
    from .sources.table import ResourceTable

    log = (lambda x: print(x, file=sys.stderr)) if a.verbose else (lambda _: None)
    out = export_ndjson(ResourceTable(_session(), a.warehouse).read(), a.directory, resource_type=a.resource_type, overwrite=a.overwrite, log=log)
    for f in out.files:
        print(f"{f.path}: {f.rows_written} rows")
    print(f"exported {out.total_rows} rows in {out.duration_ms} ms")
    return 0


def main(args: list[str] | None = None) -> int:
    a = _parser().parse_args(args)
    try:
        return {"transpile": _transpile, "load": _load, "export": _export}[a.command](a)
    except (ValueError, RuntimeError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
