"""NDJSON load: folders of {ResourceType}.ndjson files into the resource table."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..api import storage_type
from ..errors import LoadError
from .files import Entry, Files
from .table import ResourceTable

_FILE = re.compile(r"([A-Z][A-Za-z0-9]*)\.ndjson")


@dataclass(frozen=True)
class Skipped:
    file: str
    reason: str


@dataclass(frozen=True)
class Discovery:
    files: list[tuple[Entry, str]]  # with the resource type
    skipped: list[Skipped]


@dataclass
class FileResult:
    file: str
    resource_type: str
    rows_loaded: int = 0
    rows_failed: int = 0
    errors: list[str] = field(default_factory=list)


@dataclass
class LoadResult:
    files: list[FileResult]
    total_rows: int
    failed: bool
    duration_s: float = 0.0
    skipped: list[Skipped] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def discover(spark: SparkSession, directory: str, resource_type: str | None = None) -> Discovery:
    """The NDJSON files of a folder, not of folders in it; others are skipped with a reason."""
    files = Files(spark)
    if not files.is_dir(directory):
        raise LoadError(f"{directory} is no folder")
    found, skipped = [], []
    for e in files.list(directory):
        if e.is_dir:
            continue
        m = _FILE.fullmatch(e.name)
        if not m:
            skipped.append(Skipped(e.name, "the name is not {ResourceType}.ndjson"))
        elif resource_type is not None and m[1] != resource_type:
            skipped.append(Skipped(e.name, f"the resource type is not {resource_type}"))
        else:
            found.append((e, m[1]))
    return Discovery(found, skipped)


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, at (order in the file), json of every line that isn't blank; \\r\\n is one line end."""
    lines = spark.read.option("lineSep", "\n").text(paths)
    line = F.regexp_replace("value", "\r$", "")
    return lines.select(
        F.col("_metadata.file_name").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("at"),
        line.alias("json"),
    ).filter(F.trim(F.regexp_replace("json", r"[\t\r\f\x0B]", " ")) != "")


def is_resource(json):
    """Whether a line is one JSON object."""
    text = F.rtrim(F.regexp_replace(json, r"\s+$", ""))
    parsed = F.try_parse_json(json)
    return parsed.isNotNull() & F.schema_of_variant(parsed).startswith("OBJECT") & text.endswith("}")


def load_ndjson(
    spark: SparkSession,
    directory: str,
    table_path: str,
    *,
    resource_type: str | None = None,
    json_data_type: str = "STRING",
    create_table: bool = True,
    truncate: bool = False,
    continue_on_error: bool = False,
    dry_run: bool = False,
    batch_size: int = 1000,
    parallel: int = 4,
    log: Callable[[str], None] = lambda _: None,
) -> LoadResult:
    """Loads a folder's files.

    Every line must be a JSON object. A file with a line that isn't fails as a whole, and nothing of it is loaded;
    with continue_on_error its other lines are loaded and the first error is reported. batch_size and parallel are
    checked and otherwise left to Spark, whose tasks are the batches.
    """
    began = time.time()
    storage_type(json_data_type)  # before anything is read
    if batch_size < 1 or parallel < 1:
        raise LoadError("batch_size and parallel must be 1 or more")
    found = discover(spark, directory, resource_type)
    for s in found.skipped:
        log(f"skipped {s.file}: {s.reason}")
    if not found.files:
        return LoadResult([], 0, False, time.time() - began, found.skipped)
    lines = read_lines(spark, [e.path for e, _ in found.files])
    results = {e.name: FileResult(e.name, kind) for e, kind in found.files}
    if dry_run:
        for r in lines.groupBy("file").agg(F.count(F.lit(1)).alias("n")).collect():
            results[r["file"]].rows_loaded = r["n"]
        out = list(results.values())
        return LoadResult(out, sum(r.rows_loaded for r in out), False, time.time() - began, found.skipped)

    table = ResourceTable(spark, table_path)
    kind, warning = table.prepare(json_data_type, create_table)
    if warning:
        log(warning)
    checked = lines.withColumn("ok", F.coalesce(is_resource(F.col("json")), F.lit(False)))
    first_bad = F.min(F.when(~F.col("ok"), F.struct("at", F.left("json", F.lit(80)).alias("json"))))
    for r in checked.groupBy("file").agg(F.count_if("ok").alias("good"), F.count_if(~F.col("ok")).alias("bad"), first_bad.alias("first")).collect():
        at = results[r["file"]]
        at.rows_failed = r["bad"]
        if r["bad"]:
            at.errors.append(f"{r['bad']} of {r['good'] + r['bad']} lines are not JSON objects; the first: {r['first']['json']}")
        at.rows_loaded = r["good"] if continue_on_error or not r["bad"] else 0
    loaded = [n for n, r in results.items() if r.rows_loaded]
    if truncate and (loaded or not any(r.errors for r in results.values())):
        table.truncate()  # once the new lines are known to be good: a folder of bad files leaves the old rows
    if loaded:
        json = F.parse_json("json") if kind == "VARIANT" else F.col("json")
        rows = checked.filter("ok").filter(F.col("file").isin(loaded))
        table.append(
            rows.select(
                # Unique and in the order of the lines of a file; gaps between files and tasks.
                (F.monotonically_increasing_id() + table.next_id()).alias("id"),
                json.alias("json"),
                F.regexp_extract("file", _FILE.pattern, 1).alias("resource_type"),
            )
        )
    out = list(results.values())
    for r in out:
        log("; ".join([f"{r.file}: {r.rows_loaded} rows", *r.errors]))
    total = sum(r.rows_loaded for r in out)
    return LoadResult(out, total, any(r.errors for r in out), time.time() - began, found.skipped, [warning] if warning else [])
