"""Views over streams of resources. A view looks at one resource at a time, so it needs no state and no watermark."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..api import Options, ViewEngine


def ndjson_stream(spark: SparkSession, directory: str, max_files: int | None = None) -> DataFrame:
    """A stream of resources (id, resource_type, json) from the NDJSON files that appear in a folder.

    The id is a hash of the line: a stream has no order to number its lines by.
    """
    reader = spark.readStream.format("text").option("lineSep", "\n").option("pathGlobFilter", "*.ndjson")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = reader.load(directory).select(F.col("_metadata.file_name").alias("file"), F.regexp_replace("value", "\r$", "").alias("json"))
    lines = lines.filter(F.trim("json") != "")
    return lines.select(F.xxhash64("json").alias("id"), F.regexp_extract("file", r"^([A-Z][A-Za-z0-9]*)\.ndjson$", 1).alias("resource_type"), "json")


def stream_view(resources: DataFrame, view: Mapping | str, options: Options | None = None) -> DataFrame:
    """The view's rows as a stream, to be written by writeStream in append mode."""
    return ViewEngine(resources.sparkSession, options).run(view, resources)
