"""The resource table: Parquet files (id, json), partitioned by resource_type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..api import storage_type
from ..errors import LoadError
from .files import Files


class ResourceTable:
    """A table of resources in a folder. Reads are pruned to the partitions of the types that a view asks for."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)

    def exists(self) -> bool:
        return self.files.exists(self.path) and any(e.is_dir and "=" in e.name or e.name.endswith(".parquet") for e in self.files.list(self.path))

    def read(self) -> DataFrame:
        kind = self.json_type()
        return self.spark.read.schema(f"id BIGINT, json {kind}, resource_type STRING").parquet(self.path)

    def json_type(self) -> str:
        """STRING or VARIANT, as the files have it."""
        found = {f.name: f.dataType for f in self.spark.read.parquet(self.path).schema.fields}
        if isinstance(found.get("json"), T.StringType):
            return "STRING"
        if isinstance(found.get("json"), T.VariantType):
            return "VARIANT"
        raise LoadError(f"the table in {self.path} has no json column of type STRING or VARIANT")

    def prepare(self, wanted: str, create: bool = True) -> tuple[str, str | None]:
        """Makes the table ready to be written to: (its JSON type, a warning). An existing table's type wins."""
        wanted = storage_type(wanted)
        if not self.exists():
            if not create:
                raise LoadError(f"there is no table in {self.path}")
            return wanted, None
        have = self.json_type()
        warning = f"the table's json column is {have}, not {wanted}; {have} is used" if have != wanted else None
        return have, warning

    def next_id(self) -> int:
        if not self.exists():
            return 0
        last = self.read().agg(F.max("id")).first()[0]
        return 0 if last is None else last + 1

    def truncate(self) -> None:
        if self.exists():
            self.files.delete(self.path)

    def append(self, rows: DataFrame) -> None:
        """Appends rows (id, resource_type, json), sorted by type within a task, so that it has one file open at a time."""
        rows.sortWithinPartitions("resource_type", "id").write.mode("append").partitionBy("resource_type").parquet(self.path)
