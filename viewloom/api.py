"""The engine: views over a table of resources."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .errors import ViewDefinitionError
from .identifiers import check_identifier, quoted
from .model import ViewDefinition, parse_view
from .plans.view import ColumnInfo, CompiledView, Table, compile_view

# Names of the two ways to store JSON.
STORAGE = {"STRING": "STRING", "BLOB": "STRING", "VARIANT": "VARIANT", "JSON": "VARIANT"}


def storage_type(name: str) -> str:
    """STRING or VARIANT; names are trimmed, and case doesn't matter."""
    try:
        return STORAGE[name.strip().upper()]
    except (KeyError, AttributeError) as e:
        raise ViewDefinitionError(f"resource_json_data_type must be one of {', '.join(STORAGE)}, not {name!r}") from e


@dataclass(frozen=True)
class Options:
    table_name: str = "fhir_resources"
    schema_name: str | None = None
    resource_id_column: str = "id"
    resource_json_column: str = "json"
    resource_json_data_type: str = "STRING"
    strict: bool = False

    def table(self, test_id: str | None = None) -> Table:
        name = quoted(check_identifier(self.table_name, "table name"))
        if self.schema_name:
            name = f"{quoted(check_identifier(self.schema_name, 'schema name'))}.{name}"
        if test_id is not None and not re.fullmatch(r"[A-Za-z0-9_-]+", test_id):
            raise ViewDefinitionError(f"test id {test_id!r} may only have letters, digits, _ and -")
        check_identifier(self.resource_id_column, "id column")
        check_identifier(self.resource_json_column, "json column")
        return Table(name, self.resource_id_column, self.resource_json_column, storage_type(self.resource_json_data_type) == "VARIANT", test_id)


class ViewEngine:
    """Compiles ViewDefinitions, and runs them on Spark."""

    def __init__(self, spark: SparkSession | None = None, options: Options | None = None, **more):
        self.spark = spark
        self.options = options or Options(**more)

    def parse(self, view: Mapping | str | ViewDefinition) -> ViewDefinition:
        return view if isinstance(view, ViewDefinition) else parse_view(view)

    def transpile(self, view: Mapping | str | ViewDefinition, test_id: str | None = None) -> CompiledView:
        """The SELECT over the table named in the options, to be run, put into CREATE VIEW, or inserted from."""
        return compile_view(self.parse(view), self.options.table(test_id), self.options.strict)

    def run(self, view: Mapping | str | ViewDefinition, resources: DataFrame | None = None, test_id: str | None = None) -> DataFrame:
        """The view's rows, over `resources` (id, resource_type, json; batch or streaming) or the table named in the options."""
        if resources is None:
            if self.spark is None:
                raise ValueError("a session or resources are needed to run a view")
            return self.spark.sql(self.transpile(view, test_id).sql)
        spark = resources.sparkSession
        name = f"resources_{uuid.uuid4().hex}"
        at = self.options.table(test_id)
        variant = isinstance(resources.schema[self.options.resource_json_column].dataType, T.VariantType)
        compiled = compile_view(self.parse(view), Table(quoted(name), at.id_column, at.json_column, variant, at.test_id), self.options.strict)
        resources.createOrReplaceTempView(name)
        try:
            return spark.sql(compiled.sql)
        finally:
            spark.catalog.dropTempView(name)


__all__ = ["ColumnInfo", "CompiledView", "Options", "ViewEngine", "parse_view", "storage_type"]
