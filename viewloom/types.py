"""Types of output columns: FHIR types and type tags to Spark types."""

from __future__ import annotations

import re

from .errors import ViewDefinitionError
from .model import ColumnDef

# FHIR primitive types that aren't text in the output. All others, and unknown ones, are STRING.
FHIR_TYPES = {"boolean": "BOOLEAN", "integer": "INT", "positiveint": "INT", "unsignedint": "INT", "integer64": "BIGINT"}
# Widths of the FHIR types that are cut to a width.
WIDTHS = {"id": 64, "date": 10, "time": 20, "datetime": 50, "instant": 50}

# Type names of the tags oracle/type and ansi/type. {} stands for the parameters.
TAG_TYPES = {
    "NUMBER": "DECIMAL{}", "DECIMAL": "DECIMAL{}", "DEC": "DECIMAL{}", "NUMERIC": "DECIMAL{}",
    "INTEGER": "INT", "INT": "INT", "SMALLINT": "SMALLINT", "BIGINT": "BIGINT",
    "FLOAT": "FLOAT", "REAL": "FLOAT", "BINARY_FLOAT": "FLOAT", "DOUBLE PRECISION": "DOUBLE", "BINARY_DOUBLE": "DOUBLE",
    "BOOLEAN": "BOOLEAN", "DATE": "DATE", "TIME": "STRING",
    "TIMESTAMP": "TIMESTAMP_NTZ", "TIMESTAMP WITH TIME ZONE": "TIMESTAMP", "TIMESTAMP WITH LOCAL TIME ZONE": "TIMESTAMP",
    "INTERVAL YEAR TO MONTH": "INTERVAL YEAR TO MONTH", "INTERVAL DAY TO SECOND": "INTERVAL DAY TO SECOND",
    "CHAR": "STRING", "NCHAR": "STRING", "VARCHAR": "STRING", "VARCHAR2": "STRING", "NVARCHAR2": "STRING",
    "CHARACTER": "STRING", "CHARACTER VARYING": "STRING", "CHAR VARYING": "STRING", "NATIONAL CHARACTER": "STRING",
    "NATIONAL CHAR": "STRING", "NATIONAL CHARACTER VARYING": "STRING", "NATIONAL CHAR VARYING": "STRING",
    "CLOB": "STRING", "NCLOB": "STRING", "BLOB": "BINARY", "RAW": "BINARY", "LONG RAW": "BINARY", "BINARY VARYING": "BINARY", "JSON": "VARIANT",
}
#: Names only one of the two tags may use.
_ANSI_ONLY = {"DEC", "BIGINT", "TIME", "CHARACTER", "CHARACTER VARYING", "CHAR VARYING", "NATIONAL CHARACTER", "NATIONAL CHAR", "NATIONAL CHARACTER VARYING", "NATIONAL CHAR VARYING", "BINARY VARYING"}
_TYPE = re.compile(r"\s*([A-Za-z][A-Za-z0-9_ ]*?)\s*(\(\s*(\d+)(?:\s+(?:CHAR|BYTE))?\s*(?:,\s*(\d+)\s*)?\))?\s*", re.IGNORECASE)
_SPARK_TYPE = re.compile(r"(STRING|BOOLEAN|TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DATE|TIMESTAMP|TIMESTAMP_NTZ|BINARY|VARIANT|DECIMAL(\(\d+(,\s*\d+)?\))?|ARRAY<STRING>)", re.IGNORECASE)


def tag_type(tag: str, value: str, column: str) -> str:
    """The Spark type that a type tag names."""
    if tag == "spark/type":
        if not _SPARK_TYPE.fullmatch(value.strip()):
            raise ViewDefinitionError(f"column '{column}': unsupported spark/type '{value}'")
        return value.strip().upper()
    m = _TYPE.fullmatch(value)
    base = re.sub(r"\s+", " ", m[1].upper()) if m else ""
    if base not in TAG_TYPES or (tag == "oracle/type" and base in _ANSI_ONLY):
        raise ViewDefinitionError(f"column '{column}': unsupported {tag} '{value}'")
    target = TAG_TYPES[base]
    if tag == "ansi/type" and base == "BOOLEAN":
        return "BOOLEAN"
    if target == "DECIMAL{}":
        if not m[3]:
            return "DECIMAL(38,18)"
        precision, scale = int(m[3]), int(m[4] or 0)
        if not 1 <= precision <= 38 or scale > precision:
            raise ViewDefinitionError(f"column '{column}': {tag} '{value}' is out of range")
        return f"DECIMAL({precision},{scale})"
    return target


def column_type(column: ColumnDef) -> str:
    """The Spark type of a column: spark/type before oracle/type before ansi/type before the FHIR type."""
    for tag in ("spark/type", "oracle/type", "ansi/type"):
        for t in column.tags:
            if t.name == tag:
                return tag_type(tag, t.value, column.name)
    if column.collection:
        return "STRING"
    return FHIR_TYPES.get((column.type or "").rpartition("/")[2].lower(), "STRING")


def cast_text(text: str, column: ColumnDef) -> str:
    """SQL that casts a text to the column's type; a text that isn't of the type gives NULL."""
    kind = column_type(column)
    if kind == "STRING":
        width = WIDTHS.get((column.type or "").lower())
        return f"left({text}, {width})" if width and not column.tags else text
    if kind == "BOOLEAN":
        return f"CASE {text} WHEN 'true' THEN true WHEN 'false' THEN false WHEN '1' THEN true WHEN '0' THEN false END"
    if kind == "BINARY":
        return f"CAST({text} AS BINARY)"
    if kind == "VARIANT":
        return f"coalesce(try_parse_json({text}), CAST({text} AS VARIANT))"
    if kind == "ARRAY<STRING>":
        return f"from_json({text}, 'array<string>')"
    return f"try_cast({text} AS {kind})"
