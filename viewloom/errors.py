"""Errors of the engine. Each names the column and path that it is about, where there is one."""

from __future__ import annotations


class ViewDefinitionError(ValueError):
    """A view that isn't valid."""


class FhirPathError(ValueError):
    """An expression that can't be parsed or compiled."""


class IdentifierError(ValueError):
    """A table, schema or column name that isn't safe."""


class LoadError(RuntimeError):
    """A load that can't start or go on."""


class ExportError(RuntimeError):
    """An export that can't start or go on."""
