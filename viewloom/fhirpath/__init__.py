"""FHIRPath: text to syntax tree."""

from .parser import parse

__all__ = ["parse"]
