"""Compilation of expressions and views to Spark SQL."""
