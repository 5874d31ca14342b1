"""Scalar expressions of the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percentage(part: Column, whole: Column) -> Column:
    """100 part / whole to two decimals; null where whole is 0."""
    return F.round(100 * part / F.nullif(whole, F.lit(0)), 2)


def ratio(a: Column, b: Column, digits: int = 2) -> Column:
    return F.round(a / F.nullif(b, F.lit(0)), digits)


def verdict(log: Column) -> Column:
    return F.when(log.contains("VALIDATION PASSED"), "PASS").when(log.contains("VALIDATION FAILED"), "FAIL").otherwise("NONE")


def shown(value: Column, missing: str = "-") -> Column:
    return F.coalesce(value.cast("string"), F.lit(missing))


def source_name(program: Column) -> Column:
    return F.translate(program, "-", "_")


def size_tag(name: Column) -> Column:
    return F.regexp_extract(name, r"_(\d+[km]?)_\d+$", 1)


def short_name(graph: Column) -> Column:
    """A graph's name with its kind as a letter, for narrow tables."""
    return F.regexp_replace(F.regexp_replace(graph, "general_sparse_", "g_"), "bipartite_sparse_", "b_")
