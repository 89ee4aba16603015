"""Columns that pass an operator untouched, whatever their names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _names(docs: DataFrame) -> dict[str, str]:
    return {c: c if c == "text" else f"_{i}" for i, c in enumerate(docs.columns)}


def covered(docs: DataFrame) -> DataFrame:
    """`docs` with all columns but text under names that no operator gives a column of its own."""
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in _names(docs).items()))


def uncovered(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of `docs` under their own names, from rows that came from `covered`."""
    return found.select(*(F.col(n).alias(c) for c, n in _names(docs).items()))
