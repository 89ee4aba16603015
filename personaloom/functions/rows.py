"""Row-wise steps that evaluate their input once.

A filter on a computed column, and the one that Spark derives for the input of
explode(), are moved below the computation, which then runs twice per row. These
helpers keep it at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once, also where the body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def explode_once(df: DataFrame, array: str | Column, keep: list, value: str, place: str = "_place") -> DataFrame:
    """`keep` columns, `place` and `value`: one row per entry of a computed array column."""
    rows = df.select(*keep, F.posexplode_outer(array).alias(place, value))
    return rows.filter(F.col(place).isNotNull())


def compute_where(df: DataFrame, keep: list, made: dict[str, Column], wanted) -> DataFrame:
    """`keep` columns and the computed ones, for the rows that pass `wanted(struct of the computed)`."""
    one = F.array(F.struct(*[c.alias(name) for name, c in made.items()]))
    return df.select(*keep, F.inline(F.filter(one, wanted)))
