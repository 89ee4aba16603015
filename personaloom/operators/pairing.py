"""Row numbers, spans of positions, and positional pairing of two tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from personaloom.plans.lineage import cut

# Bits of monotonically_increasing_id below the partition's number.
_PLACE_BITS = 33


def _names(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _placed(df: DataFrame, keys: list[str], number: str, buckets: int | None) -> DataFrame:
    """`df` with its rows' positions from 1 in the order of the keys, nulls first.

    A sample of the keys, of any type and number, gives the ranges; rows are sorted inside them and shifted by
    the count of the ranges before, one row per range. The sorted rows are stored, so counts and positions rest
    on the same ranges whatever executors do.
    """
    ranged = df.repartitionByRange(buckets, *keys) if buckets else df.repartitionByRange(*keys)
    rows = cut(ranged.sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _PLACE_BITS)
    counts = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = F.col("_at") - F.shiftleft(F.col("_part"), _PLACE_BITS)
    numbered = rows.withColumn("_part", part).join(F.broadcast(before), "_part")
    return numbered.withColumn(number, F.col("_before") + inside + 1).drop("_part", "_at", "_before")


def number_rows(
    df: DataFrame, key: str | list[str], number: str = "line_number", buckets: int | None = None
) -> DataFrame:
    """Number rows 1..n in the order of a unique key, without moving the table to one task.

    The key is a column of any type that sorts, or several; a null comes before all values.
    """
    return _placed(df, _names(key), number, buckets)


def _reaches(keys: list[str], bound: tuple, last: bool) -> Column:
    """Whether a row's key stands at or behind `bound`, or with `last` at or before it."""
    if len(keys) > 1:
        own, other = F.struct(*keys), F.struct(*[F.lit(v).alias(k) for k, v in zip(keys, bound, strict=True)])
        return own <= other if last else own >= other
    # a plain comparison reaches the files; nulls come first
    c, value = F.col(keys[0]), bound[0]
    if value is None:
        return c.isNull() if last else F.lit(True)
    return (c <= F.lit(value)) | c.isNull() if last else c >= F.lit(value)


def rows_between(
    df: DataFrame, key: str | list[str], first: int, last: int | None = None, buckets: int | None = None
) -> DataFrame:
    """Rows at positions first..last (from 1) in the order of a unique key.

    The key is a column of any type that sorts, or several. Only keys are sorted, to find those of the
    two ends; the rows themselves are kept by a comparison with them and stay where they are.
    """
    keys = _names(key)
    ends = {p for p in (first, last) if p is not None and p > 1}
    found = {}
    if ends:
        numbered = _placed(df.select(*keys), keys, "_position", buckets).filter(F.col("_position").isin(list(ends)))
        found = {r["_position"]: tuple(r[k] for k in keys) for r in numbered.collect()}
    if last is not None and last < max(first, 1) or first > 1 and first not in found:
        return df.limit(0)
    out = df
    if first > 1:
        out = out.filter(_reaches(keys, found[first], last=False))
    if last is not None and last in found:
        out = out.filter(_reaches(keys, found[last], last=True))
    elif last == 1:
        out = out.orderBy(*keys).limit(1)
    return out


def pair_by_position(left: DataFrame, right: DataFrame, number: str = "line_number") -> DataFrame:
    """Row i with row i; the longer side is cut off. Both sides carry `number`.

    Number the raw rows before dropping unreadable ones, so that a bad line
    uses up its place on both sides.
    """
    return left.join(right, number)


def pair_parsed(left: DataFrame, right: DataFrame) -> DataFrame:
    """Parsed numbered lines (line_number, value, record) of two files, line i with line i.

    Gives line_number and, for each side, its line and record. Take the result apart with
    good_pairs and bad_pairs.
    """
    sides = [
        df.select("line_number", F.col("value").alias(f"{name}_line"), F.col("record").alias(f"{name}_record"))
        for name, df in (("left", left), ("right", right))
    ]
    return pair_by_position(*sides)


def good_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs of which both lines were readable: line_number and both records."""
    both = F.col("left_record").isNotNull() & F.col("right_record").isNotNull()
    return pairs.filter(both).select("line_number", "left_record", "right_record")


def bad_pairs(pairs: DataFrame) -> DataFrame:
    """Error rows of pairs with an unreadable line: line_number, error and both lines."""
    either = F.col("left_record").isNull() | F.col("right_record").isNull()
    return pairs.filter(either).select(
        "line_number", F.lit("JSON Decode Error").alias("error"), "left_line", "right_line"
    )
