"""Numbers that tell equal rows apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from personaloom.llm.storage import stored

#: Rows that one window numbers.
BLOCK_ROWS = 20_000
BROADCAST_BYTES = 32_000_000


def with_repeats(rows: DataFrame, key: str, order: Column | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`rows` with `repeat`: 0, 1, ... among the rows of one `key` (not null), in `order` as far as blocks allow.

    Rows of a key that stands once pass as they are. The others are stored and numbered in blocks of about
    `block_rows`, dealt out by chance; the counts of a key's blocks before, a row per block, are added. So a key of any
    number of rows is split, and each number is given once whatever the partitions are.
    """
    counts = stored(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"))
    small = counts.count() * 32 <= BROADCAST_BYTES
    once, again = counts.select(key), counts
    if small:
        once, again = F.broadcast(once), F.broadcast(again)
    once = rows.join(once, key, "left_anti")
    many = stored(rows.join(again, key).withColumn("_id", F.monotonically_increasing_id()))
    share = F.pmod(F.xxhash64("_id"), F.ceil(F.col("_n") / F.lit(block_rows))).alias("_share")
    many = many.select("*", share)
    sizes = many.groupBy(key, "_share").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(key).orderBy("_share")
    sizes = sizes.select(key, "_share", (F.sum("_size").over(before) - F.col("_size")).alias("_before"))
    inside = Window.partitionBy(key, "_share").orderBy(*([order] if order is not None else []), "_id")
    numbered = many.withColumn("_at", F.row_number().over(inside) - 1).join(sizes, [key, "_share"])
    numbered = numbered.withColumn("repeat", (F.col("_before") + F.col("_at")).cast("bigint"))
    return once.withColumn("repeat", F.lit(0).cast("bigint")).unionByName(numbered.select(*once.columns, "repeat"))
