"""Seeded shuffles, stratified samples, repetition and first-row rules.

All draws are ordered by md5(seed, key), so a sample does not depend on
partitioning and can be drawn again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from personaloom.functions.draws import order_hash, stable_uuid
from personaloom.operators.pairing import rows_between

# Up to this many rows a sort keeps the top rows per task; beyond it, hash ranges are counted first.
TOP_ROWS = 1000


def _hash_range(h: Column) -> Column:
    return F.conv(F.substring(h, 1, 4), 16, 10).cast("int")


def _lowest_hashes(df: DataFrame, strata: list[str], quota: DataFrame | int) -> DataFrame:
    """The `quota` rows of each stratum with the lowest `_hash`, for quotas of any size.

    Counts rows per hash range, keeps whole ranges below the quota and ranks
    only the rows of the one range where it is reached. `quota` is a number, or
    a small table of the strata columns and `quota`.
    """
    rows = df.withColumn("_range", _hash_range(F.col("_hash")))
    counts = rows.groupBy(*strata, "_range").agg(F.count(F.lit(1)).alias("_n"))
    running = F.sum("_n").over(Window.partitionBy(*strata).orderBy("_range"))
    sums = counts.withColumn("_upto", running)
    sums = (
        sums.withColumn("quota", F.lit(quota))
        if isinstance(quota, int)
        else sums.join(F.broadcast(quota), strata)
    )
    # one row per stratum: the first range in which the quota is reached, or none
    reached = F.col("_upto") >= F.col("quota")
    edge = sums.groupBy(*strata).agg(
        F.min(F.when(reached, F.col("_range"))).alias("_edge"),
        F.min_by(
            F.when(reached, F.col("quota") - F.col("_upto") + F.col("_n")),
            F.when(reached, F.col("_range")),
        ).alias("_need"),
    )
    # strata are named by the caller, so `edge` has a row for each of them at most
    marked = rows.join(F.broadcast(edge), strata)
    below = marked.filter(F.col("_edge").isNull() | (F.col("_range") < F.col("_edge")))
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy("_hash", "_key"))
    at_edge = (
        marked.filter(F.col("_range") == F.col("_edge"))
        .withColumn("_rank", rank)
        .filter(F.col("_rank") <= F.col("_need"))
        .drop("_rank")
    )
    return below.unionByName(at_edge).drop("_range", "_edge", "_need")


def shuffle_take(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The first `n` rows of a seeded shuffle, in shuffled order. `key` is unique."""
    hashed = df.withColumns({"_hash": order_hash(key, seed), "_key": F.col(key)})
    if n > TOP_ROWS:
        # one stratum; its key is the same for all rows, but no literal, so the join stays an equi join
        hashed = hashed.withColumn("_all", F.length("_hash"))
        hashed = _lowest_hashes(hashed, ["_all"], n).drop("_all")
        return hashed.orderBy("_hash", "_key").drop("_hash", "_key")
    return hashed.orderBy("_hash", "_key").limit(n).drop("_hash", "_key")


def quotas(types: list[str], total: int) -> dict[str, int]:
    """Split `total` evenly over the types in alphabetical order; the first ones take the rest."""
    names = sorted(set(types))
    each, rest = divmod(total, len(names))
    return {t: each + (1 if i < rest else 0) for i, t in enumerate(names)}


def stratified_sample(
    df: DataFrame,
    types: list[str],
    total: int,
    key: str = "id",
    type_col: str = "content_type",
    seed: int = 42,
) -> DataFrame:
    """An even sample over content types with fresh ids; `source_key` keeps the old key.

    A type with too few rows gives what it has (see `sample_shortfall`).
    """
    shares = quotas(types, total)
    spark = df.sparkSession
    dim = spark.createDataFrame(
        [(t, q) for t, q in shares.items()], f"`{type_col}` string, quota bigint"
    )
    hashed = df.filter(F.col(type_col).isin(list(shares))).withColumns(
        {"_hash": order_hash(key, seed), "_key": F.col(key)}
    )
    most = max(shares.values())
    if most <= TOP_ROWS:
        rank = F.row_number().over(Window.partitionBy(type_col).orderBy("_hash", "_key"))
        # the literal bound lets each task drop all but its own first rows before the shuffle
        drawn = (
            hashed.withColumn("_rank", rank)
            .filter(F.col("_rank") <= most)
            .join(F.broadcast(dim), type_col)
            .filter(F.col("_rank") <= F.col("quota"))
            .drop("_rank", "quota")
        )
    else:
        drawn = _lowest_hashes(hashed, [type_col], dim)
    new_id = stable_uuid(f"sample-{seed}", F.col("_key"))
    return drawn.drop("_hash").withColumn(key, new_id).withColumnRenamed("_key", "source_key")


def sample_shortfall(
    df: DataFrame, types: list[str], total: int, type_col: str = "content_type"
) -> DataFrame:
    """Per type: quota, available rows and how many are missing."""
    shares = quotas(types, total)
    dim = df.sparkSession.createDataFrame(
        [(t, q) for t, q in shares.items()], f"`{type_col}` string, quota bigint"
    )
    have = df.groupBy(type_col).agg(F.count(F.lit(1)).alias("available"))
    out = dim.join(have, type_col, "left").withColumn(
        "available", F.coalesce("available", F.lit(0))
    )
    return out.withColumn("missing", F.greatest(F.col("quota") - F.col("available"), F.lit(0)))


def repeat_rows(df: DataFrame, times: int, copy: str | None = None) -> DataFrame:
    """Every row `times` times in a row; `copy` names a column with the copy number."""
    name = copy or "_copy"
    out = df.withColumn(name, F.explode(F.sequence(F.lit(1), F.lit(times))))
    return out if copy else out.drop(name)


def keep_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the first in the given order. Each task drops all but its own first rows early."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def top_values(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """Value counts, most frequent first, ties by value."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(column).agg(
        F.count(F.lit(1)).alias("count")
    )
    ordered = counted.orderBy(F.desc("count"), column)
    return ordered if n is None else ordered.limit(n)


def skip_take(df: DataFrame, key: str | list[str], skip: int = 0, take: int | None = None) -> DataFrame:
    """Leave out the first `skip` rows in the order of a unique key, then keep the next `take`.

    The key is a column of any type that sorts, or several.
    """
    return rows_between(df, key, skip + 1, None if take is None else skip + take)
