"""Sources mixed to target weights by thresholds on hashed places: sums by bucket, no sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from personaloom.llm.repeats import with_repeats
from personaloom.llm.storage import stored

#: Weights of the sources in order, repeating; how often a source may be used up.
WEIGHTS, MOST = (1, 2, 3), 3
#: Hashed places have 36 bits; each level of buckets looks at 12 more.
LEVELS = (24, 12, 0)
SOURCES_BROADCAST = 100_000


def words() -> Column:
    """The number of `[^\\x20\\x09-\\x0D]+` in the text; null has none."""
    return F.coalesce(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def digest() -> Column:
    """A digest of doc_id and text, the same in every run and engine."""
    return F.md5(F.concat_ws(":", *(F.coalesce(c, F.lit("null")) for c in (F.col("doc_id").cast("string"), F.md5("text")))).cast("binary"))


def key() -> Column:
    """Equal for rows of one doc_id, text and source."""
    return F.xxhash64(digest(), F.coalesce("source", F.lit("")), F.col("source").isNull())


def place() -> Column:
    """36 bits of a digest of a row's `digest` and `repeat`."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", "digest", "repeat").cast("binary")), 1, 9), 16, 10).cast("bigint")


def _placed(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns, size and place of every row; copies of a row have places of their own."""
    slim = stored(docs.select(*names, words().alias("size"), digest().alias("digest"), key().alias("key")))
    return stored(with_repeats(slim, "key").select(*names, "size", place().alias("place")))


def targets(sums: DataFrame) -> DataFrame:
    """Adds `target` to (source, source_size): shares of all sizes by weight, none above MOST times its source.

    Sources are taken by how soon they fill up; the first that does not fill up fixes the level of all later.
    The windows run over one row per source.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in WEIGHTS])
    ranked = sums.withColumn("_w", F.get(cycle, (F.row_number().over(in_order) - 1) % len(WEIGHTS)))
    ranked = ranked.withColumn("_cap", F.col("source_size") * MOST)
    ratio = F.col("_cap") / F.col("_w")
    up = Window.orderBy(ratio, F.col("source").asc_nulls_last())
    before, whole = up.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    weight = F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0))
    ranked = ranked.withColumns({"_ratio": ratio, "_level": left / weight})
    ranked = ranked.withColumn("_stop", F.min(F.when(F.col("_ratio") > F.col("_level"), F.col("_ratio"))).over(whole))
    level = F.max(F.when(F.col("_ratio") == F.col("_stop"), F.col("_level"))).over(whole)
    ranked = ranked.withColumn("_level", level)
    target = F.when(F.col("_ratio") >= F.col("_stop"), F.col("_w") * F.col("_level")).otherwise(F.col("_cap").cast("double"))
    return ranked.select("source", "source_size", target.alias("target"))


def budgets(rows: DataFrame) -> DataFrame:
    """source, source_size, target, passes (whole uses of the source) and cut: rows below it are used once more.

    Each level sums sizes by source and bucket, inside the boundary bucket of the level before only, and keeps
    as many buckets as fit the rest of the target. `rows`: source, size, place.
    """
    state = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    state = state.withColumn("passes", passes).withColumn("_rest", F.col("target") - F.col("passes") * F.col("source_size"))
    state = stored(state.withColumn("cut", F.lit(0).cast("bigint")))
    for level in LEVELS:
        small = state.count() <= SOURCES_BROADCAST
        key = state.select(F.col("source").alias("_s"), "cut", "_rest")
        joined = rows.join(F.broadcast(key) if small else key, F.col("source").eqNullSafe(F.col("_s")))
        inside = joined.filter((F.col("place") >= F.col("cut")) & (F.col("place") < F.col("cut") + (1 << (level + 12))))
        sums = inside.groupBy("_s", "cut", "_rest", F.shiftright("place", level).alias("_bucket")).agg(F.sum("size").alias("_size"))
        run = Window.partitionBy("_s").orderBy("_bucket")  # at most 4096 buckets a source
        sums = sums.withColumn("_sum", F.sum("_size").over(run))
        over = F.col("_sum") > F.col("_rest")
        found = sums.groupBy("_s").agg(
            F.min(F.when(over, F.col("_bucket"))).alias("_at"), F.coalesce(F.max(F.when(~over, F.col("_sum"))), F.lit(0)).alias("_used")
        )
        state = state.join(found, F.col("source").eqNullSafe(F.col("_s")), "left").select(
            "source",
            "source_size",
            "target",
            "passes",
            (F.col("_rest") - F.coalesce("_used", F.lit(0))).alias("_rest"),
            F.when(F.col("_at").isNull(), F.col("cut") + (1 << (level + 12))).otherwise(F.shiftleft("_at", level)).alias("_cut"),
        )
        # where all buckets fit, the cut stands at their end and later levels find nothing to refine
        state = stored(state.withColumnRenamed("_cut", "cut"))
    return state.drop("_rest")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target and copies (times the document is used, 0 to MOST) of every row.

    Sources count by code point, null last. A row's place follows from its doc_id, its text and its number among
    rows equal in both and in source, so a target cuts between copies and between rows without ids as it does
    between others: each source's used words miss its target by less than one document. Reruns use as many of
    equal rows. Texts without words have size 0. An empty table gives an empty one. Other columns are left out.
    """
    rows = _placed(docs, "doc_id", "source")
    return _copies(rows, rows).select("doc_id", "source", "size", "source_size", "target", "copies")


def _copies(docs: DataFrame, rows: DataFrame) -> DataFrame:
    found = budgets(rows)
    small = found.count() <= SOURCES_BROADCAST
    found = found.withColumnRenamed("source", "_source")
    both = docs.join(F.broadcast(found) if small else found, F.col("source").eqNullSafe(F.col("_source")))
    # texts without words fit any rest, also that of a source which is used up
    copies = F.col("passes") + (F.col("place") < F.col("cut")).cast("bigint")
    return both.withColumn("copies", F.least(copies, F.lit(MOST).cast("bigint")))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: every row of `docs` as often as the mix uses it, with all its columns.

    Rows equal in doc_id, text and source are told apart by a digest of their other columns.
    """
    rows = _placed(docs, "source")
    named = docs.select(F.struct(*docs.columns).alias("_row"), "source", digest().alias("digest"), key().alias("key"))
    named = with_repeats(named, "key", F.xxhash64(F.to_json("_row"))).withColumn("place", place())
    used = _copies(named, rows).filter("copies > 0")
    return used.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")
