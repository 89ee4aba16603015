"""Readers for JSON lines, tab-separated files and line-numbered text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from personaloom.plans.lineage import cut, fits

BAD_LINE = "_bad_line"
# Up to this many splits a table counts as small, at 128 MB a split by default.
SMALL_SPLITS = 64
# Largest table of file splits that is broadcast, in rows.
SPLIT_ROWS = 1_000_000


def read_json_lines(
    spark: SparkSession, path: str, schema: str | T.StructType, on_bad: str = "split"
) -> DataFrame:
    """Read JSON lines; blank lines are dropped.

    on_bad 'split' keeps unreadable lines in the `_bad_line` column (take them
    apart with good_rows and bad_rows), 'skip' drops them and 'fail' stops the
    job at the first one.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if on_bad == "fail":
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if on_bad not in ("split", "skip"):
        raise ValueError("on_bad must be 'split', 'skip' or 'fail'")
    wide = T.StructType([*schema.fields, T.StructField(BAD_LINE, T.StringType())])
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    parsed = F.from_json(
        "value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_LINE}
    )
    rows = lines.select(parsed.alias("r")).select("r.*")
    return good_rows(rows) if on_bad == "skip" else rows


def good_rows(rows: DataFrame) -> DataFrame:
    """The readable rows of a 'split' read."""
    return rows.filter(F.col(BAD_LINE).isNull()).drop(BAD_LINE)


def bad_rows(rows: DataFrame) -> DataFrame:
    """Error rows of a 'split' read: the error and the original line."""
    return rows.filter(F.col(BAD_LINE).isNotNull()).select(
        F.lit("JSON Decode Error").alias("error"), F.col(BAD_LINE).alias("original_line")
    )


def read_numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_number, value) of text files, counted through all files in path order; blanks count.

    The files are read once and stored with each line's split and place, so
    the count and the numbers rest on one and the same cut into splits, whatever
    settings or executors change later. Lines are counted per split; no line is moved.
    """
    lines = cut(
        spark.read.text(path).select(
            "value",
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_at"),
        )
    )
    # a task reads a split from front to back, so `_at` minus its minimum is the place in the split
    splits = lines.groupBy("_file", "_start").agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    # one row per file split
    before = F.sum("_n").over(Window.orderBy("_file", "_start")) - F.col("_n")
    offsets = cut(splits.select("_file", "_start", "_first", before.alias("_before")))
    side = F.broadcast(offsets) if fits(offsets, SPLIT_ROWS) else offsets
    numbered = lines.join(side, ["_file", "_start"])
    number = F.col("_before") + F.col("_at") - F.col("_first") + 1
    return numbered.select(number.alias("line_number"), "value")


def parse_numbered(lines: DataFrame, schema: str | T.StructType) -> DataFrame:
    """Parse numbered lines to a `record` struct; unreadable lines keep their number and get null."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    wide = T.StructType([*schema.fields, T.StructField(BAD_LINE, T.StringType())])
    parsed = F.from_json(
        "value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_LINE}
    )
    staged = lines.withColumn("_r", parsed)
    good = F.col("_r").isNotNull() & F.col(f"_r.{BAD_LINE}").isNull() & (F.trim("value") != "")
    fields = F.struct(*[F.col("_r").getField(f.name).alias(f.name) for f in schema.fields])
    return staged.withColumn("record", F.when(good, fields)).drop("_r")


def numbered_errors(parsed: DataFrame) -> DataFrame:
    """Error rows of `parse_numbered`: line_number, error and original_line; blank lines are none."""
    return parsed.filter(F.col("record").isNull() & (F.trim("value") != "")).select(
        "line_number", F.lit("JSON Decode Error").alias("error"), F.col("value").alias("original_line")
    )


_TSV = {"sep": "\t", "quote": '"', "escape": '"', "maxCharsPerColumn": "-1"}


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """`record` and `first` of text files whose quoted cells may hold line breaks; blank records are left out.

    A line starts a record where the quotes before it in its file are even in number. Each split counts its
    own quotes, a sum over the splits before gives the parity it starts with, and records are cut inside splits, so one
    large file is read by many tasks. Only records of several lines are put together. `first` marks the first
    record of a file. Quotes inside a quoted cell are doubled, and cells without quotes around them hold none. The
    lines are stored once, with their split and place.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"),
        F.pmod(quotes, F.lit(2)).alias("_odd"),
    )
    split = Window.partitionBy("_file", "_start").orderBy("_at")
    before = F.pmod(F.sum("_odd").over(split) - F.col("_odd"), F.lit(2))
    lines = lines.withColumn("_in", before)
    # line numbers among those that start a record if the split starts outside of quotes, or inside
    lines = lines.withColumns({f"_n{k}": F.sum(F.when(F.col("_in") == k, 1).otherwise(0)).over(split) for k in (0, 1)})
    lines = cut(lines)
    splits = lines.groupBy("_file", "_start").agg(F.sum("_odd").alias("_odds"), F.max("_n0").alias("_m0"), F.max("_n1").alias("_m1"))
    # one row per file split
    order = Window.partitionBy("_file").orderBy("_start")
    splits = splits.withColumn("_base", F.pmod(F.sum("_odds").over(order) - F.col("_odds"), F.lit(2)))
    starts = F.when(F.col("_base") == 0, F.col("_m0")).otherwise(F.col("_m1"))
    last = F.when(starts > 0, F.struct(F.col("_start").alias("start"), starts.alias("n")))
    owner = F.last(last, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    splits = cut(splits.select("_file", "_start", "_base", owner.alias("_owner")))
    side = F.broadcast(splits) if fits(splits, SPLIT_ROWS) else splits
    number = F.when(F.col("_base") == 0, F.col("_n0")).otherwise(F.col("_n1"))
    own = F.struct(F.col("_start").alias("start"), number.alias("n"))
    placed = lines.join(side, ["_file", "_start"]).select(
        "value",
        "_at",
        (F.pmod(F.col("_base") + F.col("_in"), F.lit(2)) == 0).alias("_starts"),
        (F.pmod(F.col("_base") + F.col("_in") + F.col("_odd"), F.lit(2)) == 0).alias("_ends"),
        "_file",
        F.when(number > 0, own).otherwise(F.col("_owner")).alias("_record"),
    )
    first = ((F.col("_record.start") == 0) & (F.col("_record.n") == 1)).alias("first")
    plain = F.regexp_replace("value", "\r$", "").alias("record")
    whole = placed.filter("_starts and _ends").select(plain, first)
    parts = placed.filter("not (_starts and _ends)").groupBy("_file", "_record").agg(F.array_sort(F.collect_list(F.struct("_at", "value"))).alias("_l"))
    parts = parts.withColumn("_l", F.transform("_l", lambda x: x["value"]))
    # files whose lines end in CR LF: the line breaks inside their cells are read as LF, like others
    crlf = F.element_at("_l", -1).endswith("\r")
    joined = F.array_join(F.when(crlf, F.transform("_l", lambda x: F.regexp_replace(x, "\r$", ""))).otherwise(F.col("_l")), "\n")
    return whole.unionByName(parts.select(joined.alias("record"), first)).filter(F.length(F.trim("record")) > 0)


def read_tsv(
    spark: SparkSession, path: str, schema: str | T.StructType | None = None, multiline: bool = True
) -> DataFrame:
    """Tab-separated text with a header in each file; all columns STRING, by position if `schema` names them.

    With `multiline`, quoted cells may hold line breaks: records are found by `quoted_records`, in as many
    tasks as the files have splits. Files whose cells hold no line breaks, as JSON cells do, are read without it.
    """
    reader = spark.read.options(**_TSV).option("header", True)
    if not multiline:
        return (reader.schema(schema) if schema else reader).csv(path)
    if schema is None:
        names = reader.csv(path).columns  # one job that reads the head of a file
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    records = quoted_records(spark, path).filter(~F.col("first"))
    return records.select(F.from_csv("record", ddl, _TSV).alias("r")).select("r.*")


def read_corpus_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Corpus rows whose text cell is JSON: no quoting at file level, so files split at every line."""
    reader = spark.read.option("sep", "\t").option("header", True).option("quote", "")
    reader = reader.option("maxCharsPerColumn", -1)
    return reader.schema("UniqueID string, ContentType string, Text string").csv(path)


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Only the named columns of a parquet table."""
    return spark.read.parquet(path).select(*columns)


def read_spread(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table for work that is heavy per row.

    A table of a few file splits would keep most cores idle, so it is dealt out
    to all of them. Tables with more splits than cores, or with more than
    SMALL_SPLITS, are read as they are.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, SMALL_SPLITS) else df
