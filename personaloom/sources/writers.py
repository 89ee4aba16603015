"""Sinks: JSON lines, tab-separated text, one folder per content type, parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from personaloom.functions.text import json_cell, safe_name


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines with null fields written out."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_corpus_tsv(corpus: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Corpus rows (id, content_type, text); the text is a JSON cell, so tabs and newlines are safe."""
    rows = corpus.select(
        F.col("id").alias("UniqueID"),
        F.col("content_type").alias("ContentType"),
        json_cell(F.col("text")).alias("Text"),
    )
    write_tsv(rows, path, mode, quoted=False)


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists", quoted: bool = True) -> None:
    """Tab-separated text with a header; `quoted=False` for cells that are already JSON."""
    writer = df.write.mode(mode).option("sep", "\t").option("header", True)
    if quoted:
        writer = writer.option("quote", '"').option("escape", '"')
    else:
        writer = writer.option("quote", "")
    writer.csv(path)


def write_per_type(
    details: DataFrame, path: str, type_col: str = "content_type", mode: str = "errorifexists"
) -> None:
    """One folder per content type, named by its sanitised value; a hot type gives many files."""
    named = details.withColumn("type_name", safe_name(F.col(type_col)))
    named.write.mode(mode).option("sep", "\t").option("header", True).option(
        "escape", '"'
    ).partitionBy("type_name").csv(path)


def write_table(
    df: DataFrame, path: str, schema: dict[str, str] | None = None, mode: str = "errorifexists"
) -> None:
    """Parquet with an explicit schema, given as column -> type."""
    out = df
    if schema:
        out = df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in schema.items()])
    out.write.mode(mode).parquet(path)


def write_stats(stats: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A small aggregate as one JSON file."""
    stats.coalesce(1).write.mode(mode).json(path)
