"""Corpus rows, cohort texts and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from personaloom.functions.handles import parse_handles
from personaloom.functions.rows import compute_where
from personaloom.functions.text import (
    decode_json_cell,
    decode_json_cell_or_empty,
    int_or_zero,
    strip_blanks,
)
from personaloom.operators.blocks import attribute_for_cohort, attribute_on_repair


def flatten_corpus(
    records: DataFrame,
    id_col: str = "unique_id",
    passage_col: str = "generated_synthetic_passage",
    pairs_col: str = "content_pairs",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One `Article` row per non-empty passage and one row per non-empty pair, in one scan.

    `keep` names further record columns to carry along; `item` is the place in the record.
    """
    p, pairs = F.col(passage_col), F.col(pairs_col)
    article = F.when(
        p != "", F.array(F.struct(F.lit("Article").alias("ContentType"), p.alias("Text")))
    )
    none = F.expr("cast(array() as array<struct<ContentType:string,Text:string>>)")
    items = F.concat(
        F.coalesce(article, none),
        F.coalesce(F.filter(pairs, lambda x: x["Text"] != ""), none),
    )
    flat = records.select(F.col(id_col).alias("id"), *keep, F.posexplode(items).alias("item", "_p"))
    return flat.select(
        "id",
        *keep,
        "item",
        F.col("_p.ContentType").alias("content_type"),
        strip_blanks(F.col("_p.Text")).alias("text"),
    )


def in_cohort(
    locale: Column, age: Column, wanted_locale: str = "en_US", low: int = 20, high: int = 35
) -> Column:
    """Cohort test: one locale and an age range, both ends included; unreadable ages count as 0."""
    return (locale == wanted_locale) & int_or_zero(age).between(low, high)


def cohort_texts(
    records: DataFrame,
    id_col: str = "unique_id",
    order_by: tuple[str, ...] = ("unique_id",),
    limit: int | None = None,
    locale: str = "locale",
    age: str = "age",
    first_name: str = "first_name",
    last_name: str = "last_name",
    handles: str = "social_media_handles",
    pairs: str = "content_pairs",
) -> DataFrame:
    """One text per cohort record: its attributed texts joined by newline; empty ones left out.

    With `limit` the first records in `order_by` order are kept.
    """
    staged = (
        records.filter(in_cohort(F.col(locale), F.col(age)))
        .withColumn("_handles", parse_handles(F.col(handles)))
    )
    made = attribute_for_cohort(
        F.col(pairs), F.col("_handles"), F.col(first_name), F.col(last_name)
    )
    joined = F.array_join(F.transform(made, lambda p: p["Text"]), "\n")
    kept = [F.col(id_col).alias("unique_id"), *[c for c in order_by if c != "unique_id"]]
    out = compute_where(
        staged, kept, {"concat_content_pairs": joined}, lambda x: x["concat_content_pairs"] != ""
    )
    if limit is None:
        return out
    return out.orderBy(*order_by).limit(limit)


def repaired_contents(
    records: DataFrame,
    keep: tuple[str, ...] = ("unique_id",),
    first_name: str = "first_name",
    handles: str = "social_media_handles",
    pairs: str = "content_pairs",
) -> DataFrame:
    """`keep` columns and `all_content`, the attributed texts of a record; empty lists left out."""
    staged = records.withColumn("_handles", parse_handles(F.col(handles)))
    made = attribute_on_repair(F.col(pairs), F.col("_handles"), F.col(first_name))
    texts = F.transform(made, lambda p: p["Text"])
    return compute_where(
        staged, list(keep), {"all_content": texts}, lambda x: F.size(x["all_content"]) > 0
    )


def decode_corpus_text(corpus: DataFrame, text: str = "Text") -> DataFrame:
    """Decode JSON text cells to a single `text` column; unreadable cells become ''."""
    return corpus.select(decode_json_cell_or_empty(F.col(text)).alias("text"))


def decode_all_cells(table: DataFrame) -> DataFrame:
    """Decode every JSON-quoted cell of an all-string table; other cells stay as they are."""
    return table.select(*[decode_json_cell(F.col(f"`{c}`")).alias(c) for c in table.columns])


def as_string_record(
    records: DataFrame, columns: list[str] | None = None, info: str = "complete_info"
) -> DataFrame:
    """Cast columns to STRING with null as '', and attach the whole record as JSON text."""
    columns = columns or records.columns
    whole = F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"})
    casts = [
        F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in columns
    ]
    return records.select(*casts, whole.alias(info))


def end_of_text(texts: DataFrame, marker: str, text: str = "text") -> DataFrame:
    """Append the end marker to every text."""
    return texts.withColumn(text, F.concat(F.col(text), F.lit(marker)))
