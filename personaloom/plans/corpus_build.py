"""From model outputs to corpus rows and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from personaloom.operators.blocks import add_content_pairs, passage
from personaloom.operators.corpus import flatten_corpus
from personaloom.operators.stats import content_type_stats
from personaloom.sources.writers import write_corpus_tsv, write_stats, write_table


def build_corpus(
    records: DataFrame,
    output: str = "model_output",
    passage_output: str = "passage_output",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Corpus rows of each record: its article and its attributed texts. One scan, no shuffle."""
    done = add_content_pairs(records, output).withColumn(
        "generated_synthetic_passage", passage(F.col(passage_output))
    )
    return flatten_corpus(done, keep=keep)


def write_corpus(records: DataFrame, folder: str) -> DataFrame:
    """Write corpus table, corpus TSV and statistics below `folder`; returns the stored corpus.

    Model outputs are parsed once, into a stored table that the rest reads.
    """
    spark = records.sparkSession
    write_table(add_content_pairs(records), f"{folder}/records")
    stored = spark.read.parquet(f"{folder}/records")
    rows = stored.withColumn("generated_synthetic_passage", passage(F.col("passage_output")))
    write_table(flatten_corpus(rows), f"{folder}/corpus")
    corpus = spark.read.parquet(f"{folder}/corpus")
    write_corpus_tsv(corpus, f"{folder}/corpus_tsv")
    write_stats(content_type_stats(stored), f"{folder}/stats")
    return corpus
