"""Corpus rows from records that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from personaloom.plans.corpus_build import build_corpus


def start_corpus_stream(records: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append corpus rows of new records to a parquet folder until the input is used up.

    Every step is local to a record, so no state is kept; `checkpoint` makes
    each record count once over restarts.
    """
    writer = build_corpus(records).writeStream.format("parquet").outputMode("append")
    return (
        writer.option("path", folder)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
