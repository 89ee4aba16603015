"""Token ids as ORC files: stripes of run-length encoded integers, row indexes, Bloom filters on document ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from personaloom.llm.batches import bounded
from personaloom.llm.pretokens import encoder
from personaloom.llm.storage import stored
from personaloom.llm.wordhash import list_column

STRIPE_BYTES = 16 << 20
INDEX_ROWS = 1000


def write_token_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Encodes `text` of every row and writes (doc_id, ids) as ORC in ascending doc_id order.

    Rows go to ranges of doc_id first, so the shuffle carries texts, not the larger ids; each range becomes a
    file. The rows of a file are sorted, so stripe and row-group statistics cut look-ups by id or id range, and
    Bloom filters cut look-ups of ids that a group lacks. Integer columns are run-length encoded by ORC itself.

    A null or empty text has the end id alone. Null ids come first; rows of one id stand together, by text.
    Other columns of `docs` are not written. An empty table gives a readable empty store.
    """

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(tokenizer)
        for batch in bounded(batches, "text"):
            ids, counts = pieces.encode(batch.column("text"))
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, end_id)
            yield pa.record_batch([batch.column("doc_id"), list_column(ids, counts + 1, pa.int32())], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    (
        ordered.mapInArrow(encode, f"doc_id {kind}, ids array<int>")
        .write.option("compression", "zstd")
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .option("orc.row.index.stride", str(INDEX_ROWS))
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def read_token_ids(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """(doc_id, ids) of a store. `where` on doc_id reaches the files: stripes and row groups outside it are skipped."""
    rows = spark.read.orc(path)
    return rows if where is None else rows.filter(where)


def document_spans(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of a store, read from its files stripe by stripe.

    `start` counts the ids of all documents before it: a sum inside each file, plus the totals of the files
    before it. Only the totals, a row for each file, meet in one task.
    """

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            edges = lists.offsets.to_numpy()
            values = lists.values.to_numpy().astype("<u4", copy=False)
            crc = [zlib.crc32(values[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("file"), pa.array(np.diff(edges).astype(np.int64)), pa.array(crc, pa.int64())],
                ["doc_id", "file", "n_tokens", "ids_crc32"],
            )

    rows = spark.read.orc(path)
    kind = rows.schema["doc_id"].dataType.simpleString()
    read = rows.select("doc_id", F.col("_metadata.file_name").alias("file"), "ids")
    each = stored(read.mapInArrow(digest, f"doc_id {kind}, file string, n_tokens bigint, ids_crc32 bigint"))
    files = each.groupBy("file").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last"), F.sum("n_tokens").alias("_all"))
    by_range = Window.orderBy(F.col("_first").asc_nulls_first(), F.col("_last").asc_nulls_first())
    files = files.select("file", (F.sum("_all").over(by_range) - F.col("_all")).alias("_before"))
    inside = Window.partitionBy("file").orderBy("doc_id", "n_tokens", "ids_crc32").rowsBetween(Window.unboundedPreceding, 0)
    return each.join(files, "file").select(
        "doc_id",
        (F.col("_before") + F.sum("n_tokens").over(inside) - F.col("n_tokens")).alias("start"),
        "n_tokens",
        "ids_crc32",
    )
