"""Written tables that cut lineage, and the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new path under the session's spark.checkpoint.dir; only local sessions get a folder of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="personaloom-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again: no later step recomputes or loses them."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_bytes(df: DataFrame, *texts: str, fixed: int = 64) -> int:
    """Bytes of a table by a distributed count: a fixed share for each row, and its text columns."""
    size = F.count(F.lit(1)) * fixed
    for name in texts:
        size = size + F.coalesce(F.sum(F.octet_length(name)), F.lit(0))
    return df.agg(size.alias("b")).first()["b"]
