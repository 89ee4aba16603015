"""Size checks and lineage cuts shared by the multi-pass jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest text column that is broadcast, in bytes.
TEXT_BYTES = 200_000_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the session's checkpoint folder; only local sessions get one of their own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="personaloom-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def cut(df: DataFrame) -> DataFrame:
    """Store the rows in the checkpoint folder, so later passes neither recompute nor lose them."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """As cut(), for texts: a compressed table, of which later passes read the columns that they need."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/kept-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, rows: int, text: str | None = None, max_bytes: int = TEXT_BYTES) -> bool:
    """True where the table has at most `rows` rows, and its `text` column at most `max_bytes` bytes.

    Counts in place: each task sends two numbers. Call it on stored tables, which it doesn't compute anew.
    """
    size = F.coalesce(F.sum(F.octet_length(text)), F.lit(0)) if text else F.lit(0)
    found = df.agg(F.count(F.lit(1)).alias("n"), size.alias("b")).first()
    return found["n"] <= rows and found["b"] <= max_bytes


def committed(spark: SparkSession, path: str) -> bool:
    """Whether a job has written `path` to its end: the marker that file sinks leave last."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)
