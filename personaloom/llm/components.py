"""Connected components of a table of edges: contraction inside tasks, and alternating stars between them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from personaloom.llm.storage import stored


#: Edges that one task contracts.
TASK_EDGES = 500_000


def _contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ties every node of the task's edges to the smallest node that they connect it with."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        path = []
        while root.setdefault(x, x) != x:
            path.append(x)
            x = root[x]
        for p in path:
            root[p] = x
        return x

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = top(u), top(v)
            if a != b:
                root[max(a, b)] = min(a, b)
    nodes = [x for x in root if top(x) != x]
    yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array([root[x] for x in nodes], pa.int64())], ["u", "v"])


def _min_of(edges: DataFrame, with_self: bool) -> DataFrame:
    low = F.min("v")
    return edges.groupBy("u").agg((F.least(low, F.col("u")) if with_self else low).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest one around it."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    tied = both.filter(F.col("v") > F.col("u")).join(_min_of(both, True), "u")
    return tied.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    low = _min_of(edges, True)
    tied = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """node and component (its smallest node) of every node of `edges` (u, v: long).

    A round contracts the edges inside tasks of at most about `task_edges` of them, which leaves a tree of
    depth one for what each task connects. If there are more tasks than one, a large and a small star step,
    two joins, bring the trees of different tasks together, and rounds go on until one changes nothing.
    Each round is a written table. Nulls and loops are left out; an empty table gives an empty one.
    """
    kept = edges.filter("u is not null and v is not null and u <> v")
    now = stored(kept.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        found = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if found["n"] == 0 or (found["n"], found["s"]) == mark:
            break
        mark = (found["n"], found["s"])
        tasks = -(-found["n"] // task_edges)
        local = now.select(F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v"))
        local = local.repartition(tasks).mapInArrow(_contract, "u bigint, v bigint")
        now = stored(local if tasks == 1 else _small_star(_large_star(local)))
        if tasks == 1:
            break
    own = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return own.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
