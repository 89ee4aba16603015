"""Exact top-k search by inner product: a KD-tree per shard, searched best first under a bound that is passed on."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from personaloom.llm.storage import stored

SHARD_ROWS = 4096
BLOCK_QUERIES = 256
# Vectors whose trees one task holds at a time, in bytes, and the fewest tasks a core.
LANE_BYTES = 1 << 25
LANES_PER_CORE = 16
_LEAF = 64
_EXACT = 2.0**53


@dataclass
class Tree:
    """Vectors in leaf order, their ids, and nodes: rows from, to, children, box corners and the smallest id."""

    ids: np.ndarray
    vectors: np.ndarray
    nodes: list[tuple[int, int, int, int]]
    low: np.ndarray
    high: np.ndarray
    least: np.ndarray


def build(ids: np.ndarray, vectors: np.ndarray) -> Tree:
    """Median splits along the widest side of each node's tight bounding box, down to leaves of at most _LEAF rows."""
    order = np.arange(len(ids))
    nodes: list[list[int]] = []
    low, high, least = [], [], []

    def grow(a: int, b: int) -> int:
        rows = vectors[order[a:b]]
        me = len(nodes)
        nodes.append([a, b, -1, -1])
        low.append(rows.min(0, initial=np.inf))
        high.append(rows.max(0, initial=-np.inf))
        least.append(int(ids[order[a:b]].min()))
        spread = high[me] - low[me]
        if b - a > _LEAF and len(spread) and spread.max() > 0:
            middle = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(rows[:, int(spread.argmax())], middle)]
            nodes[me][2] = grow(a, a + middle)
            nodes[me][3] = grow(a + middle, b)
        return me

    grow(0, len(ids))
    return Tree(ids[order], vectors[order], [tuple(n) for n in nodes], np.array(low), np.array(high), np.array(least))


def search(tree: Tree, query: np.ndarray, own: int, k: int, floor: tuple[int, int] | None) -> list[tuple[int, int]]:
    """The (score, -id) pairs of the shard that can be among the query's k best; `floor` is a kth pair known so far.

    A node's bound is the largest inner product that its box allows, with the smallest id in it; the search
    takes the best node first and ends when none can beat the kth pair.
    """
    bounds = np.maximum(query * tree.low, query * tree.high).sum(1) if len(query) else np.zeros(len(tree.nodes))
    best: list[tuple[int, int]] = []
    heap = [(-bounds[0], int(tree.least[0]), 0)]
    while heap:
        bound, least, node = heapq.heappop(heap)
        limit = max([x for x in (floor, best[0] if len(best) == k else None) if x is not None], default=None)
        if limit is not None and (-bound, -least) < limit:
            if -bound < limit[0]:
                break
            continue
        a, b, left, right = tree.nodes[node]
        if left >= 0:
            for child in (left, right):
                heapq.heappush(heap, (-bounds[child], int(tree.least[child]), child))
            continue
        scores = tree.vectors[a:b] @ query if len(query) else np.zeros(b - a)
        for i in np.flatnonzero(scores >= (limit[0] if limit is not None else -np.inf)).tolist():
            pair = (int(scores[i]), -int(tree.ids[a + i]))
            if pair[1] == -own or (limit is not None and pair < limit):
                continue
            if len(best) < k:
                heapq.heappush(best, pair)
            elif pair > best[0]:
                heapq.heapreplace(best, pair)
    return best


def exact_search(tree: Tree, query: np.ndarray, own: int, k: int, floor: tuple[int, int] | None) -> list[tuple[int, int]]:
    """As search(), for numbers whose products floats don't hold: every row of the shard, in whole numbers.

    Scores beyond a long count as its nearest end.
    """
    q = [int(x) for x in query]
    best: list[tuple[int, int]] = []
    for name, row in zip(tree.ids.tolist(), tree.vectors, strict=True):
        score = sum(a * int(b) for a, b in zip(q, row, strict=True))
        pair = (max(-(2**63), min(2**63 - 1, score)), -name)
        if name == own or (floor is not None and pair < floor):
            continue
        if len(best) < k:
            heapq.heappush(best, pair)
        elif pair > best[0]:
            heapq.heapreplace(best, pair)
    return best


def _scaled(vectors: DataFrame) -> DataFrame:
    """vec_id, v (floor of 1024 times each component, as longs) and dim; rows with null or non-finite parts left out.

    Repeated (vec_id, vector) rows are one.
    """
    v = F.transform("embedding", lambda x: F.floor(F.lit(1024) * x.cast("double")))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    kept = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    return kept.select("vec_id", v.cast("array<bigint>").alias("v")).distinct().withColumn("dim", F.size("v"))


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), dim).astype(np.float64)


def _answers(batch: pa.RecordBatch, dim: int, trees: list[tuple[Tree, float]], k: int) -> pa.RecordBatch | None:
    """The pairs of each query of the batch that can be among its k best, from all trees together.

    The kth pair found so far, or the one that came with the query, cuts the search of the next tree.
    """
    found = []
    columns = [batch.column(c).to_pylist() for c in ("id", "score", "vec_id")]
    for name, score, other, query in zip(*columns, _matrix(batch.column("v"), dim), strict=True):
        floor = None if score is None else (score, -other)
        largest, best = float(np.abs(query).max(initial=0.0)), []
        for tree, reach in trees:
            find = exact_search if reach * largest >= _EXACT else search
            best = heapq.nlargest(k, best + find(tree, query, name, k, floor))
            if len(best) == k:
                floor = max(floor, best[-1]) if floor else best[-1]
        found += [(name, -neg, score) for score, neg in best]
    return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["query_id", "vec_id", "score"]) if found else None


def _look(k: int, begin: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task: the vectors of a lane's shards, then its queries, row by row. `begin`: a query meets its first shard alone, else all others."""

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, parts, trees = None, {}, {}

        def tree(shard: int) -> tuple[Tree, float]:
            if shard not in trees:
                ids, vectors = (np.concatenate(x) for x in zip(*parts.pop(shard), strict=True))
                trees[shard] = build(ids, vectors), float(np.abs(vectors).max(initial=0.0)) * vectors.shape[1]
            return trees[shard]

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("dim", "lane", "asks", "shard")])
            edges = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(0))[: batch.num_rows])
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), batch.num_rows], strict=True):
                dim, lane, asks, shard = keys[:, a].tolist()
                if here != (dim, lane):
                    here, parts, trees = (dim, lane), {}, {}
                part = batch.slice(a, b - a)
                if not asks:
                    parts.setdefault(shard, []).append((part.column("id").to_numpy(), _matrix(part.column("v"), dim)))
                    continue
                wanted = [s for s in sorted({*parts, *trees}) if (s == shard) == begin]
                if (found := _answers(part, dim, [tree(s) for s in wanted], k)) is not None:
                    yield found

    return look


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score: the k best inner products of every vector whose id `every` divides.

    Vectors are dealt to shards of about `shard_rows` by a hash, whatever their values, and each shard becomes
    one tree. Queries go in blocks. Each block first searches one shard; the kth pair that a query finds there
    goes along to all other shards, where it cuts the search from the start.

    A lane is a few shards: a task gets their vectors, plants the trees and then reads the queries as a stream. So
    a row holds one vector, never a tree or a block, and a query travels once per lane, not once per shard. Each
    lane returns k pairs per query at most, and a window limit keeps k of them.

    Vectors of different lengths never meet. A query with fewer candidates than k gets all. Ties go to the
    smaller id; rows of the query's own id are no candidates. Where scores may reach 2**53 they are summed as
    whole numbers, row by row; scores and components beyond a long count as its nearest end.
    """
    rows = stored(_scaled(vectors))
    dims = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    asked = rows.filter(F.col("vec_id") % every == 0)
    blocks = {r["dim"]: max(1, -(-r["n"] // block_queries)) for r in asked.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not blocks:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("bigint").alias("score")).limit(0)
    shards = {d: max(1, -(-dims[d] // shard_rows)) for d in blocks}
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    held = {d: max(1, LANE_BYTES // (8 * shard_rows * max(1, d))) for d in blocks}  # shards of a lane at most
    lanes = {d: max(-(-n // held[d]), min(n, LANES_PER_CORE * cores)) for d, n in shards.items()}

    def per_dim(numbers: dict[int, int]) -> Column:
        return F.create_map(*[F.lit(x) for item in numbers.items() for x in item])[F.col("dim")]

    lane = F.pmod(F.col("shard"), per_dim(lanes)).alias("lane")
    no = F.lit(None).cast("bigint")
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), per_dim(shards))).filter(per_dim(shards).isNotNull())
    dealt = dealt.select("dim", lane, F.lit(0).alias("asks"), "shard", F.col("vec_id").cast("bigint").alias("id"), "v", no.alias("score"), no.alias("vec_id"))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), per_dim(blocks)))
    asked = asked.withColumn("shard", F.pmod(F.xxhash64("dim", "block"), per_dim(shards)))
    asked = asked.select("dim", F.lit(1).alias("asks"), "shard", F.col("vec_id").cast("bigint").alias("id"), "v")

    def met(queries: DataFrame, begin: bool) -> DataFrame:
        together = dealt.unionByName(queries).repartition(sum(lanes.values()), "dim", "lane")
        return together.sortWithinPartitions("dim", "lane", "asks", "shard").mapInArrow(_look(k, begin), "query_id bigint, vec_id bigint, score bigint")

    begun = stored(met(asked.select("*", lane, no.alias("score"), no.alias("vec_id")), begin=True))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = begun.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k).drop("rank")
    known = asked.join(kth.withColumnRenamed("query_id", "id"), "id", "left")
    # every query visits every lane of its length, and there every shard but the one it began with
    visits = known.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("bigint"), per_dim(lanes) - 1)))
    every_pair = begun.unionByName(met(visits, begin=False))
    return every_pair.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
