"""Ranked lexical search with per-term geometric blocking.

The index holds shards of documents. In a shard each posting list is cut into blocks of similar documents, and a
block stores the coordinatewise maximum of its documents' impacts. No document of a block scores more than the
block's maxima do, so a block is skipped only where that exact bound stays below the kth best score known; lists
whose terms cannot lift a document to that score without rarer ones are not opened. The kth scores that a first
look at each item's rarest lists finds go along to all shards.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from personaloom.llm.batches import bounded
from personaloom.llm.storage import row_bytes, stored
from personaloom.llm.wordhash import ALNUM, list_column, words_of

#: Item texts that are searched for at once; more items take further passes over the documents.
BLOCK_BYTES = 1_000_000
#: Bytes of a shard's matrix of impacts, documents by query terms, and its documents at most.
SHARD_BYTES, SHARD_DOCS = 32_000_000, 2048
#: Documents of a block of a posting list, on average.
BLOCK_DOCS = 32


@dataclass
class Items:
    """Items by number: their distinct terms as numbers, and how often each occurs; all terms' sorted hashes."""

    names: list
    hashes: np.ndarray
    terms: list[np.ndarray]
    times: list[np.ndarray]

    def around(self) -> list[np.ndarray]:
        """For each term the terms of all items that hold it: the coordinates that its blocks need."""
        out: list[list[np.ndarray]] = [[] for _ in self.hashes]
        for terms in self.terms:
            for t in terms.tolist():
                out[t].append(terms)
        return [np.unique(np.concatenate(x)) if x else np.empty(0, np.int64) for x in out]


def items_of(rows: pa.Table) -> Items:
    """Items of (item_id, text) rows; the rows of one item_id are one item, their terms together."""
    found = words_of(rows.column("text"), ALNUM)
    names = rows.column("item_id").to_pylist()
    parts: dict = {}
    for r, name in enumerate(names):
        parts.setdefault(name, []).append(found.hash[found.first[r] : found.first[r + 1]])
    hashes = np.unique(found.hash)
    each = [np.unique(np.searchsorted(hashes, np.concatenate(p)), return_counts=True) for p in parts.values()]
    return Items(list(parts), hashes, [t for t, _ in each], [c for _, c in each])


# --- the index -----------------------------------------------------------------------------------

_INDEX = "n array<bigint>, counts array<int>, terms array<int>, tf array<int>, with_terms bigint, all_terms bigint"


def index(docs: DataFrame, items: Items) -> DataFrame:
    """Shards of documents: docs (their doc_id), n (their terms), and their terms of the items with occurrences.

    Documents without a term of the items are only counted, in with_terms and all_terms. A shard holds
    consecutive rows of one task; no document is moved.
    """
    sent = docs.sparkSession.sparkContext.broadcast(items.hashes)
    most = shard_docs(len(items.hashes))

    def shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = sent.value
        ids, n, counts, terms, tf = [], [], [], [], []
        seen = [0, 0]
        kind = pa.int64()

        def shard() -> pa.RecordBatch:
            flat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (n, counts, terms, tf)]
            one = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids, kind))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
            lists = [list_column(x, np.array([len(x)]), k) for x, k in zip(flat, kinds, strict=True)]
            row = pa.record_batch([one, *lists, *(pa.array([x], pa.int64()) for x in seen)], ["docs", *_names()])
            for x in (ids, n, counts, terms, tf):
                x.clear()
            seen[:] = 0, 0
            return row

        for batch in bounded(batches, "text"):
            kind = batch.column("doc_id").type
            found = words_of(batch.column("text"), ALNUM)
            total = found.count()
            seen[0] += int((total > 0).sum())
            seen[1] += int(total.sum())
            at = np.minimum(np.searchsorted(hashes, found.hash), max(len(hashes) - 1, 0))
            hit = np.flatnonzero(hashes[at] == found.hash) if len(hashes) else np.empty(0, np.int64)
            pair, times = np.unique(found.row()[hit] * max(len(hashes), 1) + at[hit], return_counts=True)
            row = pair // max(len(hashes), 1)
            own, per = np.unique(row, return_counts=True)
            cut = np.append(0, np.cumsum(per))
            names = batch.column("doc_id").take(pa.array(own)).to_pylist()
            for low in range(0, len(own), most):
                high = min(low + most, len(own))
                if ids and len(ids) + high - low > most:
                    yield shard()
                ids += names[low:high]
                n.append(total[own[low:high]])
                counts.append(per[low:high])
                terms.append((pair % max(len(hashes), 1))[cut[low] : cut[high]])
                tf.append(times[cut[low] : cut[high]])
        if ids or seen[0]:
            yield shard()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(shards, f"docs array<{kind}>, {_INDEX}")


def _names() -> list[str]:
    return [c.split()[0] for c in _INDEX.split(", ")]


def shard_docs(terms: int) -> int:
    return max(16, min(SHARD_DOCS, SHARD_BYTES // (4 * max(terms, 1))))


@dataclass
class Statistics:
    """Documents with terms, all their terms, and each query term's weight."""

    documents: int
    terms: int
    weights: np.ndarray


def statistics(shards: DataFrame, items: Items) -> Statistics:
    """Sums over the whole index; a row per query term comes to the driver."""
    total = shards.agg(F.sum("with_terms").alias("n"), F.sum("all_terms").alias("l")).first()
    n, l = total["n"] or 0, total["l"] or 0
    df = np.zeros(len(items.hashes), np.int64)
    for r in shards.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect():
        df[r["t"]] = r["df"]
    weights = [floor(1000 * log((2 * n + 2) / (2 * d + 1))) if d else 0 for d in df.tolist()]
    return Statistics(n, l, np.array(weights, np.float64))


def impacts(tf: np.ndarray, n: np.ndarray, known: Statistics) -> np.ndarray:
    """A term's part of the score before its weight; at most a million."""
    m = 100 - 75 + (75 * n * known.documents) // max(known.terms, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


# --- search in a shard ---------------------------------------------------------------------------


@dataclass
class Blocks:
    """A posting list in blocks: documents in the order of blocks, each block's end, and its maxima by coordinate."""

    members: np.ndarray
    ends: np.ndarray
    maxima: np.ndarray


@dataclass
class Shard:
    """Impacts, documents by query terms (exact in 32-bit floats, scores in 64-bit ones), and the lists in blocks."""

    docs: list
    impact: np.ndarray
    weights: np.ndarray
    around: list[np.ndarray]
    lists: dict[int, Blocks] = field(default_factory=dict)

    def blocks(self, term: int) -> Blocks:
        if term not in self.lists:
            self.lists[term] = blocks_of(np.flatnonzero(self.impact[:, term]), self.impact, self.around[term], self.weights)
        return self.lists[term]


def blocks_of(members: np.ndarray, impact: np.ndarray, coordinates: np.ndarray, weights: np.ndarray, size: int = BLOCK_DOCS) -> Blocks:
    """The list's documents by the pivot whose direction is the closest to theirs, one pivot per `size` documents."""
    points = impact[np.ix_(members, coordinates)]
    count = -(-len(members) // size)
    if count == 1:
        return Blocks(members, np.array([len(members)]), points.max(axis=0, keepdims=True))
    unit = points * weights[coordinates].astype(np.float32)
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9)
    pivots = unit[np.linspace(0, len(members) - 1, count).astype(np.int64)]
    nearest = np.argmax(unit @ pivots.T, axis=1)
    order = np.argsort(nearest, kind="stable")
    starts = np.flatnonzero(np.diff(nearest[order], prepend=-1))
    return Blocks(members[order], np.append(starts[1:], len(members)), np.maximum.reduceat(points[order], starts, axis=0))


Hit = tuple[float, object]


def best_of(hits: list[Hit], k: int) -> list[Hit]:
    """The k best, highest score first, ties by doc_id, null last."""
    return sorted(hits, key=lambda h: (-h[0], h[1] is None, h[1] if h[1] is not None else 0))[:k]


class Search:
    """The best documents of each item over the shards that one task reads."""

    def __init__(self, items: Items, known: Statistics, k: int, least: list[float]):
        self.k, self.known, self.around = k, known, items.around()
        self.terms, self.weights = [], []
        for terms, times in zip(items.terms, items.times, strict=True):
            weighs = known.weights[terms] > 0
            self.terms.append(terms[weighs])
            self.weights.append(times[weighs] * known.weights[terms[weighs]])
        self.best: list[list[Hit]] = [[] for _ in self.terms]
        self.least = list(least)  # the kth best score that is known, 0 if fewer
        self.opened = self.skipped = 0

    def shard(self, row: dict) -> Shard:
        counts = np.asarray(row["counts"])
        where = np.repeat(np.arange(len(counts)), counts)
        n = np.repeat(np.asarray(row["n"], np.int64), counts)
        impact = np.zeros((len(counts), len(self.around)), np.float32)
        impact[where, np.asarray(row["terms"])] = impacts(np.asarray(row["tf"], np.int64), n, self.known)
        return Shard(row["docs"], impact, self.known.weights, self.around)

    def look(self, shard: Shard, first_only: bool = False) -> None:
        """Takes a shard's documents in; with first_only those of each item's rarest lists, until k are seen."""
        peaks = shard.impact.max(axis=0)
        for q, (terms, weights) in enumerate(zip(self.terms, self.weights, strict=True)):
            most = peaks[terms] * weights
            order = np.argsort(-most, kind="stable")
            left = np.cumsum(most[order][::-1])[::-1]  # the most that a document without the lists before can score
            seen = np.zeros(len(shard.docs), bool)
            for i, j in enumerate(order.tolist()):
                if most[j] <= 0 or left[i] < self.least[q] or (first_only and seen.sum() >= self.k):
                    break
                blocks = shard.blocks(int(terms[j]))
                bound = blocks.maxima[:, np.searchsorted(self.around[terms[j]], terms)] @ weights
                open_ = bound >= self.least[q]
                self.opened, self.skipped = self.opened + int(open_.sum()), self.skipped + int((~open_).sum())
                mine = blocks.members[np.repeat(open_, np.diff(blocks.ends, prepend=0))]
                mine = mine[~seen[mine]]
                seen[mine] = True
                if len(mine):
                    self._take(q, shard, mine, shard.impact[np.ix_(mine, terms)] @ weights)

    def _take(self, q: int, shard: Shard, rows: np.ndarray, scores: np.ndarray) -> None:
        good = np.flatnonzero((scores >= self.least[q]) & (scores > 0))
        if len(good) > self.k:  # those that the kth best of them leaves, ties included
            good = good[scores[good] >= np.partition(scores[good], -self.k)[-self.k]]
        hits = [(s, shard.docs[r]) for s, r in zip(scores[good].tolist(), rows[good].tolist(), strict=True)]
        self.best[q] = best_of(self.best[q] + hits, self.k)
        if len(self.best[q]) == self.k:
            self.least[q] = max(self.least[q], self.best[q][-1][0])


def _searched(shards: DataFrame, items: Items, known: Statistics, k: int, least: list[float], first_only: bool) -> DataFrame:
    """item (number), doc_id, score: the k best of each task."""
    spark = shards.sparkSession
    sent = spark.sparkContext.broadcast((items, known, least))
    kind = shards.schema["docs"].dataType.elementType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, kind = Search(*sent.value[:2], k, sent.value[2]), pa.int64()
        for batch in batches:
            kind = batch.schema.field("docs").type.value_type
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].values for c in ("docs", "n", "counts", "terms", "tf")}
                row = {c: x.to_pylist() if c == "docs" else x.to_numpy() for c, x in row.items()}
                if row["docs"]:
                    search.look(search.shard(row), first_only)
        hits = [(q, doc, int(score)) for q, best in enumerate(search.best) for score, doc in best]
        for low in range(0, len(hits), 10_000):
            columns = zip(*hits[low : low + 10_000], strict=True)
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(columns, (pa.int32(), kind, pa.int64()), strict=True)], ["item", "doc_id", "score"]
            )

    return shards.select("docs", "n", "counts", "terms", "tf").mapInArrow(run, f"item int, doc_id {kind}, score bigint")


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(docs: DataFrame, benchmark: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The k documents of `docs` (doc_id, text) that score highest for each item of `benchmark` (item_id, text).

    Columns item_id, rank (from 1), doc_id, score; scores are above 0, equal ones go by doc_id, a null id last.
    Terms are runs of letters, digits and characters beyond ASCII, A-Z as a-z, told apart by 64-bit hashes. Null and
    empty texts have no term; items without a term, or whose terms occur nowhere, have no rows. Rows of one
    item_id, the null one too, are one item. Each row of `docs` is a document, repeated ids and rows included.
    Other columns are left out; empty tables give no rows.

    A task reads its shards one after the other and sends k rows per item. Items are taken in blocks of
    `block_bytes` of text by a hash of item_id, so that what is broadcast is bounded; one item counts whole.
    """
    rows = benchmark.select("item_id", "text")
    blocks = max(1, -(-row_bytes(rows, "text") // block_bytes))
    kind, doc = benchmark.schema["item_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()
    spark = docs.sparkSession
    out = None
    for b in range(blocks):
        block = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        items = items_of(block.toArrow())
        if not len(items.hashes):
            continue
        shards = stored(index(docs, items))
        known = statistics(shards, items)
        first = _ranked(_searched(shards, items, known, k, [0.0] * len(items.names), True), k).filter(F.col("rank") == k)
        least = [0.0] * len(items.names)
        for r in first.select("item", "score").collect():
            least[r["item"]] = float(r["score"])
        best = stored(_ranked(_searched(shards, items, known, k, least, False), k))
        names = spark.createDataFrame(list(enumerate(items.names)), f"item int, item_id {kind}")
        found = best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id {doc}, score bigint") if out is None else out
