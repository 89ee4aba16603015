"""Jaccard join of documents on word n-grams by vertical partitioning.

All n-grams stand in one global order, the rare ones first. Two sets that are similar enough share an n-gram
among the first few of each (their prefixes), so only sets that meet there are candidates. The order is cut into
fragments: a set is a row for each fragment, the overlap of a candidate pair is counted in each fragment apart,
by joins on (set, fragment), and summed per pair.

The result is the components of the links, so pairs that are known to be connected need no count. Parity bits
of each set, which give a lower bound on how far two sets are apart, rule most chance meetings out. Sets that
share a prefix n-gram are first compared with the closest of their neighbours by size, one pair per set; after
that only pairs of sets that still lie in different components are compared, the closest first, then all that
the bits leave open. Copies are one set from the start.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from personaloom.llm.batches import bounded, short_batches
from personaloom.llm.components import components
from personaloom.llm.storage import stored
from personaloom.llm.wordhash import NON_SPACE, gram_of, list_column, mixed, words_of

#: Counters of the sketch of n-gram frequencies; its size doesn't depend on the documents.
SKETCH_BITS = 20
_CHUNK = 1 << 12
_LEVEL = 60  # the bits of an n-gram's place in the order below its frequency level
_FRAGMENTS = 8
#: Rounds of comparing neighbours before all sets that still lie apart are compared.
CHAINS = 3
PARITY = 8  # longs of a set's parity bits
BROADCAST_BYTES = 32_000_000


@dataclass
class Rule:
    """n words per n-gram; a pair links when 100 * intersection >= percent * union."""

    n: int = 3
    percent: int = 90

    def prefix(self, size: int) -> int:
        return size - (self.percent * size + 99) // 100 + 1

    def sizes_fit(self, low: Column, high: Column) -> Column:
        return 100 * low >= self.percent * high

    def needed(self, a: Column, b: Column) -> Column:
        """The smallest overlap that links sets of these sizes."""
        return F.ceil(self.percent * (a + b) / (100 + self.percent) - 1e-6)

    def bits_fit(self, apart: Column, a: Column, b: Column) -> Column:
        """Whether it is open that sets of these sizes link, whose parity bits differ in `apart` places."""
        return apart <= a + b - 2 * self.needed(a, b)

    def linked(self, overlap: Column, a: Column, b: Column) -> Column:
        return 100 * overlap >= self.percent * (a + b - overlap)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted values without repeats."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return values[new]


def shingle_sets(batch: pa.RecordBatch, n: int) -> Iterator[np.ndarray]:
    """The distinct n-grams of each row; fewer words are one n-gram."""
    text = words_of(batch.column("text"), NON_SPACE)
    counts = text.count()
    place, value = text.grams(n)
    cut = np.searchsorted(place, text.first)
    for r, c in enumerate(counts.tolist()):
        if 0 < c < n:
            yield gram_of(text.hash[text.first[r] : text.first[r + 1]])
        else:
            yield distinct(np.sort(value[cut[r] : cut[r + 1]]))


def frequency_levels(docs: DataFrame, rule: Rule) -> np.ndarray:
    """A level from 0 (rarest) to 15 for each counter of a sketch of n-gram frequencies, by sixteenths of the counters.

    Only the order of work follows from it, never a result. A task sends its counters once, whatever it read;
    the sum has 2**SKETCH_BITS counters, whatever the corpus.
    """
    size = 1 << SKETCH_BITS

    def rows(sums: Iterable[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for chunk, counts in sums:
            yield pa.record_batch([pa.array([chunk], pa.int32()), list_column(counts, np.array([_CHUNK]), pa.int64())], ["chunk", "counts"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in bounded(batches, "text"):
            value = words_of(batch.column("text"), NON_SPACE).grams(rule.n)[1]
            total += np.bincount((value >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=size)
        if total.any():
            yield from rows((i, total[i * _CHUNK : (i + 1) * _CHUNK]) for i in range(size // _CHUNK))

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts"), strict=True):
                sums[chunk] = sums.get(chunk, 0) + counts.values.to_numpy()
        yield from rows(sums.items())

    schema = "chunk int, counts array<bigint>"
    total = np.zeros(size, np.int64)
    for row in docs.select("text").mapInArrow(count, schema).repartition("chunk").mapInArrow(add, schema).toArrow().to_batches():
        for chunk, counts in zip(row.column("chunk").to_pylist(), row.column("counts"), strict=True):
            total[chunk * _CHUNK : (chunk + 1) * _CHUNK] = counts.values.to_numpy()
    return np.searchsorted(np.quantile(total, np.arange(1, 16) / 16), total, "left").astype(np.uint8)


def ordered(found: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """A set's n-grams as places in the global order, ascending."""
    level = levels[(found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
    return distinct(np.sort((level << np.uint64(_LEVEL)) | (found >> np.uint64(64 - _LEVEL))))


def set_id(places: np.ndarray) -> int:
    """Equal for equal sets: 64 bits of a sum over the set."""
    total = np.array([mixed(places).sum(), len(places)], np.uint64)
    return int(mixed(mixed(total).sum(keepdims=True)).view(np.int64)[0])


def parity(places: np.ndarray) -> np.ndarray:
    """Bits that say whether an odd number of the set's n-grams fall on them.

    Two sets' bits differ in at most as many places as the sets have n-grams apart.
    """
    each = np.bincount((mixed(places) >> np.uint64(55)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(each.astype(np.uint8)).view(np.int64)


def fine_parity(places: np.ndarray) -> np.ndarray:
    """As parity(), of at least as many bits as the set has n-grams: a power of two, 64 or more."""
    size = 1 << max(6, (len(places) - 1).bit_length())
    each = np.bincount((mixed(places) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(each.astype(np.uint8), bitorder="little").view(np.int64)


def fine_apart(a: str, b: str) -> Column:
    """In how many places fine parity bits differ; the longer ones are folded to the shorter, 0 where that takes two folds."""
    short = F.least(F.size(a), F.size(b))

    def folded(x: str) -> Column:
        halves = F.zip_with(F.slice(x, F.lit(1), short), F.slice(x, short + 1, short), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(x) > short, halves).otherwise(F.col(x))

    differ = F.zip_with(folded(a), folded(b), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    near = F.greatest(F.size(a), F.size(b)) <= 2 * short
    return F.when(near, F.aggregate(differ, F.lit(0), lambda n, d: n + d)).otherwise(0)


def bits_apart(a: str, b: str) -> Column:
    return sum(F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(PARITY))


def profiles(docs: DataFrame, rule: Rule, levels) -> DataFrame:
    """The columns of `docs` but text, n (size of the set), node (its id, null for none), its prefix, its parity bits and the fine ones."""
    kept = [f for f in docs.schema.fields if f.name != "text"]
    names = [f.name for f in kept]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            n, node, prefix, bits, fine = [], [], [], [], []
            for found in shingle_sets(batch, rule.n):
                places = ordered(found, levels.value)
                n.append(len(places))
                node.append(set_id(places) if len(places) else None)
                prefix.append(places[: rule.prefix(len(places))] if len(places) else places)
                bits.append(parity(places))
                fine.append(fine_parity(places))
            yield pa.record_batch(
                [
                    *(batch.column(c) for c in names),
                    pa.array(n, pa.int64()),
                    pa.array(node, pa.int64()),
                    list_column(np.concatenate(prefix).view(np.int64), np.array([len(p) for p in prefix]), pa.int64()),
                    list_column(np.concatenate(bits), np.full(len(bits), PARITY), pa.int64()),
                    list_column(np.concatenate(fine), np.array([len(f) for f in fine]), pa.int64()),
                ],
                [*names, "n", "node", "prefix", "bits", "fine"],
            )

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return docs.mapInArrow(run, f"{schema}, n bigint, node bigint, prefix array<bigint>, bits array<bigint>, fine array<bigint>")


def segments(docs: DataFrame, rule: Rule, levels, wanted: DataFrame) -> DataFrame:
    """node, fragment and the set's n-grams in that fragment, for the sets in `wanted` (node, text_key); no empty ones.

    One text of each key is read, whatever the number of its copies and their ids.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text", 250_000):
            node, fragment, counts, values = [], [], [], []
            for own, found in zip(batch.column("node").to_pylist(), shingle_sets(batch, rule.n), strict=True):
                places = ordered(found, levels.value)
                each = np.bincount((places >> np.uint64(_LEVEL + 1)).astype(np.int64), minlength=_FRAGMENTS)
                there = np.flatnonzero(each)
                node += [own] * len(there)
                fragment.append(there)
                counts.append(each[there])
                values.append(places)  # ascending, so fragment by fragment
            grams = list_column(np.concatenate(values).view(np.int64), np.concatenate(counts), pa.int64())
            yield pa.record_batch(
                [pa.array(node, pa.int64()), pa.array(np.concatenate(fragment), pa.int32()), grams], ["node", "fragment", "grams"]
            )

    small = wanted.agg((F.count(F.lit(1)) * 48).alias("b")).first()["b"] <= BROADCAST_BYTES
    side = F.broadcast(wanted) if small else wanted
    texts = docs.select("text_key", "text").join(side, "text_key").select("node", "text")
    one = texts.groupBy("node").agg(F.first("text").alias("text"))
    return one.mapInArrow(run, "node bigint, fragment int, grams array<bigint>")


def overlaps(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, rule: Rule, levels) -> DataFrame:
    """a, b, their sizes and their overlap, where they have one: counted for each (pair, fragment) apart, then summed.

    A row of the joins holds a fragment of two sets, never two whole sets; the counts of a pair's fragments are
    added by an aggregate with partial sums.
    """
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    parts = segments(docs, rule, levels, stored(ends.join(nodes.select("node", "text_key"), "node")))
    each = pairs.withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit(_FRAGMENTS - 1))))
    both = each.join(parts.toDF("a", "fragment", "left"), ["a", "fragment"]).join(parts.toDF("b", "fragment", "right"), ["b", "fragment"])
    shared = both.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("left", "right")).alias("shared"))
    return shared.groupBy("a", "b", "n_a", "n_b").agg(F.sum("shared").alias("overlap"))


def _placed(live: DataFrame, found: DataFrame) -> DataFrame:
    """Prefix rows with the component that their set has so far."""
    return live.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _closest(pairs: DataFrame, end: str, most: int) -> DataFrame:
    """The pairs of each node at one end whose bits are the least apart."""
    rank = F.row_number().over(Window.partitionBy(end).orderBy("apart", "a", "b"))
    return pairs.withColumn("_rank", rank).filter(F.col("_rank") <= most).drop("_rank")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, rule: Rule, levels) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) that are settled, and the links (u, v) among them.

    Fine parity bits settle most pairs that don't link; only the sets of the others are fetched and counted.
    """
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    ends = stored(ends.join(nodes.select("node", "text_key", "fine"), "node"))
    fine = ends.select("node", "fine")
    close = pairs.select("a", "b", "n_a", "n_b").join(fine.toDF("a", "fine_a"), "a").join(fine.toDF("b", "fine_b"), "b")
    close = close.filter(rule.bits_fit(fine_apart("fine_a", "fine_b"), F.col("n_a"), F.col("n_b")))
    done = overlaps(stored(close.select("a", "b", "n_a", "n_b")), ends, docs, rule, levels)
    links = done.filter(rule.linked(F.col("overlap"), F.col("n_a"), F.col("n_b")))
    return pairs.select("a", "b"), stored(links.select(F.col("a").alias("u"), F.col("b").alias("v")))


def _linked(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """The profile of every row of `docs` (doc_id, text and others); node, component and component_id of every set."""
    spark = docs.sparkSession
    docs = docs.withColumn("text_key", F.unhex(F.md5(F.col("text").cast("binary"))))
    levels = spark.sparkContext.broadcast(frequency_levels(docs, rule))
    every = stored(profiles(docs, rule, levels))
    nodes = stored(
        every.filter("node is not null")
        .groupBy("node")
        .agg(
            F.min("doc_id").alias("rep"),
            *(F.first(c).alias(c) for c in ("n", "text_key", "prefix", "bits", "fine")),
        )
    )
    rows = nodes.select("node", "n", F.posexplode("prefix").alias("pos", "gram"))
    chain = Window.partitionBy("gram").orderBy("n", "node")
    live = rows.select("gram", "node", "n", "pos", F.lag("n").over(chain).alias("_less"), F.lead("n").over(chain).alias("_more"))
    fits = F.coalesce(rule.sizes_fit(F.col("_less"), F.col("n")), F.lit(False)) | F.coalesce(rule.sizes_fit(F.col("n"), F.col("_more")), F.lit(False))
    live = stored(live.filter(fits).drop("_less", "_more"))
    bits = nodes.select("node", "bits")
    none = docs.sparkSession.createDataFrame([], "a bigint, b bigint")
    tried, links = none, none.toDF("u", "v")
    found = none.toDF("node", "component")
    for turn in range(CHAINS):
        # along each gram's sets by size: neighbours that are not connected yet
        placed = _placed(live, found)
        order = Window.partitionBy("gram").orderBy("n", F.xxhash64("node", F.lit(turn)))
        near = placed.select("node", "n", "component", *(F.lag(c).over(order).alias(f"prev_{c}") for c in ("node", "n", "component")))
        near = near.filter((F.col("prev_component") != F.col("component")) & rule.sizes_fit(F.col("prev_n"), F.col("n")))
        near = near.select(F.col("prev_node").alias("a"), F.col("node").alias("b"), F.col("prev_n").alias("n_a"), F.col("n").alias("n_b"))
        near = near.distinct().join(bits.toDF("a", "bits_a"), "a").join(bits.toDF("b", "bits_b"), "b")
        near = near.select("a", "b", "n_a", "n_b", bits_apart("bits_a", "bits_b").alias("apart"))
        near = near.filter(rule.bits_fit(F.col("apart"), F.col("n_a"), F.col("n_b"))).join(tried, ["a", "b"], "left_anti")
        near = stored(_closest(near, "b", 1))
        if near.isEmpty():
            break
        again, extra = _verified(near, nodes, docs, rule, levels)
        tried, links = tried.unionByName(again), links.unionByName(extra)
        found = components(links)

    # all sets that share a prefix n-gram and still lie in different components
    placed = _placed(live, found)
    apart = placed.groupBy("gram").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).filter("_low < _high")
    placed = stored(placed.join(apart.select("gram"), "gram").join(bits, "node"))
    carried = ("node", "n", "pos", "component", "bits")
    left = placed.select("gram", *(F.col(c).alias(f"{c}_a") for c in carried))
    right = placed.select("gram", *(F.col(c).alias(f"{c}_b") for c in carried))
    room = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    more = left.join(
        right,
        (left["gram"] == right["gram"])
        & (F.struct("n_a", "node_a") < F.struct("n_b", "node_b"))
        & (F.col("component_a") != F.col("component_b"))
        & rule.sizes_fit(F.col("n_a"), F.col("n_b"))
        & (room >= rule.needed(F.col("n_a"), F.col("n_b")))
        & rule.bits_fit(bits_apart("bits_a", "bits_b"), F.col("n_a"), F.col("n_b")),
    )
    more = more.select(
        F.col("node_a").alias("a"), F.col("node_b").alias("b"), "n_a", "n_b", bits_apart("bits_a", "bits_b").alias("apart")
    )
    more = stored(more.distinct())
    for most in (2, None):  # the closest of each set first, which connects most; then all that still lie apart
        ends = [found.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}")) for x in ("a", "b")]
        open_ = more.join(tried, ["a", "b"], "left_anti").join(ends[0], "a", "left").join(ends[1], "b", "left")
        open_ = open_.filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).drop("of_a", "of_b")
        open_ = stored(_closest(open_, "a", most) if most else open_)
        if open_.isEmpty():
            break
        again, extra = _verified(open_, nodes, docs, rule, levels)
        tried, links = tried.unionByName(again), links.unionByName(extra)
        found = components(links)

    named = nodes.select("node", "rep").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    return every, named.select("node", "component").join(smallest, "component")


def similarity_components(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    Null and empty texts have no n-grams and link with nothing; their component_id is their own id. Rows with
    a null id take part in links; a component of null ids only has a null component_id. Repeated rows are copies.
    Other columns are left out.
    """
    with short_batches(docs.sparkSession):
        every, named = _linked(docs.select("doc_id", "text"), rule or Rule())
    return every.join(named.select("node", "component_id"), "node", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """One row of each component, with all its columns: of the rows of its smallest doc_id that with the smallest text.

    Each row counts with its own text, whatever other rows of its id hold. A component's rows with null ids are
    decided apart from its others: one of them stays as well. Rows without n-grams pass untouched.
    """
    keyed = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    with short_batches(docs.sparkSession):
        every, named = _linked(keyed, rule or Rule())
    placed = every.select("doc_id", "key", "node").join(named.select("node", "component"), "node")
    placed = stored(placed.select("doc_id", "key", "component", F.col("doc_id").isNull().alias("nameless")))
    ids = placed.groupBy("component", "nameless", "doc_id").agg(F.count(F.lit(1)).alias("rows"))
    best = ids.groupBy("component", "nameless").agg(F.min(F.struct("doc_id", "rows")).alias("best"))
    # rows that go, and rows of which one stays by its text; all others pass untouched
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id"))
    special = placed.join(best, ["component", "nameless"]).withColumn("stays", stays).filter("not stays or best.rows > 1")
    special = stored(special.select("doc_id", "key", "component", "nameless", "stays")).distinct()
    special = special.withColumnsRenamed({"doc_id": "_id", "key": "_key"})
    small = special.count() * 48 <= BROADCAST_BYTES
    side = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    gone, rivals = side(special.select("_id", "_key")), side(special.filter("stays").select("_id", "_key", "component", "nameless"))
    plain = docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"]) & (F.xxhash64(docs["text"]) == gone["_key"]), "left_anti")
    rows = docs.select(F.struct("text", *[c for c in docs.columns if c != "text"]).alias("_row"))
    rows = rows.join(rivals, rows["_row.doc_id"].eqNullSafe(rivals["_id"]) & (F.xxhash64(rows["_row.text"]) == rivals["_key"]))
    first = rows.groupBy("component", "nameless").agg(F.min("_row").alias("_row")).select("_row.*")
    return plain.unionByName(first.select(*docs.columns))
