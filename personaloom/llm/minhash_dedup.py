"""MinHash near-duplicates by tensored banding.

A set of shingles has two small collections of half keys, each half key made of a few minhashes. A table's key is
a pair of them, one from each collection, so HALVES * HALVES tables cost 2 * HALVES half keys, about the square
root of the minhashes that as many tables of their own would need. Two sets of Jaccard similarity s meet in some
table with probability (1 - (1 - s**ROWS)**HALVES)**2: 0.9998 at 0.85.

Sets that meet are candidates; a link is confirmed on the full sets of both. As the result is the components of
the links, pairs that are already connected need no count: sets are first compared with one member of each of
their tables, the closest by parity bits, then all pairs of sets that meet and still lie in different components.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from personaloom.llm.batches import bounded
from personaloom.llm.components import components
from personaloom.llm.jaccard_join import PARITY, Rule, bits_apart, parity, shingle_sets
from personaloom.llm.storage import row_bytes, stored
from personaloom.llm.wordhash import list_column, mixed

#: Half keys in each of the two collections, and minhashes in a half key.
HALVES, ROWS = 10, 3
#: Rounds of comparing sets with one member of their tables before all that meet are compared.
ROUNDS = 3
BROADCAST_BYTES = 32_000_000

_FACTORS = mixed(np.arange(1, 2 * HALVES * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_OTHER = np.uint64(0xA24BAED4963EE407)


def half_keys(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """2 * HALVES half keys of each set; `values` are all sets' hashes, `starts` their first ones. No set is empty."""
    keys = np.zeros((len(starts), 2 * HALVES), np.uint64)
    for k, factor in enumerate(_FACTORS):
        least = np.minimum.reduceat(mixed(values * factor), starts)
        keys[:, k // ROWS] = mixed(keys[:, k // ROWS] * _OTHER + least)
    return keys


def set_key(values: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets have in common: two sums over the set."""
    sums = np.array([mixed(values).sum(), mixed(values ^ _OTHER).sum()], np.uint64)
    high, low = mixed(sums + np.uint64(len(values))).view(np.int64).tolist()
    return high, low


def signatures(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, text_key (MD5 of the text), n, high and low (the set's key; null for none), halves and bits of every row."""
    rows = docs.select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("text_key"), "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            sets = list(shingle_sets(batch, rule.n))
            n = np.array([len(s) for s in sets])
            full = np.flatnonzero(n)
            halves, bits = np.zeros((len(sets), 2 * HALVES), np.uint64), np.zeros((len(sets), PARITY), np.int64)
            keys: list = [(None, None)] * len(sets)
            if len(full):
                starts = np.cumsum(n[full]) - n[full]
                halves[full] = half_keys(np.concatenate([sets[i] for i in full]), starts)
                for i in full.tolist():
                    keys[i], bits[i] = set_key(sets[i]), parity(sets[i])
            there = n > 0
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    batch.column("text_key"),
                    pa.array(n, pa.int64()),
                    pa.array([k[0] for k in keys], pa.int64()),
                    pa.array([k[1] for k in keys], pa.int64()),
                    list_column(halves[there].view(np.int64).ravel(), np.where(there, 2 * HALVES, 0), pa.int64()),
                    list_column(bits[there].ravel(), np.where(there, PARITY, 0), pa.int64()),
                ],
                ["doc_id", "text_key", "n", "high", "low", "halves", "bits"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"doc_id {kind}, text_key binary, n bigint, high bigint, low bigint, halves array<bigint>, bits array<bigint>"
    )


def full_sets(docs: DataFrame, rule: Rule, wanted: DataFrame) -> DataFrame:
    """node and its shingles as sorted hashes, for the rows of `wanted` (node, text_key).

    One text of each key is read, whatever the number of its copies and their ids. The wanted keys are broadcast
    where a count finds them few.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            sets = list(shingle_sets(batch, rule.n))
            values = list_column(np.concatenate(sets).view(np.int64), np.array([len(s) for s in sets]), pa.int64())
            yield pa.record_batch([batch.column("node"), values], ["node", "shingles"])

    small = row_bytes(wanted) <= BROADCAST_BYTES
    texts = docs.select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("text_key"), "text")
    found = texts.join(F.broadcast(wanted) if small else wanted, "text_key")
    one = found.groupBy("node").agg(F.first("text").alias("text"))
    return one.mapInArrow(run, "node bigint, shingles array<bigint>")


def _tables(sets: DataFrame) -> DataFrame:
    """key, node, n: the tables in which a set may meet another.

    Sets that meet in the table of two half keys share both, so half keys that no other set has are left out
    before pairs of them are formed.
    """
    halves = sets.select("node", "n", F.posexplode("halves").alias("half", "value"))
    shared = halves.groupBy("half", "value").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1").drop("sets")
    own = halves.join(shared, ["half", "value"]).withColumn("side", F.col("half") >= HALVES)
    own = own.groupBy("node", "n").agg(
        *(F.collect_list(F.when(F.col("side") == side, F.struct("half", "value"))).alias(name) for side, name in ((False, "us"), (True, "vs")))
    )
    pairs = own.select("node", "n", "vs", F.explode("us").alias("u")).select("node", "n", "u", F.explode("vs").alias("v"))
    return pairs.select(F.xxhash64("u.half", "u.value", "v.half", "v.value").alias("key"), "node", "n")


def _placed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows with the component that their set has so far."""
    return rows.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _open(rule: Rule) -> Column:
    """Whether two sets of different components may be linked, by their sizes and parity bits."""
    low, high = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    fits = (F.col("component_a") != F.col("component_b")) & rule.sizes_fit(low, high)
    return fits & rule.bits_fit(bits_apart("bits_a", "bits_b"), F.col("n_a"), F.col("n_b"))


def _pairs(met: DataFrame, rule: Rule) -> DataFrame:
    """a < b, n_a, n_b, apart of the pairs that are open, each once."""
    found = met.filter(_open(rule)).select("node_a", "node_b", "n_a", "n_b", bits_apart("bits_a", "bits_b").alias("apart"))
    ends = [F.struct(F.col(f"node_{x}").alias("node"), F.col(f"n_{x}").alias("n")) for x in "ab"]
    found = found.select(F.least(*ends).alias("x"), F.greatest(*ends).alias("y"), "apart").distinct()
    return found.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b"), "apart")


def _side(rows: DataFrame, x: str) -> DataFrame:
    return rows.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "component", "bits")))


def _closest(pairs: DataFrame) -> DataFrame:
    """Of each set's pairs the one whose bits are the least apart, found with partial sums in the tasks."""
    both = pairs.select(F.explode(F.array("a", "b")).alias("end"), F.struct("apart", "a", "b", "n_a", "n_b").alias("pair"))
    best = both.groupBy("end").agg(F.min("pair").alias("pair"))
    return best.select("pair.a", "pair.b", "pair.n_a", "pair.n_b").distinct()


def _confirmed(pairs: DataFrame, shingles: DataFrame, rule: Rule) -> DataFrame:
    """The pairs with `linked`: whether the full sets are similar enough."""
    both = pairs.select("a", "b", "n_a", "n_b").join(shingles.toDF("a", "left"), "a").join(shingles.toDF("b", "right"), "b")
    overlap = F.size(F.array_intersect("left", "right"))
    return stored(both.select("a", "b", rule.linked(overlap, F.col("n_a"), F.col("n_b")).alias("linked")))


def _linked(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """The signature of every row, and high, low, component_id of every set."""
    spark = docs.sparkSession
    rows = stored(signatures(docs, rule).withColumn("uid", F.monotonically_increasing_id()))
    firsts = rows.filter("high is not null").groupBy("high", "low").agg(F.min("uid").alias("uid"), F.min("doc_id").alias("id"))
    sets = stored(firsts.select("uid", "id").join(rows, "uid").withColumnRenamed("uid", "node"))
    live = stored(_tables(sets))
    met = live.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y")).filter("x < y")
    live = stored(live.join(met.select("key"), "key"))
    bits = sets.select("node", "bits")
    wanted = sets.join(live.select("node").distinct(), "node", "left_semi").select("node", "text_key")
    shingles = stored(full_sets(docs, rule, stored(wanted)))

    tried = spark.createDataFrame([], "a bigint, b bigint")
    links, found = tried.toDF("u", "v"), tried.toDF("node", "component")

    def confirm(pairs: DataFrame) -> None:
        nonlocal tried, links, found
        done = _confirmed(pairs, shingles, rule)
        tried = tried.unionByName(done.select("a", "b"))
        links = links.unionByName(done.filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v")))
        found = components(links)

    for turn in range(ROUNDS):
        # each table's sets beside one of them, another one in each round
        placed = _placed(live, found).join(bits, "node")
        one = live.groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "node", F.lit(turn)).alias("_h"), "node")).alias("one"))
        one = _side(one.select("key", "one.node").join(_placed(sets.select("node", "n", "bits"), found), "node"), "b")
        pairs = _pairs(_side(placed, "a").join(one, "key"), rule).join(tried, ["a", "b"], "left_anti")
        pairs = stored(_closest(pairs))
        if pairs.isEmpty():
            break
        confirm(pairs)

    # all pairs that meet and still lie apart: a table's largest component is compared with the rest, not with itself
    placed = _placed(live, found)
    inside = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("k"))
    mixed_keys = inside.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("k", "component")).alias("most"))
    mixed_keys = mixed_keys.filter("parts > 1").select("key", F.col("most.component").alias("main"))
    placed = stored(placed.join(mixed_keys, "key").join(bits, "node"))
    more = _side(placed.filter("component <> main"), "a").join(_side(placed, "b"), "key")
    more = stored(_pairs(more, rule).join(tried, ["a", "b"], "left_anti"))
    for closest in (True, False):
        ends = [found.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}")) for x in ("a", "b")]
        rest = more.join(tried, ["a", "b"], "left_anti").join(ends[0], "a", "left").join(ends[1], "b", "left")
        rest = rest.filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).drop("of_a", "of_b")
        rest = stored(_closest(rest) if closest else rest)
        if rest.isEmpty():
            break
        confirm(rest)

    named = _placed(sets.select("node", "id", "high", "low"), found)
    smallest = named.groupBy("component").agg(F.min("id").alias("component_id"))
    return rows, named.select("high", "low", "component").join(smallest, "component").drop("component")


def near_duplicates(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id (the smallest doc_id reachable by links), kept.

    Null and empty texts have no shingles, link with nothing and are their own component. Rows with null ids take
    part in links; a component of null ids only has a null component_id. `kept` is whether doc_id is the
    component_id, two nulls counting as equal: repeated rows of that id are all kept. Copies, also of thousands
    of rows or without ids, are one set from the start. Other columns are left out; an empty table gives none.
    """
    rows, named = _linked(docs.select("doc_id", "text"), rule or Rule(n=5, percent=85))
    found = rows.select("doc_id", "n", "high", "low").join(named, ["high", "low"], "left")
    component = F.when(F.col("high").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    found = found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """doc_id of the documents that stay, one of each component, each once."""
    return near_duplicates(docs, rule).filter("kept").select("doc_id").distinct()
