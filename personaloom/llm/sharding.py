"""Shards of near-equal bytes that keep linked documents together: balanced label propagation on Spark joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from personaloom.llm.repeats import with_repeats
from personaloom.llm.storage import stored
from personaloom.llm.thresholds import PLACE_BITS, nested_cuts, place_of

#: Rows per block within which slots are numbered by a sort.
SLOT_ROWS = 20_000
#: Links of more than a share's BIG-th part are dealt out one by one; there are at most shards * BIG of them.
BIG = 16
#: Lower bits of a row's order that its place fills; the bits above are its link's.
_ROW_BITS = 12


def _below(cuts: dict[int, int], group: Column, place: Column) -> Column:
    """Whether a place lies below its group's cut."""
    limit = F.create_map(*[F.lit(x) for g, c in cuts.items() for x in (int(g), int(c))])
    return place < F.coalesce(F.element_at(limit, group), F.lit(0))


def _loads(rows: DataFrame, shards: int) -> list[int]:
    found = {r["shard"]: r["size"] for r in rows.groupBy("shard").agg(F.sum("size").alias("size")).collect()}
    return [int(found.get(s, 0)) for s in range(shards)]


def _fill(loads: list[int], free: int) -> list[int]:
    """The bytes that each shard gets of `free`: the least loaded are raised to one level."""
    held = sorted(loads)
    for n in range(len(held), 0, -1):
        level = -(-(sum(held[:n]) + free) // n)
        if level >= held[n - 1]:
            break
    return [max(0, level - x) for x in loads]


def _order() -> Column:
    """A row's place in a line of links: a hash of the link, then the row's own place."""
    link = F.shiftrightunsigned(F.xxhash64("link", F.lit(1)), 64 - PLACE_BITS + _ROW_BITS)
    return F.shiftleft(link, _ROW_BITS) + F.shiftright("place", PLACE_BITS - _ROW_BITS)


def packed(sizes: dict[int, int], room: list[int]) -> dict[int, list[tuple[int, int]]]:
    """For each link the shards that take it and how many of its bytes; `room` is lowered by them.

    The largest come first. A link goes whole to the shard that it leaves the least room in; one that no shard
    has room for goes to those with the most room, so to as few as can be then.
    """
    plan = {}
    for link, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        fit = [s for s, r in enumerate(room) if r >= size]
        order = [min(fit, key=lambda s: (room[s], s))] if fit else sorted(range(len(room)), key=lambda s: (-room[s], s))
        plan[link] = []
        for s in order:
            if size > 0:
                take = min(size, room[s])
                plan[link].append((s, take))
                room[s] -= take
                size -= take
    return plan


def _begun(linked: DataFrame, sums: DataFrame, shards: int, share: int) -> DataFrame:
    """Linked rows with the shard that they start at: each link in one shard, but for those that have to be cut.

    `sums` has link and all (its bytes). Large links are dealt out by `packed`. The others stand in a line by a
    hash, which is cut by bytes where the shards' remaining rooms end; they fill the same part of each room.
    """
    large = {r["link"]: r["all"] for r in sums.filter(F.col("all") * BIG > share).collect()}
    room = [share] * shards
    plan = packed(large, room)
    small = (linked.agg(F.sum("size").alias("s")).first()["s"] or 0) - sum(large.values())
    ends = [sum(room[: s + 1]) * small // max(1, sum(room)) for s in range(shards)]
    budgets, takers = {0: ends[:-1]}, {0: list(range(shards))}
    known = []
    for link, parts in plan.items():
        takers[len(takers)] = [s for s, _ in parts]
        budgets[len(budgets)] = [sum(n for _, n in parts[: i + 1]) for i in range(len(parts) - 1)]
        known.append(F.struct(F.lit(link).alias("link"), F.lit(len(takers) - 1).alias("_group")))
    if known:
        known = linked.sparkSession.range(1).select(F.inline(F.array(*known)))
        rows = linked.join(F.broadcast(known), "link", "left").withColumn("_group", F.coalesce("_group", F.lit(0)))
    else:
        rows = linked.withColumn("_group", F.lit(0))
    rows = rows.withColumn("_at", F.when(F.col("_group") == 0, _order()).otherwise(F.col("place")))
    parted = {g: b for g, b in budgets.items() if b}
    line = rows.filter(F.col("_group").isin(list(parted))).select(F.col("_group").alias("group"), F.col("_at").alias("place"), "size")
    cuts = nested_cuts(line, parted) if parted else {}

    def of_group(values: dict[int, list[int]]) -> Column:
        listed = [F.array(*[F.lit(int(x)) for x in v]).cast("array<bigint>") for v in values.values()]
        return F.element_at(F.create_map(*[x for g, v in zip(values, listed, strict=True) for x in (F.lit(g), v)]), F.col("_group"))

    below = F.size(F.filter(of_group({g: cuts.get(g, []) for g in takers}), lambda c: c <= F.col("_at")))
    return stored(rows.withColumn("shard", F.get(of_group(takers), below).cast("int")).drop("_group", "_at"))


def propagate(linked: DataFrame, shards: int, capacity: int) -> DataFrame:
    """Moves linked rows (link, place, size, shard and others) towards the shard where most of their link is.

    A row's neighbours are all rows of its link: their bytes per shard are sums by (link, shard), so no edge is
    ever listed and a link of any size has `shards` sums. In each round a row wants the shard with room that
    holds the most of its link, if that is more than its own shard holds; of a link that is too large for that
    shard, the parts in the shards that hold the least go to those that hold the most, in pairs. Moves into a shard are accepted in
    the order of a hash of the link, whole links first, as far as the shard's room goes. Rounds go on until one
    accepts no move, or leaves as many parts of links and as many bytes apart from their link's largest part.
    """
    cut = None
    while True:
        held = linked.groupBy("link", "shard").agg(F.sum("size").alias("held"))
        links = held.groupBy("link").agg(F.count(F.lit(1)).alias("n"), (F.sum("held") - F.max("held")).alias("apart"))
        now = links.filter("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("apart"), F.lit(0)).alias("apart")).first()
        if now["n"] == 0 or (cut is not None and now["n"] >= cut["n"] and now["apart"] >= cut["apart"]):
            break
        cut = now
        room = [capacity - x for x in _loads(linked, shards)]
        rank = F.struct("held", F.pmod(F.xxhash64("link", "shard"), F.lit(1 << 20)).alias("tie"), "shard")
        mine = Window.partitionBy("link")  # at most one row per shard
        rooms = F.create_map(*[F.lit(x) for pair in enumerate(room) for x in pair])
        ranked = held.select("link", "shard", "held", rank.alias("rank"))
        ranked = ranked.withColumn("tops", F.collect_list(F.when(rooms[F.col("shard")] > 0, F.col("rank"))).over(mine))
        ranked = ranked.withColumns(
            {
                "tops": F.reverse(F.array_sort("tops")),
                "all": F.sum("held").over(mine),
                "at": F.row_number().over(mine.orderBy("rank")) - 1,
            }
        )
        most = F.get("tops", F.lit(0))
        whole = F.col("all") - most["held"] <= rooms[most["shard"]]  # what the shard holds is in its load
        best = F.when(whole, most).otherwise(F.get("tops", F.col("at")))
        wish = ranked.withColumn("best", best).filter(F.col("best") > F.col("rank"))
        wish = wish.select("link", "shard", F.col("best.shard").alias("to"))
        placed = linked.join(wish, ["link", "shard"], "left").withColumn("order", _order())
        moves = placed.filter("to is not null").select(F.col("to").alias("group"), F.col("order").alias("place"), "size")
        cuts = nested_cuts(moves, {s: [room[s]] for s in range(shards) if room[s] > 0})
        if not any(c[0] for c in cuts.values()):
            break
        moved = F.col("to").isNotNull() & _below({g: c[0] for g, c in cuts.items()}, F.col("to"), F.col("order"))
        before = linked.columns
        linked = stored(placed.withColumn("shard", F.when(moved, F.col("to")).otherwise(F.col("shard"))).select(*before))
    return linked


def assign(rows: DataFrame, shards: int = 16) -> DataFrame:
    """`rows` with `shard`: near-equal sums of `size` (at least 1 each), linked rows together as far as room allows.

    `rows` has link (null: none), place and size, and may have more. Each link starts in one shard where one has
    room for it, and what is cut moves by `propagate`, at most an equal share of all bytes per shard; what a
    shard holds beyond its share goes back, rows of cut links first. Unlinked rows then fill the
    shards up to one level, by thresholds on their hashed places.
    A row that is larger than a share makes its shard too large. An empty table gives an empty one.
    """
    sums = rows.filter("link is not null").groupBy("link").agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("all")).filter("_n > 1")
    sums = stored(sums.select("link", "all"))
    marked = rows.join(sums.select("link", F.lit(True).alias("_linked")), "link", "left")
    marked = stored(marked.withColumns({"_linked": F.coalesce("_linked", F.lit(False)), "shard": F.lit(0)}))
    total = marked.agg(F.sum("size").alias("s")).first()["s"] or 0
    share = -(-int(total) // shards)
    linked = propagate(_begun(marked.filter("_linked"), sums, shards, share), shards, share)
    loads = _loads(linked, shards)
    # parts of cut links end between two rows, so a shard may hold most of one row more than its share
    row = min(linked.agg(F.max("size").alias("m")).first()["m"] or 0, share // 64)
    over = {s: [share + row] for s in range(shards) if loads[s] > share + row}
    if over:
        apart = linked.groupBy("link").agg(F.count_distinct("shard").alias("_n")).filter("_n > 1").select("link", F.lit(1).alias("_apart"))
        last = F.shiftleft(F.coalesce("_apart", F.lit(0)).cast("bigint"), PLACE_BITS - 1) + F.shiftright(_order(), 1)
        linked = stored(linked.join(apart, "link", "left").withColumn("_last", last).drop("_apart"))
        cuts = nested_cuts(linked.select(F.col("shard").alias("group"), F.col("_last").alias("place"), "size"), over)
        back = F.col("shard").isin(list(over)) & ~_below({g: c[0] for g, c in cuts.items()}, F.col("shard"), F.col("_last"))
        linked = stored(linked.withColumn("_linked", ~back).drop("_last"))
        loads = _loads(linked.filter("_linked"), shards)
    free = linked.filter("not _linked").unionByName(marked.filter("not _linked"))
    budgets, done = [], 0
    for n in _fill(loads, int(total) - sum(loads))[:-1]:
        done += n
        budgets.append(done)
    cuts = nested_cuts(free.select(F.lit(0).alias("group"), "place", "size"), {0: budgets})[0]
    filled = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("place")))
    free = free.withColumn("shard", filled)
    return linked.filter("_linked").unionByName(free).drop("_linked")


def with_slots(rows: DataFrame, shards: int) -> DataFrame:
    """Numbers the rows of each shard from 0 without gaps.

    Blocks of hashed places of about SLOT_ROWS rows are numbered inside; the counts of the blocks before, one
    row per block, are added.
    """
    blocks = max(1, rows.count() // (shards * SLOT_ROWS))
    cut = rows.withColumn("_block", F.shiftright(F.col("place") * blocks, PLACE_BITS))
    sizes = cut.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_block")
    sizes = sizes.select("shard", "_block", (F.sum("_n").over(before) - F.col("_n")).alias("_before"))
    inside = Window.partitionBy("shard", "_block").orderBy("place", "doc_id", "size")
    numbered = cut.withColumn("_at", F.row_number().over(inside) - 1)
    return numbered.join(sizes, ["shard", "_block"]).withColumn("slot", F.col("_before") + F.col("_at")).drop("_block", "_at", "_before")


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot and grown_shard (null) of every row; equal texts are linked.

    The size is the text's UTF-8 bytes (null: none) plus 1; a null text has the checksum of nothing. Nulls are
    not linked. Repeated rows, thousands of one id and text or without both, each get a slot and a place of their
    own. Other columns are left out.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id",
        (F.length(raw) + 1).cast("bigint").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("link"),
    )
    # copies of a row get places of their own, so that a cut can fall between them
    rows = with_repeats(stored(rows.withColumn("key", F.xxhash64("doc_id", "link", "size"))), "key")
    rows = rows.select("doc_id", "size", "text_crc32", "link", place_of("key", "repeat").alias("place"))
    done = stored(assign(stored(rows), shards))
    return with_slots(done, shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "link"
    )
