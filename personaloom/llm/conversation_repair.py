"""Repair of conversation structure: the cheapest edits that make turns alternate, by a checkpointed dynamic programme.

The programme walks a conversation's rows with four states: START, SYSTEM (a system turn was said), USER (the
user's turn is open) and DONE (an assistant answered). Its backward vectors, the cost that is left in each
state, are kept at checkpoints only: at the blocks into which a long conversation is cut, which tasks work on
apart, and at every square root of a block's rows inside it. Walking forward recomputes the vectors between two
checkpoints and takes, of the edits that lie on a cheapest path, the ASCII-least.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import groupby
from math import isqrt

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from personaloom.llm.storage import stored

#: Fixed values: `[\x20\x09-\x0D]`, costs of the edits, and the surcharge of a truncated row that stays.
BLANKS = " \t\n\x0b\x0c\r"
RE_ROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

START, SYSTEM, USER, DONE = range(4)
#: The state that an initial leads to, and the initial that a new or a rerolled turn takes in a state.
BY_INITIAL = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): DONE, (DONE, "u"): USER}
BY_EDIT = (USER, USER, DONE, USER)
ROLE_OF = ("user", "user", "assistant", "user")

NEVER = 1 << 60
#: What is left to pay behind the last row: missing turns are inserted.
AT_END = (0, 2 * INSERT, INSERT, 0)

#: A block's rows, and the bytes of its texts but for the last one's.
BLOCK_ROWS, BLOCK_BYTES = 4096, 4_000_000

Vector = tuple[int, ...]
#: Initial, whether the row must go, whether its text is cut off.
Code = tuple[str, bool, bool]


@lru_cache(maxsize=1 << 16)
def _step(code: Code, after: Vector) -> Vector:
    """The vector before a row from the one behind it; `after` has a smallest entry of 0."""
    initial, must_go, cut = code
    extra = TRUNCATED if cut else 0
    cost = []
    for state in range(4):
        ways = [after[state] + DELETE]
        if not must_go:
            ways.append(after[BY_EDIT[state]] + RE_ROLE + extra)
            if (state, initial) in BY_INITIAL:
                ways.append(after[BY_INITIAL[state, initial]] + extra)
        cost.append(min(ways))
    for _ in range(3):  # turns inserted before the row; no cheapest way has more than three of them
        cost = [min(cost[s], cost[BY_EDIT[s]] + INSERT) for s in range(4)]
    return tuple(min(c, NEVER) for c in cost)


def before(code: Code, after: Vector) -> Vector:
    low = min(after)
    return tuple(NEVER if c >= NEVER else c + low for c in _step(code, tuple(NEVER if c >= NEVER else c - low for c in after)))


def block_costs(codes: list[Code]) -> list[list[int]]:
    """The cost from each state before a block to each state behind it."""
    columns = []
    for end in range(4):
        vector = tuple(0 if s == end else NEVER for s in range(4))
        for code in reversed(codes):
            vector = before(code, vector)
        columns.append(vector)
    return [[columns[end][s] for end in range(4)] for s in range(4)]


def joined(costs: list[list[int]], after: Vector) -> Vector:
    """The vector before a block from the costs through it and the vector behind it."""
    return tuple(min(NEVER, *(c + a for c, a in zip(row, after, strict=True))) for row in costs)


def walk(codes: list[Code], after: Vector, state: int) -> Iterator[tuple[str, int, int]]:
    """Edit, row (that it stands before or is about) and the state it is made in; at last ("", rows, end state)."""
    span = max(1, isqrt(len(codes)))
    marks, vector = {}, after
    for i in reversed(range(len(codes))):
        vector = before(codes[i], vector)
        if i % span == 0:
            marks[i] = vector
    for low in range(0, len(codes), span):
        high = min(low + span, len(codes))
        vectors = [marks.get(high, after)]
        for i in reversed(range(low, high)):
            vectors.append(before(codes[i], vectors[-1]))
        vectors.reverse()
        for i in range(low, high):
            here, there = vectors[i - low], vectors[i - low + 1]
            initial, must_go, cut = codes[i]
            extra = TRUNCATED if cut else 0
            while True:
                left, kept = here[state], BY_INITIAL.get((state, initial))
                if left == there[state] + DELETE:
                    yield "D", i, state
                    break
                if left == here[BY_EDIT[state]] + INSERT:
                    yield "I", i, state
                    state = BY_EDIT[state]
                    continue
                if kept is not None and not must_go and left == there[kept] + extra:
                    yield "K", i, state
                    state = kept
                else:
                    yield "R", i, state
                    state = BY_EDIT[state]
                break
    yield "", len(codes), state


# --- rows in order, cut into blocks --------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that the crc32 of `conv_id:turn` names; a null counts as one space.

    Of 20 remainders 0 drops a row, 1 empties its text, 2 takes `[.!?]` out of it, 3 repeats the row, 4 makes it the user's.
    """

    def known(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.pmod(F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    rows = rows.filter("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("_times"))
    return rows.drop("_times")


def blocks(turns: DataFrame, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """conv_id, turn, role, text with `at`, ascending in the order of a conversation's rows, and `block`, ascending too.

    Rows stand by turn, nulls first; rows of one turn by role, the first 100 characters of the text and its
    digest. Ranges of that order split a long conversation over tasks, even one of equal rows. Also: the
    role's `initial`, whether the text is `blank` or `cut` off, and `key`, equal for equal rows of a conversation.
    """
    said = F.rtrim("text", F.lit(BLANKS))
    name = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    key = F.sha2(F.concat_ws(":", name, F.length("role"), "role", "text").cast("binary"), 256)
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    )
    rows = rows.select(
        "*",
        F.substring("role", 1, 1).alias("initial"),
        (said == "").alias("blank"),
        (~F.substring(said, -1, 1).isin(".", "!", "?")).alias("cut"),
        key.alias("key"),
        F.monotonically_increasing_id().alias("_id"),
    )
    order = ["conv_id", "turn", F.substring("role", 1, 100), F.substring("text", 1, 100), "key", "_id"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_id")
    schema = placed.schema.simpleString()[len("struct<") : -1]

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = at = (TaskContext.get().partitionId() << 40) - 1
        now, rows, size = (), 0, 0
        for batch in batches:
            places, numbers = [], []
            sizes = pc.binary_length(batch.column("text")).to_pylist()
            for conv, more in zip(batch.column("conv_id").to_pylist(), sizes, strict=True):
                if now != (conv,) or rows >= block_rows or size >= block_bytes:
                    now, rows, size, block = (conv,), 0, 0, block + 1
                at, rows, size = at + 1, rows + 1, size + more
                places.append(at)
                numbers.append(block)
            columns = [*batch.columns, pa.array(places, pa.int64()), pa.array(numbers, pa.int64())]
            yield pa.record_batch(columns, [*batch.schema.names, "at", "block"])

    # the columns keep their names; only types stand in the schema
    return placed.mapInArrow(number, f"{schema}, at bigint, block bigint")


def repeats(rows: DataFrame) -> DataFrame:
    """conv_id, block, at of every row whose role and text stood earlier in its conversation."""
    first = rows.groupBy("key").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    slim = rows.filter("not blank").select("key", "conv_id", "block", "at")
    return slim.join(first.select("key", "first"), "key").filter("at > first").select("conv_id", "block", "at")


_ROW = "conv_id {0}, block bigint, at bigint, mark int, turn {1}, role string, text string, initial string, blank boolean, cut boolean"
_STATE = "after array<bigint>, entry int, last boolean"


def _grouped(rows: DataFrame, marks: DataFrame, states: DataFrame | None, texts: bool) -> DataFrame:
    """Rows, marks of repeats and states of blocks, together by block, in the order state, row, its mark.

    They meet by a union, so that nothing is joined with the texts.
    """
    spark = rows.sparkSession
    kinds = [rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn")]
    shape = spark.createDataFrame([], f"{_ROW.format(*kinds)}, {_STATE}")
    own = rows if texts else rows.drop("turn", "role", "text")
    every = shape.unionByName(own.drop("key").withColumn("mark", F.lit(1)), allowMissingColumns=True)
    every = every.unionByName(marks.withColumn("mark", F.lit(2)), allowMissingColumns=True)
    if states is not None:
        every = every.unionByName(states.withColumn("mark", F.lit(0)), allowMissingColumns=True)
    return every.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", F.asc_nulls_first("at"), "mark")


def _records(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(0, batch.num_rows, 1024):
            yield from batch.slice(k, 1024).to_pylist()


def _block_of(records: Iterable[dict]) -> tuple[dict | None, list[dict]]:
    """A block's state and its rows, with their faults."""
    state, rows = None, []
    for r in records:
        if r["mark"] == 0:
            state = r
        elif r["mark"] == 2:
            if rows[-1]["fault"] != "blank":
                rows[-1]["fault"] = "duplicate"
        else:
            r["fault"] = "blank" if r["blank"] else "truncated" if r["cut"] else None
            rows.append(r)
    return state, rows


def _codes(rows: list[dict]) -> list[Code]:
    return [(r["initial"], r["fault"] in ("blank", "duplicate"), r["fault"] == "truncated") for r in rows]


def _by_block(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[dict, dict | None, list[dict]]]:
    for _, records in groupby(_records(batches), lambda r: (r["conv_id"], r["block"])):
        state, rows = _block_of(records)
        yield rows[0], state, rows


def _written(rows: Iterable[tuple], schema: pa.Schema, most: int = 1024, most_chars: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size."""
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= most or chars >= most_chars:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _mapped(df: DataFrame, f: Callable[[Iterable[pa.RecordBatch]], Iterator[tuple]], schema: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)
    return df.mapInArrow(lambda batches: _written(f(batches), kinds), schema)


def block_states(rows: DataFrame, marks: DataFrame) -> DataFrame | None:
    """after, entry and last of every block of the conversations that have more blocks than one; None without such.

    The costs through each block are found apart and joined from the last block back, then the ways through
    each block from the first on. Both scans stream a few numbers per block of a conversation through one task.
    """
    many = rows.groupBy("conv_id").agg(F.min("block").alias("low"), F.max("block").alias("high")).filter("low < high")
    many = stored(many.select(F.col("conv_id").alias("_conv")))
    if many.isEmpty():
        return None
    conv = rows.schema["conv_id"].dataType.simpleString()
    own, seen = (df.join(many, df["conv_id"].eqNullSafe(many["_conv"]), "left_semi") for df in (rows, marks))
    key = f"conv_id {conv}, block bigint"

    def costs(batches):
        for r, _, held in _by_block(batches):
            yield r["conv_id"], r["block"], [c for row in block_costs(_codes(held)) for c in row]

    def back(batches):
        for _, group in groupby(_records(batches), lambda r: r["conv_id"]):
            vector, last = AT_END, True
            for r in group:
                yield r["conv_id"], r["block"], list(vector), last
                vector, last = joined([r["costs"][k : k + 4] for k in range(0, 16, 4)], vector), False

    def ways(batches):
        for r, state, held in _by_block(batches):
            codes = _codes(held)
            ends = [max(walk(codes, tuple(state["after"]), s), key=lambda e: e[1])[2] for s in range(4)]
            yield r["conv_id"], r["block"], state["after"], state["last"], ends

    def forth(batches):
        for _, group in groupby(_records(batches), lambda r: r["conv_id"]):
            entry = START
            for r in group:
                yield r["conv_id"], r["block"], r["after"], entry, r["last"]
                entry = r["ends"][entry]

    through = _mapped(_grouped(own, seen, None, texts=False), costs, f"{key}, costs array<bigint>")
    ordered = through.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("block"))
    afters = stored(_mapped(ordered, back, f"{key}, after array<bigint>, last boolean"))
    found = _mapped(_grouped(own, seen, afters, texts=False), ways, f"{key}, after array<bigint>, last boolean, ends array<int>")
    ordered = found.repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return stored(_mapped(ordered, forth, f"{key}, {_STATE}"))


# --- results -------------------------------------------------------------------------------------


def edits(turns: DataFrame, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per edit of the cheapest repair, in order within (conv_id, block), blocks ascending.

    `edit` is K (keep), R (give the role that fits), D (delete) or I (insert an empty turn); of equally cheap
    repairs the one whose edits are ASCII-least is taken. `role` and `text` are those after the edit (of a deleted
    row its own), `turn`, `initial` (of the row's own role) and `fault` (blank, duplicate, truncated) are null for
    inserted turns. Roles are told by their first character: s, u and a can be kept, all others, the empty one
    too, are rerolled or deleted. Nulls in role and text are one space; the null conv_id is one conversation, null
    turns stand first. Other columns are left out; an empty table gives none. `alone`: the conversation is one block.
    """
    rows = stored(blocks(turns, block_rows, block_bytes))
    marks = stored(repeats(rows))
    states = block_states(rows, marks)
    conv, turn = (rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))

    def make(batches):
        for r, state, held in _by_block(batches):
            key, seq = (r["conv_id"], r["block"]), 0
            after, entry, last = (tuple(state["after"]), state["entry"], state["last"]) if state else (AT_END, START, True)
            for edit, i, at in walk(_codes(held), after, entry):
                if not edit and last:  # missing turns at the end
                    while AT_END[at]:
                        yield *key, seq, state is None, "I", None, ROLE_OF[at], "", None, None
                        at, seq = BY_EDIT[at], seq + 1
                if not edit:
                    break
                if edit == "I":
                    yield *key, seq, state is None, "I", None, ROLE_OF[at], "", None, None
                else:
                    row = held[i]
                    role = ROLE_OF[at] if edit == "R" else row["role"]
                    yield *key, seq, state is None, edit, row["turn"], role, row["text"], row["initial"], row["fault"]
                seq += 1

    schema = f"conv_id {conv}, block bigint, seq bigint, alone boolean, edit string, turn {turn}, role string, text string, initial string, fault string"
    return _mapped(_grouped(rows, marks, states, texts=True), make, schema)


def repaired(turns: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, place (ascending within a conversation), role, text."""
    done = edits(turns).filter("edit <> 'D'")
    return done.select("conv_id", F.struct("block", "seq").alias("place"), "role", "text")


_SUMS = "blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"


def _summed(made: Iterable[dict]) -> dict:
    """What a block's edits sum to; faults, turns and initials of its rows, its audit and its repaired lines."""
    out = dict(blank=0, duplicate=0, truncated=0, illegal=0, cost=0, head=None, tail=None, low=None, high=None, distinct=0)
    audit, lines = [], []
    for e in made:
        audit.append(e["edit"])
        if e["edit"] != "D":
            lines.append(f"{e['role']}:{e['text']}")
        out["cost"] += {"K": 0, "R": RE_ROLE, "D": DELETE, "I": INSERT}[e["edit"]]
        if e["edit"] == "I":
            continue
        if e["fault"]:
            out[e["fault"]] += 1
            out["cost"] += TRUNCATED if e["fault"] == "truncated" and e["edit"] != "D" else 0
        if out["tail"] is not None:
            out["illegal"] += out["tail"] + e["initial"] not in ("su", "ua", "au")
        out["head"] = e["initial"] if out["head"] is None else out["head"]
        out["tail"] = e["initial"]
        if e["turn"] is not None and e["turn"] != out["high"]:
            out["distinct"] += 1
            out["high"] = e["turn"]
            out["low"] = e["turn"] if out["low"] is None else out["low"]
    return out | {"audit": "".join(audit), "lines": lines}


def report(conversations: DataFrame, turns: DataFrame, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per conv_id of `conversations`: gaps, faults and the cheapest repair of its rows in `turns`.

    A block's edits are summed where they were made. Only the sums and the repaired lines of conversations of
    several blocks meet again: a digest and an audit need them in order, so they stream through one task, which
    holds one block and the audit. A conversation without rows in `turns` has zeros, an empty audit and the digest
    of nothing. `gaps` counts turn numbers that miss between the smallest and the largest.
    """
    conv = turns.schema["conv_id"].dataType.simpleString()
    turn = turns.schema["turn"].dataType.simpleString()
    schema = f"conv_id {conv}, block bigint, alone boolean, {_SUMS}, head string, tail string, low {turn}, high {turn}, distinct bigint, audit string, lines string"
    sums = ["blank", "duplicate", "truncated", "illegal", "cost"]
    rest = ["head", "tail", "low", "high", "distinct", "audit"]

    def sum_up(batches):
        for _, group in groupby(_records(batches), lambda r: (r["conv_id"], r["block"])):
            made = list(group)
            out = _summed(made)
            said = "\n".join(out["lines"])
            if made[0]["alone"]:
                said = hashlib.sha256(said.encode()).hexdigest()
            elif out["lines"]:  # a line break before each of the conversation's lines tells "no line" from an empty one
                said = "\n" + said
            yield made[0]["conv_id"], made[0]["block"], made[0]["alone"], *(out[c] for c in [*sums, *rest]), said

    def join_up(batches):
        for key, group in groupby(_records(batches), lambda r: r["conv_id"]):
            total, digest, audit = dict.fromkeys(sums, 0), hashlib.sha256(), []
            tail, low, high, distinct, begun = None, None, None, 0, False
            for r in group:
                for c in sums:
                    total[c] += r[c]
                total["illegal"] += tail is not None and tail + r["head"] not in ("su", "ua", "au")
                tail = r["tail"]
                if r["low"] is not None:
                    distinct += r["distinct"] - (r["low"] == high)
                    low, high = r["low"] if low is None else low, r["high"]
                audit.append(r["audit"])
                if r["lines"]:
                    digest.update(r["lines"][not begun :].encode())
                    begun = True
            yield key, None, True, *(total[c] for c in sums), None, None, low, high, distinct, "".join(audit), digest.hexdigest()

    parts = stored(_mapped(edits(turns, block_rows, block_bytes), sum_up, schema))
    cut = parts.filter("not alone").repartition("conv_id").sortWithinPartitions("conv_id", "block")
    done = parts.filter("alone").unionByName(_mapped(cut, join_up, schema)).withColumnRenamed("conv_id", "_conv")
    every = conversations.select("conv_id").distinct()
    found = every.join(done, every["conv_id"].eqNullSafe(done["_conv"]), "left")
    gaps = F.when(F.col("distinct") > 0, F.col("high") - F.col("low") + 1 - F.col("distinct")).otherwise(0).cast("bigint")
    zero = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in sums]
    return found.select(
        "conv_id",
        gaps.alias("gaps"),
        *zero,
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("lines", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
