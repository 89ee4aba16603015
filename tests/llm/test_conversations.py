"""Conversation repair against brute force, on odd rows and on blocks of a few rows."""

import hashlib
import random
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from personaloom.llm import conversation_repair

SPACE = " \t\n\x0b\x0c\r"
NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
FULL = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """Cost, edits and repaired lines by plain recursion; rows are (initial, role, text, fault)."""

    @lru_cache(maxsize=None)
    def best(i, state, inserts):
        ways = []
        if i == len(rows) and state in ("", "a"):
            ways.append((0, "", ()))
        wanted = next(x for x in NEXT[state] if x != "s")
        if inserts < 3:
            cost, text, lines = best(i, wanted, inserts + 1)
            ways.append((cost + 5, "I" + text, (FULL[wanted] + ":", *lines)))
        if i < len(rows):
            initial, role, text, fault = rows[i]
            cost, after, lines = best(i + 1, state, 0)
            ways.append((cost + 2, "D" + after, lines))
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                if initial in NEXT[state]:
                    cost, after, lines = best(i + 1, NEXT[state][initial], 0)
                    ways.append((cost + extra, "K" + after, (f"{role}:{text}", *lines)))
                cost, after, lines = best(i + 1, wanted, 0)
                ways.append((cost + extra + 1, "R" + after, (f"{FULL[wanted]}:{text}", *lines)))
        return min(ways) if ways else (10**9, "", ())

    return best(0, "", 0)


def expected(turns):
    """Per conversation, from (conv_id, turn, role, text) rows: the columns of the report."""
    by = defaultdict(list)
    for conv, turn, role, text in turns:
        by[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, found in by.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:100], hashlib.sha256(f"{conv}:{r[1]}{r[2]}".encode()).hexdigest()))
        seen, rows = set(), []
        for _, role, text in found:
            said = text.strip(SPACE)
            fault = "blank" if not said else "duplicate" if (role, text) in seen else None if said[-1] in ".!?" else "truncated"
            seen.add((role, text))
            rows.append((role[:1], role, text, fault))
        kinds = [r[3] for r in rows]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        numbers = {t for t, *_ in found if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        cost, audit, lines = cheapest(tuple(rows))
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, digest)
    return out


def broken(seed, conversations):
    pick = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(pick.randrange(9) if conv else 60):
            role = pick.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "unknown", None])
            text = pick.choice(["Yes.", "No!", "cut", " ", "", None, f"t{pick.randrange(3)}?", "x." + "y" * 150])
            rows.append((None if conv == 5 else conv, None if pick.random() < 0.1 else turn + pick.randrange(2), role, text))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, block string, at long"


def table(spark, rows):
    """With columns whose names the operator uses itself."""
    return spark.createDataFrame([(*r, "x", None) for r in rows], SCHEMA)


@pytest.mark.parametrize("block_rows", [3, 7, 4096])
def test_repair_equals_brute_force(spark, block_rows):
    rows = broken(block_rows, 40)
    turns = table(spark, rows)
    got = {r[0]: tuple(r)[1:] for r in conversation_repair.report(turns, turns, block_rows=block_rows).collect()}
    assert got == expected(rows)


def test_damage(spark):
    rows = broken(1, 30)
    got = conversation_repair.damaged(table(spark, rows)).collect()
    want = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        want += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_one_conversation_of_equal_rows_is_split(spark):
    """Thousands of rows of one turn number, most of them equal, in blocks of 50 over many tasks."""
    rows = [(7, None, "user", "same.")] * 3000 + [(7, 1, "assistant", f"a{i}." + "z" * (i % 40)) for i in range(40)]
    turns = table(spark, rows)
    held = conversation_repair.blocks(turns, block_rows=50)
    assert held.groupBy("block").count().agg(F.max("count")).first()[0] <= 50
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so little data would else be one task
    try:
        assert held.groupBy(F.shiftright("block", 40)).count().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = conversation_repair.report(turns, turns, block_rows=50).first()
    assert got["duplicate"] == 2999 and len(got["audit"].replace("I", "")) == 3040
    done = conversation_repair.repaired(turns).orderBy("place").collect()
    assert [r["role"][0] for r in done] == ["u", "a"] * (len(done) // 2)


def test_empty_tables_and_lost_conversations(spark):
    turns = table(spark, broken(2, 5))
    none = turns.filter("conv_id < -5")
    assert conversation_repair.report(none, none).count() == 0
    assert conversation_repair.edits(none).count() == 0
    lost = conversation_repair.report(turns.select("conv_id"), none).collect()
    assert lost and all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in lost)
