"""Reproducible random draws.

A draw is a function of a row key and a salt, so a retried task, another
partition count or another engine gives the same value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(key: Column | str, salt: str) -> Column:
    """DOUBLE in [0, 1) from the first 32 bits of md5(key|salt)."""
    if isinstance(key, str):
        # one parsed expression instead of many small calls, as profiles hold some hundred draws
        return F.expr(
            f"cast(conv(substring(md5(concat(cast(`{key}` AS string), '|{salt}')), 1, 8), 16, 10) "
            "AS bigint) / 4294967296.0D"
        )
    digest = F.md5(F.concat(key.cast("string"), F.lit(f"|{salt}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def uniform_between(key: Column | str, salt: str, low, high) -> Column:
    low, high = _number(low), _number(high)
    return low + uniform(key, salt) * (high - low)


def whole_between(key: Column | str, salt: str, low: int, high: int) -> Column:
    """BIGINT in [low, high], both ends included."""
    return F.lit(low) + F.floor(uniform(key, salt) * F.lit(high - low + 1))


def order_hash(key: Column | str, seed: int | str) -> Column:
    """The md5 text that a seeded shuffle orders by."""
    return F.md5(F.concat(F.lit(f"{seed}|"), (F.col(key) if isinstance(key, str) else key).cast("string")))


def stable_uuid(seed: str, *keys: Column) -> Column:
    """An id in UUID form that depends on the seed and the keys only."""
    parts = [F.coalesce(k.cast("string"), F.lit("")) for k in keys]
    h = F.md5(F.concat_ws("|", F.lit(seed), *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat_ws("-", *cut)


def weighted_choice(draw: Column, values: Sequence, weights: Sequence) -> Column:
    """Pick one value with probability proportional to its weight.

    Weights may be numbers or columns. The result is one CASE expression over
    cumulative weights, so it stays inside generated code.
    """
    if len(values) != len(weights) or not values:
        raise ValueError("values and weights must have the same length, at least 1")
    constant = not any(isinstance(w, Column) for w in weights)
    steps, total = [], 0.0 if constant else F.lit(0.0)
    for w in weights:
        total = total + (float(w) if constant else _number(w))
        steps.append(total)
    point = draw * F.lit(total) if constant else draw * total
    choice = None
    for value, step in zip(values[:-1], steps[:-1]):
        hit = point < step
        choice = F.when(hit, F.lit(value)) if choice is None else choice.when(hit, F.lit(value))
    last = F.lit(values[-1])
    return last if choice is None else choice.otherwise(last)


def pick(draw: Column, values: Sequence[str]) -> Column:
    """Pick one of a few constants with equal probability."""
    mark = "\n"
    listed = F.split(F.lit(mark.join(values)), mark)
    return F.get(listed, F.floor(draw * F.lit(len(values))).cast("int"))


def _number(v) -> Column:
    return v.cast("double") if isinstance(v, Column) else F.lit(float(v))
