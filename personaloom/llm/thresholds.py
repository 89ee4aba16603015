"""Budget thresholds on hashed places, found from histograms that are refined where a threshold falls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places are hashes of 36 bits, looked at 12 bits at a time.
PLACE_BITS, STEP_BITS = 36, 12


def nested_cuts(rows: DataFrame, budgets: dict[int, list[int]]) -> dict[int, list[int]]:
    """For each group and budget the largest place so that the sizes of the group's rows below it fit the budget.

    `rows` has `group` (int), `place` and `size`. The first pass sums sizes by group and the place's upper bits;
    a later one only looks at the buckets that hold a threshold. What comes to the driver is one row per
    bucket: groups x 4096 first, thresholds x 4096 then, whatever the number of rows.
    """
    cuts = {g: [1 << PLACE_BITS] * len(wanted) for g, wanted in budgets.items()}
    state = {(g, i): (0, 0) for g, wanted in budgets.items() for i in range(len(wanted))}  # boundary bucket, size below it
    for shift in range(PLACE_BITS - STEP_BITS, -1, -STEP_BITS):
        if not state:
            break
        upper = shift + STEP_BITS
        key = F.shiftleft(F.col("group").cast("bigint"), PLACE_BITS - upper) + F.shiftright("place", upper)
        within = sorted({(g << (PLACE_BITS - upper)) + bucket for (g, _), (bucket, _) in state.items()})
        sums = rows.filter(key.isin(within)).groupBy("group", F.shiftright("place", shift).alias("bucket")).agg(F.sum("size").alias("size"))
        inside: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for g, bucket, size in sorted((r["group"], r["bucket"], r["size"]) for r in sums.collect()):
            inside.setdefault((g, bucket >> STEP_BITS), []).append((bucket, size))
        found = {}
        for (g, i), (bucket, below) in state.items():
            for lower, size in inside.get((g, bucket), []):
                if below + size > budgets[g][i]:
                    found[g, i] = (lower, below)
                    cuts[g][i] = lower << shift
                    break
                below += size
        state = found  # what fits as a whole has no boundary bucket
    return cuts


def place_of(*columns) -> Column:
    """A hashed place of the given columns."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - PLACE_BITS)
