"""Entity extraction and overlap, in-row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from personaloom.functions.rows import let

# The entity patterns, matched in any case. The class [A-Z|a-z]
# admits a pipe character, which is kept.
PATTERNS = {
    "EMAIL": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "PHONE": r"\b(?:\+?1[-.]?)?\(?([0-9]{3})\)?[-.]?([0-9]{3})[-.]?([0-9]{4})\b",
    "SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "ZIP_CODE": r"\b\d{5}(?:-\d{4})?\b",
    "CREDIT_CARD": r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b",
}
# Fixed value: two capitalised words, matched case-sensitively.
PERSON_PATTERN = r"\b[A-Z][a-z]+ [A-Z][a-z]+\b"

ENTITY_TYPES = [*PATTERNS, "PERSON"]
ENTITY_ARRAY = "array<struct<type:string,value:string>>"


def pattern_values(text: Column, kind: str) -> Column:
    """Distinct values of one entity type; a phone number is its ten digits."""
    if kind == "PERSON":
        return F.array_distinct(F.regexp_extract_all(text, F.lit(PERSON_PATTERN), F.lit(0)))
    found = F.regexp_extract_all(text, F.lit("(?i)" + PATTERNS[kind]), F.lit(0))
    if kind == "PHONE":
        found = F.transform(found, lambda m: F.right(F.regexp_replace(m, "[^0-9]", ""), F.lit(10)))
    return F.array_distinct(found)


def pattern_entities(text: Column) -> Column:
    """All pattern entities of a text as ARRAY<STRUCT<type, value>>; empty for null text."""
    def typed(kind):
        return F.transform(
            pattern_values(text, kind),
            lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")),
        )

    per_type = [typed(kind) for kind in ENTITY_TYPES]
    return F.coalesce(F.concat(*per_type), F.expr(f"cast(array() as {ENTITY_ARRAY})"))


def overlapping(real: Column, synthetic: Column) -> Column:
    """Entities of `real` that hold, or are held by, an entity of the same type in `synthetic`.

    Case does not matter. Values of one type are tested only against that type.
    """

    lowered = F.transform(
        synthetic, lambda s: F.struct(s["type"].alias("type"), F.lower(s["value"]).alias("low"))
    )

    def within(others):
        def touches(r):
            low = F.lower(r["value"])
            return F.exists(
                others,
                lambda s: (s["type"] == r["type"])
                & (F.contains(low, s["low"]) | F.contains(s["low"], low)),
            )

        return touches

    # both sides are extracted once per record, not once per entity
    return let(
        F.struct(real.alias("r"), lowered.alias("s")), lambda b: F.filter(b["r"], within(b["s"]))
    )


def entities_json(entities: Column) -> Column:
    """Entities as JSON text {type: [values]}; types and values in order."""
    def of_type(kind):
        return F.array_sort(
            F.transform(F.filter(entities, lambda e: e["type"] == kind), lambda e: e["value"])
        )

    kinds = F.array_sort(F.array_distinct(F.transform(entities, lambda e: e["type"])))
    pairs = F.transform(kinds, lambda k: F.struct(k.alias("key"), of_type(k).alias("value")))
    return F.to_json(F.map_from_entries(pairs))
