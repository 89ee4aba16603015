"""Social handles: tolerant parsing and mention tests, all in-row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from personaloom.functions.rows import let

_PY_NULL = r"(?<=[:,\[]\s{0,4})None(?=\s{0,4}[,}\]])"


def parse_handles(handles: Column) -> Column:
    """Handle text to MAP<STRING, ARRAY<STRING>>.

    Accepts JSON and single-quoted Python dict text; a single handle becomes a
    one-element array, null values are dropped, a repeated platform keeps its
    first place and its last value, and unreadable or empty text gives an
    empty map.
    """
    loose = F.from_json(F.regexp_replace(handles, _PY_NULL, "null"), "map<string,string>")
    found = F.coalesce(loose, F.expr("cast(map() as map<string,string>)"))

    def last_values(m):
        entries = F.map_entries(m)
        return F.transform(
            F.array_distinct(F.map_keys(m)),
            lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1),
        )

    def as_list(v):
        listed = F.filter(F.from_json(v, "array<string>"), lambda x: x.isNotNull())
        return F.when(v.startswith("["), listed).otherwise(F.array(v))

    given = F.filter(let(found, last_values), lambda e: e["value"].isNotNull())
    pairs = F.transform(
        given, lambda e: F.struct(e["key"].alias("key"), as_list(e["value"]).alias("value"))
    )
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def handle_values(handles: Column) -> Column:
    """All handles of a parsed map as one array, in platform order."""
    return F.flatten(F.map_values(handles))


def first_mention(text: Column, values: Column, first_name: Column) -> Column:
    """First handle, then the first name, that the text holds in any case; null when none does."""
    lowered = F.lower(text)
    names = F.concat(values, F.array(first_name))
    return F.get(F.filter(names, lambda h: (h != "") & F.contains(lowered, F.lower(h))), F.lit(0))


def is_mentioned(text: Column, values: Column, first_name: Column) -> Column:
    """True where any handle or the first name occurs in the text."""
    lowered = F.lower(text)
    by_handle = F.exists(values, lambda h: (h != "") & F.contains(lowered, F.lower(h)))
    by_name = (first_name != "") & F.contains(lowered, F.lower(first_name))
    return F.coalesce(by_handle, F.lit(False)) | F.coalesce(by_name, F.lit(False))
