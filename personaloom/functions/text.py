"""Text, JSON-cell and number helpers as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that Python's str.strip() and str.split() treat as blank.
_BLANK_CODES = [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]
BLANK_CHARS = "".join(map(chr, _BLANK_CODES))
# The same set as a pattern; a blank class is tested much faster than a list of characters.
_WORD = r"(?U)[^\s\x1c-\x1f]++"


def strip_blanks(c: Column) -> Column:
    """Drop blank characters of any script from both ends."""
    return F.btrim(c, F.lit(BLANK_CHARS))


def word_count(c: Column) -> Column:
    """Number of runs of non-blank characters."""
    return F.regexp_count(c, F.lit(_WORD))


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def alnum_only(c: Column) -> Column:
    """Lower-cased text reduced to ASCII letters and digits."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def safe_name(c: Column) -> Column:
    """A value usable as a file or folder name: all but word characters, '-', '_' and '.' become '_'."""
    return F.regexp_replace(c, r"(?U)[^\w\-_.]", "_")


def money_value(c: Column) -> Column:
    """Currency text to DOUBLE: keep digits and dots only (the sign is lost), anything unreadable is 0."""
    return F.coalesce(F.regexp_replace(c, "[^0-9.]", "").try_cast("double"), F.lit(0.0))


def int_or_zero(c: Column) -> Column:
    """Whole number, or 0 where the text is none; fractions are cut off for numeric input only."""
    return F.coalesce(c.try_cast("int"), F.lit(0))


def json_cell(c: Column) -> Column:
    """Quote a STRING so that tabs, quotes and newlines fit in one cell."""
    boxed = F.to_json(F.struct(c.alias("v")))
    # {"v":...} -> the quoted value; a null string gives {} and stays null
    return F.when(c.isNotNull(), F.substr(boxed, F.lit(6), F.length(boxed) - F.lit(6)))


def decode_json_cell(c: Column) -> Column:
    """Undo json_cell; cells that are no JSON string stay as they are, a bare null becomes null.

    Numbers and other JSON values keep their own text, as every column stays STRING.
    """
    quoted = F.btrim(c).startswith('"')
    decoded = F.try_variant_get(F.try_parse_json(c), "$", "string")
    return F.when(quoted, F.coalesce(decoded, c)).when(c != "null", c)


def decode_json_cell_or_empty(c: Column) -> Column:
    """Text of a JSON cell; whatever is no JSON becomes ''."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(c), "$", "string"), F.lit(""))
