"""Which profile fields does each text reveal?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from personaloom.functions.handles import parse_handles
from personaloom.functions.rows import explode_once
from personaloom.functions.text import (
    alnum_only,
    digits_only,
    money_value,
    strip_blanks,
    word_count,
)

# Profile fields searched in texts, by kind of comparison.
GENERAL_FIELDS = [
    "First Name", "Last Name", "Father's Name", "Mother's Name", "Spouse Name",
    "Emergency Contact Name", "Gender", "Age", "Nationality", "Marital Status", "Children Count",
    "Birth Date", "Birth City", "Blood Type", "Email Address", "Work Email", "Education Info",
    "Finance Status", "Employer", "Job Title", "Credit Score",
]
ID_FIELDS = ["National ID", "Passport Number", "Driver's License"]
PHONE_FIELDS = ["Phone Number", "Work Phone", "Emergency Contact Phone"]
ADDRESS_FIELD = "Address"
HEALTH_FIELDS = ["Allergies", "Disability"]
HANDLE_FIELD = "Social Media Handle"
# Street words that do not identify an address.
STREET_WORDS = [
    "mount", "road", "street", "st", "rd", "ave", "avenue", "ln", "lane", "dr", "drive", "blvd",
    "boulevard", "ct", "court", "pl", "place", "pkwy", "parkway", "cir", "circle",
]

MATCH = "struct<field:string,original:string,matched:string>"


def column_name(field: str) -> str:
    """Column that holds a profile field: lower case, words joined by '_', no apostrophes."""
    return field.lower().replace("'", "").replace(" ", "_")


def long_enough(value: Column) -> Column:
    """All digits (one is enough), or at least three characters."""
    return value.rlike("^[0-9]+$") | (F.length(value) >= 3)


def address_parts(address: Column) -> Column:
    """Distinct parts of an address without street words, longest first, ties by alphabet."""
    plain = F.regexp_replace(F.lower(address), r"\b(?:" + "|".join(STREET_WORDS) + r")\b", "")
    by_comma = F.transform(F.split(plain, ","), strip_blanks)
    by_blank = F.split(plain, r"\s+")
    parts = F.filter(F.array_union(by_comma, by_blank), lambda p: F.length(p) >= 3)
    ranked = F.array_sort(F.transform(parts, lambda p: F.struct(-F.length(p), p.alias("part"))))
    return F.transform(ranked, lambda r: r["part"])


# A profile value to look for, and the form of the text to look in: lower, alnum or digits.
VALUE = "struct<field:string,mode:string,original:string,value:string>"
VALUES = "_search_values"


def field_values() -> Column:
    """ARRAY of VALUE: every profile field in the spelling that texts are searched for; nulls are left out.

    Identifiers are reduced to letters and digits, phone numbers to digits, all others to lower case. Health fields that
    say 'none' hold nothing. Profile columns are read by `column_name`.
    """
    forms = [
        ("lower", GENERAL_FIELDS, lambda c: F.lower(c.cast("string"))),
        ("alnum", ID_FIELDS, alnum_only),
        ("digits", PHONE_FIELDS, digits_only),
        ("lower", HEALTH_FIELDS, lambda c: F.nullif(F.lower(c), F.lit("none"))),
    ]
    found = []
    for mode, fields, spelt in forms:
        for field in fields:
            c = F.col(column_name(field))
            row = F.struct(F.lit(field).alias("field"), F.lit(mode).alias("mode"), c.cast("string").alias("original"), spelt(c).alias("value"))
            found.append(F.when(spelt(c).isNotNull(), row))
    return F.array_compact(F.array(*found))


def search_values() -> Column:
    """The field values that are long enough to tell something."""
    return F.filter(field_values(), lambda v: long_enough(v["value"]))


def with_search_values(records: DataFrame, handles: str = "social_media_handles") -> DataFrame:
    """Adds what `field_matches` looks for, built once per record: values, address parts and handles."""
    pairs = F.flatten(
        F.transform(
            F.map_entries(parse_handles(F.col(handles))),
            lambda e: F.transform(e["value"], lambda h: F.struct(e["key"].alias("p"), h.alias("h"), F.lower(h).alias("low"))),
        )
    )
    made = F.struct(
        search_values().alias("values"),
        F.col(column_name(ADDRESS_FIELD)).cast("string").alias("address"),
        address_parts(F.col(column_name(ADDRESS_FIELD))).alias("parts"),
        F.filter(pairs, lambda p: p["h"] != "").alias("handles"),
    )
    return records.withColumn(VALUES, made)


def field_matches(lowered: Column, digits: Column, alnum: Column) -> Column:
    """ARRAY<STRUCT<field, original, matched>> of the profile fields that a text reveals.

    The three text forms must be stored columns (lower case, digits only, letters and digits only), so that
    each is computed once per text. The values come from `with_search_values`; of an address the longest part counts.
    """
    wanted = F.col(VALUES)

    def reveals(v):
        return (
            F.when(v["mode"] == "lower", F.contains(lowered, v["value"]))
            .when(v["mode"] == "digits", F.contains(digits, v["value"]))
            .otherwise(F.contains(alnum, v["value"]))
        )

    by_field = F.transform(
        F.filter(wanted["values"], reveals),
        lambda v: F.struct(v["field"].alias("field"), v["original"].alias("original"), v["value"].alias("matched")),
    )
    part = F.slice(F.filter(wanted["parts"], lambda p: F.contains(lowered, p)), 1, 1)
    by_address = F.transform(
        part, lambda p: F.struct(F.lit(ADDRESS_FIELD).alias("field"), wanted["address"].alias("original"), p.alias("matched"))
    )
    by_handle = F.transform(
        F.filter(wanted["handles"], lambda p: F.contains(lowered, p["low"])),
        lambda p: F.struct(
            F.lit(HANDLE_FIELD).alias("field"), F.concat(p["p"], F.lit(": "), p["h"]).alias("original"), p["low"].alias("matched")
        ),
    )
    none = F.expr(f"cast(array() as array<{MATCH}>)")
    return F.concat(by_field, F.coalesce(by_address, none), F.coalesce(by_handle, none))


def add_mentions(texts: DataFrame, text: str = "text", handles: str = "social_media_handles") -> DataFrame:
    """Add the matches and their counts to rows that hold a text and its profile columns.

    Rows of `with_search_values` bring what to look for along; others get it here.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = texts if VALUES in texts.columns else with_search_values(texts, handles)
    forms = rows.withColumns({"_lower": F.lower(t), "_digits": digits_only(t), "_alnum": alnum_only(t)})
    matched = forms.withColumn(
        "mentions", field_matches(F.col("_lower"), F.col("_digits"), F.col("_alnum"))
    ).drop("_lower", "_digits", "_alnum", VALUES)
    fields = F.array_distinct(F.transform(F.col("mentions"), lambda m: m["field"]))
    return (
        matched.withColumn("mentioned_pii_fields", fields)
        .withColumn("num_mentioned_pii_fields", F.size("mentioned_pii_fields"))
        .withColumn("any_pii_mentioned", F.col("num_mentioned_pii_fields") > 0)
    )


# Long texts of a record that no feature needs.
RECORD_TEXTS = ("model_output", "passage_output", "synthetic_article")


def explode_pairs(
    records: DataFrame, pairs: str = "content_pairs", real_text: str = "real_person_text_input",
    error: str = "error",
) -> DataFrame:
    """One row per content pair with lengths, money as numbers and the record's flags.

    The record's own texts (`RECORD_TEXTS`, the seed text and the error) stay behind: of them
    only lengths and flags go along, so that no text is stored once per pair.
    """
    record = records.withColumns(
        {
            "real_person_text_length": F.length(F.coalesce(F.col(real_text), F.lit(""))),
            "generation_error": F.col(error).isNotNull(),
        }
    )
    kept = [c for c in record.columns if c not in (pairs, real_text, error, *RECORD_TEXTS)]
    rows = explode_once(record, pairs, kept, "_pair", "content_pair_index")
    text = F.coalesce(F.col("_pair.Text"), F.lit(""))
    has = lambda c: F.lower(F.coalesce(F.col(c), F.lit("None"))) != "none"
    return rows.withColumns(
        {
            "content_type": F.col("_pair.ContentType"),
            "synthetic_text": text,
            "synthetic_text_length": F.length(text),
            "synthetic_word_count": word_count(text),
            "net_worth_value": money_value(F.col("net_worth")),
            "annual_salary_value": money_value(F.col("annual_salary")),
            "has_allergies": has("allergies"),
            "has_disability": has("disability"),
        }
    ).drop("_pair")


def feature_rows(records: DataFrame) -> DataFrame:
    """One row per text with its features and mentions; row-local, so no shuffle.

    What is looked for is built once per record, before its texts are taken apart.
    """
    return add_mentions(explode_pairs(with_search_values(records)), "synthetic_text")


def mention_details(features: DataFrame, keep: tuple[str, ...] = ("unique_id",)) -> DataFrame:
    """One row per match: what was looked up, what was found and in which text."""
    rows = explode_once(features, "mentions", [*keep, "content_type", "synthetic_text"], "_m")
    return rows.select(
        *keep,
        "content_type",
        F.col("_m.field").alias("pii_field_name"),
        F.col("_m.original").alias("original_pii_value_from_input"),
        F.col("_m.matched").alias("pii_value_checked"),
        "synthetic_text",
    )
