"""Operator inputs derived from the given tables.

Column rules are written in the part of SQL that Spark and DuckDB read the
same way, so that queries and their check SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from personaloom.functions.text import json_cell
from personaloom.operators.catalogue import LOCALES, job_catalogue
from personaloom.sources.readers import read_spread

NL, QUOTE = "chr(10)", "chr(39)"


# Tables on which the work per row is heavy: long texts, and the keys of profiles.
HEAVY_TABLES = ("documents", "conversations", "customer")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return read_spread(spark, path) if name in HEAVY_TABLES else spark.read.parquet(path)


def case(expr: str, values: list[str], other: str) -> str:
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE {expr} {arms} ELSE {other} END"


def quoted(*values: str) -> list[str]:
    return [f"'{v}'" for v in values]


_ID = "cast(conv_id AS string)"
_W1 = "replace(replace(split_part(text, ' ', 1), '.', ''), ',', '')"
_W2 = "replace(replace(split_part(text, ' ', 2), '.', ''), ',', '')"
_PAD = f"lpad(cast(conv_id % 10000 AS string), 4, '0')"
_BODY = (
    f"concat(text, CASE turn % 3 WHEN 0 THEN concat({NL}, 'Call 1 555 010 ', {_PAD}) "
    f"WHEN 1 THEN concat({NL}, 'See ', cast(18 + conv_id % 73 AS string), ' card AB ', {_PAD}, ' 77 [1] and more') ELSE '' END)"
)
_LABEL1 = case(
    "(conv_id + turn) % 8",
    quoted("Social Media", "Forum", "Review", "Comment", "Promotion", "Poem", "social media"),
    "'Social Post'",
)
_LABEL2 = case(
    "(conv_id + 2 * turn) % 5",
    quoted("Blog Comment", "Forum Thread", "Social Network", "Customer Review"),
    "'Marketing'",
)
_OUTPUT = (
    f"CASE WHEN turn = 6 THEN NULL ELSE concat('Intro', {NL}, '[', {_LABEL1}, ']', {NL}, "
    f"replace({_BODY}, {NL}, concat({NL}, {NL}, '[', {_LABEL2}, ']', {NL})), "
    f"{NL}, '[Forum Post]  ', {NL}, '[Online Ad] sold by ', {_ID}) END"
)
_HANDLES = case(
    "conv_id % 6",
    [
        "'{}'",
        f"concat('{{\"Twitter\":\"@u', {_ID}, '\",\"Reddit\":\"', {_W1}, '\"}}')",
        f"concat('{{', {QUOTE}, 'Twitter', {QUOTE}, ': ', {QUOTE}, '@u', {_ID}, {QUOTE}, ', ', "
        f"{QUOTE}, 'TikTok', {QUOTE}, ': ', {QUOTE}, {_W2}, {QUOTE}, '}}')",
        f"concat('{{\"Facebook\":[\"@f', {_ID}, '\",\"', {_W2}, '\"],\"X\":\"@x', {_ID}, '\"}}')",
        "'not a dict'",
    ],
    "NULL",
)
_PASSAGE = (
    f"CASE turn % 4 WHEN 0 THEN concat('x [Synthetic Article]', {NL}, text, ' ', {NL}, "
    "'[Real Person Text Usage Notes] none [Real Person Text Usage Notes]') "
    f"WHEN 1 THEN concat('[Synthetic Article]', text) "
    f"WHEN 2 THEN concat('[Synthetic Article] ', {NL}, '[Real Person Text Usage Notes]') ELSE "
    f"concat('[Synthetic Article]', text, {NL}, '[Real Person Text Usage Notes]') END"
)

# One generation record per conversation row.
RECORD_RULES: dict[str, str] = {
    "conv_id": "conv_id",
    "turn": "turn",
    "unique_id": f"concat('P', {_ID})",
    "locale": case("conv_id % 3", quoted("en_US", "en_GB"), "'en_US'"),
    "first_name": f"CASE WHEN turn % 2 = 1 THEN {_W1} ELSE concat('Zq', {_ID}) END",
    "last_name": f"concat('Qz', {_ID})",
    "fathers_name": "split_part(text, ' ', 3)",
    "mothers_name": f"concat('Mother ', {_ID})",
    "spouse_name": f"CASE WHEN conv_id % 4 = 0 THEN NULL ELSE concat('Sp ', {_ID}) END",
    "gender": case("conv_id % 4", quoted("Male", "Female", "Other"), "'Female'"),
    "age": "cast(18 + conv_id % 73 AS int)",
    "age_text": "CASE WHEN turn = 5 THEN 'unknown' ELSE cast(18 + conv_id % 73 AS string) END",
    "nationality": case("conv_id % 3", quoted("American", "British"), "'American'"),
    "marital_status": case("conv_id % 4", quoted("Single", "Married", "Divorced"), "'Widowed'"),
    "children_count": "cast(conv_id % 5 AS int)",
    "national_id": f"concat('ab-', {_PAD}, '-77')",
    "passport_number": "CASE WHEN conv_id % 5 = 0 THEN 'N/A' ELSE concat('X', cast(conv_id AS string)) END",
    "drivers_license": "'N/A'",
    "phone_number": f"concat('+1 (555) 010-', {_PAD})",
    "work_phone": "'N/A'",
    "address": f"concat({_ID}, ' ', {_W2}, ' Street, Mount ', split_part(text, ' ', 4))",
    "email_address": f"concat('p', {_ID}, '@example.com')",
    "work_email": "''",
    "birth_date": "'1990-01-02'",
    "birth_city": "split_part(text, ' ', 5)",
    "education_info": case("conv_id % 3", quoted("High School", "PhD"), "'Diploma'"),
    "finance_status": case("conv_id % 3", quoted("Low", "Medium"), "'High'"),
    "net_worth": f"concat('$', CASE WHEN conv_id % 2 = 0 THEN '-' ELSE '' END, {_ID}, '.5')",
    "employer": f"concat('Works ', {_ID})",
    "job_title": f"concat('Job ', cast(conv_id % 20 AS string))",
    "annual_salary": f"CASE WHEN conv_id % 7 = 0 THEN 'unknown' ELSE concat('$', cast(1000 * conv_id AS string)) END",
    "credit_score": "cast(300 + conv_id % 551 AS int)",
    "social_media_handles": _HANDLES,
    "blood_type": case("conv_id % 2", quoted("A+"), "'O-'"),
    "allergies": case("conv_id % 3", quoted("None", "Dust"), "'None'"),
    "disability": "CASE WHEN conv_id % 10 = 0 THEN 'Visual' ELSE 'None' END",
    "emergency_contact_name": f"concat('Helper ', {_ID})",
    "emergency_contact_phone": f"concat('+44 20 ', {_PAD})",
    "model_output": _OUTPUT,
    "passage_output": _PASSAGE,
    "real_person_text_input": "concat(role, ': ', text)",
    "error": "CASE WHEN conv_id % 9 = 0 THEN 'timeout' ELSE NULL END",
}

# The columns of a record that make up its profile.
PROFILE_FIELDS = [c for c in RECORD_RULES if c not in (
    "conv_id", "turn", "age_text", "model_output", "passage_output", "real_person_text_input", "error"
)]

RECORDS_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in RECORD_RULES.items()) + " FROM conversations"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second-stage records with profile, handles, model output and passage output."""
    rules = [f"{e} AS {n}" for n, e in RECORD_RULES.items()]
    return table(spark, sf_dir, "conversations").selectExpr(*rules)


# Real text and passage: the two halves of a document.
_HALF = "cast(floor(length(text) / 2.0) AS int)"
HALVES_RULES = {
    "doc_id": "doc_id",
    "real_person_text_input": f"concat(substr(text, 1, {_HALF}), CASE doc_id % 5 WHEN 0 THEN ' Ann Lee' "
    "WHEN 1 THEN ' call 555-010-9999 or 1-555-010-9999' WHEN 2 THEN ' zip 12345-6789' ELSE '' END)",
    "generated_synthetic_passage": f"CASE WHEN doc_id % 17 = 0 THEN ' ' ELSE concat(substr(text, {_HALF} + 1), "
    "CASE doc_id % 5 WHEN 0 THEN ' by Joann Leeson and Ann Lee' WHEN 1 THEN ' fax (555)010-9999' "
    "WHEN 2 THEN ' zip 12345 id 123-45-6789' ELSE '' END) END",
}
HALVES_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in HALVES_RULES.items()) + " FROM documents"


def halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [f"{e} AS {n}" for n, e in HALVES_RULES.items()]
    return table(spark, sf_dir, "documents").selectExpr(*rules)


def deep_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose wanted section lies 1 to 30 levels deep, among parts of odd shapes."""
    n = (F.col("doc_id") % 30).cast("int")
    text = F.concat(F.lit('{"type":"section","name":"Personal life","has_parts":["odd [[",7,null,{"x":[[]]},'
                          '{"type":"paragraph","value":'), json_cell(F.col("text")), F.lit("}]}"))
    level = F.lit('"just text",{"type":"section","name":"Level","has_parts":[')
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("["), F.repeat(level, n), text, F.repeat(F.lit("]}"), n), F.lit("]")).alias("sections")
    )


def wiki_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encyclopaedia records: both halves of a document as section texts at varying depth."""
    docs = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    half = F.floor(F.length("text") / F.lit(2.0)).cast("int")
    a = json_cell(F.substr("text", F.lit(1), half))
    b = json_cell(F.substr("text", half + 1))

    def paragraph(cell):
        return F.concat(F.lit('{"type":"paragraph","value":'), cell, F.lit("}"))

    def section(name, *parts):
        return F.concat(
            F.lit('{"type":"section","name":'), json_cell(name), F.lit(',"has_parts":['),
            F.concat_ws(",", *parts), F.lit("]}"),
        )

    list_part = F.lit('{"type":"list","value":"no paragraph"}')
    empty = F.lit('{"type":"section","name":"Personal life","has_parts":null}')
    nested = section(
        F.lit("Biography"),
        paragraph(a),
        section(
            F.lit(" EARLY LIFE and education"), list_part, paragraph(a),
            section(F.lit("Later personal life"), paragraph(b)), paragraph(b),
        ),
    )
    flat = F.concat_ws(
        ",", section(F.lit("Personal life"), paragraph(b), list_part), section(F.lit("Early life"), paragraph(a))
    )
    other = section(F.lit("Career"), paragraph(a))
    tree = (
        F.when(k % 4 == 0, nested).when(k % 4 == 1, flat).when(k % 4 == 2, other).otherwise(empty)
    )
    box = F.when(k % 5 == 0, F.lit("Infobox Person")).when(k % 5 == 1, "infobox persons").otherwise(
        "infobox person"
    )
    born = F.struct(F.lit("Born").alias("name"), F.concat(F.lit("City "), k.cast("string")).alias("value"))
    work = F.struct(F.lit("occupation").alias("name"), F.lit("none").alias("value"))
    parts = F.when(k % 2 == 0, F.array(work, born)).otherwise(F.array(work))
    return docs.select(
        k,
        F.when(k % 11 != 0, F.concat(F.lit("Person "), k.cast("string"))).otherwise("").alias("name"),
        F.concat(F.lit("https://example.org/"), k.cast("string")).alias("url"),
        F.col("lang").alias("abstract"),
        F.when(k % 13 != 0, F.array(F.struct(box.alias("name"), parts.alias("has_parts")))).alias(
            "infoboxes"
        ),
        F.concat(F.lit("["), tree, F.lit("]")).alias("sections"),
    )


# Pool values per supplier row: kind -> rule.
_S = "cast(s_suppkey AS string)"
POOL_RULES = {
    "male": f"concat('Adam', {_S})",
    "female": f"concat(CASE WHEN s_suppkey % 5 = 0 THEN concat('O', {QUOTE}, 'Eva') ELSE 'Eva Li' END, {_S})",
    "last": f"concat(CASE WHEN s_suppkey % 3 = 0 THEN 'van Dal' ELSE 'Smith' END, {_S})",
    "company": f"concat(CASE s_suppkey % 4 WHEN 0 THEN 'Ace & Sons ' WHEN 1 THEN 'Dataworks, Ltd. ' "
    f"WHEN 2 THEN 'Group.One ' ELSE 'Müller-Berg ' END, {_S})",
    "company_suffix": "CASE WHEN s_suppkey % 2 = 0 THEN 'Group' ELSE 'LLC' END",
    "city": f"concat('Town ', {_S})",
    "address": f"concat({_S}, ' Main Road', {NL}, 'Town ', {_S})",
    "user": f"concat('user', {_S})",
    "tld": "CASE WHEN s_suppkey % 2 = 0 THEN 'com' ELSE 'org' END",
}
_LOCALE_NAMES = quoted(*[row[0] for row in LOCALES])


def locale_of(key: str) -> str:
    return case(f"{key} % 8", _LOCALE_NAMES[:-1], _LOCALE_NAMES[-1])


POOLS_SQL = " UNION ALL ".join(
    f"SELECT {locale_of('s_suppkey')} AS locale, '{kind}' AS kind, "
    f"cast(floor(s_suppkey / 8.0) AS bigint) AS ordinal, {rule} AS value FROM supplier"
    for kind, rule in POOL_RULES.items()
)


def pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    stack = ", ".join(f"'{kind}', {rule}" for kind, rule in POOL_RULES.items())
    return table(spark, sf_dir, "supplier").selectExpr(
        f"{locale_of('s_suppkey')} AS locale",
        "cast(floor(s_suppkey / 8.0) AS bigint) AS ordinal",
        f"stack({len(POOL_RULES)}, {stack}) AS (kind, value)",
    )


# Job titles: one per nation.
TITLE_RULES = {
    "ord": "cast(n_nationkey AS int)",
    "title": "CASE n_nationkey WHEN 3 THEN 'Doctor' WHEN 13 THEN 'Pilot' WHEN 5 THEN 'General Laborer' "
    "ELSE concat('Job ', n_name) END",
    "weight": "cast(1 + n_nationkey AS double)",
    "tier": case(
        "n_nationkey % 6",
        quoted(
            "Entry/Service", "Skilled Trades/Technical", "Professional/Analyst",
            "High Professional/Specialized", "Management/Executive",
        ),
        "NULL",
    ),
}
TITLES_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in TITLE_RULES.items()) + " FROM nation"


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr(*[f"{e} AS {n}" for n, e in TITLE_RULES.items()])


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job_catalogue(titles(spark, sf_dir))


KEYS_SQL = f"SELECT c_custkey AS profile_key, {locale_of('c_custkey')} AS locale FROM customer"


def profile_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS profile_key", f"{locale_of('c_custkey')} AS locale"
    )
