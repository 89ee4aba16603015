"""Check SQL of the registered queries, for DuckDB on the same tables.

The SQL states each result on its own terms and shares only input rules
(fixtures) and fixed values with the queries.
"""

from __future__ import annotations

from personaloom.functions.entities import PATTERNS, PERSON_PATTERN
from personaloom.functions.text import BLANK_CHARS
from personaloom.operators import blocks, catalogue as C, mentions as M
from personaloom.registry import fixtures as X
from personaloom.registry.profile_oracle import PROFILE_SQL

BLANK = BLANK_CHARS
NL = "chr(10)"
ORACLES: dict[str, str] = {}


def trim(x: str) -> str:
    return f"trim({x}, '{BLANK}')"


def cte(*parts: tuple[str, str], select: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({s})" for n, s in parts) + " " + select


# --- shared steps ------------------------------------------------------------------------------

_labels = ", ".join(
    f"('{spelling}', '{kind}', {i})"
    for i, (kind, names) in enumerate(blocks.LABELS.items(), 1)
    for spelling in names
)
_pattern = r"\[(?:" + "|".join(s for names in blocks.LABELS.values() for s in names) + r")\][^\[]*"
RECORDS = ("records", X.RECORDS_SQL)
LABELS = ("labels_", f"SELECT * FROM (VALUES {_labels}) t(label, kind, ord)")
RAW = (
    "raw_blocks",
    "SELECT conv_id, turn, unnest(bs) AS b, unnest(range(len(bs))) AS pos FROM "
    f"(SELECT conv_id, turn, regexp_extract_all(model_output, '{_pattern}') AS bs FROM records)",
)
BLOCKS = (
    "blocks",
    f"SELECT * FROM (SELECT conv_id, turn, pos, l.ord, l.kind AS content_type, "
    f"{trim('substr(b, strpos(b, chr(93)) + 1)')} AS txt FROM raw_blocks "
    "JOIN labels_ l ON l.label = substr(b, 2, strpos(b, chr(93)) - 2)) WHERE txt <> ''",
)
HANDLES = (
    "handles",
    "SELECT conv_id, turn, first_name, last_name, hj, flatten(list_transform(json_keys(hj), lambda k: "
    "CASE WHEN json_type(hj, '$.\"' || k || '\"') = 'ARRAY' "
    "THEN CAST(json_extract(hj, '$.\"' || k || '\"') AS VARCHAR[]) "
    "ELSE [json_extract_string(hj, '$.\"' || k || '\"')] END)) AS vals FROM (SELECT *, "
    "CASE WHEN social_media_handles IS NULL THEN '{}' WHEN json_valid(social_media_handles) "
    "THEN social_media_handles WHEN json_valid(replace(social_media_handles, chr(39), chr(34))) "
    "THEN replace(social_media_handles, chr(39), chr(34)) ELSE '{}' END AS hj FROM records)",
)
PLACED = (
    "placed",
    "SELECT b.*, h.first_name, h.last_name, h.hj, h.vals, row_number() OVER "
    "(PARTITION BY b.conv_id, b.turn ORDER BY b.ord, b.pos) - 1 AS place, "
    "list_filter(list_concat(h.vals, [h.first_name]), lambda h: h <> '' "
    "AND contains(lower(b.txt), lower(h)))[1] AS mention "
    "FROM blocks b JOIN handles h USING (conv_id, turn)",
)
PAIRS = (
    "pairs",
    "SELECT conv_id, turn, place, content_type, CASE WHEN content_type IN ('Social Media', 'Forum Post') "
    "AND mention IS NULL AND coalesce(vals[1], first_name) IS NOT NULL "
    "THEN coalesce(vals[1], first_name) || ' : ' || txt ELSE txt END AS text FROM placed",
)
STEPS = (RECORDS, LABELS, RAW, BLOCKS, HANDLES, PLACED, PAIRS)


def pairs_sql(select: str, *more: tuple[str, str]) -> str:
    return cte(*STEPS, *more, select=select)


def records_sql(select: str) -> str:
    return cte(RECORDS, select=select)


# --- sources and sinks -------------------------------------------------------------------------

ORACLES["s1_json_lines_good"] = "SELECT doc_id, lang, n_chars, text FROM documents WHERE doc_id % 10 <> 3"
ORACLES["s1_json_lines_bad"] = (
    "SELECT line_number, 'JSON Decode Error' AS error, substr('{\"doc_id\":' || doc_id || ',\"lang\"', 1, 12) "
    "AS original_line FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS line_number FROM documents) "
    "WHERE doc_id % 10 = 3"
)
ORACLES["s2_tsv_round_trip"] = "SELECT cast(doc_id AS VARCHAR) AS doc_id, source, text FROM documents"
ORACLES["s3_skip_filter_take"] = (
    "SELECT * FROM (SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id OFFSET 100) "
    "WHERE lang = 'en' ORDER BY doc_id LIMIT 150"
)
ORACLES["s4_pruned_columns"] = "SELECT doc_id, n_chars FROM documents"
ORACLES["s5_json_sink"] = "SELECT conv_id, turn, role, text FROM conversations"
ORACLES["s6_corpus_tsv"] = "SELECT cast(doc_id AS VARCHAR) AS id, lang AS content_type, text FROM documents"
ORACLES["s7_file_per_type"] = pairs_sql(
    "SELECT replace(replace(content_type, ' ', '_'), '/', '_') AS type_name, content_type, "
    "count(*) AS count FROM pairs GROUP BY 1, 2"
)
ORACLES["s8_typed_table"] = (
    "SELECT cast(doc_id AS VARCHAR) AS doc_id, lang, cast(n_chars AS INTEGER) AS n_chars, source, text FROM documents"
)
ORACLES["s9_stats_file"] = pairs_sql(
    "SELECT content_type, count(*) AS count, cast(sum(length(text)) AS BIGINT) AS total_length, "
    "round(avg(length(text)), 6) AS average_length, "
    "round(count(*) / (SELECT count(*) FROM records) * 100.0, 6) AS percentage_of_records FROM pairs GROUP BY 1"
)

# --- seed people: expected texts straight from the rules of the fixture ------------------------

_A, _B = f"substr(text, 1, {X._HALF})", f"substr(text, {X._HALF} + 1)"
WIKI = (
    "wiki",
    "SELECT *, doc_id % 5 <> 1 AND doc_id % 13 <> 0 AS person, doc_id % 11 <> 0 AS named, "
    f"CASE WHEN doc_id % 4 < 2 THEN {trim(_B)} ELSE '' END AS personal_life, "
    f"CASE doc_id % 4 WHEN 0 THEN {trim(f'{_A} || {NL} || {_B}')} WHEN 1 THEN {trim(_A)} ELSE '' END "
    "AS early_life, 'Person ' || doc_id AS name, 'https://example.org/' || doc_id AS url FROM documents",
)
def _paragraph(x: str) -> str:
    return f"'{{\"type\":\"paragraph\",\"value\":' || cast(to_json({x}) AS VARCHAR) || '}}'"


def _section(name: str, *parts: str) -> str:
    return f"'{{\"type\":\"section\",\"name\":\"{name}\",\"has_parts\":[' || " + " || ',' || ".join(parts) + " || ']}'"


_LIST = "'{\"type\":\"list\",\"value\":\"no paragraph\"}'"
_NESTED = _section(
    "Biography",
    _paragraph(_A),
    _section(
        " EARLY LIFE and education", _LIST, _paragraph(_A), _section("Later personal life", _paragraph(_B)), _paragraph(_B)
    ),
)
_FLAT = _section("Personal life", _paragraph(_B), _LIST) + " || ',' || " + _section("Early life", _paragraph(_A))
_CONTENT = f"'[' || CASE doc_id % 4 WHEN 0 THEN {_NESTED} WHEN 1 THEN {_FLAT} END || ']'"
_CHOSEN = "person AND named AND (personal_life <> '' OR early_life <> '')"
ORACLES["w1_person_infobox"] = cte(WIKI, select="SELECT doc_id FROM wiki WHERE person")
ORACLES["w2_named_records"] = cte(WIKI, select="SELECT doc_id, name FROM wiki WHERE named")
ORACLES["w3_deep_sections"] = f"SELECT doc_id, {trim('text')} AS personal_life FROM documents"
ORACLES["w3_section_text"] = cte(WIKI, select="SELECT doc_id, personal_life, early_life FROM wiki")
ORACLES["w4_seed_people"] = cte(
    WIKI,
    select=f"SELECT doc_id, name, url, lang AS abstract, {_CONTENT} AS wikipedia_content, personal_life, early_life "
    "FROM wiki WHERE " + _CHOSEN,
)
ORACLES["w5_cells"] = (
    "SELECT doc_id, cast(to_json(text) AS VARCHAR) AS cell, text AS decoded, "
    "CASE WHEN length(cast(to_json(text) AS VARCHAR)) <= 9 THEN text ELSE "
    "substr(cast(to_json(text) AS VARCHAR), 1, 9) END AS kept FROM documents"
)
ORACLES["w6_birth_origin"] = (
    "SELECT doc_id, CASE WHEN doc_id % 5 <> 1 AND doc_id % 13 <> 0 AND doc_id % 2 = 0 "
    "THEN 'City ' || doc_id ELSE '' END AS origin FROM documents"
)
ORACLES["w7_seed_cells"] = cte(
    WIKI,
    select="SELECT doc_id, "
    + ", ".join(
        f"cast(to_json({c}) AS VARCHAR) AS {n}"
        for n, c in [
            ("Name", "name"), ("URL", "url"), ("Abstract", "lang"), ("Personal_Life", "personal_life"),
            ("Early_Life", "early_life"),
        ]
    )
    + f", {_CONTENT} AS Wikipedia_Content FROM wiki WHERE " + _CHOSEN,
)

# --- blocks, attribution, corpus ---------------------------------------------------------------

_RAW_PASSAGE = (
    r"regexp_extract(passage_output, '(?s)\[Synthetic Article\](.*?)\[Real Person Text Usage Notes\]', 1)"
)
PASSAGES = ("passages", f"SELECT conv_id, turn, unique_id, passage_output, {trim(_RAW_PASSAGE)} AS passage FROM records")
ORACLES["p1_passages"] = cte(
    RECORDS, PASSAGES,
    select="SELECT conv_id, turn, passage AS generated_synthetic_passage FROM passages WHERE passage <> ''",
)
ORACLES["p2_nested_generation"] = cte(
    RECORDS, PASSAGES,
    select="SELECT conv_id, turn, cast(to_json({'system_prompt': 'Write.', 'user_prompt': 'u' || unique_id, "
    "'model_parameters': 'model-a', 'model_output': passage_output, 'generated_synthetic_passage': passage}) "
    "AS VARCHAR) AS generation FROM passages WHERE passage <> ''",
)
ORACLES["p3_content_blocks"] = pairs_sql("SELECT conv_id, turn, cast(pos AS INTEGER) AS pos, content_type, txt AS text FROM blocks")
ORACLES["p4_block_types"] = pairs_sql(
    "SELECT cast(ord AS INTEGER) AS ord, content_type, count(*) AS count FROM blocks GROUP BY 1, 2"
)
ORACLES["p5_handles"] = pairs_sql(
    "SELECT conv_id, turn, platform, cast(unnest(range(len(vs))) AS INTEGER) AS place, unnest(vs) AS handle FROM "
    "(SELECT conv_id, turn, platform, CASE WHEN json_type(hj, '$.\"' || platform || '\"') = 'ARRAY' "
    "THEN CAST(json_extract(hj, '$.\"' || platform || '\"') AS VARCHAR[]) "
    "ELSE [json_extract_string(hj, '$.\"' || platform || '\"')] END AS vs FROM "
    "(SELECT conv_id, turn, hj, unnest(json_keys(hj)) AS platform FROM handles))"
)
_PLACE = "cast(place AS INTEGER) AS place"
ORACLES["p6_first_mention"] = pairs_sql(f"SELECT conv_id, turn, {_PLACE}, mention FROM placed")
ORACLES["p7_attribution_extraction"] = pairs_sql(f"SELECT conv_id, turn, {_PLACE}, content_type, text FROM pairs")
_REPAIRED = "CASE WHEN mention IS NULL AND vals[1] IS NOT NULL THEN vals[1] || ' ' || txt ELSE txt END"
ORACLES["p8_attribution_repair"] = pairs_sql(
    f"SELECT conv_id, turn, {_PLACE}, content_type, {_REPAIRED} AS text FROM placed"
)
_COHORT = (
    "CASE WHEN hj = '{}' THEN first_name || ' ' || last_name || ' ' || txt "
    "WHEN content_type = 'Social Media' AND mention IS NULL THEN vals[1] || ' ' || txt ELSE txt END"
)
ORACLES["p9_attribution_cohort"] = pairs_sql(
    f"SELECT conv_id, turn, {_PLACE}, content_type, {_COHORT} AS text FROM placed"
)
ORACLES["p10_corpus_rows"] = pairs_sql(
    "SELECT r.unique_id AS id, i.conv_id, i.turn, cast(row_number() OVER (PARTITION BY i.conv_id, i.turn "
    "ORDER BY i.k) - 1 AS INTEGER) AS item, content_type, "
    f"{trim('i.text')} AS text FROM (SELECT conv_id, turn, -1 AS k, 'Article' AS content_type, passage AS text "
    "FROM passages WHERE passage <> '' UNION ALL SELECT conv_id, turn, place, content_type, text FROM pairs) i "
    "JOIN records r USING (conv_id, turn)",
    PASSAGES,
)
ORACLES["p11_safe_pass"] = records_sql(
    "SELECT conv_id, turn, model_output IS NULL OR spouse_name IS NULL AS unchanged FROM records"
)
_AGE = "coalesce(try_cast(age_text AS INTEGER), 0)"
_IN_COHORT = f"locale = 'en_US' AND {_AGE} BETWEEN 20 AND 35"
ORACLES["p12_cohort"] = records_sql(f"SELECT conv_id, turn FROM records WHERE {_IN_COHORT}")
ORACLES["p13_cohort_texts"] = pairs_sql(
    "SELECT conv_id, turn, r.unique_id, t AS concat_content_pairs FROM (SELECT conv_id, turn, "
    f"string_agg({_COHORT}, {NL} ORDER BY place) AS t FROM placed GROUP BY 1, 2) "
    f"JOIN records r USING (conv_id, turn) WHERE {_IN_COHORT} AND t <> '' ORDER BY 1, 2 LIMIT 100"
)
ORACLES["p14_repaired_contents"] = pairs_sql(f"SELECT conv_id, turn, {_PLACE}, {_REPAIRED} AS text FROM placed")
ORACLES["p15_age_numbers"] = records_sql(f"SELECT conv_id, turn, {_AGE} AS age FROM records")
ORACLES["p16_decoded_corpus"] = (
    "SELECT CASE WHEN doc_id % 6 = 1 AND length(cast(to_json(text) AS VARCHAR)) > 20 THEN '' ELSE text END "
    "AS text FROM documents"
)
ORACLES["p17_decoded_cells"] = "SELECT cast(doc_id AS VARCHAR) AS doc_id, lang, text FROM documents"
def _json_of(columns: list[str], table: str = "") -> str:
    """The named columns as one JSON text, nulls included."""
    return "cast(to_json({" + ", ".join(f"'{c}': {table}{c}" for c in columns) + "}) AS VARCHAR)"


ORACLES["p18_string_records"] = records_sql(
    "SELECT " + ", ".join(f"coalesce(cast({c} AS VARCHAR), '') AS {c}" for c in X.RECORD_RULES)
    + f", {_json_of(list(X.RECORD_RULES))} AS complete_info FROM records"
)
ORACLES["p19_end_marker"] = "SELECT doc_id, text || '<end>' AS text FROM documents"

# --- prompts and requests ----------------------------------------------------------------------

_INSPIRATION = trim(
    f"CASE WHEN turn % 2 = 0 THEN real_person_text_input ELSE '' END || {NL} || "
    f"CASE WHEN turn % 3 = 0 THEN coalesce(passage_output, '') ELSE '' END || {NL} || coalesce(spouse_name, '')"
)
_FALLBACK = "md5('request|' || conv_id || '|' || turn)"
_UUID = " || '-' || ".join(f"substr({_FALLBACK}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
PROMPTS = (
    "prompts",
    f"SELECT *, '**Inputs**:' || {NL} || 'real_wiki_inspiration_text:' || {NL} || real_text || ' ' || {NL} || "
    f"' synthetic_profile_json: ' || {NL} || ' ' || profile_json AS user_prompt FROM (SELECT conv_id, turn, "
    f"CASE WHEN turn % 5 <> 4 THEN unique_id || '-' || turn ELSE {_UUID} END AS custom_id, "
    f"{_INSPIRATION} AS real_text, {_json_of(X.PROFILE_FIELDS)} AS profile_json FROM records)",
)
ORACLES["b1_inspiration"] = cte(
    RECORDS, PROMPTS, select="SELECT conv_id, turn, real_text AS real_person_text_input FROM prompts"
)
ORACLES["b2_article_prompts"] = cte(RECORDS, PROMPTS, select="SELECT conv_id, turn, user_prompt FROM prompts")
ORACLES["b3_online_text_prompts"] = cte(
    RECORDS, PASSAGES,
    select=f"SELECT conv_id, turn, '**Synthetic Profile Json**:' || {NL} || CASE WHEN turn % 4 <> 1 THEN "
    f"{_json_of(X.PROFILE_FIELDS, 'r.')} "
    f"ELSE '{{}}' END || {NL} || {NL} || '**Synthetic Persona Article**:' || {NL} || passage AS user_prompt "
    "FROM passages JOIN records r USING (conv_id, turn)",
)
ORACLES["b4_batch_requests"] = cte(
    RECORDS, PROMPTS,
    select="SELECT conv_id, turn, cast(to_json({'custom_id': custom_id, 'method': 'POST', 'url': '/chat/completions', "
    "'body': {'model': 'model-a', 'messages': [{'role': 'system', 'content': 'Write.'}, {'role': 'user', "
    "'content': user_prompt}]}}) AS VARCHAR) AS line FROM prompts",
)
_LINE_UUID = _UUID.replace(_FALLBACK, "md5('request|' || line_number)")
BATCH = (
    "batch",
    f"""SELECT line_number, n % 9 IN (4, 7) OR doc_id % 10 = 3 AS bad, CASE WHEN conv_id % 4 <> 1 THEN unique_id ELSE {_LINE_UUID} END AS custom_id,
       {trim(f"lang || {NL} || CASE WHEN doc_id % 3 <> 0 THEN coalesce(text, '') ELSE '' END || {NL}")} AS real_text,
       '{{"Unique ID":"' || CASE WHEN conv_id % 4 <> 1 THEN unique_id ELSE '' END || '","profile":' || {_json_of(X.PROFILE_FIELDS)} || '}}' AS profile_line
FROM (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS n FROM records)
JOIN (SELECT doc_id, text, lang, row_number() OVER (ORDER BY doc_id) AS line_number FROM documents) ON n + 1 = line_number""",
)
_BATCH_PROMPT = (
    f"md5('**Inputs**:' || {NL} || 'real_wiki_inspiration_text:' || {NL} || real_text || ' ' || {NL} || "
    f"' synthetic_profile_json: ' || {NL} || ' ' || profile_line)"
)
ORACLES["b4_batch_job"] = cte(
    RECORDS, BATCH,
    select="SELECT line_number, custom_id, real_text AS real_person_text_input, prompt_md5, count(*) OVER (PARTITION BY custom_id, prompt_md5) "
    f"AS requests FROM (SELECT *, {_BATCH_PROMPT} AS prompt_md5 FROM batch WHERE NOT bad)",
)
ORACLES["b7_batch_job_counts"] = cte(
    RECORDS, BATCH,
    select="SELECT count(*) FILTER (NOT bad) AS prepared, count(*) FILTER (bad) AS json_errors, count(*) FILTER (bad) AS error_rows, "
    "(sum(line_number) FILTER (bad))::BIGINT AS error_lines FROM batch",
)
ORACLES["b5_request_metadata"] = cte(
    RECORDS, PROMPTS,
    select="SELECT conv_id, turn, custom_id, real_text AS real_person_text_input, 'Write.' AS system_prompt, "
    "'{\"model\":\"model-a\",\"max_tokens\":4000}' AS model_parameters FROM prompts",
)
COMPLETIONS = (
    "completions",
    "SELECT p.custom_id, p.conv_id, p.turn, out AS model_output, CASE WHEN out IS NULL THEN coalesce("
    "CASE WHEN p.turn % 3 <> 0 AND p.turn % 5 <> 4 THEN r.error END, "
    "'API call failed or returned empty response. See logs.') END AS error FROM (SELECT *, CASE WHEN turn % 3 = 1 "
    "AND turn % 5 <> 4 THEN (SELECT passage_output FROM records q WHERE q.conv_id = prompts.conv_id "
    "AND q.turn = prompts.turn) END AS out FROM prompts) p JOIN records r USING (conv_id, turn)",
)
ORACLES["b6_completions"] = cte(RECORDS, PROMPTS, COMPLETIONS, select="SELECT * FROM completions")
ORACLES["b7_outcomes"] = cte(
    RECORDS, PROMPTS, COMPLETIONS,
    select="SELECT count(*) FILTER (model_output IS NOT NULL) AS processed, "
    "count(*) FILTER (model_output IS NULL) AS errors, cast(0 AS BIGINT) AS json_errors FROM completions",
)

# --- entities and contamination ----------------------------------------------------------------

# RE2 word borders know ASCII letters only: letters beyond are masked by '_' for name search.
_MASKED = r"regexp_replace({}, '[\x{{00AA}}-\x{{024F}}]', '_', 'g')"


def entity_sql(kind: str, text: str, source: str, key: str = "doc_id") -> str:
    if kind == "PERSON":
        found = f"regexp_extract_all({_MASKED.format(text)}, '{PERSON_PATTERN}')"
    elif kind == "PHONE":
        found = (
            f"list_transform(regexp_extract_all({text}, '(?i){PATTERNS[kind]}'), "
            "lambda m: right(regexp_replace(m, '[^0-9]', '', 'g'), 10))"
        )
    else:
        found = f"regexp_extract_all({text}, '(?i){PATTERNS[kind]}')"
    return f"SELECT DISTINCT {key}, '{kind}' AS type, unnest({found}) AS value FROM {source}"


def all_entities(text: str, source: str) -> str:
    return " UNION ALL ".join(entity_sql(k, text, source) for k in [*PATTERNS, "PERSON"])


_REAL, _SYN = "real_person_text_input", "generated_synthetic_passage"
HALVES = ("halves", X.HALVES_SQL)
USABLE = ("usable", f"SELECT * FROM halves WHERE {trim(_REAL)} <> '' AND {trim(_SYN)} <> ''")
REAL, SYN = ("real_", all_entities(_REAL, "usable")), ("syn_", all_entities(_SYN, "usable"))
HITS = (
    "hits",
    "SELECT * FROM real_ r WHERE EXISTS (SELECT 1 FROM syn_ s WHERE s.doc_id = r.doc_id AND s.type = r.type "
    "AND (contains(lower(r.value), lower(s.value)) OR contains(lower(s.value), lower(r.value))))",
)


def entities_json_sql(source: str) -> str:
    return (
        f"SELECT doc_id, '{{' || string_agg(cast(to_json(type) AS VARCHAR) || ':' || vs, ',' ORDER BY type) || '}}' AS j "
        f"FROM (SELECT doc_id, type, cast(to_json(list_sort(list(value))) AS VARCHAR) AS vs FROM {source} GROUP BY 1, 2) "
        "GROUP BY 1"
    )


ORACLES["c1_pattern_entities"] = all_entities("text", "documents")
ORACLES["c2_person_names"] = f"SELECT doc_id, value FROM ({entity_sql('PERSON', 'text', 'documents')})"
ORACLES["c3_model_entities"] = (
    all_entities("text", "documents")
    + " UNION ALL SELECT DISTINCT doc_id, 'ORG', source FROM documents"
)
ORACLES["c4_overlaps"] = cte(HALVES, USABLE, REAL, SYN, HITS, select="SELECT doc_id, type, value FROM hits")
ORACLES["c5_contamination_report"] = cte(
    HALVES, USABLE, REAL, SYN, HITS, ("rj", entities_json_sql("real_")), ("sj", entities_json_sql("syn_")),
    select="SELECT h.doc_id AS unique_id, h.type AS entity_type, h.value AS entity_value, "
    f"cast(to_json({{'doc_id': u.doc_id, '{_REAL}': u.{_REAL}, '{_SYN}': u.{_SYN}}}) AS VARCHAR) AS complete_record, "
    "rj.j AS real_entities, sj.j AS synthetic_entities FROM hits h JOIN usable u USING (doc_id) "
    "JOIN rj USING (doc_id) JOIN sj USING (doc_id)",
)
ORACLES["c6_contamination_summary"] = cte(
    HALVES, USABLE, REAL, SYN, HITS,
    select="SELECT (SELECT count(*) FROM halves) AS records, count(DISTINCT doc_id) AS contaminated_records, "
    "count(*) AS contaminations FROM hits",
)
ORACLES["c7_clean_records"] = cte(
    HALVES, USABLE, REAL, SYN, HITS,
    select="SELECT doc_id FROM halves WHERE doc_id NOT IN (SELECT doc_id FROM hits)",
)

# --- mentions ----------------------------------------------------------------------------------

# Capital stand-ins keep accented letters of a lower-case address inside words for RE2.
_ACCENTS, _CAPITALS = "äöüßéèêçñíóúáàâîôûëï", "ABCDEFGHIJKLMNOPQRST"
_STREET = r"\b(?:" + "|".join(M.STREET_WORDS) + r")\b"
_CLEAN = (
    f"translate(regexp_replace(translate(lower(address), '{_ACCENTS}', '{_CAPITALS}'), '{_STREET}', '', 'g'), "
    f"'{_CAPITALS}', '{_ACCENTS}')"
)


def _field_row(field: str, column: str, value: str, found: str) -> str:
    long = f"(regexp_full_match({value}, '[0-9]+') OR length({value}) >= 3)"
    name = field.replace("'", "''")
    return (
        f"{{'field': '{name}', 'original': cast({column} AS VARCHAR), 'matched': {value}, "
        f"'ok': coalesce({long} AND {found}, false)}}"
    )


def _field_rows() -> str:
    rows = []
    for f in M.GENERAL_FIELDS + M.HEALTH_FIELDS:
        c = M.column_name(f)
        v = f"lower(cast({c} AS VARCHAR))"
        none = f" AND {v} <> 'none'" if f in M.HEALTH_FIELDS else ""
        rows.append(_field_row(f, c, v, f"contains(lower(text), {v}){none}"))
    for f in M.ID_FIELDS:
        c = M.column_name(f)
        v = f"regexp_replace(lower({c}), '[^a-z0-9]', '', 'g')"
        rows.append(_field_row(f, c, v, f"contains(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), {v})"))
    for f in M.PHONE_FIELDS:
        c = M.column_name(f)
        v = f"regexp_replace({c}, '[^0-9]', '', 'g')"
        rows.append(_field_row(f, c, v, f"contains(regexp_replace(text, '[^0-9]', '', 'g'), {v})"))
    return "[" + ", ".join(rows) + "]"


TEXTS = (
    "texts",
    "SELECT p.place, p.content_type, p.text, r.*, h.hj FROM pairs p JOIN records r USING (conv_id, turn) "
    "JOIN handles h USING (conv_id, turn)",
)
FIELD_HITS = (
    "field_hits",
    "SELECT conv_id, turn, place, content_type, text, m.field AS field, m.original AS original, m.matched AS matched "
    f"FROM (SELECT *, unnest({_field_rows()}) AS m FROM texts) WHERE m.ok",
)
ADDRESS_HITS = (
    "address_hits",
    "SELECT conv_id, turn, place, content_type, text, 'Address' AS field, address AS original, part AS matched FROM ("
    "SELECT *, row_number() OVER (PARTITION BY conv_id, turn, place ORDER BY length(part) DESC, part) AS rn FROM ("
    f"SELECT *, unnest(list_concat(list_transform(string_split({_CLEAN}, ','), lambda p: {trim('p')}), "
    rf"string_split_regex({_CLEAN}, '\s+'))) AS part FROM texts) "
    "WHERE length(part) >= 3 AND contains(lower(text), part)) WHERE rn = 1",
)
HANDLE_HITS = (
    "handle_hits",
    "SELECT conv_id, turn, place, content_type, text, 'Social Media Handle' AS field, platform || ': ' || handle "
    "AS original, lower(handle) AS matched FROM (SELECT *, unnest(CASE WHEN json_type(hj, '$.\"' || platform || '\"') "
    "= 'ARRAY' THEN CAST(json_extract(hj, '$.\"' || platform || '\"') AS VARCHAR[]) ELSE "
    "[json_extract_string(hj, '$.\"' || platform || '\"')] END) AS handle FROM (SELECT *, unnest(json_keys(hj)) "
    "AS platform FROM texts)) WHERE handle <> '' AND contains(lower(text), lower(handle))",
)
ALL_HITS = (
    "all_hits",
    "SELECT * FROM field_hits UNION ALL SELECT * FROM address_hits UNION ALL SELECT * FROM handle_hits",
)
COUNTS = (
    "features",
    "SELECT t.*, coalesce(c.n, 0) AS n, coalesce(c.n, 0) > 0 AS any_hit FROM texts t LEFT JOIN (SELECT conv_id, turn, "
    "place, count(DISTINCT field) AS n FROM all_hits GROUP BY 1, 2, 3) c USING (conv_id, turn, place)",
)


def mentions_sql(select: str) -> str:
    return pairs_sql(select, TEXTS, FIELD_HITS, ADDRESS_HITS, HANDLE_HITS, ALL_HITS, COUNTS)


_INDEX = "cast(place AS INTEGER) AS content_pair_index"
ORACLES["m1_feature_rows"] = pairs_sql(
    f"SELECT conv_id, turn, {_INDEX}, content_type, cast(length(text) AS INTEGER) AS synthetic_text_length, "
    f"cast(len(regexp_extract_all(text, '[^{BLANK}]+')) AS INTEGER) AS synthetic_word_count, "
    "cast(length(real_person_text_input) AS INTEGER) AS real_person_text_length, error IS NOT NULL AS generation_error, "
    "lower(allergies) <> 'none' AS has_allergies, lower(disability) <> 'none' AS has_disability FROM texts",
    TEXTS,
)


def _detail_sql(fields: list[str] | None, source: str = "all_hits", text: str = "") -> str:
    names = ", ".join("'" + f.replace("'", "''") + "'" for f in fields or [])
    where = f" WHERE field IN ({names})" if fields else ""
    return mentions_sql(
        f"SELECT conv_id, turn, {_INDEX}, {text}field AS pii_field_name, original AS original_pii_value_from_input, "
        f"matched AS pii_value_checked FROM {source}{where}"
    )


def _value_rows() -> str:
    rows = []
    for mode, fields in (("lower", M.GENERAL_FIELDS), ("alnum", M.ID_FIELDS), ("digits", M.PHONE_FIELDS), ("lower", M.HEALTH_FIELDS)):
        for f in fields:
            c = M.column_name(f)
            v = f"lower(cast({c} AS VARCHAR))"
            if mode == "alnum":
                v = f"regexp_replace(lower({c}), '[^a-z0-9]', '', 'g')"
            elif mode == "digits":
                v = f"regexp_replace({c}, '[^0-9]', '', 'g')"
            elif f in M.HEALTH_FIELDS:
                v = f"nullif({v}, 'none')"
            name = f.replace("'", "''")
            rows.append(f"{{'field': '{name}', 'mode': '{mode}', 'original': cast({c} AS VARCHAR), 'value': {v}}}")
    return "[" + ", ".join(rows) + "]"


VALUE_ROWS = f"(SELECT conv_id, turn, m.field, m.mode, m.original, m.value FROM (SELECT *, unnest({_value_rows()}) AS m FROM records) WHERE m.value IS NOT NULL)"
ORACLES["m2_search_values"] = records_sql(f"SELECT * FROM {VALUE_ROWS}")
ORACLES["m3_length_gate"] = records_sql(
    "SELECT conv_id, turn, field, cast(length(value) AS INTEGER) AS n, "
    f"regexp_full_match(value, '[0-9]+') OR length(value) >= 3 AS long_enough FROM {VALUE_ROWS}"
)
ORACLES["m4_phone_mentions"] = _detail_sql(M.PHONE_FIELDS)
ORACLES["m5_id_mentions"] = _detail_sql(M.ID_FIELDS)
ORACLES["m6_address_mentions"] = _detail_sql([M.ADDRESS_FIELD])
ORACLES["m7_general_mentions"] = _detail_sql(M.GENERAL_FIELDS + M.HEALTH_FIELDS)
ORACLES["m8_handle_mentions"] = _detail_sql([M.HANDLE_FIELD])
ORACLES["m9_mention_counts"] = mentions_sql(
    f"SELECT conv_id, turn, {_INDEX}, cast(n AS INTEGER) AS num_mentioned_pii_fields, any_hit AS any_pii_mentioned FROM features"
)
ORACLES["m10_mention_details"] = _detail_sql(None, text="content_type, text AS synthetic_text, ")


def _money(c: str) -> str:
    return f"coalesce(try_cast(regexp_replace({c}, '[^0-9.]', '', 'g') AS DOUBLE), 0.0)"


ORACLES["m11_money_values"] = records_sql(
    f"SELECT conv_id, turn, {_money('net_worth')} AS net_worth, {_money('annual_salary')} AS annual_salary FROM records"
)

# --- joins -------------------------------------------------------------------------------------

ORACLES["j1_positional_pairs"] = (
    "SELECT line_number, item_id, doc_id, lang FROM (SELECT item_id, row_number() OVER (ORDER BY item_id) AS line_number "
    "FROM benchmark) JOIN (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) AS line_number FROM documents) "
    "USING (line_number)"
)
_LINES = (
    "FROM (SELECT item_id, text AS item_text, row_number() OVER (ORDER BY item_id) AS line_number FROM benchmark) "
    "JOIN (SELECT doc_id, lang, n_chars, text, row_number() OVER (ORDER BY doc_id) AS line_number FROM documents) "
    "USING (line_number)"
)
ORACLES["j1_file_pairs"] = (
    f"SELECT line_number, item_id AS item_item_id, item_text, doc_id, lang, n_chars, text {_LINES} "
    "WHERE item_id % 4 <> 1 AND doc_id % 10 <> 3"
)
ORACLES["j1_file_errors"] = (
    "SELECT line_number, 'JSON Decode Error' AS error, md5(CASE WHEN item_id % 4 = 1 THEN substr(line, 1, 12) ELSE line END) AS left_md5, "
    "md5(CASE WHEN doc_id % 10 = 3 THEN substr(right_line, 1, 12) ELSE right_line END) AS right_md5 FROM (SELECT *, "
    "CAST(to_json({'item_id': item_id, 'text': item_text}) AS VARCHAR) AS line, "
    "CAST(to_json({'doc_id': doc_id, 'lang': lang, 'n_chars': n_chars, 'text': text}) AS VARCHAR) AS right_line "
    f"{_LINES}) WHERE item_id % 4 = 1 OR doc_id % 10 = 3"
)
ORACLES["j1_pairs_by_text"] = (
    "SELECT line_number, source, text_md5, id, turn_key FROM (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST, "
    "text_md5 NULLS FIRST, id) AS line_number FROM (SELECT source, md5(text) AS text_md5, cast(doc_id AS VARCHAR) AS id FROM documents)) "
    "JOIN (SELECT *, row_number() OVER (ORDER BY turn_key) AS line_number FROM (SELECT concat_ws('-', role, conv_id, turn) "
    "AS turn_key FROM conversations)) USING (line_number)"
)
ORACLES["o6_skip_take_by_text"] = (
    "SELECT event_type, md5(cast(event_id AS VARCHAR)) AS digest, event_id FROM events "
    "ORDER BY event_type NULLS FIRST, digest LIMIT 1500 OFFSET 777"
)
SUBSET = ("subset", "SELECT DISTINCT text FROM documents UNION ALL SELECT text FROM benchmark")
ORACLES["j2_exact_link"] = cte(
    SUBSET, select="SELECT md5(s.text) AS text_md5, d.doc_id AS id FROM subset s LEFT JOIN documents d USING (text)"
)


def recovered_sql(texts: str) -> str:
    return (
        f"SELECT text, min(doc_id) AS id FROM (SELECT DISTINCT text, lower(text) AS low FROM ({texts}) WHERE text IS NOT NULL) n "
        "JOIN (SELECT doc_id, lower(text) AS host FROM documents) d ON contains(host, low) OR (host <> '' AND "
        "starts_with(low, host)) GROUP BY 1"
    )


_PARTS = (
    "SELECT text FROM benchmark UNION ALL SELECT translate(substr(text, cast(doc_id % 50 + 5 AS INTEGER), "
    "cast(doc_id % 90 AS INTEGER)), 'aeiouznt', 'AEIOUZNT') FROM documents UNION ALL SELECT text || ' and more' FROM documents"
)
ORACLES["j3_recovered_ids"] = f"SELECT md5(text) AS text_md5, id FROM ({recovered_sql(_PARTS)})"
ORACLES["j3_benchmark_in_documents"] = (
    f"SELECT md5(text) AS text_md5, id FROM ({recovered_sql('SELECT text FROM benchmark')})"
)
_PIECES = (
    "SELECT CASE WHEN n = 1 THEN substr(piece, 1, 40) ELSE piece END AS text FROM (SELECT n, array_to_string("
    "list_slice(w, least(2, len(w)), least(2, len(w)) + n - 1), ' ') AS piece FROM (SELECT "
    "string_split_regex(text, '\\s+') AS w, 1 + doc_id % 5 AS n FROM documents WHERE text IS NOT NULL)) WHERE piece <> ''"
)
ORACLES["j3_short_texts"] = f"SELECT md5(text) AS text_md5, id FROM ({recovered_sql(_PIECES)})"
LINKED = ("linked", "SELECT s.text, d.doc_id AS id FROM subset s LEFT JOIN documents d USING (text)")
BACK = ("back", recovered_sql("SELECT text FROM linked WHERE id IS NULL"))
ORACLES["j4_relinked"] = cte(
    SUBSET, LINKED, BACK,
    select="SELECT DISTINCT md5(f.text) AS text_md5, f.id, cast(to_json({'doc_id': d.doc_id, 'lang': lang, 'source': source}) "
    "AS VARCHAR) AS complete_info FROM (SELECT * FROM linked WHERE id IS NOT NULL UNION ALL SELECT * FROM back) f "
    "JOIN documents d ON d.doc_id = f.id WHERE d.doc_id % 4 <> 3",
)
ORACLES["j5_text_lookup"] = (
    "SELECT item_id, id FROM benchmark LEFT JOIN (SELECT text, min(doc_id) AS id FROM documents GROUP BY 1) USING (text)"
)
TITLES = ("titles", X.TITLES_SQL)
TIERS = (
    "tiers",
    "SELECT * FROM (VALUES "
    + ", ".join(f"('{t}', {lo}, {hi}, {level}, {age})" for t, lo, hi, level, age in C.TIERS)
    + ") t(tier, min_salary, max_salary, required_level, min_age)",
)
PEOPLE = ("people", "SELECT c_custkey, 'Job NATION_' || c_nationkey AS job_title FROM customer")
ORACLES["j6_tier_lookup"] = cte(
    TITLES, TIERS, PEOPLE,
    select="SELECT p.job_title, p.c_custkey, l.tier, l.min_salary, l.max_salary FROM people p LEFT JOIN "
    "(SELECT title, tier, min_salary, max_salary FROM titles JOIN tiers USING (tier)) l ON l.title = p.job_title",
)
JOBS = (
    "jobs",
    "SELECT ord, title, weight, t.tier, CASE WHEN t.tier IS NULL THEN 0 WHEN title = 'Doctor' THEN 8 ELSE "
    "required_level END AS required_level, CASE WHEN t.tier IS NULL THEN 18 WHEN title = 'Doctor' THEN 25 WHEN "
    "title = 'Pilot' THEN 21 ELSE min_age END AS min_age FROM titles t LEFT JOIN tiers USING (tier)",
)
OPEN = (
    "open_jobs",
    "SELECT level, band, ord, title, tier, sum(greatest(0.1::DOUBLE, weight * CASE WHEN level - required_level >= 5 THEN "
    "0.01::DOUBLE WHEN level - required_level >= 3 THEN 0.2::DOUBLE ELSE 1.0::DOUBLE END)) OVER (PARTITION BY level, band "
    "ORDER BY ord) AS upto FROM jobs, range(10) l(level), (VALUES (18), (21), (25)) b(band) "
    "WHERE level >= required_level AND band >= min_age",
)
ORACLES["j7_open_jobs"] = cte(
    TITLES, TIERS, JOBS, OPEN,
    select="SELECT c_custkey, title, round(upto, 6) AS upto FROM customer JOIN open_jobs ON level = c_custkey % 10 AND "
    "band = CASE WHEN c_custkey % 73 >= 7 THEN 25 WHEN c_custkey % 73 >= 3 THEN 21 ELSE 18 END",
)
ORACLES["j8_rows_of_top_jobs"] = records_sql(
    "SELECT job_title, conv_id, turn FROM records WHERE job_title IN (SELECT job_title FROM records GROUP BY 1 "
    "ORDER BY count(*) DESC, 1 LIMIT 15)"
)
ORACLES["j9_untiered_titles"] = cte(TITLES, select="SELECT title FROM titles WHERE tier IS NULL")

# --- statistics --------------------------------------------------------------------------------

ORACLES["a1_content_type_stats"] = pairs_sql(
    "SELECT content_type, count(*) AS count, cast(sum(length(text)) AS BIGINT) AS total_length, "
    "round(sum(length(text))::DOUBLE / count(*), 6) AS average_length, "
    "round(count(*)::DOUBLE / (SELECT count(*) FROM records) * 100, 6) AS percentage_of_records FROM pairs GROUP BY 1"
)
_FIRSTS = (
    "(SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY conv_id, turn, place) AS rn FROM texts)"
)
_PROFILE_COLUMNS = [
    "gender", "nationality", "job_title", "education_info", "locale", "marital_status", "finance_status",
]
ORACLES["a2_profile_values"] = pairs_sql(
    "SELECT field, value, count(*) AS count FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS field, {c} AS value FROM {_FIRSTS} WHERE rn = 1" for c in _PROFILE_COLUMNS
    ) + ") GROUP BY 1, 2",
    TEXTS,
)
_WIDTHS = {
    "age": ("age", 5), "net_worth_value": (_money("net_worth"), 10),
    "annual_salary_value": (_money("annual_salary"), 10000), "synthetic_text_length": ("length(text)", 50),
    "synthetic_word_count": (f"len(regexp_extract_all(text, '[^{BLANK}]+'))", 10), "num_mentioned_pii_fields": ("n", 1),
}
ORACLES["a3_histograms"] = mentions_sql(
    " UNION ALL ".join(
        f"SELECT '{c}' AS field, floor({e} / {w}.0::DOUBLE) * {w}.0::DOUBLE AS bin_start, count(*) AS count FROM features GROUP BY 2"
        for c, (e, w) in _WIDTHS.items()
    )
)
ORACLES["a4_content_types"] = pairs_sql("SELECT content_type, count(*) AS count FROM pairs GROUP BY 1")
ORACLES["a5_totals"] = pairs_sql(
    "SELECT count(*) AS texts, count(DISTINCT unique_id) AS profiles, count(error) AS error_texts, "
    "round(count(*)::DOUBLE / count(DISTINCT unique_id), 6) AS texts_per_profile FROM texts",
    TEXTS,
)
_RATE = "round(avg(any_hit::INT) * 100, 6) AS percentage"
ORACLES["a6_any_mention"] = mentions_sql(
    f"SELECT cast(sum(any_hit::INT) AS BIGINT) AS texts_with_pii, {_RATE} FROM features"
)
_DISTINCT_HITS = "(SELECT DISTINCT conv_id, turn, place, content_type, field FROM all_hits)"
ORACLES["a7_field_counts"] = mentions_sql(
    f"SELECT field, count(*) AS count FROM {_DISTINCT_HITS} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15"
)
ORACLES["a8_field_by_type"] = mentions_sql(
    "SELECT field, " + ", ".join(
        f"count(*) FILTER (content_type = '{t}') AS \"{t}\"" for t in blocks.CONTENT_TYPES
    ) + f" FROM {_DISTINCT_HITS} GROUP BY 1"
)
ORACLES["a9_mention_rate"] = mentions_sql(f"SELECT content_type, {_RATE} FROM features GROUP BY 1")
ORACLES["a10_mentions_by_age"] = mentions_sql(
    "SELECT CASE WHEN age < 18 THEN '0-18' WHEN age < 30 OR top < 44 THEN '19-30' WHEN age < 45 OR top < 59 THEN '31-45' "
    "WHEN age < 60 OR top < 74 THEN '46-60' WHEN age < 75 OR top < 75 THEN '61-75' ELSE '75+' END AS age_group, "
    "round(sum(n)::DOUBLE / count(*), 6) AS avg_num_mentioned FROM features, (SELECT max(age) AS top FROM features) GROUP BY 1"
)
ORACLES["a11_share_by_mention"] = mentions_sql(
    "SELECT content_type, any_hit AS any_pii_mentioned, round(c * 100.0::DOUBLE / sum(c) OVER (PARTITION BY any_hit), 6) "
    "AS percentage FROM (SELECT any_hit, content_type, count(*) AS c FROM features GROUP BY 1, 2) QUALIFY content_type IN "
    "(SELECT content_type FROM features GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3)"
)
ORACLES["a12_top_job_rates"] = mentions_sql(
    f"SELECT job_title, {_RATE} FROM features GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 15"
)
ORACLES["a13_share_by_job"] = pairs_sql(
    "SELECT job_title, " + ", ".join(
        f"round(count(*) FILTER (content_type = '{t}') * 100.0::DOUBLE / count(*), 6) AS \"{t}\"" for t in blocks.CONTENT_TYPES
    ) + " FROM texts GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 8",
    TEXTS,
)
ORACLES["a14_error_jobs"] = pairs_sql(
    "SELECT job_title, count(*) AS count FROM (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY conv_id, turn, "
    "place) AS rn FROM texts WHERE error IS NOT NULL) WHERE rn = 1 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15",
    TEXTS,
)
ORACLES["a16_relink_counts"] = cte(
    SUBSET, LINKED, BACK,
    select="SELECT count(*) AS rows, count(*) FILTER (l.id IS NULL) AS missing, count(*) FILTER (l.id IS NULL AND "
    "b.id IS NOT NULL) AS recovered, count(*) FILTER (l.id IS NULL AND b.id IS NULL) AS still_missing FROM linked l "
    "LEFT JOIN back b USING (text)",
)

# --- order, samples, repeats -------------------------------------------------------------------

for _name, _n in (("o1_shuffle_take", 500), ("o1_shuffle_take_many", 6000)):
    ORACLES[_name] = f"SELECT o_orderkey FROM orders ORDER BY md5('800|' || o_orderkey), o_orderkey LIMIT {_n}"
ORACLES["o2_top_values"] = "SELECT source, count(*) AS count FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15"


def _sample_sql(source: str, total: int, extra: str) -> str:
    uid = "md5('sample-42|' || id)"
    fresh = " || '-' || ".join(f"substr({uid}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return (
        f"SELECT {fresh} AS id, content_type, {extra}id AS source_key FROM (SELECT *, row_number() OVER (PARTITION BY "
        f"content_type ORDER BY md5('42|' || id), id) AS rn FROM ({source})) JOIN (SELECT content_type, {total} // n_types + "
        f"(place <= {total} % n_types)::INT AS quota FROM (SELECT content_type, row_number() OVER (ORDER BY content_type) "
        f"AS place, count(*) OVER () AS n_types FROM (SELECT DISTINCT content_type FROM ({source})))) USING (content_type) "
        "WHERE rn <= quota"
    )


_TYPED = "SELECT cast(doc_id AS VARCHAR) AS id, lang AS content_type, text FROM documents"
_ORDERS = "SELECT cast(o_orderkey AS VARCHAR) AS id, o_orderpriority AS content_type FROM orders"
ORACLES["o3_stratified_sample"] = _sample_sql(_TYPED, 150, "text, ")
ORACLES["o3_stratified_sample_many"] = _sample_sql(_ORDERS, 9001, "")
ORACLES["o3_sample_shortfall"] = (
    "SELECT lang AS content_type, cast(500 AS BIGINT) AS quota, count(*) AS available, "
    "greatest(500 - count(*), 0) AS missing FROM documents GROUP BY 1"
)
ORACLES["o4_keep_first"] = (
    "SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) = 1"
)
ORACLES["o5_repeated_rows"] = "SELECT doc_id, lang, cast(k AS INTEGER) AS copy FROM documents, range(1, 26) r(k)"
ORACLES["o6_skip_take"] = (
    "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 2345 OFFSET 1234"
)

# --- profile generation ------------------------------------------------------------------------


def profile_sql(columns: tuple[str, ...]) -> str:
    return PROFILE_SQL + " SELECT profile_key, " + ", ".join(columns) + " FROM profiles"


ORACLES["a15_education_job_flow"] = (
    PROFILE_SQL + ", pairs_ AS (SELECT education_info, coalesce(tier, 'Untiered') AS tier, job_title, count(*) AS c "
    "FROM profiles LEFT JOIN titles ON title = job_title GROUP BY 1, 2, 3), flows AS ("
    "SELECT 0 AS stage, education_info AS source, tier AS target, c FROM pairs_ UNION ALL "
    "SELECT 1, tier, job_title, c FROM pairs_) SELECT source, target, round(sum(c) * 100.0::DOUBLE / "
    "sum(sum(c)) OVER (PARTITION BY stage), 6) AS value FROM flows GROUP BY stage, source, target"
)

ORACLES["f_text_functions"] = (
    f"SELECT doc_id, {trim('text')} AS stripped, cast(len(regexp_extract_all(text, '[^{BLANK}]+')) AS INTEGER) AS word_count, "
    "regexp_replace(text, '[^0-9]', '', 'g') AS digits, md5(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) AS alnum_md5, "
    r"regexp_replace(text, '[^\p{L}\p{M}\p{N}_\-.]', '_', 'g') AS safe_name, "
    "round(('0x' || substr(md5(doc_id || '|x'), 1, 8))::BIGINT / 4294967296.0::DOUBLE, 9) AS draw FROM documents"
)


def _add_profile_oracles() -> None:
    from personaloom.registry.queries import PROFILE_QUERIES

    for name, columns in PROFILE_QUERIES.items():
        ORACLES[name] = profile_sql(columns)


_add_profile_oracles()
