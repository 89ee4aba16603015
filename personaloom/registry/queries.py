"""The registered queries: each runs one operator over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from personaloom.functions import draws, entities, handles, text as tx
from personaloom.functions.rows import explode_once
from personaloom.operators import (
    blocks,
    catalogue,
    contamination,
    corpus,
    mentions,
    pairing,
    profiles,
    prompts,
    relink,
    sampling,
    seeds,
    stats,
)
from personaloom.plans import batch_job
from personaloom.plans.corpus_build import build_corpus
from personaloom.plans.lineage import ensure_checkpoint_dir
from personaloom.plans.mention_report import PROFILE_COLUMNS
from personaloom.registry import fixtures as X
from personaloom.registry.fixtures import table
from personaloom.sources import readers, writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ASOF = date(2025, 4, 18)
ROW = ("conv_id", "turn")
MODEL, SYSTEM_PROMPT, MAX_TOKENS = "model-a", "Write.", 4000


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def scratch(spark: SparkSession) -> str:
    """A new folder next to the checkpoints, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4()}"


def with_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.add_content_pairs(X.records(spark, sf))


def plain_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Records with unattributed pairs and parsed handles."""
    return X.records(spark, sf).withColumns(
        {
            "content_pairs": blocks.content_pairs(F.col("model_output")),
            "_handles": handles.parse_handles(F.col("social_media_handles")),
        }
    )


def features(spark: SparkSession, sf: str) -> DataFrame:
    return mentions.feature_rows(with_pairs(spark, sf))


def rounded(c: str) -> F.Column:
    return F.round(F.col(c), 6).alias(c)


# --- sources and sinks -------------------------------------------------------------------------

_LINE_SCHEMA = "doc_id bigint, lang string, n_chars bigint, text string"


def _written_lines(spark: SparkSession, sf: str) -> str:
    """JSON lines of the documents in order, some of them broken."""
    path = scratch(spark)
    line = F.to_json(F.struct("doc_id", "lang", "n_chars", "text"))
    broken = F.when(F.col("doc_id") % 10 == 3, F.substring(line, 1, 12)).otherwise(line)
    table(spark, sf, "documents").orderBy("doc_id").select(broken.alias("value")).write.text(path)
    return path


@query
def s1_json_lines_good(spark, sf):
    path = _written_lines(spark, sf)
    return readers.good_rows(readers.read_json_lines(spark, path, _LINE_SCHEMA))


@query
def s1_json_lines_bad(spark, sf):
    lines = readers.read_numbered_lines(spark, _written_lines(spark, sf))
    return readers.numbered_errors(readers.parse_numbered(lines, _LINE_SCHEMA))


@query
def s2_tsv_round_trip(spark, sf):
    path = scratch(spark)
    rows = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "source", "text")
    writers.write_tsv(rows, path)
    return readers.read_tsv(spark, path, "doc_id string, source string, text string")


@query
def s3_skip_filter_take(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    rest = sampling.skip_take(docs, "doc_id", skip=100)
    return sampling.skip_take(rest.filter("lang = 'en'"), "doc_id", take=150)


@query
def s4_pruned_columns(spark, sf):
    return readers.read_columns(spark, f"{sf}/documents.parquet", ["doc_id", "n_chars"])


@query
def s5_json_sink(spark, sf):
    path = scratch(spark)
    writers.write_json_lines(table(spark, sf, "conversations"), path)
    schema = "conv_id bigint, turn bigint, role string, text string"
    return readers.read_json_lines(spark, path, schema, on_bad="fail")


@query
def s6_corpus_tsv(spark, sf):
    path = scratch(spark)
    rows = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("content_type"), "text"
    )
    writers.write_corpus_tsv(rows, path)
    back = readers.read_corpus_tsv(spark, path)
    return back.select(
        F.col("UniqueID").alias("id"),
        F.col("ContentType").alias("content_type"),
        tx.decode_json_cell_or_empty(F.col("Text")).alias("text"),
    )


@query
def s7_file_per_type(spark, sf):
    path = scratch(spark)
    rows = stats_rows(spark, sf)
    writers.write_per_type(rows, path)
    back = spark.read.option("sep", "\t").option("header", True).option("escape", '"').schema(
        "conv_id bigint, turn bigint, content_type string, type_name string"
    ).csv(path)
    return back.groupBy("type_name", "content_type").agg(F.count(F.lit(1)).alias("count"))


def stats_rows(spark, sf):
    pairs = explode_once(with_pairs(spark, sf), "content_pairs", list(ROW), "p")
    return pairs.select(*ROW, F.col("p.ContentType").alias("content_type"))


@query
def s8_typed_table(spark, sf):
    path = scratch(spark)
    schema = {"doc_id": "string", "lang": "string", "n_chars": "int", "source": "string", "text": "string"}
    writers.write_table(table(spark, sf, "documents"), path, schema)
    return spark.read.parquet(path)


@query
def s9_stats_file(spark, sf):
    path = scratch(spark)
    writers.write_stats(stats.content_type_stats(with_pairs(spark, sf)), path)
    schema = "content_type string, count bigint, total_length bigint, average_length double, percentage_of_records double"
    back = spark.read.schema(schema).json(path)
    return back.withColumns({c: rounded(c) for c in ("average_length", "percentage_of_records")})


# --- seed people -------------------------------------------------------------------------------


@query
def w1_person_infobox(spark, sf):
    return X.wiki_records(spark, sf).filter(seeds.has_person_infobox(F.col("infoboxes"))).select("doc_id")


@query
def w2_named_records(spark, sf):
    return X.wiki_records(spark, sf).filter("name <> ''").select("doc_id", "name")


@query
def w3_section_text(spark, sf):
    texts = seeds.section_texts(F.col("sections"), {"personal_life": "Personal life", "early_life": "Early life"})
    return X.wiki_records(spark, sf).select("doc_id", texts.alias("texts")).select("doc_id", "texts.*")


@query
def w3_deep_sections(spark, sf):
    return X.deep_records(spark, sf).select("doc_id", seeds.section_text(F.col("sections"), "personal life").alias("personal_life"))


@query
def w4_seed_people(spark, sf):
    return seeds.select_seed_people(X.wiki_records(spark, sf), ("doc_id",))


@query
def w5_cells(spark, sf):
    cell = tx.json_cell(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", cell.alias("cell"), tx.decode_json_cell(cell).alias("decoded"),
        tx.decode_json_cell(F.substring(cell, 1, 9)).alias("kept"),
    )


@query
def w6_birth_origin(spark, sf):
    return X.wiki_records(spark, sf).select("doc_id", seeds.birth_origin(F.col("infoboxes")).alias("origin"))


@query
def w7_seed_cells(spark, sf):
    people = seeds.select_seed_people(X.wiki_records(spark, sf), ("doc_id",))
    return seeds.seed_cells(people, ("doc_id",))


# --- blocks, attribution, corpus ---------------------------------------------------------------


@query
def p1_passages(spark, sf):
    found = blocks.extract_passages(X.records(spark, sf), "passage_output")
    return found.select(*ROW, "generated_synthetic_passage")


@query
def p2_nested_generation(spark, sf):
    r = X.records(spark, sf).select(
        *ROW,
        F.lit(SYSTEM_PROMPT).alias("system_prompt"),
        F.concat(F.lit("u"), "unique_id").alias("user_prompt"),
        F.lit(MODEL).alias("model_parameters"),
        F.col("passage_output").alias("model_output"),
    )
    nested = blocks.nest_passage_generation(blocks.extract_passages(r))
    return nested.select(*ROW, F.to_json("SyntheticPassageGeneration").alias("generation"))


@query
def p3_content_blocks(spark, sf):
    return X.records(spark, sf).select(*ROW, F.inline(blocks.raw_blocks(F.col("model_output")))).select(
        *ROW, "pos", F.col("ContentType").alias("content_type"), F.col("Text").alias("text")
    )


@query
def p4_block_types(spark, sf):
    found = X.records(spark, sf).select(F.inline(blocks.raw_blocks(F.col("model_output"))))
    return found.groupBy(F.col("ord"), F.col("ContentType").alias("content_type")).agg(
        F.count(F.lit(1)).alias("count")
    )


@query
def p5_handles(spark, sf):
    parsed = X.records(spark, sf).select(*ROW, F.explode(handles.parse_handles(F.col("social_media_handles"))))
    return parsed.select(*ROW, F.col("key").alias("platform"), F.posexplode("value").alias("place", "handle"))


@query
def p6_first_mention(spark, sf):
    r = plain_pairs(spark, sf)
    rows = explode_once(r, "content_pairs", [*ROW, "first_name", "_handles"], "p", "place")
    who = handles.first_mention(F.col("p.Text"), handles.handle_values(F.col("_handles")), F.col("first_name"))
    return rows.select(*ROW, "place", who.alias("mention"))


def _texts_in_place(r: DataFrame, pairs) -> DataFrame:
    rows = r.select(*ROW, F.posexplode(pairs).alias("place", "p"))
    return rows.select(
        *ROW, "place", F.col("p.ContentType").alias("content_type"), F.col("p.Text").alias("text")
    )


@query
def p7_attribution_extraction(spark, sf):
    r = plain_pairs(spark, sf)
    cols = [F.col(c) for c in ("content_pairs", "_handles", "first_name")]
    return _texts_in_place(r, blocks.attribute_on_extraction(*cols))


@query
def p8_attribution_repair(spark, sf):
    r = plain_pairs(spark, sf)
    cols = [F.col(c) for c in ("content_pairs", "_handles", "first_name")]
    return _texts_in_place(r, blocks.attribute_on_repair(*cols))


@query
def p9_attribution_cohort(spark, sf):
    r = plain_pairs(spark, sf)
    cols = [F.col(c) for c in ("content_pairs", "_handles", "first_name", "last_name")]
    return _texts_in_place(r, blocks.attribute_for_cohort(*cols))


@query
def p10_corpus_rows(spark, sf):
    return build_corpus(X.records(spark, sf), keep=ROW)


@query
def p11_safe_pass(spark, sf):
    r = blocks.add_content_pairs(X.records(spark, sf), profile_present=F.col("spouse_name").isNotNull())
    return r.select(*ROW, F.col("content_pairs").isNull().alias("unchanged"))


@query
def p12_cohort(spark, sf):
    r = X.records(spark, sf)
    return r.filter(corpus.in_cohort(F.col("locale"), F.col("age_text"))).select(*ROW)


@query
def p13_cohort_texts(spark, sf):
    r = X.records(spark, sf).withColumn("content_pairs", blocks.content_pairs(F.col("model_output")))
    return corpus.cohort_texts(r, order_by=ROW, age="age_text", limit=100).select(*ROW, "unique_id", "concat_content_pairs")


@query
def p14_repaired_contents(spark, sf):
    r = X.records(spark, sf).withColumn("content_pairs", blocks.content_pairs(F.col("model_output")))
    out = corpus.repaired_contents(r, ROW)
    return explode_once(out, "all_content", list(ROW), "text", "place")


@query
def p15_age_numbers(spark, sf):
    return X.records(spark, sf).select(*ROW, tx.int_or_zero(F.col("age_text")).alias("age"))


@query
def p16_decoded_corpus(spark, sf):
    cell = tx.json_cell(F.col("text"))
    broken = F.when(F.col("doc_id") % 6 == 1, F.substring(cell, 1, 20)).otherwise(cell)
    return corpus.decode_corpus_text(table(spark, sf, "documents").select(broken.alias("Text")))


@query
def p17_decoded_cells(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), tx.json_cell(F.col("lang")).alias("lang"),
        F.when(F.col("doc_id") % 2 == 0, tx.json_cell(F.col("text"))).otherwise(F.col("text")).alias("text"),
    )
    return corpus.decode_all_cells(docs)


@query
def p18_string_records(spark, sf):
    return corpus.as_string_record(X.records(spark, sf))


@query
def p19_end_marker(spark, sf):
    return corpus.end_of_text(table(spark, sf, "documents").select("doc_id", "text"), "<end>")


# --- prompts and requests ----------------------------------------------------------------------


def profile_json() -> F.Column:
    """The whole profile as JSON, nulls included."""
    return F.to_json(F.struct(*X.PROFILE_FIELDS), {"ignoreNullFields": "false"})


def prompt_rows(spark, sf):
    """Requests per record: id (missing for every fifth turn), inspiration and prompt."""
    docs = X.records(spark, sf)
    inspiration = prompts.inspiration_text(
        F.when(F.col("turn") % 2 == 0, F.col("real_person_text_input")),
        F.when(F.col("turn") % 3 == 0, F.col("passage_output")),
        F.col("spouse_name"),
    )
    profile = profile_json()
    own_id = F.when(F.col("turn") % 5 != 4, F.concat("unique_id", F.lit("-"), F.col("turn").cast("string")))
    return docs.select(
        *ROW,
        prompts.custom_id(own_id, F.col("conv_id"), F.col("turn")).alias("custom_id"),
        inspiration.alias("real_person_text_input"),
        profile.alias("profile_json"),
        prompts.article_prompt(inspiration, profile).alias("user_prompt"),
    )


@query
def b1_inspiration(spark, sf):
    return prompt_rows(spark, sf).select(*ROW, "real_person_text_input")


@query
def b2_article_prompts(spark, sf):
    return prompt_rows(spark, sf).select(*ROW, "user_prompt")


@query
def b3_online_text_prompts(spark, sf):
    r = X.records(spark, sf).withColumn("passage", blocks.passage(F.col("passage_output")))
    profile = F.when(F.col("turn") % 4 != 1, profile_json())
    return r.select(*ROW, prompts.online_text_prompt(profile, F.col("passage")).alias("user_prompt"))


@query
def b4_batch_requests(spark, sf):
    requests = prompts.batch_requests(prompt_rows(spark, sf), MODEL, SYSTEM_PROMPT, ROW)
    return prompts.request_lines(requests, ROW)


def _batch_job(spark, sf):
    """The whole job from two line files, both with broken lines and lines of other shapes."""
    path = scratch(spark)
    rows = pairing.number_rows(X.records(spark, sf), list(ROW), "place").withColumn("n", F.col("place") - 1)
    whole = F.concat(F.lit('{"Unique ID":"'), F.when(F.col("conv_id") % 4 != 1, F.col("unique_id")).otherwise(""), F.lit('","profile":'), profile_json(), F.lit("}"))
    line = F.when(F.col("n") % 9 == 4, F.substring(whole, 1, 20)).when(F.col("n") % 9 == 7, "[1]").otherwise(whole)
    rows.orderBy("n").select(line.alias("value")).write.text(f"{path}/profiles")
    person = F.to_json(F.struct(F.col("lang").alias("Abstract"), F.when(F.col("doc_id") % 3 != 0, F.col("text")).alias("Personal_Life")))
    line = F.when(F.col("doc_id") % 10 == 3, F.substring(person, 1, 12)).otherwise(person)
    table(spark, sf, "documents").orderBy("doc_id").select(line.alias("value")).write.text(f"{path}/people")
    return batch_job.prepare_batches(spark, f"{path}/profiles", f"{path}/people", f"{path}/out", MODEL, SYSTEM_PROMPT, MAX_TOKENS)


@query
def b4_batch_job(spark, sf):
    """Metadata of the job, read back, beside the requests of the same prompt."""
    done = _batch_job(spark, sf)
    known = F.from_json("value", "line_number long, custom_id string, real_person_text_input string, user_prompt string")
    known = done["metadata"].select(known.alias("m")).select("m.*")
    asked = F.from_json("value", "custom_id string, body struct<messages:array<struct<role:string,content:string>>>")
    asked = done["requests"].select(asked.alias("r")).groupBy("r.custom_id", F.md5(F.col("r.body.messages")[1]["content"]).alias("prompt_md5"))
    asked = asked.agg(F.count(F.lit(1)).alias("requests"))
    known = known.select("line_number", "custom_id", "real_person_text_input", F.md5("user_prompt").alias("prompt_md5"))
    return known.join(asked, ["custom_id", "prompt_md5"])


@query
def b7_batch_job_counts(spark, sf):
    done = _batch_job(spark, sf)
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    counts = done["counts"].select("prepared", "json_errors", none.alias("error_rows"), none.alias("error_lines"))
    errors = done["errors"].select(none.alias("prepared"), none.alias("json_errors"), one.alias("error_rows"), F.col("line_number").alias("error_lines"))
    both = counts.unionByName(errors)
    return both.agg(*[F.sum(c).alias(c) for c in both.columns])


@query
def b5_request_metadata(spark, sf):
    meta = prompts.request_metadata(prompt_rows(spark, sf), MODEL, SYSTEM_PROMPT, MAX_TOKENS)
    return meta.select(
        *ROW, "custom_id", "real_person_text_input", "system_prompt",
        F.to_json("model_parameters").alias("model_parameters"),
    )


def completions(spark, sf):
    meta = prompt_rows(spark, sf).select(*ROW, "custom_id")
    answers = X.records(spark, sf).filter("turn % 3 <> 0").select(
        F.concat("unique_id", F.lit("-"), F.col("turn").cast("string")).alias("custom_id"),
        F.when(F.col("turn") % 3 == 1, F.col("passage_output")).alias("model_output"),
        F.col("error"),
    )
    return prompts.ingest_completions(meta, answers)


@query
def b6_completions(spark, sf):
    return completions(spark, sf)


@query
def b7_outcomes(spark, sf):
    return prompts.outcome_counts(completions(spark, sf))


# --- entities and contamination ----------------------------------------------------------------


@query
def c1_pattern_entities(spark, sf):
    return contamination.text_entities(table(spark, sf, "documents"), ("doc_id",))


@query
def c2_person_names(spark, sf):
    found = entities.pattern_values(F.col("text"), "PERSON")
    return table(spark, sf, "documents").select("doc_id", F.explode(found).alias("value"))


@query
def c3_model_entities(spark, sf):
    docs = table(spark, sf, "documents")
    found = contamination.text_entities(docs, ("doc_id",))
    other = docs.select(
        "doc_id", F.lit("ORG").alias("type"), F.concat(F.lit(" "), "source", F.lit("\n")).alias("value")
    )
    return contamination.with_model_entities(found, other, ("doc_id",))


@query
def c4_overlaps(spark, sf):
    hit = contamination.contaminated_entities(X.halves(spark, sf), "doc_id")
    return explode_once(hit, "_hits", ["doc_id"], "hit").select("doc_id", "hit.*")


@query
def c5_contamination_report(spark, sf):
    return contamination.contamination_report(X.halves(spark, sf), "doc_id")


@query
def c6_contamination_summary(spark, sf):
    return contamination.contamination_summary(X.halves(spark, sf))


@query
def c7_clean_records(spark, sf):
    return contamination.keep_clean(X.halves(spark, sf)).select("doc_id")


# --- mentions ----------------------------------------------------------------------------------


@query
def m1_feature_rows(spark, sf):
    f = mentions.explode_pairs(with_pairs(spark, sf))
    return f.select(
        *ROW, "content_pair_index", "content_type", "synthetic_text_length", "synthetic_word_count",
        "real_person_text_length", "generation_error", "has_allergies", "has_disability",
    )


def _details(spark, sf, fields: list[str]):
    f = features(spark, sf)
    d = mentions.mention_details(f, (*ROW, "content_pair_index"))
    return d.filter(F.col("pii_field_name").isin(fields)).drop("synthetic_text", "content_type")


def _field_values(spark, sf):
    values = X.records(spark, sf).select(*ROW, mentions.field_values().alias("v"))
    return values.select(*ROW, F.inline("v"))


@query
def m2_search_values(spark, sf):
    return _field_values(spark, sf)


@query
def m3_length_gate(spark, sf):
    long = mentions.long_enough(F.col("value")).alias("long_enough")
    return _field_values(spark, sf).select(*ROW, "field", F.length("value").alias("n"), long)


@query
def m4_phone_mentions(spark, sf):
    return _details(spark, sf, mentions.PHONE_FIELDS)


@query
def m5_id_mentions(spark, sf):
    return _details(spark, sf, mentions.ID_FIELDS)


@query
def m6_address_mentions(spark, sf):
    return _details(spark, sf, [mentions.ADDRESS_FIELD])


@query
def m7_general_mentions(spark, sf):
    return _details(spark, sf, mentions.GENERAL_FIELDS + mentions.HEALTH_FIELDS)


@query
def m8_handle_mentions(spark, sf):
    return _details(spark, sf, [mentions.HANDLE_FIELD])


@query
def m9_mention_counts(spark, sf):
    return features(spark, sf).select(
        *ROW, "content_pair_index", "num_mentioned_pii_fields", "any_pii_mentioned"
    )


@query
def m10_mention_details(spark, sf):
    return mentions.mention_details(features(spark, sf), (*ROW, "content_pair_index"))


@query
def m11_money_values(spark, sf):
    return X.records(spark, sf).select(
        *ROW,
        tx.money_value(F.col("net_worth")).alias("net_worth"),
        tx.money_value(F.col("annual_salary")).alias("annual_salary"),
    )


# --- joins -------------------------------------------------------------------------------------


@query
def j1_positional_pairs(spark, sf):
    left = pairing.number_rows(table(spark, sf, "benchmark").select("item_id"), "item_id")
    right = pairing.number_rows(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return pairing.pair_by_position(left, right)


def _file_pairs(spark, sf):
    """Two line files, both with broken lines, paired line by line."""
    path = scratch(spark)
    line = F.to_json(F.struct("item_id", "text"))
    broken = F.when(F.col("item_id") % 4 == 1, F.substring(line, 1, 12)).otherwise(line)
    table(spark, sf, "benchmark").orderBy("item_id").select(broken.alias("value")).write.text(path)
    left = readers.parse_numbered(readers.read_numbered_lines(spark, path), "item_id bigint, text string")
    right = readers.read_numbered_lines(spark, _written_lines(spark, sf))
    return pairing.pair_parsed(left, readers.parse_numbered(right, _LINE_SCHEMA))


@query
def j1_file_pairs(spark, sf):
    return pairing.good_pairs(_file_pairs(spark, sf)).select(
        "line_number",
        *[F.col(f"left_record.{c}").alias(f"item_{c}") for c in ("item_id", "text")],
        *[F.col(f"right_record.{c}").alias(c) for c in ("doc_id", "lang", "n_chars", "text")],
    )


@query
def j1_file_errors(spark, sf):
    return pairing.bad_pairs(_file_pairs(spark, sf)).select("line_number", "error", F.md5("left_line").alias("left_md5"), F.md5("right_line").alias("right_md5"))


def _subset(spark, sf):
    """Texts without ids: each document text once, and the benchmark texts."""
    own = table(spark, sf, "documents").select("text").distinct()
    return own.unionByName(table(spark, sf, "benchmark").select("text"))


def _master(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), "text", F.col("doc_id").alias("pos")
    )


@query
def j2_exact_link(spark, sf):
    linked = relink.link_exact(_subset(spark, sf), _master(spark, sf).drop("pos"))
    return linked.select(F.md5("text").alias("text_md5"), "id")


def _containing(spark, sf):
    """Texts to recover: benchmark items, parts of documents in mixed case, and documents with a tail."""
    docs = table(spark, sf, "documents")
    bench = table(spark, sf, "benchmark").select("text")
    k = F.col("doc_id").cast("int")
    piece = F.substr("text", k % 50 + 5, k % 90)
    part = docs.select(F.translate(piece, "aeiouznt", "AEIOUZNT").alias("text"))
    tail = docs.select(F.concat("text", F.lit(" and more")).alias("text"))
    return bench.unionByName(part).unionByName(tail)


@query
def j3_recovered_ids(spark, sf):
    found = relink.recover_ids(_containing(spark, sf), _master(spark, sf))
    return found.select(F.md5("text").alias("text_md5"), "id")


@query
def j3_benchmark_in_documents(spark, sf):
    found = relink.recover_ids(table(spark, sf, "benchmark").select("text"), _master(spark, sf))
    return found.select(F.md5("text").alias("text_md5"), "id")


def _info(spark, sf):
    docs = table(spark, sf, "documents").filter("doc_id % 4 <> 3")
    return docs.select(
        F.col("doc_id").alias("id"), F.to_json(F.struct("doc_id", "lang", "source")).alias("complete_info")
    )


@query
def j3_short_texts(spark, sf):
    """Pieces of one to five words of the documents, many of which share their inner words."""
    words = F.split("text", r"\s+", 8)  # a piece ends with the sixth word
    n = (1 + F.col("doc_id") % 5).cast("int")
    piece = F.array_join(F.slice(words, F.least(F.lit(2), F.size(words)), n), " ")
    docs = table(spark, sf, "documents").filter("text is not null")
    pieces = docs.select(F.when(n == 1, F.substring(piece, 1, 40)).otherwise(piece).alias("text")).filter("text <> ''")
    found = relink.recover_ids(pieces, _master(spark, sf))
    return found.select(F.md5("text").alias("text_md5"), "id")


@query
def j4_relinked(spark, sf):
    out = relink.relink(_subset(spark, sf), _master(spark, sf), _info(spark, sf))
    return out.select(F.md5("text").alias("text_md5"), "id", "complete_info")


@query
def j5_text_lookup(spark, sf):
    ids = _master(spark, sf).groupBy("text").agg(F.min_by("id", "pos").alias("id"))
    return relink.link_exact(table(spark, sf, "benchmark"), ids).select("item_id", "id")


def people_with_jobs(spark, sf):
    customers = table(spark, sf, "customer")
    return customers.select(
        "c_custkey", F.concat(F.lit("Job NATION_"), F.col("c_nationkey").cast("string")).alias("job_title")
    )


def tier_table(spark, sf):
    tiers = X.jobs(spark, sf).filter("tier IS NOT NULL")
    low, high = (
        F.coalesce(*[F.when(F.col("tier") == t[0], F.lit(t[i])) for t in catalogue.TIERS]) for i in (1, 2)
    )
    return tiers.select("title", "tier", low.alias("min_salary"), high.alias("max_salary"))


@query
def j6_tier_lookup(spark, sf):
    return catalogue.tier_of_titles(people_with_jobs(spark, sf), tier_table(spark, sf))


@query
def j7_open_jobs(spark, sf):
    rows = profiles.eligible_jobs(X.jobs(spark, sf)).select("level", "band", "title", "upto")
    people = table(spark, sf, "customer").select(
        "c_custkey", (F.col("c_custkey") % 10).cast("int").alias("level"),
        F.when(F.col("c_custkey") % 73 >= 7, 25).when(F.col("c_custkey") % 73 >= 3, 21).otherwise(18).alias("band"),
    )
    return people.join(rows, ["level", "band"]).select("c_custkey", "title", rounded("upto"))


@query
def j8_rows_of_top_jobs(spark, sf):
    r = X.records(spark, sf).select(*ROW, "job_title")
    return stats.rows_of_top_jobs(r, 15)


@query
def j9_untiered_titles(spark, sf):
    return catalogue.titles_without_tier(X.titles(spark, sf), tier_table(spark, sf))


# --- statistics --------------------------------------------------------------------------------


@query
def a1_content_type_stats(spark, sf):
    s = stats.content_type_stats(with_pairs(spark, sf))
    return s.select(
        "content_type", "count", "total_length", rounded("average_length"), rounded("percentage_of_records")
    )


def first_profiles(spark, sf):
    f = features(spark, sf)
    return sampling.keep_first(f, "unique_id", [*ROW, "content_pair_index"])


@query
def a2_profile_values(spark, sf):
    return stats.value_counts(first_profiles(spark, sf), PROFILE_COLUMNS)


@query
def a3_histograms(spark, sf):
    f = features(spark, sf)
    return stats.histograms(
        f,
        {
            "age": 5, "net_worth_value": 10, "annual_salary_value": 10000, "synthetic_text_length": 50,
            "synthetic_word_count": 10, "num_mentioned_pii_fields": 1,
        },
    )


@query
def a4_content_types(spark, sf):
    return sampling.top_values(stats_rows(spark, sf), "content_type")


@query
def a5_totals(spark, sf):
    t = stats.totals(mentions.explode_pairs(with_pairs(spark, sf)))
    return t.withColumn("texts_per_profile", rounded("texts_per_profile"))


@query
def a6_any_mention(spark, sf):
    return stats.any_mention(features(spark, sf)).withColumn("percentage", rounded("percentage"))


@query
def a7_field_counts(spark, sf):
    return stats.field_counts(features(spark, sf))


@query
def a8_field_by_type(spark, sf):
    return stats.field_by_type(features(spark, sf), blocks.CONTENT_TYPES)


@query
def a9_mention_rate(spark, sf):
    return stats.mention_rate(features(spark, sf), "content_type").withColumn("percentage", rounded("percentage"))


@query
def a10_mentions_by_age(spark, sf):
    s = stats.mentions_by_age(features(spark, sf))
    return s.withColumn("avg_num_mentioned", rounded("avg_num_mentioned"))


@query
def a11_share_by_mention(spark, sf):
    s = stats.type_share_by_mention(features(spark, sf), 3)
    return s.withColumn("percentage", rounded("percentage"))


@query
def a12_top_job_rates(spark, sf):
    return stats.top_job_rates(features(spark, sf)).withColumn("percentage", rounded("percentage"))


@query
def a13_share_by_job(spark, sf):
    s = stats.type_share_by_job(features(spark, sf), blocks.CONTENT_TYPES)
    return s.select("job_title", *[F.round(f"`{t}`", 6).alias(t) for t in blocks.CONTENT_TYPES])


@query
def a14_error_jobs(spark, sf):
    return stats.error_jobs(mentions.explode_pairs(with_pairs(spark, sf)), [*ROW, "content_pair_index"])


@query
def a15_education_job_flow(spark, sf):
    flow = stats.education_job_flow(generated(spark, sf), X.jobs(spark, sf))
    return flow.withColumn("value", rounded("value"))


@query
def a16_relink_counts(spark, sf):
    master = _master(spark, sf)
    linked = relink.link_exact(_subset(spark, sf), master.drop("pos"))
    missing = linked.filter("id IS NULL").select("text")
    return relink.relink_counts(linked, relink.recover_ids(missing, master))


# --- order, samples, repeats -------------------------------------------------------------------


@query
def o1_shuffle_take(spark, sf):
    return sampling.shuffle_take(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 500, 800)


@query
def o1_shuffle_take_many(spark, sf):
    return sampling.shuffle_take(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 6000, 800)


@query
def o2_top_values(spark, sf):
    return sampling.top_values(table(spark, sf, "documents"), "source", 15)


def _typed(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("content_type"), "text"
    )


@query
def o3_stratified_sample(spark, sf):
    return sampling.stratified_sample(_typed(spark, sf), ["fr", "en", "es", "de"], 150)


@query
def o3_stratified_sample_many(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("content_type")
    )
    types = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    return sampling.stratified_sample(rows, types, 9001)


@query
def o3_sample_shortfall(spark, sf):
    return sampling.sample_shortfall(_typed(spark, sf), ["fr", "en", "es", "de"], 2000)


@query
def o4_keep_first(spark, sf):
    c = table(spark, sf, "conversations")
    return sampling.keep_first(c, "role", ["conv_id", "turn"])


@query
def o5_repeated_rows(spark, sf):
    return sampling.repeat_rows(table(spark, sf, "documents").select("doc_id", "lang"), 25, "copy")


@query
def o6_skip_take(spark, sf):
    docs = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return sampling.skip_take(docs, "o_orderkey", skip=1234, take=2345)


@query
def o6_skip_take_by_text(spark, sf):
    """By a text and a number: events by type and, as text, by time."""
    rows = table(spark, sf, "events").select("event_type", F.md5(F.col("event_id").cast("string")).alias("digest"), "event_id")
    return sampling.skip_take(rows, ["event_type", "digest"], skip=777, take=1500)


@query
def j1_pairs_by_text(spark, sf):
    """Documents and conversations, both in the order of text keys, row i with row i."""
    docs = table(spark, sf, "documents").select("source", F.md5("text").alias("text_md5"), F.col("doc_id").cast("string").alias("id"))
    left = pairing.number_rows(docs, ["source", "text_md5", "id"])
    turns = table(spark, sf, "conversations").select(F.concat_ws("-", "role", "conv_id", "turn").alias("turn_key"))
    return pairing.pair_by_position(left, pairing.number_rows(turns, "turn_key"))


# --- profile generation ------------------------------------------------------------------------


def generated(spark, sf):
    return profiles.generate_profiles(X.profile_keys(spark, sf), X.pools(spark, sf), X.jobs(spark, sf), ASOF)


def _profile_query(*columns: str) -> Query:
    return lambda spark, sf: generated(spark, sf).select("profile_key", *columns)


PROFILE_QUERIES = {
    "g1_keys": ("unique_id", "locale"),
    "g2_categories": ("gender", "blood_type", "allergies", "disability"),
    "g3_names": ("first_name", "last_name", "fathers_name", "mothers_name"),
    "g4_birth": ("birth_date", "age"),
    "g5_education": ("education_info",),
    "g6_marital_status": ("marital_status",),
    "g7_spouse": ("spouse_name",),
    "g8_children": ("children_count",),
    "g9_job": ("job_title",),
    "g10_salary": ("annual_salary",),
    "g11_finance": ("finance_status",),
    "g12_net_worth": ("net_worth",),
    "g13_credit": ("credit_score",),
    "g14_email": ("email_address",),
    "g15_work_email": ("work_email", "employer"),
    "g16_handles": ("social_media_handles",),
    "g17_ids": ("national_id", "passport_number", "drivers_license"),
    "g18_contact": (
        "phone_number", "work_phone", "address", "birth_city", "emergency_contact_name",
        "emergency_contact_phone",
    ),
    "g19_nationality": ("nationality",),
    "g_full_profiles": tuple(profiles.PROFILE_FIELDS),
}
QUERIES.update({name: _profile_query(*columns) for name, columns in PROFILE_QUERIES.items()})


@query
def f_text_functions(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id",
        tx.strip_blanks(F.concat(F.lit("\n \t"), t, F.lit("  \n"))).alias("stripped"),
        tx.word_count(t).alias("word_count"),
        tx.digits_only(t).alias("digits"),
        F.md5(tx.alnum_only(t)).alias("alnum_md5"),
        tx.safe_name(t).alias("safe_name"),
        F.round(draws.uniform("doc_id", "x"), 9).alias("draw"),
    )
