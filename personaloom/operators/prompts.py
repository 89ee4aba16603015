"""Prompt, batch-request and completion tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from personaloom.functions.draws import stable_uuid
from personaloom.functions.text import strip_blanks, text_or_empty

# The error texts written for a missing completion.
NO_ARTICLE_ERROR = "API call failed or returned empty response. See logs."
NO_ONLINE_TEXT_ERROR = "API call failed or returned empty/invalid response. See logs."
# Endpoint of a batch request line.
BATCH_METHOD = "POST"
BATCH_URL = "/chat/completions"


def inspiration_text(abstract: Column, personal_life: Column, early_life: Column) -> Column:
    """Abstract, personal life and early life, one per line, stripped; null counts as ''."""
    lines = [text_or_empty(c) for c in (abstract, personal_life, early_life)]
    return strip_blanks(F.concat_ws("\n", *lines))


def article_prompt(inspiration: Column, profile_json: Column) -> Column:
    """User prompt of the article stage; the profile is compact JSON."""
    return F.concat(
        F.lit("**Inputs**:\nreal_wiki_inspiration_text:\n"),
        inspiration,
        F.lit(" \n synthetic_profile_json: \n "),
        profile_json,
    )


def online_text_prompt(profile_json: Column, passage: Column) -> Column:
    """User prompt of the online-text stage; a missing profile is '{}', a missing passage ''."""
    profile = F.when(profile_json.isNull() | (profile_json == ""), "{}").otherwise(profile_json)
    return F.concat(
        F.lit("**Synthetic Profile Json**:\n"),
        profile,
        F.lit("\n\n**Synthetic Persona Article**:\n"),
        text_or_empty(passage),
    )


def custom_id(unique_id: Column, *fallback_keys: Column) -> Column:
    """The profile id, or an id derived from the fallback keys where it is missing."""
    return F.coalesce(F.nullif(unique_id, F.lit("")), stable_uuid("request", *fallback_keys))


def batch_requests(
    prompts: DataFrame, model: str, system_prompt: str, keep: tuple[str, ...] = ()
) -> DataFrame:
    """One batch request per row of `prompts(custom_id, user_prompt)`."""
    body = F.struct(
        F.lit(model).alias("model"),
        F.array(
            F.struct(F.lit("system").alias("role"), F.lit(system_prompt).alias("content")),
            F.struct(F.lit("user").alias("role"), F.col("user_prompt").alias("content")),
        ).alias("messages"),
    )
    return prompts.select(
        *keep,
        "custom_id",
        F.lit(BATCH_METHOD).alias("method"),
        F.lit(BATCH_URL).alias("url"),
        body.alias("body"),
    )


def request_lines(requests: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Batch requests as JSON text in a `line` column."""
    whole = F.struct("custom_id", "method", "url", "body")
    return requests.select(*keep, F.to_json(whole).alias("line"))


def request_metadata(
    prompts: DataFrame, model: str, system_prompt: str, max_tokens: int
) -> DataFrame:
    """Metadata rows with the same custom_id as the requests; every other column is kept."""
    return prompts.withColumn("system_prompt", F.lit(system_prompt)).withColumn(
        "model_parameters",
        F.struct(F.lit(model).alias("model"), F.lit(max_tokens).alias("max_tokens")),
    )


def ingest_completions(
    metadata: DataFrame, responses: DataFrame, missing_error: str = NO_ARTICLE_ERROR
) -> DataFrame:
    """Attach `model_output` or `error` from `responses(custom_id, model_output, error)`.

    A request without output gets its own error, or `missing_error`.
    """
    r = responses.select("custom_id", "model_output", F.col("error").alias("_error"))
    joined = metadata.join(r, "custom_id", "left")
    no_output = F.col("model_output").isNull()
    error = F.when(no_output, F.coalesce(F.col("_error"), F.lit(missing_error)))
    return joined.withColumn("error", error).drop("_error")


def outcome_counts(
    results: DataFrame, output: str = "model_output", error: str = "error", bad_json: str | None = None
) -> DataFrame:
    """Processed, failed and unreadable rows. `bad_json` names the unreadable input line column."""
    out, err = F.col(output), text_or_empty(F.col(error))
    unreadable = F.col(bad_json).isNotNull() if bad_json else F.lit(False)
    processed = ~unreadable & (err == "") & out.isNotNull()
    return results.agg(
        F.count_if(processed).alias("processed"),
        F.count_if(~processed).alias("errors"),
        F.count_if(unreadable).alias("json_errors"),
    )
