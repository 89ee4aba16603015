"""From two files of JSON lines to batch requests and their metadata, with a stored parent that a restart goes on from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from personaloom.operators import prompts
from personaloom.operators.pairing import pair_by_position
from personaloom.plans.lineage import committed
from personaloom.sources.readers import read_numbered_lines
from personaloom.sources.writers import write_stats, write_table

# Members of the two kinds of records.
ID_MEMBER = "Unique ID"
PERSON_MEMBERS = ("Abstract", "Personal_Life", "Early_Life")
BAD_LINE_ERROR = "JSON Decode Error"


def _records(lines: DataFrame, name: str) -> DataFrame:
    """line_number, the line, and its record where the line is a JSON object."""
    parsed = F.try_parse_json(F.trim("value"))
    is_object = F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT"))
    return lines.select("line_number", F.trim("value").alias(f"{name}_line"), F.when(is_object, parsed).alias(name))


def _member(record: str, name: str):
    return F.try_variant_get(F.col(record), f'$["{name}"]', "string")


def prompt_table(profiles: DataFrame, people: DataFrame) -> DataFrame:
    """One row per pair of lines (line_number, value): its request, or with `error` both lines as they were.

    Line i goes with line i and the longer file is cut off. The profile goes into the prompt as its line is
    written; a missing id is derived from the line's number.
    """
    pairs = pair_by_position(_records(profiles, "profile"), _records(people, "person"))
    bad = F.col("profile").isNull() | F.col("person").isNull()
    inspiration = prompts.inspiration_text(*[_member("person", m) for m in PERSON_MEMBERS])
    rows = pairs.select(
        "line_number",
        F.when(bad, BAD_LINE_ERROR).alias("error"),
        prompts.custom_id(_member("profile", ID_MEMBER), F.col("line_number")).alias("custom_id"),
        inspiration.alias("real_person_text_input"),
        "profile_line",
        F.when(bad, F.col("person_line")).alias("person_line"),
    )
    text = prompts.article_prompt(F.col("real_person_text_input"), F.col("profile_line"))
    return rows.withColumn("user_prompt", F.when(F.col("error").isNull(), text))


def prepare_batches(
    spark: SparkSession, profiles: str, people: str, folder: str, model: str, system_prompt: str, max_tokens: int
) -> dict[str, DataFrame]:
    """Writes requests, metadata, errors and counts below `folder` and returns them as read back from there.

    The pairs are parsed once, into a stored table; its counts are observed while it is written. Every part is
    a folder with a commit marker: a second call with the same folder leaves what is committed as it is, reads it, and
    writes only what is missing, also when the input files are gone.
    """
    parent, counts = f"{folder}/prompts", f"{folder}/counts"
    if not committed(spark, parent):
        seen = Observation("batch")
        rows = prompt_table(read_numbered_lines(spark, profiles), read_numbered_lines(spark, people))
        failed = F.count_if(F.col("error").isNotNull())
        rows = rows.observe(seen, F.count_if(F.col("error").isNull()).alias("prepared"), failed.alias("json_errors"))
        write_table(rows, parent, mode="overwrite")
        got = spark.createDataFrame([(seen.get["prepared"], seen.get["json_errors"])], "prepared long, json_errors long")
        write_stats(got, counts, mode="overwrite")
    stored = spark.read.parquet(parent)
    if not committed(spark, counts):  # the job ended between the two
        failed = F.count_if(F.col("error").isNotNull())
        write_stats(stored.agg(F.count_if(F.col("error").isNull()).alias("prepared"), failed.alias("json_errors")), counts, mode="overwrite")
    good = stored.filter("error is null")
    requests = prompts.request_lines(prompts.batch_requests(good, model, system_prompt))
    known = prompts.request_metadata(good, model, system_prompt, max_tokens)
    record = F.parse_json("profile_line").alias("synthetic_pii_input")
    known = known.select(
        F.to_json(
            F.struct(
                "line_number", "custom_id", record, "real_person_text_input", "system_prompt", "user_prompt", "model_parameters"
            ),
            {"ignoreNullFields": "false"},
        ).alias("line")
    )
    broken = stored.filter("error is not null").select("line_number", "error", "profile_line", "person_line")
    for name, lines in (
        ("requests", requests), ("metadata", known), ("errors", broken.select(F.to_json(F.struct(*broken.columns)).alias("line")))
    ):
        if not committed(spark, f"{folder}/{name}"):
            lines.write.mode("overwrite").text(f"{folder}/{name}")
    return {
        "requests": spark.read.text(f"{folder}/requests"),
        "metadata": spark.read.text(f"{folder}/metadata"),
        "errors": spark.read.schema("line_number long, error string, profile_line string, person_line string").json(f"{folder}/errors"),
        "counts": spark.read.schema("prepared long, json_errors long").json(counts),
    }
