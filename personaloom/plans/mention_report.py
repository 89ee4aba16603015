"""All mention statistics of a record table, from one stored feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from personaloom.operators import mentions, stats
from personaloom.operators.sampling import keep_first
from personaloom.sources.writers import write_per_type, write_table

PROFILE_COLUMNS = [
    "gender", "nationality", "job_title", "education_info", "locale", "marital_status",
    "finance_status",
]


def mention_report(
    records: DataFrame, folder: str, types: list[str], order: list[str]
) -> dict[str, DataFrame]:
    """Write features and mention details below `folder`; returns the statistics by name.

    Each statistic reads only its own columns of the stored features.
    """
    write_table(mentions.feature_rows(records), f"{folder}/features")
    features = records.sparkSession.read.parquet(f"{folder}/features")
    write_per_type(mentions.mention_details(features), f"{folder}/details")
    people = keep_first(
        features.select("unique_id", *order, *PROFILE_COLUMNS, "age", "net_worth_value", "annual_salary_value"),
        "unique_id",
        order,
    )
    return {
        "totals": stats.totals(features),
        "profile_values": stats.value_counts(people, PROFILE_COLUMNS),
        "profile_histograms": stats.histograms(
            people, {"age": 5, "net_worth_value": 50_000, "annual_salary_value": 10_000}
        ),
        "text_histograms": stats.histograms(
            features,
            {"synthetic_text_length": 50, "synthetic_word_count": 10, "num_mentioned_pii_fields": 1},
        ),
        "any_mention": stats.any_mention(features),
        "field_counts": stats.field_counts(features),
        "field_by_type": stats.field_by_type(features, types),
        "mention_rate": stats.mention_rate(features, "content_type"),
        "mentions_by_age": stats.mentions_by_age(features),
        "type_share_by_mention": stats.type_share_by_mention(features),
        "top_job_rates": stats.top_job_rates(features),
        "type_share_by_job": stats.type_share_by_job(features, types),
        "error_jobs": stats.error_jobs(features, order),
    }
