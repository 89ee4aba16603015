"""Corpus and mention statistics. All of them aggregate before any window or join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from personaloom.functions.rows import explode_once
from personaloom.operators.sampling import keep_first, top_values

# Lower edges of the age bands and their labels.
AGE_EDGES = [0, 18, 30, 45, 60, 75]
AGE_LABELS = ["0-18", "19-30", "31-45", "46-60", "61-75", "75+"]
TOP_N = 15
TOP_JOBS_STACKED = 8


def content_type_stats(records: DataFrame, pairs: str = "content_pairs") -> DataFrame:
    """Per content type: count, total and average length, and count per 100 records.

    Each record adds one marker row, so the record count comes from the same
    scan and the same aggregate. Pairs without a type are left out.
    """
    none = F.expr("cast(array() as array<struct<t:string,n:int,record:boolean>>)")
    lengths = F.transform(
        F.col(pairs),
        lambda p: F.struct(p["ContentType"].alias("t"), F.length(p["Text"]).alias("n"), F.lit(False).alias("record")),
    )
    marker = F.array(F.struct(F.lit(None).cast("string").alias("t"), F.lit(0).alias("n"), F.lit(True).alias("record")))
    items = records.select(F.inline(F.concat(marker, F.coalesce(lengths, none))))
    sums = items.groupBy("t", "record").agg(
        F.count(F.lit(1)).alias("count"), F.sum("n").alias("total_length")
    )
    everything = Window.partitionBy()  # one row per content type
    n_records = F.max(F.when(F.col("record"), F.col("count"))).over(everything)
    return (
        sums.withColumn("_records", n_records)
        .filter(F.col("t").isNotNull() & ~F.col("record"))
        .select(
            F.col("t").alias("content_type"),
            "count",
            "total_length",
            (F.col("total_length") / F.col("count")).alias("average_length"),
            (F.col("count") / F.col("_records") * 100).alias("percentage_of_records"),
        )
    )


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, count) of several columns in one scan; nulls are left out."""
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value"))
            for c in columns
        ]
    )
    long = df.select(F.inline(pairs)).filter(F.col("value").isNotNull())
    return long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("count"))


def histograms(df: DataFrame, widths: dict[str, float]) -> DataFrame:
    """(field, bin_start, count) with fixed-width bins from 0, for several columns in one scan."""
    pairs = F.array(
        *[
            F.struct(
                F.lit(c).alias("field"),
                (F.floor(F.col(c) / F.lit(float(w))) * F.lit(float(w))).alias("bin_start"),
            )
            for c, w in widths.items()
        ]
    )
    long = df.select(F.inline(pairs)).filter(F.col("bin_start").isNotNull())
    return long.groupBy("field", "bin_start").agg(F.count(F.lit(1)).alias("count"))


def totals(features: DataFrame, id_col: str = "unique_id") -> DataFrame:
    """Texts, profiles, texts per profile and texts of failed records."""
    return features.agg(
        F.count(F.lit(1)).alias("texts"),
        F.count_distinct(F.col(id_col)).alias("profiles"),
        F.count_if("generation_error").alias("error_texts"),
    ).withColumn(
        "texts_per_profile",
        F.when(F.col("profiles") > 0, F.col("texts") / F.col("profiles")),
    )


def any_mention(features: DataFrame) -> DataFrame:
    """Texts with at least one mention, as count and percentage."""
    flag = F.col("any_pii_mentioned").cast("int")
    return features.agg(
        F.sum(flag).alias("texts_with_pii"), (F.avg(flag) * 100).alias("percentage")
    )


def field_counts(features: DataFrame, n: int | None = TOP_N) -> DataFrame:
    """How many texts mention each field, most frequent first."""
    fields = explode_once(features, "mentioned_pii_fields", [], "field")
    return top_values(fields, "field", n)


def field_by_type(features: DataFrame, types: list[str]) -> DataFrame:
    """Fields as rows, content types as columns, mention counts as cells, 0 where there is none."""
    fields = explode_once(features, "mentioned_pii_fields", ["content_type"], "field")
    counts = [F.count_if(F.col("content_type") == t).alias(t) for t in types]
    return fields.groupBy("field").agg(*counts)


def mention_rate(features: DataFrame, by: str) -> DataFrame:
    """Percentage of texts with a mention per value of a column."""
    rate = F.avg(F.col("any_pii_mentioned").cast("int")) * 100
    return features.filter(F.col(by).isNotNull()).groupBy(by).agg(rate.alias("percentage"))


def age_band(age: Column, max_age: Column) -> Column:
    """Label of the left-closed age band; bands beyond the highest age are folded into the last one."""
    def edges_up_to(x: Column) -> Column:
        return sum((F.when(x >= e, 1).otherwise(0) for e in AGE_EDGES[1:]), F.lit(0))

    bands = F.when(max_age >= 75, F.lit(6)).otherwise(edges_up_to(max_age + 1))
    place = F.least(edges_up_to(age), F.greatest(bands - F.lit(1), F.lit(0)))
    label = F.get(F.array(*[F.lit(x) for x in AGE_LABELS]), place)
    return F.when(age >= 0, label)


def mentions_by_age(features: DataFrame, age: str = "age") -> DataFrame:
    """Mean number of mentioned fields per age band."""
    per_age = features.filter(F.col(age).isNotNull()).groupBy(age).agg(
        F.sum("num_mentioned_pii_fields").alias("_sum"), F.count(F.lit(1)).alias("_n")
    )
    oldest = F.max(age).over(Window.partitionBy())  # one row per age in years
    banded = per_age.withColumn("age_group", age_band(F.col(age), oldest))
    return (
        banded.filter(F.col("age_group").isNotNull())
        .groupBy("age_group")
        .agg((F.sum("_sum") / F.sum("_n")).alias("avg_num_mentioned"))
    )


def type_share_by_mention(features: DataFrame, n: int = TOP_N) -> DataFrame:
    """Share of each content type among texts with and without mentions, for the top `n` types.

    Shares are taken over all types before the top ones are picked.
    """
    counts = features.filter(F.col("content_type").isNotNull()).groupBy(
        "any_pii_mentioned", "content_type"
    ).agg(F.count(F.lit(1)).alias("_n"))
    within = Window.partitionBy("any_pii_mentioned")  # one row per content type
    shares = counts.withColumn("percentage", F.col("_n") * 100 / F.sum("_n").over(within))
    top = (
        counts.groupBy("content_type")
        .agg(F.sum("_n").alias("_all"))
        .orderBy(F.desc("_all"), "content_type")
        .limit(n)
    )
    return shares.join(F.broadcast(top.select("content_type")), "content_type", "left_semi").drop("_n")


def top_job_rates(features: DataFrame, n: int = TOP_N, job: str = "job_title") -> DataFrame:
    """Mention rate of the `n` most frequent job titles."""
    flag = F.col("any_pii_mentioned").cast("int")
    per_job = features.filter(F.col(job).isNotNull()).groupBy(job).agg(
        F.count(F.lit(1)).alias("_n"), (F.avg(flag) * 100).alias("percentage")
    )
    return per_job.orderBy(F.desc("_n"), job).limit(n).drop("_n")


def top_jobs(features: DataFrame, n: int, job: str = "job_title") -> DataFrame:
    """The `n` most frequent job titles."""
    return top_values(features, job, n).select(job)


def rows_of_top_jobs(features: DataFrame, n: int, job: str = "job_title") -> DataFrame:
    """Rows of the `n` most frequent job titles; the list of titles has `n` rows at most."""
    return features.join(F.broadcast(top_jobs(features, n, job)), job, "left_semi")


def type_share_by_job(
    features: DataFrame, types: list[str], n: int = TOP_JOBS_STACKED, job: str = "job_title"
) -> DataFrame:
    """Content-type shares of the `n` most frequent job titles, one column per type, 0-filled."""
    shares = [
        (F.count_if(F.col("content_type") == t) * 100 / F.count("content_type")).alias(t)
        for t in types
    ]
    per_job = features.filter(F.col(job).isNotNull()).groupBy(job).agg(
        F.count(F.lit(1)).alias("_n"), *shares
    )
    return per_job.orderBy(F.desc("_n"), job).limit(n).drop("_n")


def profiles_with_errors(features: DataFrame, order: list[str], id_col: str = "unique_id") -> DataFrame:
    """One row per profile that has texts of failed records."""
    return keep_first(features.filter("generation_error"), id_col, order)


def error_jobs(features: DataFrame, order: list[str], n: int = TOP_N) -> DataFrame:
    """Job titles of the profiles with errors, most frequent first."""
    return top_values(profiles_with_errors(features, order), "job_title", n)


def education_job_flow(profiles: DataFrame, jobs: DataFrame) -> DataFrame:
    """(source, target, value): shares in percent of education -> tier and tier -> job title.

    `jobs` is the job catalogue (title, tier); titles without a tier count as 'Untiered'.
    """
    pairs = profiles.filter(F.col("job_title").isNotNull()).groupBy("education_info", "job_title").agg(
        F.count(F.lit(1)).alias("_n")
    )
    titles = jobs.select(F.col("title").alias("job_title"), "tier")
    tiered = pairs.join(titles, "job_title", "left").withColumn(
        "tier", F.coalesce("tier", F.lit("Untiered"))
    )
    flows = F.array(
        F.struct(F.col("education_info").alias("source"), F.col("tier").alias("target")),
        F.struct(F.col("tier").alias("source"), F.col("job_title").alias("target")),
    )
    long = tiered.select("_n", F.posexplode(flows).alias("_stage", "_flow")).select(
        "_n", "_stage", "_flow.*"
    )
    summed = long.groupBy("_stage", "source", "target").agg(F.sum("_n").alias("_n"))
    stage = Window.partitionBy("_stage")  # one row per link of the flow
    return summed.withColumn("value", F.col("_n") * 100 / F.sum("_n").over(stage)).select(
        "source", "target", "value"
    )
