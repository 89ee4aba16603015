"""Synthetic profile generation: one row in, one consistent person out.

Every random value is a draw from md5(key, salt), so a profile depends on its
key only. Names, companies, streets and job titles come from the caller's
tables:

pools(locale, kind, ordinal, value): `ordinal` counts from 0 within locale and
kind. Kinds: male, female, last, company, company_suffix, city, address, user,
tld.

jobs: a catalogue made by catalogue.job_catalogue.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from personaloom.functions.draws import (
    pick,
    stable_uuid,
    uniform,
    uniform_between,
    weighted_choice,
    whole_between,
)
from personaloom.operators import catalogue as C
from personaloom.plans.lineage import fits

POOL_ROWS, POOL_BYTES = 500_000, 20_000_000
#: Longest list of one locale and kind that travels whole where the pools are larger than that.
HELD_ROWS, HELD_BYTES = 1_000, 100_000
#: Ordinals of the catalogue whose weights one task adds up.
JOB_BLOCK = 4096
#: Titles and their bytes that are broadcast; levels, bands and buckets repeat them 80 times at most.
JOB_ROWS, JOB_BYTES = 10_000, 1_000_000
MIN_AGE, MAX_AGE = 18, 90
KEY = "profile_key"

PROFILE_FIELDS = [
    "unique_id", "locale", "first_name", "last_name", "fathers_name", "mothers_name", "gender",
    "age", "nationality", "marital_status", "spouse_name", "children_count", "national_id",
    "passport_number", "drivers_license", "phone_number", "work_phone", "address",
    "email_address", "work_email", "birth_date", "birth_city", "education_info",
    "finance_status", "net_worth", "employer", "job_title", "annual_salary", "credit_score",
    "social_media_handles", "blood_type", "allergies", "disability", "emergency_contact_name",
    "emergency_contact_phone",
]


def profile_keys(spark: SparkSession, per_locale: int, locales: list[str] | None = None) -> DataFrame:
    """`per_locale` keys for each locale."""
    names = locales or [row[0] for row in C.LOCALES]
    place = F.floor(F.col("id") / F.lit(per_locale)).cast("int")
    rows = spark.range(per_locale * len(names))
    return rows.select(
        F.col("id").alias(KEY), F.get(F.array(*[F.lit(n) for n in names]), place).alias("locale")
    )


def pool_table(values: DataFrame) -> DataFrame:
    """Number the values of (locale, kind, value) within locale and kind, in alphabetical order."""
    w = Window.partitionBy("locale", "kind").orderBy("value")
    return values.select("locale", "kind", (F.row_number().over(w) - 1).alias("ordinal"), "value")


def _case(column: str, values: dict[str, str | int | float], other: float | None = None) -> Column:
    """Value by column content, as one parsed CASE expression."""

    def literal(v):
        return f"'{v}'" if isinstance(v, str) else f"{v}D" if isinstance(v, float) else str(v)

    arms = " ".join(f"WHEN '{k}' THEN {literal(v)}" for k, v in values.items())
    return F.expr(f"CASE {column} {arms} ELSE {'NULL' if other is None else literal(other)} END")


def _by_locale(place: int) -> Column:
    return _case("locale", {row[0]: row[place] for row in C.LOCALES})


def _by_tier(place: int) -> Column:
    values = {row[0]: float(row[place]) for row in C.TIERS}
    return _case("_tier", values, float(C.UNTIERED[place - 1]))


def _by_finance(values: list) -> Column:
    return _case("finance_status", dict(zip(C.FINANCE[0], values)))


def cents(x: Column) -> Column:
    """Round to two digits, as DECIMAL."""
    return x.cast("decimal(18,2)")


def money_text(sign: Column, amount: Column) -> Column:
    """Currency sign and number, with one digit after the dot at least."""
    return F.concat(sign, F.regexp_replace(cents(amount).cast("string"), "0$", ""))


def own_gender() -> Column:
    return weighted_choice(uniform(KEY, "gender"), *C.GENDERS)


def pool_draws() -> dict[str, tuple[Column, str]]:
    """Per drawn column its kind and its salt. Both follow from the key alone, so all draws can be made at once."""

    def either(salt: str) -> Column:
        return pick(uniform(KEY, salt), ["male", "female"])

    gender = own_gender()
    own = F.when(gender == "Male", "male").when(gender == "Female", "female").otherwise(either("first_kind"))
    plain = {
        "_company": "company", "_suffix": "company_suffix", "_tld": "tld", "_address": "address", "birth_city": "city",
        "_user": "user", "_helper_last": "last", "_spouse_last": "last",
    }
    return {
        "first_name": (own, "first_name"),
        "_birth_name": (F.lit("last"), "last_name"),
        "_mother": (F.lit("female"), "mother"),
        "_father": (F.lit("male"), "father"),
        "_spouse_first": (either("spouse_kind"), "_spouse_first"),
        "_helper_first": (either("helper_kind"), "_helper_first"),
        **{column: (F.lit(kind), column) for column, kind in plain.items()},
    }


class _Pools:
    """Draws values from the pool tables.

    Small pools travel as one broadcast row per locale, so a draw is an array look-up and a draw nobody reads
    costs nothing. Otherwise the lists of up to HELD_ROWS values travel like that, which many people share, and
    all draws from longer lists are made at once: rows (key, locale, column, kind, ordinal) join the pools in one
    join and come back as a row per key, before any other column of the profiles exists.
    """

    def __init__(self, pools: DataFrame):
        self.pools = pools
        self.small = fits(pools, POOL_ROWS, "value", POOL_BYTES)

    def attach(self, df: DataFrame) -> DataFrame:
        """Add what draw_all reads: _pools, kind to values, and where pools are large _drawn, column to value."""
        sized = self.pools.groupBy("locale", "kind").agg(
            (F.max("ordinal") + 1).alias("n"), F.sum(F.octet_length("value")).alias("bytes")
        )
        short = F.lit(True) if self.small else (F.col("n") <= HELD_ROWS) & (F.col("bytes") <= HELD_BYTES)
        ordered = F.array_sort(F.collect_list(F.struct("ordinal", "value")))
        lists = self.pools
        if not self.small:
            lists = lists.join(sized.filter(short).select("locale", "kind"), ["locale", "kind"], "left_semi")
        held = lists.groupBy("locale", "kind").agg(F.transform(ordered, lambda x: x["value"]).alias("held"))
        by_locale = held.groupBy("locale").agg(F.map_from_entries(F.collect_list(F.struct("kind", "held"))).alias("_pools"))
        side = F.broadcast if self.small or fits(held.select(F.explode("held").alias("v")), POOL_ROWS, "v", POOL_BYTES) else (lambda d: d)
        out = df.join(side(by_locale), "locale", "left")
        if self.small:
            return out
        long_lists = sized.filter(~short).groupBy("locale").agg(F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("_n"))
        return out.join(self._drawn(df, F.broadcast(long_lists)), [KEY, "locale"], "left")

    def _drawn(self, df: DataFrame, lengths: DataFrame) -> DataFrame:
        """KEY, locale and _drawn, a map from column to the value drawn from a long list."""
        draws = pool_draws()
        wanted = [
            F.struct(
                F.lit(column).alias("column"),
                kind.alias("kind"),
                F.floor(uniform(KEY, salt) * F.try_element_at("_n", kind)).alias("ordinal"),
            )
            for column, (kind, salt) in draws.items()
        ]
        asked = df.select(KEY, "locale").distinct().join(lengths, "locale")
        asked = asked.select(KEY, "locale", F.inline(F.filter(F.array(*wanted), lambda d: d["ordinal"].isNotNull())))
        values = self.pools.select("locale", "kind", F.col("ordinal").cast("bigint").alias("ordinal"), "value")
        found = asked.join(values, ["locale", "kind", "ordinal"])
        # one entry per column, as keys are distinct
        return found.groupBy(KEY, "locale").agg(F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias("_drawn"))

    def draw_all(self, df: DataFrame, *columns: str) -> DataFrame:
        """Add these columns of pool_draws()."""
        draws = pool_draws()
        return df.withColumns({c: self._look_up(c, *draws[c]) for c in columns})

    def _look_up(self, column: str, kind: Column, salt: str) -> Column:
        held = F.try_element_at("_pools", kind)
        value = F.get(held, F.floor(uniform(KEY, salt) * F.size(held)).cast("int"))
        return value if self.small else F.coalesce(F.try_element_at("_drawn", F.lit(column)), value)


def _years_before(day: date, years: int) -> date:
    try:
        return day.replace(year=day.year - years)
    except ValueError:  # 29 February
        return day.replace(year=day.year - years, day=28)


def add_person(df: DataFrame, pools: _Pools, asof: date) -> DataFrame:
    """Gender, names, birth date and age."""
    oldest, youngest = _years_before(asof, MAX_AGE + 1), _years_before(asof, MIN_AGE)
    span = (youngest - oldest).days
    born = F.date_add(F.lit(oldest), whole_between(KEY, "birth", 1, span).cast("int"))
    out = df.withColumns(
        {
            "gender": own_gender(),
            "_born": born,
        }
    )
    late = F.month("_born") * 100 + F.dayofmonth("_born") > asof.month * 100 + asof.day
    out = out.withColumns(
        {
            "birth_date": F.date_format("_born", "yyyy-MM-dd"),
            "age": (F.lit(asof.year) - F.year("_born") - F.when(late, 1).otherwise(0)).cast("int"),
        }
    ).drop("_born")
    out = pools.draw_all(out, "first_name", "_birth_name", "_mother", "_father")
    space = F.lit(" ")
    return out.withColumns(
        {
            "fathers_name": F.concat("_father", space, "_birth_name"),
            "mothers_name": F.concat("_mother", space, "_birth_name"),
        }
    ).drop("_father", "_mother")


def add_family(df: DataFrame, pools: _Pools) -> DataFrame:
    """Education, marital status, spouse, last name and children."""
    age = F.col("age")
    levels, weights = C.EDUCATION
    allowed = [
        F.when(age >= low, F.lit(float(w))).otherwise(0.0)
        for w, low in zip(weights, C.EDUCATION_MIN_AGE)
    ]
    young, old = age < 22, age > 65
    factors = {"Single": (1.5, 0.5), "Married": (0.2, 1.0), "Divorced": (0.1, 1.0), "Widowed": (0.05, 3.0)}
    marital_weights = [
        F.greatest(
            F.lit(1.0),
            F.when(young, w * factors[s][0]).when(old, w * factors[s][1]).otherwise(F.lit(float(w))),
        )
        for s, w in zip(*C.MARITAL)
    ]
    out = df.withColumns(
        {
            "education_info": weighted_choice(uniform(KEY, "education"), levels, allowed),
            "marital_status": weighted_choice(uniform(KEY, "marital"), C.MARITAL[0], marital_weights),
        }
    )
    status = F.col("marital_status")
    u = uniform(KEY, "has_spouse")
    known = (
        (status == "Married") | ((status == "Widowed") & (u < 0.7)) | ((status == "Divorced") & (u < 0.6))
    )
    out = pools.draw_all(out, "_spouse_first", "_spouse_last")
    suffix = F.when(status == "Widowed", " (Deceased)").when(status == "Divorced", " (Ex)").otherwise("")
    takes = (F.col("gender") == "Female") & (status == "Married") & (uniform(KEY, "takes_name") < 0.8)
    kids = list(range(5))
    married = weighted_choice(uniform(KEY, "children"), kids, C.CHILDREN_MARRIED)
    former = weighted_choice(uniform(KEY, "children"), kids, C.CHILDREN_FORMER)
    return out.withColumns(
        {
            "spouse_name": F.when(
                known, F.concat("_spouse_first", F.lit(" "), "_spouse_last", suffix)
            ).otherwise("N/A"),
            "last_name": F.when(takes, F.col("_spouse_last")).otherwise(F.col("_birth_name")),
            "children_count": F.when((status == "Married") & (age > 20), married)
            .when(status.isin("Widowed", "Divorced") & (age > 22), former)
            .otherwise(0),
        }
    ).drop("_spouse_first", "_spouse_last", "_birth_name")


def eligible_jobs(jobs: DataFrame) -> DataFrame:
    """Per education level and age band the open jobs: level, band, ord, title, tier, and their interval of weight.

    A job owns the points from `low` up to, not including, `upto`; intervals follow each other in order of
    `ord`. Bands start at the ages at which further jobs open. Over-qualified people get a lower weight: a fifth
    from 3 levels up, a hundredth from 5. Weights are added up in blocks of ordinals, and block after block.
    """
    top = len(C.EDUCATION[0]) - 1
    bands = sorted({MIN_AGE, *(row[4] for row in C.TIERS), C.MASTER_AGE, 21})
    open_bands = F.filter(
        F.array(*[F.lit(b) for b in bands]), lambda b: b >= F.col("min_age")
    )
    rows = jobs.withColumn(
        "level", F.explode(F.sequence(F.col("required_level"), F.lit(top)))
    ).withColumn("band", F.explode(open_bands))
    gap = F.col("level") - F.col("required_level")
    factor = F.when(gap >= 5, 0.01).when(gap >= 3, 0.2).otherwise(1.0)
    weighted = rows.withColumn("_w", F.greatest(F.lit(0.1), F.col("weight") * factor))
    block = ["level", "band", "_block"]
    inside = Window.partitionBy(block).orderBy("ord")
    sums = weighted.withColumn("_block", F.floor(F.col("ord") / JOB_BLOCK)).withColumn("_sum", F.sum("_w").over(inside))
    before = Window.partitionBy("level", "band").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.groupBy(block).agg(F.max("_sum").alias("_all"))
    starts = starts.select(*block, "_all", F.coalesce(F.sum("_all").over(before), F.lit(0.0)).alias("_start"))
    total = F.max(F.col("_start") + F.col("_all")).over(Window.partitionBy("level", "band"))
    placed = sums.withColumn("_below", F.coalesce(F.lag("_sum").over(inside), F.lit(0.0)))
    return placed.join(starts.select(*block, "_start", total.alias("total")), block).select(
        "level", "band", "ord", "title", "tier", "total",
        (F.col("_start") + F.col("_below")).alias("low"), (F.col("_start") + F.col("_sum")).alias("upto"),
    )


def choose_jobs(people: DataFrame, jobs: DataFrame, point: Column) -> DataFrame:
    """Add _job (title, tier), drawn by weight from the jobs open to each person's `level` and `band`.

    Intervals of weight are scaled to shares of the sum, from 0 to 1, and joined with the `point` that falls into
    them. That range is cut into as many equal buckets as there are jobs, so a person meets about two intervals,
    however long the catalogue. The intervals are broadcast where they are few. People without an open job get null.
    """
    size = jobs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("title")), F.lit(0)).alias("b")).first()
    buckets = max(1, size["n"])

    def bucket(x: Column) -> Column:
        return F.least(F.floor(x * buckets), F.lit(buckets - 1).cast("bigint"))

    shares = eligible_jobs(jobs).withColumns({"_low": F.col("low") / F.col("total"), "_upto": F.col("upto") / F.col("total")})
    spans = shares.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_low")), bucket(F.col("_upto")))))
    spans = spans.select("level", "band", "_bucket", "_low", "_upto", F.struct("title", "tier").alias("_job"))
    side = F.broadcast if size["n"] <= JOB_ROWS and size["b"] <= JOB_BYTES else (lambda d: d)
    aimed = people.withColumn("_point", point).withColumn("_bucket", bucket(F.col("_point"))).alias("p")
    met = [F.col(f"p.{c}") == F.col(f"s.{c}") for c in ("level", "band", "_bucket")]
    inside = (F.col("p._point") >= F.col("s._low")) & (F.col("p._point") < F.col("s._upto"))
    found = aimed.join(side(spans).alias("s"), [*met, inside], "left")
    return found.select(*[F.col(f"p.{c}") for c in people.columns], F.col("s._job"))


def add_work(df: DataFrame, jobs: DataFrame) -> DataFrame:
    """Job title, salary, finance status, net worth and credit score."""
    age = F.col("age")
    level = F.array_position(
        F.array(*[F.lit(e) for e in C.EDUCATION[0]]), F.col("education_info")
    ) - 1
    band = F.when(age >= 25, 25).when(age >= 21, 21).otherwise(MIN_AGE)
    out = choose_jobs(df.withColumns({"level": level.cast("int"), "band": band}), jobs, uniform(KEY, "job"))
    out = out.withColumns({"_rate": _by_locale(3), "_sign": _by_locale(1)}).drop("level", "band")
    out = out.withColumns({"job_title": F.col("_job.title"), "_tier": F.col("_job.tier")}).drop("_job")

    rate = F.col("_rate")
    low = F.floor(_by_tier(1) * rate * (F.lit(0.8) + uniform(KEY, "salary_low") * 0.4))
    high = F.floor(_by_tier(2) * rate * (F.lit(0.8) + uniform(KEY, "salary_high") * 0.4))
    out = out.withColumns({"_low": low.cast("double"), "_high": high.cast("double")})
    top = F.when(F.col("_high") <= F.col("_low"), F.col("_low") + rate * 1000.0).otherwise(F.col("_high"))
    experience = F.least(F.lit(1.5), F.lit(1.0) + (age - 18) / F.lit(40.0))
    pay = cents(uniform_between(KEY, "salary", F.col("_low"), top) * experience).cast("double")
    capped = F.least(pay, rate * 60000.0 * (F.lit(1.0) + uniform(KEY, "salary_cap") * 0.2))
    out = out.withColumn("_pay", F.when(age < 21, capped).otherwise(pay)).drop("_low", "_high")

    floor_pay = rate * 10000.0
    pay = F.col("_pay")
    place = (pay - floor_pay) / F.greatest(F.lit(1.0), rate * 300000.0 - floor_pay)
    out = out.withColumn("_place", F.greatest(F.lit(0.0), F.least(F.lit(1.0), place)))
    poor, modest, rich = F.col("_place") < 0.15, F.col("_place") < 0.4, F.col("_place") > 0.75
    factors = [(2.0, 1.0, 0.3), (1.5, 1.5, 0.5), (1.0, 1.2, 1.0), (0.5, 1.0, 1.5), (0.2, 0.5, 2.0)]
    finance_weights = [
        F.greatest(
            F.lit(0.1),
            F.when(poor, w * f[0]).when(modest, w * f[1]).when(rich, w * f[2]).otherwise(F.lit(float(w))),
        )
        for w, f in zip(C.FINANCE[1], factors)
    ]
    out = out.withColumn(
        "finance_status", weighted_choice(uniform(KEY, "finance"), C.FINANCE[0], finance_weights)
    )

    saved = pay * uniform_between(KEY, "savings_rate", 0.02, 0.15) * (age - 18)
    base = saved * _by_finance(C.NET_WORTH_FACTOR)
    noise = uniform_between(KEY, "worth_noise", -5000, 10000) * rate
    worth = F.greatest(F.lit(0.0), base * uniform_between(KEY, "worth", 0.5, 1.5)) + noise
    start = uniform_between(KEY, "young_worth", rate * -20000.0, rate * 5000.0)
    lucky = (age < 30) & (uniform(KEY, "young") < 0.2)
    score = (
        _by_finance(C.CREDIT_BASE)
        + whole_between(KEY, "credit", -80, 80)
        + F.floor((age - 18) * F.lit(0.5))
    )
    return out.withColumns(
        {
            "annual_salary": money_text(F.col("_sign"), F.greatest(floor_pay, pay)),
            "net_worth": money_text(
                F.col("_sign"), F.when(lucky, F.greatest(worth, start)).otherwise(worth)
            ),
            "credit_score": F.greatest(F.lit(300), F.least(F.lit(850), score)).cast("int"),
        }
    ).drop("_pay", "_place", "_rate", "_sign")


def _digits(salt: str, low: int, high: int) -> Column:
    """Between `low` and `high` digits, 12 at most."""
    nine = F.lpad(whole_between(KEY, f"{salt}_a", 0, 999_999_999).cast("string"), 9, "0")
    three = F.lpad(whole_between(KEY, f"{salt}_b", 0, 999).cast("string"), 3, "0")
    n = whole_between(KEY, f"{salt}_n", low, high).cast("int")
    return F.substr(F.concat(nine, three), F.lit(1), n)


def _phone(salt: str) -> Column:
    number = whole_between(KEY, salt, 100_000_000, 999_999_999).cast("string")
    return F.concat(_by_locale(2), F.lit(" "), number)


def _compact(name: str) -> Column:
    return F.regexp_replace(F.lower(name), r"\s+", "")


def email_address() -> Column:
    """One of seven name formats, or in a fifth of cases an opaque user name, at a local domain."""
    first = F.split_part(F.lower("first_name"), F.lit(" "), F.lit(1))
    last = F.split_part(F.lower("last_name"), F.lit(" "), F.lit(-1))
    two = whole_between(KEY, "email_two", 1, 99).cast("string")
    three = whole_between(KEY, "email_three", 100, 999).cast("string")
    formats = [
        F.concat(first, F.lit("."), last),
        F.concat(first, last),
        F.concat(F.substring(first, 1, 1), last),
        F.concat(first, F.lit("_"), last),
        F.concat(last, two),
        F.concat(first, three),
        F.concat(first, F.lit("."), last, two),
    ]
    which = whole_between(KEY, "email_format", 0, len(formats) - 1)
    named = F.regexp_replace(_nth(which, formats), "[^a-z0-9._]", "")
    user = F.when(uniform(KEY, "email_opaque") < 0.2, F.col("_user")).otherwise(named)
    u, domain = uniform(KEY, "email_domain"), None
    for locale, names in C.EMAIL_DOMAINS.items():
        hit, choice = F.col("locale") == locale, pick(u, names)
        domain = F.when(hit, choice) if domain is None else domain.when(hit, choice)
    return F.concat(user, F.lit("@"), domain)


def _nth(which: Column, values: list[Column]) -> Column:
    out = None
    for i, v in enumerate(values[:-1]):
        out = F.when(which == i, v) if out is None else out.when(which == i, v)
    return out.otherwise(values[-1])


def social_handle(slot: int) -> Column:
    """A handle made from the names, 20 characters at most, with a leading @.

    Reads the stored columns _first and _last (lower-case names without
    blanks) and _platform<slot>.
    """
    first, last = F.col("_first"), F.col("_last")
    initial, low, dot = F.substring(first, 1, 1), F.lit("_"), F.lit(".")
    three = whole_between(KEY, f"handle_three{slot}", 1, 999).cast("string")
    two = whole_between(KEY, f"handle_two{slot}", 1, 99).cast("string")
    formal = [F.concat(first, last), F.concat(first, dot, last), F.concat(initial, last)]
    formats = [
        formal[0],
        formal[1],
        F.concat(first, low, last),
        formal[2],
        F.concat(last, initial),
        F.concat(first, three),
        F.concat(last, three),
        F.concat(first, low, two),
        F.concat(last, low, two),
    ]
    anyone = _nth(whole_between(KEY, f"handle_format{slot}", 0, 8), formats)
    proper = _nth(whole_between(KEY, f"handle_formal{slot}", 0, 2), formal)
    linked_in = F.col(f"_platform{slot}") == "LinkedIn"
    formal_wanted = linked_in & (uniform(KEY, f"handle_pro{slot}") < 0.7)
    handle = F.when(formal_wanted, proper).otherwise(anyone)
    return F.concat(F.lit("@"), F.substring(handle, 1, 20))


def add_handles(df: DataFrame) -> DataFrame:
    """0 to 4 platforms drawn with replacement, as Python dict text; a repeated one keeps its last handle."""
    slots = range(1, 5)
    staged = df.withColumns(
        {
            "_first": _compact("first_name"),
            "_last": _compact("last_name"),
            **{
                f"_platform{i}": weighted_choice(uniform(KEY, f"platform{i}"), *C.PLATFORMS)
                for i in slots
            },
        }
    )
    n = whole_between(KEY, "platforms", 0, 4)
    pairs = [
        F.when(n >= i, F.struct(F.col(f"_platform{i}").alias("p"), social_handle(i).alias("h")))
        for i in slots
    ]
    staged = staged.withColumn("_handles", F.array_compact(F.array(*pairs)))
    held = F.col("_handles")

    def entry(name):
        handle = F.element_at(F.filter(held, lambda x: x["p"] == name), -1)["h"]
        mark = F.when(F.contains(handle, F.lit("'")), '"').otherwise("'")
        return F.concat(F.lit("'"), name, F.lit("': "), mark, handle, mark)

    names = F.array_distinct(F.transform(held, lambda x: x["p"]))
    text = F.concat(F.lit("{"), F.array_join(F.transform(names, entry), ", "), F.lit("}"))
    return staged.withColumn("social_media_handles", text).drop(
        "_first", "_last", "_handles", *[f"_platform{i}" for i in slots]
    )


def add_contacts(df: DataFrame, pools: _Pools) -> DataFrame:
    """Employer, addresses, phones, ids, handles, health and emergency contact."""
    out = add_handles(df)
    out = pools.draw_all(
        out, "_user", "_company", "_suffix", "_tld", "_address", "birth_city", "_helper_last", "_helper_first"
    )
    store = F.col("job_title").isin(C.STORE_JOBS)
    out = out.withColumn(
        "employer",
        F.when(store, F.concat("_suffix", F.lit(" Store"))).otherwise(F.col("_company")),
    )
    word = F.regexp_extract(F.lower("employer"), r"^[^ ,.]*", 0)
    word = F.regexp_replace(word, r"[^\p{L}\p{N}]", "")
    own_domain = (
        F.col("_tier").isNotNull()
        & (F.col("_tier") != C.TIERS[0][0])
        & (F.length(word) > 3)
        & ~word.isin(C.GENERIC_EMPLOYER_WORDS)
    )
    initial = F.lower(F.substring("first_name", 1, 1))
    personal = F.concat(initial, F.lit("."), F.lower("last_name"), F.lit("@"), word)
    general = F.concat("_user", F.lit("@"), alnum_lower("_company"))
    mailbox = F.when(own_domain, personal).otherwise(general)
    region = F.split_part("locale", F.lit("_"), F.lit(2))
    ssn = F.concat_ws(
        "-",
        whole_between(KEY, "ssn_a", 100, 999).cast("string"),
        whole_between(KEY, "ssn_b", 10, 99).cast("string"),
        whole_between(KEY, "ssn_c", 1000, 9999).cast("string"),
    )
    other_id = F.concat(
        region, F.lit("-ID-"), whole_between(KEY, "national_id", 1_000_000, 9_999_999).cast("string")
    )
    letters = F.substr(
        F.concat(_letter("passport_x"), _letter("passport_y")),
        F.lit(1),
        whole_between(KEY, "passport_letters", 1, 2).cast("int"),
    )
    passport = F.concat(letters, _digits("passport", 7, 9))
    licence = F.concat(region, F.lit("-DL-"), _digits("licence", 7, 12))
    out = out.withColumns(
        {
            "unique_id": stable_uuid("profile", F.col(KEY)),
            "nationality": _by_locale(4),
            "email_address": email_address(),
            "work_email": F.concat(mailbox, F.lit("."), "_tld"),
            "phone_number": _phone("phone"),
            "work_phone": F.when(uniform(KEY, "has_work_phone") < 0.7, _phone("work_phone")).otherwise("N/A"),
            "address": F.regexp_replace("_address", "\n", ", "),
            "national_id": F.when(F.col("locale") == "en_US", ssn).otherwise(other_id),
            "passport_number": F.when(uniform(KEY, "has_passport") < 0.6, passport).otherwise("N/A"),
            "drivers_license": F.when(uniform(KEY, "has_licence") < 0.85, licence).otherwise("N/A"),
            "blood_type": weighted_choice(uniform(KEY, "blood"), *C.BLOOD_TYPES),
            "allergies": weighted_choice(uniform(KEY, "allergy"), *C.ALLERGIES),
            "disability": weighted_choice(uniform(KEY, "disability"), *C.DISABILITIES),
            "emergency_contact_name": F.concat("_helper_first", F.lit(" "), "_helper_last"),
            "emergency_contact_phone": _phone("helper_phone"),
        }
    )
    return out.drop(
        "_user", "_company", "_suffix", "_tld", "_address", "_helper_last", "_helper_first", "_tier"
    )


def alnum_lower(name: str) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def _letter(salt: str) -> Column:
    return F.chr(whole_between(KEY, salt, 65, 90))


def generate_profiles(keys: DataFrame, pools: DataFrame, jobs: DataFrame, asof: date) -> DataFrame:
    """A full profile for every row of keys(profile_key, locale). Runs size checks of pools and jobs."""
    drawn = _Pools(pools)
    out = drawn.attach(keys)
    out = add_person(out, drawn, asof)
    out = add_family(out, drawn)
    out = add_work(out, jobs)
    out = add_contacts(out, drawn)
    return out.select(KEY, *PROFILE_FIELDS)


