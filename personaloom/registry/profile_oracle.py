"""Check SQL of profile generation, for DuckDB."""

from __future__ import annotations

from personaloom.operators import catalogue as C
from personaloom.registry import fixtures as X

ASOF = "2025-04-18"


def u(salt: str) -> str:
    return f"(('0x' || substr(md5(profile_key || '|{salt}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def d(x) -> str:
    return f"({x})::DOUBLE"


def whole(salt: str, low: int, high: int) -> str:
    return f"({low} + floor({u(salt)} * {high - low + 1}))::BIGINT"


def between(salt: str, low: str, high: str) -> str:
    return f"({low} + {u(salt)} * ({high} - {low}))"


def choose(point: str, values: list, weights: list[str]) -> str:
    total = d(0)
    steps = []
    for w in weights:
        total = f"({total} + {d(w)})"
        steps.append(total)

    def lit(v):
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    arms = " ".join(f"WHEN {point} * {total} < {s} THEN {lit(v)}" for v, s in zip(values[:-1], steps[:-1]))
    return f"CASE {arms} ELSE {lit(values[-1])} END"


def fixed(salt: str, table: tuple[list, list]) -> str:
    return choose(u(salt), table[0], [str(w) for w in table[1]])


def even(salt: str, values: list[str]) -> str:
    return choose(u(salt), values, ["1"] * len(values))


def pool(kind: str, salt: str) -> str:
    return (
        f"(SELECT p.value FROM pools_n p WHERE p.locale = t.locale AND p.kind = {kind} "
        f"AND p.ordinal = floor({u(salt)} * p.n)::BIGINT)"
    )


def by_locale(place: int) -> str:
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else d(v)

    return "CASE locale " + " ".join(f"WHEN '{r[0]}' THEN {lit(r[place])}" for r in C.LOCALES) + " END"


def nth(which: str, values: list[str]) -> str:
    return f"CASE {which} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def money(amount: str) -> str:
    return f"(sign || regexp_replace(cast(cast({amount} AS DECIMAL(18,2)) AS VARCHAR), '0$', ''))"


def digits(salt: str, low: int, high: int) -> str:
    return (
        f"substr(lpad({whole(salt + '_a', 0, 999999999)}::VARCHAR, 9, '0') || "
        f"lpad({whole(salt + '_b', 0, 999)}::VARCHAR, 3, '0'), 1, {whole(salt + '_n', low, high)})"
    )


def phone(salt: str) -> str:
    return f"({by_locale(2)} || ' ' || {whole(salt, 100000000, 999999999)})"


_age_weights = [
    f"CASE WHEN age >= {low} THEN {w} ELSE 0 END" for w, low in zip(C.EDUCATION[1], C.EDUCATION_MIN_AGE)
]
_marital_weights = [
    "greatest(1.0::DOUBLE, CASE WHEN age < 22 THEN 52.5::DOUBLE WHEN age > 65 THEN 17.5::DOUBLE ELSE 35.0::DOUBLE END)",
    "greatest(1.0::DOUBLE, CASE WHEN age < 22 THEN 10.0::DOUBLE ELSE 50.0::DOUBLE END)",
    "greatest(1.0::DOUBLE, CASE WHEN age < 22 THEN 1.0::DOUBLE ELSE 10.0::DOUBLE END)",
    "greatest(1.0::DOUBLE, CASE WHEN age < 22 THEN 0.25::DOUBLE WHEN age > 65 THEN 15.0::DOUBLE ELSE 5.0::DOUBLE END)",
]


def _finance_weight(base: float, poor: float, modest: float, rich: float) -> str:
    return (
        f"greatest(0.1::DOUBLE, CASE WHEN place < 0.15::DOUBLE THEN {d(base * poor)} WHEN place < 0.4::DOUBLE THEN "
        f"{d(base * modest)} WHEN place > 0.75::DOUBLE THEN {d(base * rich)} ELSE {d(base)} END)"
    )


_finance_weights = [
    _finance_weight(5, 2.0, 1.0, 0.3), _finance_weight(20, 1.5, 1.5, 0.5), _finance_weight(40, 1.0, 1.2, 1.0),
    _finance_weight(25, 0.5, 1.0, 1.5), _finance_weight(10, 0.2, 0.5, 2.0),
]


def _by_finance(values: list) -> str:
    return "CASE finance_status " + " ".join(f"WHEN '{n}' THEN {v}" for n, v in zip(C.FINANCE[0], values)) + " END"


_first, _last = "split_part(lower(first_name), ' ', 1)", "string_split(lower(last_name), ' ')[-1]"
_email_formats = [
    f"{_first} || '.' || {_last}", f"{_first} || {_last}", f"substr({_first}, 1, 1) || {_last}",
    f"{_first} || '_' || {_last}", f"{_last} || {whole('email_two', 1, 99)}",
    f"{_first} || {whole('email_three', 100, 999)}", f"{_first} || '.' || {_last} || {whole('email_two', 1, 99)}",
]
_email_user = (
    f"CASE WHEN {u('email_opaque')} < 0.2::DOUBLE THEN {pool(chr(39) + 'user' + chr(39), '_user')} ELSE "
    f"regexp_replace({nth(whole('email_format', 0, 6), _email_formats)}, '[^a-z0-9._]', '', 'g') END"
)
_email_domain = "CASE locale " + " ".join(
    f"WHEN '{loc}' THEN {even('email_domain', names)}" for loc, names in C.EMAIL_DOMAINS.items()
) + " END"


def _handle(i: int) -> str:
    first, last = (rf"regexp_replace(lower({c}), '\s+', '', 'g')" for c in ("first_name", "last_name"))
    initial = f"substr({first}, 1, 1)"
    three, two = whole(f"handle_three{i}", 1, 999), whole(f"handle_two{i}", 1, 99)
    formal = [f"{first} || {last}", f"{first} || '.' || {last}", f"{initial} || {last}"]
    formats = [
        formal[0], formal[1], f"{first} || '_' || {last}", formal[2], f"{last} || {initial}",
        f"{first} || {three}", f"{last} || {three}", f"{first} || '_' || {two}", f"{last} || '_' || {two}",
    ]
    platform = fixed(f"platform{i}", C.PLATFORMS)
    name = (
        f"CASE WHEN {platform} = 'LinkedIn' AND {u(f'handle_pro{i}')} < 0.7::DOUBLE THEN "
        f"{nth(whole(f'handle_formal{i}', 0, 2), formal)} ELSE {nth(whole(f'handle_format{i}', 0, 8), formats)} END"
    )
    return (
        f"CASE WHEN {whole('platforms', 0, 4)} >= {i} THEN {{'p': {platform}, 'h': '@' || substr({name}, 1, 20)}} END"
    )


_quote = "CASE WHEN contains(h, chr(39)) THEN chr(34) ELSE chr(39) END"
_slots = "list_filter([" + ", ".join(_handle(i) for i in range(1, 5)) + "], lambda s: s IS NOT NULL)"
_named = "list_filter(names, lambda n, i: list_position(names, n) = i)"
_handle_of = "list_filter(slots, lambda s: s.p = n)[-1].h"
_handles = (
    f"'{{' || coalesce(array_to_string(list_transform({_named}, lambda n: chr(39) || n || chr(39) || ': ' || "
    + f"{_quote.replace('(h,', '(' + _handle_of + ',')} || {_handle_of} || {_quote.replace('(h,', '(' + _handle_of + ',')}"
    + "), ', '), '') || '}'"
)

_word = r"regexp_replace(regexp_extract(lower(employer), '^[^ ,.]*'), '[^\p{L}\p{N}]', '', 'g')"
_generic = ", ".join(f"'{w}'" for w in C.GENERIC_EMPLOYER_WORDS)
_own_domain = f"tier IS NOT NULL AND tier <> 'Entry/Service' AND length({_word}) > 3 AND {_word} NOT IN ({_generic})"
_mailbox = (
    f"CASE WHEN {_own_domain} THEN lower(substr(first_name, 1, 1)) || '.' || lower(last_name) || '@' || {_word} ELSE "
    f"{pool(chr(39) + 'user' + chr(39), '_user')} || '@' || regexp_replace(lower(company), '[^a-z0-9]', '', 'g') END"
)
_region = "split_part(locale, '_', 2)"
_kids = [str(i) for i in range(5)]
_stores = ", ".join(f"'{j}'" for j in C.STORE_JOBS)
_uid = "md5('profile|' || profile_key)"
_uuid = " || '-' || ".join(f"substr({_uid}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
_tier_case = (
    lambda i, other: "CASE tier " + " ".join(f"WHEN '{t[0]}' THEN {d(t[i])}" for t in C.TIERS) + f" ELSE {d(other)} END"
)

_steps = [
    ("pools", X.POOLS_SQL),
    ("pools_n", "SELECT *, count(*) OVER (PARTITION BY locale, kind) AS n FROM pools"),
    ("titles", X.TITLES_SQL),
    (
        "tiers",
        "SELECT * FROM (VALUES " + ", ".join(f"('{t}', {level}, {age})" for t, _, _, level, age in C.TIERS)
        + ") t(tier, required_level, min_age)",
    ),
    (
        "jobs",
        "SELECT ord, title, weight, t.tier, CASE WHEN t.tier IS NULL THEN 0 WHEN title = 'Doctor' THEN 8 ELSE "
        "required_level END AS required_level, CASE WHEN t.tier IS NULL THEN 18 WHEN title = 'Doctor' THEN 25 WHEN "
        "title = 'Pilot' THEN 21 ELSE min_age END AS min_age FROM titles t LEFT JOIN tiers USING (tier)",
    ),
    (
        "open_jobs",
        "SELECT level, band, ord, title, tier, sum(w) OVER (PARTITION BY level, band ORDER BY ord) AS upto, "
        "sum(w) OVER (PARTITION BY level, band ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM ("
        "SELECT *, greatest(0.1::DOUBLE, weight * CASE WHEN level - required_level >= 5 THEN 0.01::DOUBLE WHEN "
        "level - required_level >= 3 THEN 0.2::DOUBLE ELSE 1.0::DOUBLE END) AS w FROM jobs, range(10) l(level), "
        "(VALUES (18), (21), (25)) b(band) WHERE level >= required_level AND band >= min_age)",
    ),
    ("open_total", "SELECT level, band, max(upto) AS total FROM open_jobs GROUP BY 1, 2"),
    ("keys", X.KEYS_SQL),
    (
        "t1",
        f"SELECT *, {fixed('gender', C.GENDERS)} AS gender, (DATE '1934-04-18' + (1 + floor({u('birth')} * (DATE '2007-04-18' - DATE '1934-04-18')))::INTEGER)::DATE AS born "
        "FROM keys t",
    ),
    (
        "t2",
        "SELECT *, strftime(born, '%Y-%m-%d') AS birth_date, (2025 - year(born) - (month(born) * 100 + day(born) > 418)::INT)::INT "
        f"AS age, CASE gender WHEN 'Male' THEN 'male' WHEN 'Female' THEN 'female' ELSE {even('first_kind', ['male', 'female'])} END "
        "AS first_kind FROM t1",
    ),
    (
        "t3",
        f"SELECT *, {pool('t.first_kind', 'first_name')} AS first_name, {pool(chr(39) + 'last' + chr(39), 'last_name')} AS birth_name, "
        f"{pool(chr(39) + 'female' + chr(39), 'mother')} AS mother, {pool(chr(39) + 'male' + chr(39), 'father')} AS father, "
        f"{choose(u('education'), C.EDUCATION[0], _age_weights)} AS education_info, "
        f"{choose(u('marital'), C.MARITAL[0], _marital_weights)} AS marital_status, "
        f"{even('spouse_kind', ['male', 'female'])} AS spouse_kind, {even('helper_kind', ['male', 'female'])} AS helper_kind FROM t2 t",
    ),
    (
        "t4",
        f"SELECT *, {pool('t.spouse_kind', '_spouse_first')} AS spouse_first, "
        f"{pool(chr(39) + 'last' + chr(39), '_spouse_last')} AS spouse_last, "
        f"CASE WHEN age >= 25 THEN 25 WHEN age >= 21 THEN 21 ELSE 18 END AS band, list_position(["
        + ", ".join("'" + e.replace("'", "''") + "'" for e in C.EDUCATION[0]) + "], education_info) - 1 AS level, "
        f"{by_locale(3)} AS rate, {by_locale(1)} AS sign FROM t3 t",
    ),
    (
        "t5",
        "SELECT t.*, CASE WHEN marital_status = 'Married' THEN spouse_first || ' ' || spouse_last "
        f"WHEN marital_status = 'Widowed' AND {u('has_spouse')} < 0.7::DOUBLE THEN spouse_first || ' ' || spouse_last || ' (Deceased)' "
        f"WHEN marital_status = 'Divorced' AND {u('has_spouse')} < 0.6::DOUBLE THEN spouse_first || ' ' || spouse_last || ' (Ex)' "
        "ELSE 'N/A' END AS spouse_name, CASE WHEN gender = 'Female' AND marital_status = 'Married' AND "
        f"{u('takes_name')} < 0.8::DOUBLE THEN spouse_last ELSE birth_name END AS last_name, "
        f"CASE WHEN marital_status = 'Married' AND age > 20 THEN {choose(u('children'), [0, 1, 2, 3, 4], [str(w) for w in C.CHILDREN_MARRIED])} "
        f"WHEN marital_status IN ('Widowed', 'Divorced') AND age > 22 THEN {choose(u('children'), [0, 1, 2, 3, 4], [str(w) for w in C.CHILDREN_FORMER])} "
        "ELSE 0 END AS children_count, j.title AS job_title, j.tier AS tier FROM t4 t JOIN open_total o USING (level, band) "
        f"JOIN open_jobs j ON j.level = t.level AND j.band = t.band AND {u('job')} * o.total < j.upto AND "
        f"(j.below IS NULL OR {u('job')} * o.total >= j.below)",
    ),
    (
        "t6",
        f"SELECT *, floor({_tier_case(1, C.UNTIERED[0])} * rate * (0.8::DOUBLE + {u('salary_low')} * 0.4::DOUBLE)) AS low, "
        f"floor({_tier_case(2, C.UNTIERED[1])} * rate * (0.8::DOUBLE + {u('salary_high')} * 0.4::DOUBLE)) AS high FROM t5",
    ),
    (
        "t7",
        "SELECT *, cast(cast((low + " + u("salary") + " * (CASE WHEN high <= low THEN low + rate * 1000.0::DOUBLE ELSE high END - low)) "
        "* least(1.5::DOUBLE, 1.0::DOUBLE + (age - 18) / 40.0::DOUBLE) AS DECIMAL(18,2)) AS DOUBLE) AS full_pay FROM t6",
    ),
    (
        "t8",
        "SELECT *, CASE WHEN age < 21 THEN least(full_pay, rate * 60000.0::DOUBLE * (1.0::DOUBLE + "
        f"{u('salary_cap')} * 0.2::DOUBLE)) ELSE full_pay END AS pay FROM t7",
    ),
    (
        "t9",
        "SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (pay - rate * 10000.0::DOUBLE) / greatest(1.0::DOUBLE, "
        "rate * 300000.0::DOUBLE - rate * 10000.0::DOUBLE))) AS place FROM t8",
    ),
    ("t10", f"SELECT *, {choose(u('finance'), C.FINANCE[0], _finance_weights)} AS finance_status FROM t9"),
    (
        "t11",
        f"SELECT *, greatest(0.0::DOUBLE, pay * {between('savings_rate', d(0.02), d(0.15))} * (age - 18) * "
        f"{_by_finance([d(x) for x in C.NET_WORTH_FACTOR])} * {between('worth', d(0.5), d(1.5))}) + "
        f"{between('worth_noise', d(-5000), d(10000))} * rate AS worth, {pool(chr(39) + 'company' + chr(39), '_company')} AS company, "
        f"{pool(chr(39) + 'company_suffix' + chr(39), '_suffix')} AS suffix FROM t10 t",
    ),
    (
        "t12",
        f"SELECT *, CASE WHEN job_title IN ({_stores}) THEN suffix || ' Store' ELSE company END AS employer, {_slots} AS slots FROM t11",
    ),
    ("t13", "SELECT *, list_transform(slots, lambda s: s.p) AS names FROM t12"),
    (
        "profiles",
        f"SELECT profile_key, {_uuid} AS unique_id, locale, first_name, last_name, father || ' ' || birth_name AS fathers_name, "
        "mother || ' ' || birth_name AS mothers_name, gender, age, "
        f"{by_locale(4)} AS nationality, marital_status, spouse_name, children_count, CASE WHEN locale = 'en_US' THEN "
        f"{whole('ssn_a', 100, 999)} || '-' || {whole('ssn_b', 10, 99)} || '-' || {whole('ssn_c', 1000, 9999)} ELSE "
        f"{_region} || '-ID-' || {whole('national_id', 1000000, 9999999)} END AS national_id, "
        f"CASE WHEN {u('has_passport')} < 0.6::DOUBLE THEN substr(chr({whole('passport_x', 65, 90)}::INT) || "
        f"chr({whole('passport_y', 65, 90)}::INT), 1, {whole('passport_letters', 1, 2)}) || {digits('passport', 7, 9)} ELSE 'N/A' END "
        f"AS passport_number, CASE WHEN {u('has_licence')} < 0.85::DOUBLE THEN {_region} || '-DL-' || {digits('licence', 7, 12)} "
        f"ELSE 'N/A' END AS drivers_license, {phone('phone')} AS phone_number, CASE WHEN {u('has_work_phone')} < 0.7::DOUBLE THEN "
        f"{phone('work_phone')} ELSE 'N/A' END AS work_phone, replace({pool(chr(39) + 'address' + chr(39), '_address')}, chr(10), ', ') "
        f"AS address, {_email_user} || '@' || {_email_domain} AS email_address, {_mailbox} || '.' || "
        f"{pool(chr(39) + 'tld' + chr(39), '_tld')} AS work_email, birth_date, {pool(chr(39) + 'city' + chr(39), 'birth_city')} AS birth_city, "
        "education_info, finance_status, "
        + money(
            f"CASE WHEN age < 30 AND {u('young')} < 0.2::DOUBLE THEN greatest(worth, "
            f"{between('young_worth', 'rate * (-20000.0::DOUBLE)', 'rate * 5000.0::DOUBLE')}) ELSE worth END"
        )
        + " AS net_worth, employer, job_title, "
        + money("greatest(rate * 10000.0::DOUBLE, pay)")
        + f" AS annual_salary, greatest(300, least(850, {_by_finance(C.CREDIT_BASE)} + {whole('credit', -80, 80)} + "
        f"floor((age - 18) * 0.5)))::INT AS credit_score, {_handles} AS social_media_handles, {fixed('blood', C.BLOOD_TYPES)} AS blood_type, "
        f"{fixed('allergy', C.ALLERGIES)} AS allergies, {fixed('disability', C.DISABILITIES)} AS disability, "
        f"{pool('t.helper_kind', '_helper_first')} || ' ' || {pool(chr(39) + 'last' + chr(39), '_helper_last')} AS emergency_contact_name, "
        f"{phone('helper_phone')} AS emergency_contact_phone FROM t13 t",
    ),
]

PROFILE_SQL = "WITH " + ", ".join(f"{name} AS ({sql})" for name, sql in _steps)
