"""Joins against brute force, sampling and profile rules, independence of partitioning."""

import random
import time
from datetime import date

import pytest
from pyspark.sql import functions as F

from personaloom.operators import blocks, catalogue, contamination, pairing, profiles, prompts, relink, sampling
from personaloom.plans.bits import might_hold, wanted_bits
from personaloom.registry import fixtures as X

MASTER = [
    ("a", "The quick brown fox jumps over the lazy dog", 1),
    ("b", "THE QUICK BROWN FOX jumps over the lazy dog again and again", 2),
    ("c", "the quick", 3),
    ("d", "", 4),
    ("e", None, 5),
    ("f", "price is 5 (usd). really?", 6),
    ("g", "straße und straße", 7),
    ("h", "The quick brown fox jumps over the lazy dog", 8),
    ("i", "x", 9),
    ("k", "one  two\tthree\nfour five six seven eight nine", 10),
]
TEXTS = [
    "quick brown fox jumps over the", "The quick brown fox jumps over the lazy dog", "ick brown fox jum", "5 (usd)",
    "the quick and more words than that", "usd). really", "zebra", "", " ", "x marks", "STRASSE", "aße und", None, "a",
    "wo\tthree\nfour five si", "two three four", "again and again", "one two", "lazy dog again and again and again",
]


def brute_force():
    out = {}
    for t in TEXTS:
        if t is None:
            continue
        low = t.lower()
        hits = [
            (pos, i) for i, m, pos in MASTER
            if m is not None and (low in m.lower() or (m != "" and low.startswith(m.lower())))
        ]
        if hits:
            out[t] = min(hits)[1]
    return out


@pytest.mark.parametrize("lookup_rows", [1_000_000, 0])
def test_recovery_equals_brute_force(spark, lookup_rows):
    master = spark.createDataFrame(MASTER, "id string, text string, pos int")
    texts = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    got = relink.recover_ids(texts, master, lookup_rows=lookup_rows)
    assert {r["text"]: r["id"] for r in got.collect()} == brute_force()


def test_short_texts_with_one_inner_word_do_not_meet(spark):
    """4,000 texts around the same word: candidates follow the texts, not their square."""
    n = 4000
    texts = spark.range(n).selectExpr("cast(id as string) sid", "concat('left', id, ' the right', id) low")
    keyed, shapes = relink._needle_keys(texts)
    hosts = relink._host_keys(texts.selectExpr("concat('x ', low, ' y') low"), shapes).select("key")
    assert hosts.join(keyed, "key").count() <= 6 * n


def test_hosts_make_wanted_keys_only(spark):
    """Short texts of a hundred shapes: a host makes the keys that texts have, not one per word and shape."""
    pick = random.Random(7)
    ends = ["a", "be", "four", "eighteen"]
    texts = [" ".join([x, *(f"in{pick.randrange(90)}" for _ in range(k)), y]) for k in range(4) for x in ends for y in ends]
    needles = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "sid string, low string")
    keyed, shapes = relink._needle_keys(needles)
    assert len(shapes) > 50
    wanted = keyed.selectExpr("explode(concat(array(key), parts)) key").distinct()
    hosts = spark.createDataFrame([(i, f"w{i} x{t}z other words of no text {i}") for i, t in enumerate(texts)], "pos int, low string")
    made = relink._host_keys(hosts, shapes, wanted_bits(wanted, "key")).select("pos", "key").distinct()
    found = {(int(r["sid"]), r["pos"]) for r in made.join(keyed, "key").collect()}
    assert {(i, i) for i in range(len(texts))} <= found
    assert made.count() <= 6 * len(texts)


@pytest.mark.parametrize("lookup_rows", [1_000_000, 0])
def test_one_word_texts(spark, lookup_rows):
    """The first host by place, whatever words hold the text; hosts without a place are none; an empty text is in all."""
    master = [("9", "xab cd", 9), ("3", "q zABz", 3), ("n", "ab", None), ("3", "q zabz", 3), ("5", "\u00e9ab", 5), ("1", None, 1), ("4", "", 4)]
    texts = ["ab", "cd", "aB", "zz", "", "q", "d", None]
    m = spark.createDataFrame(master, "id string, text string, pos int")
    t = spark.createDataFrame([(x,) for x in texts], "text string")
    got = {r["text"]: r["id"] for r in relink.recover_ids(t, m, lookup_rows=lookup_rows).collect()}
    assert got == {"ab": "3", "aB": "3", "cd": "9", "": "3", "q": "3", "d": "9"}


@pytest.mark.parametrize("lookup_rows", [1_000_000, 0])
def test_recovery_with_hot_phrases(spark, lookup_rows):
    """A third of the master shares one opening, and so do the texts."""
    opening = "this notice was written for all of the people who read it "
    master = [(str(i), (opening if i % 3 == 0 else f"other {i} words here now ") + f"number {i} ends", i) for i in range(300)]
    texts = [opening + f"number {i} ends here" for i in range(0, 60, 2)] + [f"read it number {i} en" for i in range(50)]
    m = spark.createDataFrame(master, "id string, text string, pos int")
    t = spark.createDataFrame([(x,) for x in texts], "text string")
    got = {r["text"]: r["id"] for r in relink.recover_ids(t, m, lookup_rows=lookup_rows).collect()}
    want = {}
    for x in texts:
        hits = [(p, i) for i, h, p in master if x in h or x.startswith(h)]
        if hits:
            want[x] = min(hits)[1]
    assert got == want and want


def shuffled(spark, run):
    """Bytes that `run` writes to shuffles."""

    def total():
        found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    before = total()
    run()
    for _ in range(50):  # the listener follows the jobs
        time.sleep(0.1)
        now = total()
        if now == total() and now > before:
            break
    return now - before


def lines(rows):
    pick = random.Random(4)
    return [" ".join(f"w{pick.randrange(3000)}x" for _ in range(60)) for _ in range(rows)]


@pytest.mark.parametrize("lookup_rows", [1_000_000, 0])
def test_recovery_in_parts(spark, monkeypatch, lookup_rows):
    """A master that is searched part by part, with repeated and missing places, gives what one search gives."""
    monkeypatch.setattr(relink, "FIRST_ROWS", 2, raising=False)
    monkeypatch.setattr(relink, "GROWTH", 2, raising=False)
    pick = random.Random(11)
    master = [(f"m{i}", " ".join(f"a{pick.randrange(12)}b" for _ in range(pick.randrange(1, 14))), None if i % 11 == 5 else pick.randrange(60)) for i in range(90)]
    texts = {" ".join(h.split(" ")[a : a + n])[cut:] for _, h, _ in master for a in (0, 1, 3) for n in (1, 2, 3, 5, 9) for cut in (0, 1)} | {h + " tail" for _, h, _ in master}
    m = spark.createDataFrame(master, "id string, text string, pos int")
    t = spark.createDataFrame([(x,) for x in sorted(texts)], "text string")
    got = {r["text"]: r["id"] for r in relink.recover_ids(t, m, lookup_rows=lookup_rows).collect()}
    want = {}
    for x in texts:
        hits = [(p, i) for i, h, p in master if p is not None and (x in h or x.startswith(h))]
        if hits:
            want[x] = min(hits)[1]
    assert {x: got.get(x) for x in want} == want and all(got[x] is None for x in set(got) - set(want))


def test_common_short_texts_meet_few_hosts(spark, monkeypatch):
    """Texts that every host holds are found in the first hosts; the others' hits are not stored and moved."""
    monkeypatch.setattr(relink, "FIRST_ROWS", 50, raising=False)
    words = [f"word{i}" for i in range(30)]
    master = [(str(i), " ".join([*words, f"own{i}"]), i) for i in range(4000)]
    m = spark.createDataFrame(master, "id string, text string, pos int")
    t = spark.createDataFrame([(" ".join(words[a : a + n]),) for a in range(25) for n in (2, 3, 4)], "text string")
    got = []
    moved = shuffled(spark, lambda: got.extend(relink.recover_ids(t, m).collect()))
    assert len(got) == 75 and {r["id"] for r in got} == {"0"}
    assert moved < 1_500_000


def test_long_texts_are_moved_a_few_times(spark):
    """Without any broadcast a long text is moved to be told apart and to be given back, not once for each of its keys or openings."""
    texts = lines(3000)
    m = spark.createDataFrame([(str(i), x, i) for i, x in enumerate(texts)], "id string, text string, pos int")
    t = spark.createDataFrame([(x + " and more",) for x in texts], "text string")
    got = []
    moved = shuffled(spark, lambda: got.extend(relink.recover_ids(t, m, lookup_rows=0).collect()))
    assert len(got) == 3000
    assert moved < 5 * sum(map(len, texts))


def test_short_texts_do_not_move_the_master(spark):
    """One text of one word, whose keys are runs of characters, moves hardly more than texts of many words do."""
    texts = lines(4000)
    master = spark.createDataFrame([(str(i), t, i) for i, t in enumerate(texts)], "id string, text string, pos int").repartition(8)
    needles = [" ".join(t.split()[10:20]) for t in texts[:40]]

    def moved(more):
        t = spark.createDataFrame([(x,) for x in needles + more], "text string")
        return shuffled(spark, lambda: relink.recover_ids(t, master, lookup_rows=1000).collect())

    plain = moved([])
    assert moved(["2999x"]) < 1.5 * plain + 100_000


def test_shuffles_stay_below_the_master(spark):
    """Without any broadcast the join moves the rows that may match, not the master's word runs."""
    texts = lines(6000)
    size = sum(map(len, texts))
    master = spark.createDataFrame([(str(i), t, i) for i, t in enumerate(texts)], "id string, text string, pos int").repartition(8)
    base = shuffled(spark, lambda: master.write.format("noop").mode("overwrite").save())
    t = spark.createDataFrame([(" ".join(x.split()[10:20]),) for x in texts[:300]], "text string")
    got = []
    moved = shuffled(spark, lambda: got.extend(relink.recover_ids(t, master, lookup_rows=0).collect()))
    assert len(got) == 300
    # the fixture's own repartition runs once for each scan of the master
    assert moved - 5 * base < size


@pytest.mark.parametrize("lookup_rows", [1_000_000, 0])
def test_hot_keys_are_dealt_out(spark, lookup_rows):
    """Needles whose only key thousands of master texts hold, in shares of a few hits."""
    master = spark.createDataFrame([(str(i), f"say {i} the very same words here {i}", i) for i in range(500)], "id string, low string, pos int")
    needles = spark.createDataFrame([("a", "the very same words here"), ("b", "the very same words here 4"), ("c", "nothing of this")], "sid string, low string")
    found = relink._contained_in(needles, master, lookup_rows, hot_hits=7)
    got = sorted((r["sid"], r["pos"]) for r in found.collect())
    assert got == sorted([("a", i) for i in range(500)] + [("b", i) for i in range(500) if str(i).startswith("4")])


def test_bitmap_loses_nothing(spark):
    rows = spark.range(200_000).selectExpr("id", "xxhash64(id) key")
    wanted = rows.filter("id % 100 = 7").select("key")
    kept = might_hold(rows, "key", wanted)
    assert kept.join(wanted, "key").count() == 2000
    assert kept.count() < 2000 + 200_000 * 0.03
    assert might_hold(rows, "key", wanted.filter("false")).count() == 0


@pytest.mark.parametrize("lookup_rows", [1_000_000, 0])
def test_exact_link(spark, lookup_rows):
    subset = spark.createDataFrame([("t1",), ("t1",), (None,), ("zz",)], "text string")
    master = spark.createDataFrame([("1", "t1"), ("2", "t1"), ("3", None), ("4", "q")], "id string, text string")
    got = sorted(map(repr, (tuple(r) for r in relink.link_exact(subset, master, lookup_rows=lookup_rows).collect())))
    want = [("t1", "1"), ("t1", "1"), ("t1", "2"), ("t1", "2"), (None, "3"), ("zz", None)]
    assert got == sorted(map(repr, want))


@pytest.mark.parametrize("lookup_rows", [1_000_000, 0])
def test_relink(spark, lookup_rows):
    subset = spark.createDataFrame([("quick brown fox", "n"), ("quick brown fox", "n"), ("x", "m"), ("none", "m")], "text string, tag string")
    master = spark.createDataFrame(MASTER, "id string, text string, pos int")
    info = spark.createDataFrame([("a", "A"), ("i", "I")], "id string, complete_info string")
    got = relink.relink(subset, master, info, lookup_rows=lookup_rows).select("text", "tag", "id", "complete_info")
    assert sorted(map(tuple, got.collect())) == [("quick brown fox", "n", "a", "A"), ("x", "m", "i", "I")]


@pytest.mark.parametrize("parts", [1, 8, 60])
def test_same_result_for_any_partitioning(spark, sf_dir, parts):
    docs = spark.read.parquet(f"{sf_dir}/orders.parquet").repartition(parts)
    base = spark.read.parquet(f"{sf_dir}/orders.parquet")
    for n in (10, 1200):
        assert (
            sampling.shuffle_take(docs, "o_orderkey", n, 7).collect()
            == sampling.shuffle_take(base, "o_orderkey", n, 7).collect()
        )


def test_large_and_small_samples_agree(spark, sf_dir, monkeypatch):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("content_type")
    )
    types = ["1-URGENT", "2-HIGH", "5-LOW"]
    small = sampling.stratified_sample(rows, types, 100).collect()
    order = sampling.shuffle_take(rows, "id", 77, 3).collect()
    monkeypatch.setattr(sampling, "TOP_ROWS", 0)
    large = sampling.stratified_sample(rows, types, 100).collect()
    assert sorted(map(repr, small)) == sorted(map(repr, large)) and len(small) == 100
    assert sampling.shuffle_take(rows, "id", 77, 3).collect() == order


def test_quotas():
    assert sampling.quotas(["b", "a", "c"], 8) == {"a": 3, "b": 3, "c": 2}


def test_first_rows_are_cut_before_the_shuffle(spark, sf_dir):
    df = sampling.keep_first(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "role", ["conv_id", "turn"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_row_numbers_and_spans(spark):
    rows = spark.createDataFrame([(k * 7 - 50,) for k in range(500)], "k bigint").repartition(7)
    got = pairing.number_rows(rows, "k", buckets=13).orderBy("k").collect()
    assert [r["line_number"] for r in got] == list(range(1, 501))
    for first, last in ((1, 10), (38, 300), (200, None), (499, 600), (501, None)):
        keys = sorted(r["k"] for r in pairing.rows_between(rows, "k", first, last, buckets=13).collect())
        assert keys == [k * 7 - 50 for k in range(500)][first - 1 : last]


def test_clean_records_equal_the_join(spark, sf_dir):
    h = X.halves(spark, sf_dir)
    report = contamination.contamination_report(h, "doc_id")
    joined = contamination.drop_contaminated(h, report, "doc_id").select("doc_id").collect()
    assert sorted(joined) == sorted(contamination.keep_clean(h).select("doc_id").collect())


def test_model_entities_join_the_overlap(spark):
    records = spark.createDataFrame(
        [(1, "seed text", "passage text"), (2, "seed text", "passage text")],
        "id int, real_person_text_input string, generated_synthetic_passage string",
    )
    external = spark.createDataFrame(
        [(1, "real", "ORG", " Acme Ltd "), (1, "synthetic", "ORG", "acme"), (2, "real", "ORG", "Acme"), (2, "synthetic", "LOC", "Acme")],
        "id int, side string, type string, value string",
    )
    got = contamination.contamination_report(records, "id", external=external).collect()
    assert [(r["unique_id"], r["entity_type"], r["entity_value"]) for r in got] == [(1, "ORG", "Acme Ltd")]


def test_request_ids_are_stable(spark, sf_dir):
    base = spark.range(20).select("id", F.when(F.col("id") > 10, "x").otherwise("").alias("u"))
    ids = base.select(prompts.custom_id(F.when(F.col("u") == "x", F.col("id").cast("string")), F.col("id")))
    again = base.repartition(3).select(
        prompts.custom_id(F.when(F.col("u") == "x", F.col("id").cast("string")), F.col("id"))
    )
    assert sorted(ids.collect()) == sorted(again.collect())
    assert ids.distinct().count() == 20


def generate(spark, n=200, pools=None):
    rows = [
        (loc, kind, i, f"{kind}{i}") for loc, *_ in catalogue.LOCALES for i in range(4)
        for kind in ("male", "female", "last", "company", "company_suffix", "city", "address", "user", "tld")
    ]
    pool = spark.createDataFrame(rows, "locale string, kind string, ordinal bigint, value string")
    titles = spark.createDataFrame(
        [(0, "Cashier", 5.0, "Entry/Service"), (1, "Doctor", 5.0, "High Professional/Specialized"),
         (2, "Pilot", 50.0, "High Professional/Specialized"), (3, "Police Officer", 5.0, None),
         (4, "Consultant", 5.0, "Management/Executive")],
        "ord int, title string, weight double, tier string",
    )
    return profiles.generate_profiles(
        profiles.profile_keys(spark, n), pool, catalogue.job_catalogue(titles), date(2025, 4, 18)
    )


def test_profiles_keep_their_constraints(spark):
    people = generate(spark).cache()
    assert people.count() == 200 * len(catalogue.LOCALES)
    level = F.array_position(F.array(*[F.lit(e) for e in catalogue.EDUCATION[0]]), F.col("education_info")) - 1
    low_age = F.get(F.array(*[F.lit(a) for a in catalogue.EDUCATION_MIN_AGE]), level.cast("int"))
    broken = [
        ~F.col("age").between(18, 90),
        F.col("age") < low_age,
        (F.col("job_title") == "Doctor") & ((level < 8) | (F.col("age") < 25)),
        (F.col("job_title") == "Pilot") & ((level < 7) | (F.col("age") < 21)),
        (F.col("job_title") == "Consultant") & ((level < 3) | (F.col("age") < 25)),
        ~F.col("credit_score").between(300, 850),
        (F.col("marital_status") == "Single") & (F.col("spouse_name") != "N/A"),
        (F.col("age") < 20) & (F.col("children_count") > 0),
        F.col("job_title").isNull(),
        *[F.col(c).isNull() for c in profiles.PROFILE_FIELDS],
    ]
    counts = people.agg(*[F.count_if(b).alias(f"c{i}") for i, b in enumerate(broken)]).first()
    assert list(counts) == [0] * len(broken)
    assert people.select("unique_id").distinct().count() == people.count()
    people.unpersist()


@pytest.mark.parametrize("held", [0, 1000])
def test_large_pools_give_the_same_people(spark, monkeypatch, held):
    small = generate(spark, 20).collect()
    monkeypatch.setattr(profiles, "POOL_ROWS", 0)
    monkeypatch.setattr(profiles, "HELD_ROWS", held)
    assert sorted(generate(spark, 20).collect()) == sorted(small)


def test_all_draws_are_one_join(spark, monkeypatch):
    """Long lists are joined once, short ones travel whole; unknown locales and repeated and null keys draw alike."""
    rows = [("de", "last", i, f"n{i}") for i in range(50)] + [("de", "male", i, f"m{i}") for i in range(3)]
    pool = spark.createDataFrame(rows, "locale string, kind string, ordinal bigint, value string")
    keys = spark.createDataFrame([(i, "de") for i in range(40)] + [(3, "de"), (4, "xx"), (None, "de"), (5, None)], f"{profiles.KEY} long, locale string")

    def people():
        held = profiles._Pools(pool)
        out = held.draw_all(held.attach(keys), "_birth_name", "_spouse_last", "_father", "_user")
        return out.select(profiles.KEY, "locale", "_birth_name", "_spouse_last", "_father", "_user")

    small = sorted(map(repr, people().collect()))
    monkeypatch.setattr(profiles, "POOL_ROWS", 10)
    monkeypatch.setattr(profiles, "HELD_ROWS", 10)
    assert sorted(map(repr, people().collect())) == small and len(small) == 44
    assert people().filter("_birth_name is not null").count() == 41


@pytest.mark.parametrize("lookup", [0, 1000])
def test_jobs_are_drawn_by_intervals(spark, monkeypatch, lookup):
    """One heavy job, many light ones, several blocks of ordinals: equal to a walk along the running weights."""
    monkeypatch.setattr(profiles, "JOB_BLOCK", 7)
    monkeypatch.setattr(profiles, "JOB_ROWS", lookup)
    titles = [(i, f"t{i}", 500.0 if i == 20 else 0.25 * (1 + i % 5), i % 9, 18 + i % 3) for i in range(60)]
    jobs = spark.createDataFrame([(*t[:3], None, *t[3:]) for t in titles], "ord int, title string, weight double, tier string, required_level int, min_age int")
    people = [(i, i % 10, (18, 21, 25)[i % 3], i / 600) for i in range(600)] + [(600, None, 18, 0.5), (601, 3, 18, None)]
    frame = spark.createDataFrame(people, "id int, level int, band int, u double")
    got = {r["id"]: r["title"] for r in profiles.choose_jobs(frame, jobs, F.col("u")).select("id", "_job.title").collect()}
    for i, level, band, u in people:
        left = [(t, max(0.1, w * (0.01 if level - need >= 5 else 0.2 if level - need >= 3 else 1.0))) for _, t, w, need, age in titles if level is not None and level >= need and band >= age]
        point, want = (u or 0) * sum(w for _, w in left), None
        for t, w in left if u is not None else []:
            want, point = t, point - w
            if point < -1e-9:
                break
        if abs(point) > 1e-6 or want is None:  # a point on an edge may go either way by rounding
            assert got[i] == want
    assert len(got) == 602


def test_blocks_hold_no_bracket(spark, sf_dir):
    found = X.records(spark, sf_dir).select(F.inline(blocks.raw_blocks(F.col("model_output"))))
    assert found.filter(F.contains("Text", F.lit("[")) | (F.trim("Text") == "")).count() == 0


def test_repeats(spark):
    got = sampling.repeat_rows(spark.range(3), 25)
    assert got.count() == 75 and got.columns == ["id"]


@pytest.mark.parametrize("buckets", [None, 1, 13])
def test_positions_by_keys_of_any_type(spark, buckets):
    """Texts, and a text with a date and a null: numbers and spans equal those of a sorted list."""
    pick = random.Random(8)
    rows = [(f"k{pick.randrange(40)}", date(2020, 1, 1 + i % 28), i) for i in range(900)] + [(None, date(2020, 2, 1), -1)]
    pick.shuffle(rows)
    df = spark.createDataFrame(rows, "name string, day date, i int")
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2]))
    keys = ["name", "day", "i"]
    got = pairing.number_rows(df, keys, buckets=buckets).orderBy("line_number").collect()
    assert [(r["name"], r["day"], r["i"]) for r in got] == ordered
    assert [r["line_number"] for r in got] == list(range(1, 902))
    text = df.select(F.concat_ws("/", "name", "day", "i").alias("key"))
    by_text = sorted(r["key"] for r in text.collect())
    for first, last in ((1, 1), (1, 5), (0, 3), (400, 410), (890, None), (901, 901), (902, None), (5, 4), (1, None), (3, 5000)):
        want = ordered[max(first, 1) - 1 : last]
        assert sorted(map(repr, map(tuple, pairing.rows_between(df, keys, first, last, buckets).collect()))) == sorted(map(repr, want))
        assert sorted(r["key"] for r in pairing.rows_between(text, "key", first, last, buckets).collect()) == by_text[max(first, 1) - 1 : last]
