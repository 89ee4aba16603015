"""MinHash near-duplicates against brute force."""

import random

import numpy as np
import pytest

from personaloom.llm import jaccard_join, minhash_dedup
from personaloom.llm.jaccard_join import Rule
from tests.llm.conftest import SOLID, words


def shingles(text, n=5):
    w = words(text, SOLID)
    return frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[i : i + n]) for i in range(len(w) - n + 1)])


def expected(rows, percent=85):
    return expected_of(rows, 5, percent)


def expected_of(rows, n, percent):
    """(doc_id, n_shingles, component_id, kept) of (doc_id, text) rows, comparing all pairs of different sets."""
    sets = [shingles(t, n) for _, t in rows]
    every = list(dict.fromkeys(s for s in sets if s))
    root = {s: s for s in every}

    def top(s):
        while root[s] != s:
            s = root[s]
        return s

    for i, a in enumerate(every):
        for b in every[i + 1 :]:
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                root[top(a)] = top(b)
    least = {}
    for (doc, _), s in zip(rows, sets, strict=True):
        if s and doc is not None:
            least[top(s)] = min(doc, least.get(top(s), doc))
    out = []
    for (doc, _), s in zip(rows, sets, strict=True):
        component = least.get(top(s)) if s else doc
        out.append((doc, len(s), component, doc == component))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def family(seed, texts, length, edits):
    """Texts that each differ from one text, or from the one before, in a few words."""
    pick = random.Random(seed)
    base = [f"w{pick.randrange(5000)}" for _ in range(length)]
    out = []
    for i in range(texts):
        own = list(base)
        for _ in range(pick.randrange(edits + 1)):
            own[pick.randrange(length)] = f"e{i}x{pick.randrange(100)}"
        if i % 7 == 0:
            base = own
        out.append(" ".join(own))
    return out


def test_dedup_equals_brute_force(spark, odd, odd_rows, none):
    got = minhash_dedup.near_duplicates(odd)
    assert ordered(got.collect()) == ordered(expected(odd_rows))
    assert minhash_dedup.near_duplicates(none).count() == 0


def test_families_of_near_copies(spark):
    """Chains and stars around the threshold: every link between different texts is found."""
    texts = [t for k in range(6) for t in family(k, 40, 60 + 40 * k, 2 + k)]
    rows = [(None if i % 50 == 0 else i, t) for i, t in enumerate(texts)] + [(i, t) for i, t in enumerate(texts[:30])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert ordered(minhash_dedup.near_duplicates(docs).collect()) == ordered(expected(rows))


def test_many_rows_without_ids(spark):
    """Thousands of rows without ids and of one id: their texts meet by digest, not by id."""
    rows = [(None, f"copy {i % 1500} " + " ".join(f"x{i % 1500}y{k}" for k in range(30))) for i in range(4000)]
    rows += [(3, "same " * 3 + "words in all of these rows") for _ in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash_dedup.near_duplicates(docs)
    assert got.filter("doc_id is null").count() == 4000
    assert [tuple(r) for r in got.filter("doc_id = 3").distinct().collect()] == [(3, 5, 3, True)]
    assert [r["doc_id"] for r in minhash_dedup.deduplicated(docs).collect() if r["doc_id"] is not None] == [3]


@pytest.mark.parametrize("similarity", [0.85, 0.9])
def test_share_of_pairs_that_meet(similarity):
    """Pairs of sets of one similarity share a table about as often as the docstring's formula says."""
    pick = np.random.default_rng(5)
    size, trials, met = 400, 300, 0
    common = round(size * 2 * similarity / (1 + similarity))
    for _ in range(trials):
        values = pick.integers(0, 1 << 63, 2 * size - common, dtype=np.uint64)
        both = np.concatenate([values[:size], values[size - common :]])
        a, b = minhash_dedup.half_keys(both, np.array([0, size]))
        same = a == b
        met += same[: minhash_dedup.HALVES].any() and same[minhash_dedup.HALVES :].any()
    assert met / trials >= 0.99


def test_rule_of_other_widths(spark):
    texts = family(9, 30, 80, 6)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = minhash_dedup.near_duplicates(docs, Rule(n=5, percent=95)).collect()
    assert ordered(got) == ordered(expected(list(enumerate(texts)), percent=95))


def test_jaccard_join_of_rows_without_ids(spark):
    """Thousands of rows without ids or of one id: sets are fetched by text, not by id."""
    rows = [(None, f"copy {i % 900} " + " ".join(f"x{i % 900 // 2}y{k}" for k in range(60))) for i in range(2500)]
    rows += [(3, "same " * 3 + "words in all of these rows") for _ in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.similarity_components(docs, Rule(n=3, percent=90))
    want = [(d, n, c) for d, n, c, _ in expected_of(rows, 3, 90)]
    assert ordered(got.collect()) == ordered(want)


def test_fine_parity_is_a_lower_bound(spark):
    """Of sets of any two sizes; close to the truth where the sets are alike."""
    rng = np.random.default_rng(3)
    rows = []
    for n, drop, add in [(1, 0, 0), (1, 1, 1), (64, 0, 1), (65, 5, 0), (1000, 40, 60), (1030, 60, 0), (4000, 600, 600), (300, 299, 0), (5000, 0, 9000)]:
        a = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 62, add, dtype=np.uint64)]))
        if len(b):
            apart = len(np.setxor1d(a, b))
            rows.append((len(a), len(b), apart, jaccard_join.fine_parity(a).tolist(), jaccard_join.fine_parity(b).tolist()))
    frame = spark.createDataFrame(rows, "n int, m int, apart int, x array<bigint>, y array<bigint>")
    for r in frame.withColumn("bits", jaccard_join.fine_apart("x", "y")).collect():
        assert len(r["x"]) * 64 >= r["n"] and r["bits"] <= r["apart"]
        if r["apart"] <= 0.12 * r["n"]:
            assert r["bits"] >= 0.75 * r["apart"]


def test_jaccard_join_passes_short_batches(spark, monkeypatch):
    """Batches of the join's jobs are short, whatever the session says, and the session keeps its own setting."""
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    levels = jaccard_join.frequency_levels
    monkeypatch.setattr(jaccard_join, "frequency_levels", lambda docs, rule: seen.append(int(spark.conf.get(name))) or levels(docs, rule))
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c d")], "doc_id bigint, text string")
    before = spark.conf.get(name)
    assert {r["component_id"] for r in jaccard_join.similarity_components(docs).collect()} == {1}
    assert seen == [2000] and spark.conf.get(name) == before
