"""Operators on document texts against brute force, on odd rows, and on empty tables."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from personaloom.llm import decontaminate, edit_counts, jaccard_join, license_scan, quality, token_store, wordhash
from personaloom.llm.components import components
from personaloom.llm.pretokens import PieceEncoder
from personaloom.llm.storage import shared_folder
from tests.llm.conftest import ALNUM, SOLID, words


def test_word_arrays_equal_regular_expressions(odd_rows):
    texts = [t for _, t in odd_rows]
    for mask, pattern in ((wordhash.ALNUM, ALNUM), (wordhash.NON_SPACE, SOLID)):
        found = wordhash.words_of(pa.array(texts), mask)
        for r, text in enumerate(texts):
            got = [found.bytes_of(i).decode() for i in range(found.first[r], found.first[r + 1])]
            assert got == words(text, pattern)
        by_word = {}
        for i, h in enumerate(found.hash.tolist()):
            assert by_word.setdefault(h, found.bytes_of(i)) == found.bytes_of(i)


# --- tokens ------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.sampled_from(list("ab1 '\n\tsrevlmd.,!é日　🙂<|>")), max_size=40), max_size=6))
def test_pieces_equal_the_library(tokenizer, texts):
    pieces = _encoder(tokenizer)
    ids, counts = pieces.encode(pa.array([*texts, "x<|endoftext|> y"], pa.string()))
    at = 0
    for text, n in zip([*texts, "x<|endoftext|> y"], counts.tolist(), strict=True):
        assert ids[at : at + n].tolist() == pieces.tokenizer.encode(text, add_special_tokens=False).ids
        at += n


_KEPT = {}


def _encoder(path):
    return _KEPT.setdefault(path, PieceEncoder(path, limit=300))  # a small limit: the cache starts anew often


def test_token_store(spark, odd, odd_rows, none, tokenizer):
    path = shared_folder(spark)
    token_store.write_token_ids(odd, path, tokenizer, end_id=2)
    got = sorted(map(tuple, token_store.document_spans(spark, path).collect()), key=lambda r: r[1])
    plain = PieceEncoder(tokenizer).tokenizer
    ids = [(d, [*plain.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in odd_rows]
    digest = [(d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in ids]
    assert Counter((d, n, c) for d, _, n, c in got) == Counter(digest)
    keys = [-1 if d is None else d for d, *_ in got]
    assert keys == sorted(keys)
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    one = token_store.read_token_ids(spark, path, where=F.col("doc_id") == 12).collect()
    assert [r["ids"] for r in one] == [x for d, x in ids if d == 12]
    empty = shared_folder(spark)
    token_store.write_token_ids(none, empty, tokenizer)
    assert token_store.document_spans(spark, empty).count() == 0


def test_token_look_up_reaches_the_files(spark, odd, tokenizer):
    path = shared_folder(spark)
    token_store.write_token_ids(odd, path, tokenizer)
    rows = token_store.read_token_ids(spark, path)
    plan = rows.filter("doc_id = 12").select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,12)" in plan and "ids" not in plan.split("ReadSchema")[1]


@settings(max_examples=50, deadline=None)
@given(
    text=st.text(alphabet=st.sampled_from(list("ab1 '\n\tsre.é日")), max_size=300),
    picks=st.lists(st.tuples(st.integers(0, 300), st.integers(0, 9), st.text(alphabet=st.sampled_from(list("ab '\n.")), max_size=8)), max_size=5),
)
def test_edits_equal_a_new_count(tokenizer, text, picks):
    pieces, edits, at = _encoder(tokenizer), [], 0
    for start, size, new in sorted(picks):
        start = min(max(start, at), len(text))
        at = min(start + size, len(text))
        edits.append({"start": start, "end": at, "replacement": new})
    chars, tokens = next(edit_counts.build(pieces, pa.array([text])))
    for _ in range(2):  # the second time on the changed tree
        new = edit_counts.spliced(text, 0, len(text), sorted(edits, key=lambda e: (e["start"], e["end"])))
        edit_counts.apply(pieces, text, chars, tokens, edits)
        starts, piece = pieces.pieces(new, np.zeros(1, np.int64)) if new else ([], np.empty(0, np.int64))
        assert int(tokens[1]) == int(pieces.length[piece].sum()) and int(chars[1]) == len(new)
        for tree in (chars, tokens):
            assert all(tree[i] == tree[2 * i] + tree[2 * i + 1] for i in range(1, len(tree) // 2))
        text, edits = new, [{"start": len(new) // 2, "end": len(new) // 2, "replacement": "'s b"}]


def test_edit_counts(odd, odd_rows, none, tokenizer):
    def run(docs):
        grown = edit_counts.with_trees(docs, tokenizer)
        return edit_counts.apply_edits(edit_counts.with_personal_edits(grown), tokenizer)

    got = run(odd).collect()
    plain = PieceEncoder(tokenizer).tokenizer
    plain.encode_special_tokens = True
    want = []
    for d, t in odd_rows:
        new, n = edit_counts.PERSONAL.subn("[removed]", t or "")
        count = [len(plain.encode(x, add_special_tokens=False).ids) for x in (t or "", new)]
        want.append((d, new if t is not None else None, count[0], n, count[1]))
    assert Counter((r.doc_id, r.text, r.n_tokens, r.n_edits, r.n_tokens_edited) for r in got) == Counter(want)
    mail = next(r for r in got if r.doc_id == 12)
    assert mail.n_edits == 2 and 0 < mail.n_encoded
    assert run(none).count() == 0


# --- benchmark passages ------------------------------------------------------------------------


def _contamination(rows, items):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows.setdefault((n, tuple(w[k : k + n])), set()).add(str(i) if i is not None else None)
    out = []
    for d, t in rows:
        w, hit, names = words(t), set(), set()
        for (n, x), owners in windows.items():
            for k in range(len(w) - n + 1):
                if w[k] == x[0] and tuple(w[k : k + n]) == x:
                    hit.update(range(k, k + n))
                    names |= owners - {None}
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(names), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


@pytest.fixture(scope="module")
def items(spark):
    passage = " ".join(f"t{i}" for i in range(30, 50))
    rows = [(1, passage), (2, "two WORDS"), (3, None), (4, "..."), (5, "É日本語"), (5, "É日本語"), (None, "t100 t101"), (6, " ".join(f"T{i}" for i in range(40, 60)))]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], "item_id long, text string, n_words string")


@pytest.mark.parametrize("block_bytes", [32_000_000, 150])
def test_contamination(odd, odd_rows, items, none, block_bytes):
    rows, benchmark = items
    found = decontaminate.scan(odd.select("doc_id", "text"), benchmark, block_bytes=block_bytes)
    got = found.select("doc_id", "n_words", decontaminate.hit_words().alias("n"), "hit_items", decontaminate.contaminated().alias("c")).collect()
    want = [(d, n, h, k, s, c) for d, n, h, k, s, c in _contamination(odd_rows, rows)]
    sha = lambda x: hashlib.sha256(",".join(x).encode()).hexdigest()
    assert Counter((r.doc_id, r.n_words, r.n, len(r.hit_items), sha(r.hit_items), r.c) for r in got) == Counter(want)
    assert decontaminate.report(none, benchmark).count() == 0
    assert decontaminate.report(odd, benchmark.limit(0)).filter("contaminated").count() == 0


def test_contaminated_rows_and_spans_go(odd, odd_rows, items):
    rows, benchmark = items
    bad = Counter(d for d, *_, c in _contamination(odd_rows, rows) if c)
    kept = decontaminate.without_documents(odd, benchmark)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(d for d, _ in odd_rows) - bad
    cut = decontaminate.without_spans(odd, benchmark)
    assert cut.columns == odd.columns and decontaminate.report(cut, benchmark).agg({"n_hit": "sum"}).first()[0] == 0
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert texts[5] == "" and texts[1] is None and texts[4] == "one" and texts[12].startswith(" Ünder")


# --- near duplicates ---------------------------------------------------------------------------


def brute_components(rows, n, percent):
    sets = []
    for _, t in rows:
        w = words(t, SOLID)
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[top(i)] = top(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        best.setdefault(top(i), []).append(d)
    smallest = {k: min([d for d in v if d is not None], default=None) for k, v in best.items()}
    return [(d, len(sets[i]), d if not sets[i] else smallest[top(i)]) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_components(spark, odd, odd_rows, n, percent):
    rule = jaccard_join.Rule(n, percent)
    assert Counter(map(tuple, jaccard_join.similarity_components(odd, rule).collect())) == Counter(brute_components(odd_rows, n, percent))


def test_borderline_family(spark):
    """Copies of one text with one to four changes each: many pairs lie next to the threshold."""
    import random

    rng = random.Random(3)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for d in range(140):
        text = list(base)
        for _ in range(rng.randint(1, 4)):
            text[rng.randrange(90)] = f"v{rng.randrange(50)}"
        rows.append((d, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for n, percent in ((3, 90), (5, 80)):
        got = jaccard_join.similarity_components(docs, jaccard_join.Rule(n, percent)).collect()
        assert sorted(map(tuple, got)) == sorted(brute_components(rows, n, percent))


def test_one_of_each(odd, none):
    kept = jaccard_join.one_of_each(odd, jaccard_join.Rule(5, 80))
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 3, 4, 5, 6, 7, 8, 12, 13, 14]
    assert kept.filter("doc_id is null").count() == 2
    assert jaccard_join.one_of_each(none).count() == 0


@pytest.mark.parametrize("small", [True, False])
def test_one_of_each_decides_by_row(spark, monkeypatch, small):
    monkeypatch.setattr(jaccard_join, "BROADCAST_BYTES", 32_000_000 if small else 0)
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcde")
    rows = [
        (1, a, 1), (1, b, 2), (2, a, 3), (3, b, 4),  # two unrelated texts of one id, each with a copy
        (5, c, 5), (4, c, 6), (5, d, 7),  # the id's smaller text goes with document 4, its larger one is the only one
        (6, e, 8), (6, e + " tail", 9), (6, e, 8),  # linked texts and a repeated row of one id
        (None, "n " + d[::-1], 10), (None, "n " + d[::-1], 10),  # copies with null ids only
        (7, None, 11), (7, None, 11), (7, " ", 12),  # no n-grams
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component int")
    kept = jaccard_join.one_of_each(docs, jaccard_join.Rule(5, 80)).collect()
    assert Counter(map(tuple, kept)) == Counter([rows[i] for i in (0, 1, 5, 6, 7, 10, 12, 13, 14)])


def test_graph_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7), (None, 3)] + [(200, 201 + i) for i in range(50)]
    for task_edges in (500_000, 7):
        got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long"), task_edges).collect()))
        assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((100, 101, 103), 100), **dict.fromkeys(range(200, 251), 200)}


# --- licenses ----------------------------------------------------------------------------------


def test_license_scan(spark, none):
    mit = next(t for label, t in license_scan.TEXTS if label == "text:mit")
    near = mit.replace("granted free", "granted to you free").replace("of this ", "")
    rows = [
        (1, "It is UNDER the MIT-license. Not under the mit; license? under the mit x license"), (2, None), (3, ""), (4, "cc by"),
        (5, "CC BY-NC 4.0 cc by nc"), (5, "CC BY-NC 4.0 cc by nc"), (6, "Apache License, Version 2.0"), (7, f"word {near} word"),
        (8, "cc by nc " * 3000), (None, "under the mit license"),
    ]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n_words int")
    for limit in (license_scan.BROADCAST_BYTES, 0):
        got = license_scan.scan(docs, broadcast_bytes=limit).collect()
        want = []
        for d, t in rows:
            w, places = words(t), []
            for label, phrase in license_scan.PHRASES:
                p = phrase.split()
                places += [(k, label) for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
            at = [k for k, _ in places]
            want.append((d, len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))))
        assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == Counter(want)
        assert all(set(r.base_labels.split(",")) <= {*r.labels.split(","), ""} and 0 <= r.score <= 1 for r in got)
        assert next(r for r in got if r.doc_id == 7).labels == "text:mit"
    assert license_scan.scan(none).count() == 0


# --- quality -----------------------------------------------------------------------------------


def test_quality(spark, sf_dir, odd, none):
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.1')}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    scored = quality.scored(docs, model).join(labels, "doc_id").select("score", "predicted", "quality", quality.held_out().alias("held"))
    rows = [r for r in scored.collect() if r.held]
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.97
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([[g > b for g in good] for b in bad]) > 0.97
    got = quality.scored(odd, model)
    assert got.columns == [*[c for c in odd.columns if c not in ("score", "predicted")], "score", "predicted"]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.collect()) and got.count() == odd.count()
    assert len({r.score for r in got.collect() if not r.text}) == 1
    assert quality.scored(none, model).count() == 0 and quality.fit(docs, labels.limit(0)) is None
    assert {r.score for r in quality.scored(odd, None).collect()} == {0.5}
    assert quality.fit(docs, labels).weights == model.weights


def test_stages_keep_the_values_of_clashing_columns(odd, items):
    names = [c for c in odd.columns if c != "text"]
    docs = odd.withColumns({c: F.lit(c) for c in ("hit_spans", "hit_items", "score", "predicted", "n_words")})
    every = Counter(map(tuple, docs.select(*names, "hit_spans", "hit_items").collect()))
    model = quality.Model(b"plain words " * 40, b"other words " * 40, [0.0, 0.0, 1.0])
    stages = {
        "good": [quality.good_documents(docs, m) for m in (None, model)],
        "clean": [decontaminate.without_documents(docs, items[1]), decontaminate.without_spans(docs, items[1])],
    }
    for name, frames in stages.items():
        for kept in frames:
            assert kept.dtypes == docs.dtypes, name
            assert Counter(map(tuple, kept.select(*names, "hit_spans", "hit_items").collect())) <= every, name
