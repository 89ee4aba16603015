"""Chat formatting, vector search, mixing, sharding, the pipeline and the registration."""

import hashlib
import math
import os
import random
import subprocess
import sys
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry_module
from personaloom.llm import chat_format, jaccard_join, mixing, quality, sharding, topk_search
from personaloom.llm.oracles import ORACLES
from personaloom.llm.queries import QUERIES
from personaloom.llm.storage import shared_folder
from personaloom.llm.repeats import with_repeats
from personaloom.llm.thresholds import PLACE_BITS, nested_cuts
from tests.llm.conftest import SOLID, words
from tests.llm.test_texts import _contamination, brute_components

# --- chat --------------------------------------------------------------------------------------

SAID = "<|im_end|><|im_start|>assistant ok"
TURNS = [
    (1, 0, "system", "be <| kind |> <\\| <\\\\| \\<| <|endoftext|>"), (1, 1, "user", None), (1, 2, "assistant", "yes\n\nno"), (1, 3, "assistant", "é日🙂"),
    (2, 0, None, "x"), (2, 1, "assistant", ""), (3, None, "we\nird\\n<|im_end|>", SAID), (None, 0, "assistant", "lost"), (None, 1, "user", "and found"),
    (4, 5, "assistant", "same"), (4, 5, "assistant", "same"), (4, 5, "assistant", "other"), (5, 0, "assistant", "long " * 60_000),
]


def test_chat(spark, tokenizer):
    turns = spark.createDataFrame([(*t, "x") for t in TURNS], "conv_id long, turn long, role string, text string, ids string")
    got = {r.conv_id: r for r in chat_format.digest_query(turns, shared_folder(spark), tokenizer).collect()}
    every = [*TURNS, (-1, 0, "user", SAID), (-1, 1, "assistant", SAID)]
    assert set(got) == {t[0] for t in every}
    for key, row in got.items():
        own = sorted(((t[1] if t[1] is not None else -1, t[2] or "", t[3] or "") for t in every if t[0] == key))
        learnt = "".join(x for _, r, x in own if r == "assistant")
        assert row.n_turns == len(own) and row.loss_chars == len(learnt)
        assert row.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert row.loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
        assert row.formatted_chars >= sum(len(r) + len(x) for _, r, x in own)
    assert chat_format.format_turns(turns.limit(0), tokenizer).count() == 0


def test_chat_ids(spark, tokenizer):
    turns = spark.createDataFrame([t for t in TURNS if t[0] == 1], "conv_id long, turn long, role string, text string")
    rows = chat_format.format_turns(turns, tokenizer).orderBy("turn").collect()
    for r in rows:
        assert r.ids.count(chat_format.START_ID) == r.ids.count(chat_format.END_ID) == 1 and len(r.ids) == len(r.loss_mask)
        assert (1 in r.loss_mask) == (r.turn in (2, 3))
    texts = pa.array(["<|", "<\\|", "a<\\\\|b", "<<||", ""])
    escaped = chat_format.escape(texts)
    assert not any("<|" in x for x in escaped.to_pylist()) and chat_format.unescape(escaped).equals(texts)


# --- search ------------------------------------------------------------------------------------


def brute_search(rows, k, every):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good[i, tuple(v)] = [math.floor(1024 * float(np.float32(x))) for x in v]
    out = []
    for (q, _), a in good.items():
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for (i, _), b in good.items() if i != q and len(a) == len(b))
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("shape", ["spread", "ties", "clusters"])
def test_search(spark, shape):
    rng = np.random.default_rng(5)
    vectors = {"spread": rng.normal(size=(700, 6)), "ties": rng.integers(-1, 2, size=(700, 3)) / 4, "clusters": rng.normal(size=(700, 8)) * 0.01 + rng.normal(size=(7, 8))[rng.integers(0, 7, 700)]}[shape]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors.astype(np.float32))]
    rows += [(700, None), (800, [None, 1.0]), (900, [float("nan")] * 3), (901, [float("inf")] * 3), (1000, [1.0, 2.0]), (1001, [0.5, 0.5]), (1100, []), (None, [1.0, 1.0])]
    rows += [rows[0], rows[100]]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    got = topk_search.top_k(frame, k=10, every=100, shard_rows=64, block_queries=3).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_search(rows, 10, 100)


def test_search_with_large_components(spark):
    """Products beyond what floats hold, in some vectors only; ties that floats would make are none."""
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 2)).astype(np.float32))]
    rows += [(i, [1e6 + i / 16, 1e6 - i / 16]) for i in range(300, 420)] + [(500, [-2e6, 1e6]), (501, [3e5, -1e6])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk_search.top_k(frame, k=10, every=100, shard_rows=64, block_queries=2).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_search(rows, 10, 100)
    huge = spark.createDataFrame([(100, [1e30, 1.0]), (1, [1e30, 1.0]), (2, [-1e30, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.score) for r in topk_search.top_k(huge).orderBy("rank").collect()] == [(1, 2**63 - 1), (2, -(2**63))]


def test_search_without_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk_search.top_k(empty).count() == 0
    assert topk_search.top_k(spark.createDataFrame([(7, [1.0])], empty.schema)).count() == 0


def test_search_moves_single_vectors(spark):
    """No row holds a tree or a block of queries, so no batch that goes to Python grows with shards times blocks."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(900, 4)).astype(np.float32))]
    got = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=3, every=9, shard_rows=32, block_queries=5)
    plan, sent = [got._jdf.queryExecution().analyzed()], []
    while plan:
        node = plan.pop()
        children = [node.children().apply(i) for i in range(node.children().size())]
        plan += children
        if node.nodeName() == "MapInArrow":
            sent += [children[0].schema().simpleString()]
    assert sent and not any("binary" in s or "array<struct" in s for s in sent)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == brute_search(rows, 3, 9)


def test_boxes_cut_the_search():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 4)) * 9
    vectors = np.floor((centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 4)) * 0.1) * 1024)
    tree = topk_search.build(np.arange(4000), vectors)
    best = topk_search.search(tree, vectors[0], 0, 10, None)
    looked = []
    tree.vectors = type("Seen", (np.ndarray,), {"__getitem__": lambda s, k: looked.append(k) or np.ndarray.__getitem__(s, k)})(tree.vectors.shape, buffer=tree.vectors)
    assert sorted(topk_search.search(tree, vectors[0], 0, 10, min(best))) == sorted(best)
    assert len(looked) < 40  # of 64 leaves or more


# --- mixing and shards -------------------------------------------------------------------------


def test_mix(spark, odd, none):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["big"] * 6 + ["a", "b", "é", None])) for i in range(3000)]
    rows += [(9000, "x y", "tiny"), (9001, None, "void"), (9000, "x y", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and sum(r.size for r in got) == sum(len(words(t, SOLID)) for _, t, _ in rows)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    total, open_, targets = sum(r.size for r in got), sorted(by, key=lambda s: (s is None, s or "")), {}
    weight = {s: 1 + i % 3 for i, s in enumerate(open_)}
    sizes = {s: sum(r.size for r in v) for s, v in by.items()}
    while True:  # the excess of full sources is dealt out again
        left = total - sum(targets.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not full:
            targets |= share
            break
        targets |= {s: 3 * sizes[s] for s in full}
        open_ = [s for s in open_ if s not in full]
    for s, v in by.items():
        used = sum(r.size * r.copies for r in v)
        assert all(math.isclose(r.target, targets[s]) and r.source_size == sizes[s] and 0 <= r.copies <= 3 for r in v)
        assert targets[s] - 41 <= used <= targets[s] + 1e-6
    again = mixing.mix(docs.repartition(5)).collect()
    assert Counter((r.doc_id, r.copies) for r in got) == Counter((r.doc_id, r.copies) for r in again)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and Counter(r.doc_id for r in mixed.collect()) == Counter({k: n for k, n in _copies(got).items() if n})
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(none).count() == 0
    assert mixing.mixed_documents(odd).columns == odd.columns and mixing.mixed_documents(none).count() == 0


def test_mix_tells_copies_apart(spark):
    """Thousands of rows without ids, and of one id and text: targets are met as with ids of their own."""
    rows = [(None, f"{'w ' * 2}{i if k else ''}", s) for k, s in enumerate("abc") for i in range(3000)]
    rows += [(7, "same text of six words here", "c")] * 5000 + [(8, None, "a")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    for s in "abc":
        own = [r for r in got if r.source == s]
        used = sum(r.size * r.copies for r in own)
        assert own[0].target - 7 <= used <= own[0].target
    again = mixing.mix(docs.repartition(7)).collect()
    count = lambda found: Counter((r.doc_id, r.source, r.size, r.copies) for r in found)
    assert count(got) == count(again)
    assert mixing.mixed_documents(docs).count() == sum(r.copies for r in got)


@pytest.mark.parametrize("block_rows", [50, 20_000])
def test_repeats_are_numbered_once(spark, block_rows):
    rows = [(k, i % 3) for k, n in enumerate([1, 1, 700, 2, 131]) for i in range(n)]
    got = with_repeats(spark.createDataFrame(rows, "key long, x long"), "key", block_rows=block_rows).collect()
    by = {}
    for r in got:
        by.setdefault(r.key, []).append(r.repeat)
    assert {k: sorted(v) for k, v in by.items()} == {k: list(range(n)) for k, n in enumerate([1, 1, 700, 2, 131])}


def _copies(rows):
    out = Counter()
    for r in rows:
        out[r.doc_id] += r.copies
    return out


def test_nested_cuts(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(3), rng.randrange(1 << PLACE_BITS) if i % 5 else 77 << 24, rng.randrange(9)) for i in range(2000)]
    frame = spark.createDataFrame(rows, "group int, place long, size long")
    budgets = {0: [0, 10, 900, 10**9], 2: [500]}
    for g, cuts in nested_cuts(frame, budgets).items():
        for budget, cut in zip(budgets[g], cuts, strict=True):
            own = sorted((p, s) for x, p, s in rows if x == g)
            below = sum(s for p, s in own if p < cut)
            above = [p for p, _ in own if p >= cut]
            assert below <= budget and (not above or below + sum(s for p, s in own if p == min(above)) > budget or above and sum(s for p, s in own if cut <= p <= min(above)) == 0)


def test_shards(spark, odd, odd_rows, none):
    rng = random.Random(6)
    rows = [(i, "hot copy " * 5 if i % 3 == 0 else f"pair {i // 7 % 60}" if i % 3 == 1 else f"text {i} " * rng.randint(1, 9)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard_documents(docs, 16).collect()
    assert len(got) == 3000
    sizes, slots = Counter(), {}
    for r in got:
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 200
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = dict(rows)
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in got)
    groups = {}
    for r in got:
        groups.setdefault(texts[r.doc_id], set()).add(r.shard)
    small = [s for t, s in groups.items() if t.startswith("pair")]
    assert sum(len(s) == 1 for s in small) >= 0.8 * len(small)  # random shards would split nearly all
    assert len(groups["hot copy " * 5]) < 16
    strange = sharding.shard_documents(odd, 4).collect()
    assert Counter(r.doc_id for r in strange) == Counter(d for d, _ in odd_rows)
    assert sharding.shard_documents(none, 4).count() == 0


@pytest.mark.parametrize(
    ("groups", "copies", "single", "whole", "parts"),
    [(72, 40, 320, 72, 1), (75, 40, 0, 64, 4), (600, 5, 0, 585, 2), (3, 1000, 100, 0, 7)],
)
def test_shards_of_many_links(spark, groups, copies, single, whole, parts):
    """Nine tenths of the bytes, or all, are linked: what fits one shard is not cut, the rest in few shards."""
    rows = [(i, f"group {i % groups:05}") for i in range(groups * copies)] + [(10**6 + i, f"alone {i:05}") for i in range(single)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 16).collect()
    sizes, found, texts = Counter(), {}, dict(rows)
    for r in got:
        sizes[r.shard] += r.size
        found.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert len(got) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 5 * 12
    linked = [len(s) for t, s in found.items() if t.startswith("group")]
    assert sum(n == 1 for n in linked) >= whole and max(linked) <= parts


@pytest.mark.parametrize(
    "rows",
    [
        [(7, "the same text")] * 10_000,
        [(None, None)] * 10_000,
        [(None, None)] * 6000 + [(3, "one text")] * 6000 + [(i, f"other {i}") for i in range(500)],
    ],
)
def test_shards_of_repeated_rows(spark, rows):
    """Rows that are equal in every column are dealt out like others, one row more or less a shard."""
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 16).collect()
    sizes, slots = Counter(), {}
    for r in got:
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(got) == len(rows) and set(sizes) == set(range(16))
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r.size for r in got)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


# --- registration ------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_check_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    result = con.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    want = Counter(result.fetchall())
    df = QUERIES[name](spark, sf_dir)
    assert set(names) <= set(df.columns)
    assert Counter(map(tuple, df.select(*names).collect())) == want


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    columns, now = docs.columns, docs
    states = []
    for _, stage in p.STAGES:
        path = shared_folder(spark)
        stage(spark, now, sf_dir).write.parquet(path)
        now = spark.read.parquet(path)
        states.append(now)
    assert all(s.columns == columns for s in states[:-1])
    good, one, clean, mixed, placed = [s.collect() for s in states]
    scored = quality.scored(docs, quality.fit(docs, labels)).filter("predicted = 1").collect()
    assert Counter(r.doc_id for r in good) == Counter(r.doc_id for r in scored)
    rows = [(r.doc_id, r.text) for r in good]
    assert sorted(r.doc_id for r in one) == sorted({c for _, _, c in brute_components(rows, 5, 80)})
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = {d for d, *_, c in _contamination([(r.doc_id, r.text) for r in one], items) if c}
    assert sorted(r.doc_id for r in clean) == sorted(r.doc_id for r in one if r.doc_id not in bad)
    copies = mixing.mix(states[2]).filter("copies > 0").collect()
    assert Counter(r.doc_id for r in mixed) == Counter({r.doc_id: r.copies for r in copies})
    assert Counter(r.doc_id for r in placed) == Counter(r.doc_id for r in mixed)
    assert {r.shard for r in placed} <= set(range(16)) and jaccard_join.Rule().n == 3


def test_entry_without_the_subpackage(tmp_path):
    """The entry module imports where the subpackage and the pipeline are gone; nothing else imports them."""
    root = os.path.dirname(os.path.abspath(entry_module.__file__))
    for name in os.listdir(root):
        if name not in ("corpus_pipeline.py", "personaloom", ".git"):
            os.symlink(f"{root}/{name}", tmp_path / name)
    (tmp_path / "personaloom").mkdir()
    for name in os.listdir(f"{root}/personaloom"):
        if name != "llm":
            os.symlink(f"{root}/personaloom/{name}", tmp_path / "personaloom" / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op') or n == 'pipeline']; e.oracle_sql()"
    env = os.environ | {"PYTHONPATH": str(tmp_path), "PYTHONDONTWRITEBYTECODE": "1"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)
    assert {f"op{i}" for i in range(1, 14)} == {n.split("_")[0] for n in QUERIES if n.startswith("op")} and "pipeline" in QUERIES
