"""Ranked lexical search against brute force."""

import random
from collections import Counter
from math import floor, log

import numpy as np

from personaloom.llm import lexical_search
from tests.llm.conftest import words


def expected(docs, benchmark, k=10):
    """Counter of (item_id, rank, score, doc_id), scoring every document for every item."""
    known = [(d, Counter(words(t))) for d, t in docs]
    lengths = [sum(c.values()) for _, c in known]
    n, total = sum(x > 0 for x in lengths), sum(lengths)
    df = Counter(t for _, c in known for t in c)
    items = {}
    for item, text in benchmark:
        items.setdefault(item, Counter()).update(words(text))
    out = []
    for item, terms in items.items():
        scores = []
        for (doc, c), length in zip(known, lengths, strict=True):
            score = 0
            for t, times in terms.items():
                if c[t]:
                    w = floor(1000 * log((2 * n + 2) / (2 * df[t] + 1)))
                    score += times * w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * (100 - 75 + (75 * length * n) // total)))
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        for rank, (score, unnamed, doc) in enumerate(sorted(scores)[:k]):
            out.append((item, rank + 1, None if unnamed else doc, -score))
    return Counter(out)


def found(df):
    return Counter(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()))


def texts(seed, count, vocabulary, most):
    """Texts of words of very unequal frequency, in a few subjects."""
    pick = random.Random(seed)
    out = []
    for _ in range(count):
        base = pick.randrange(4) * vocabulary
        out.append(" ".join(f"W{base * (pick.random() < 0.7) + int(vocabulary * pick.random() ** 3)}" for _ in range(pick.randrange(most))))
    return out


def test_search_equals_brute_force(spark, odd, odd_rows, none):
    benchmark = [(1, "the MIT license one t60 t61 mail"), (2, "t10 T10 t50 w5x5 tail"), (2, "two words"), (3, ""), (4, None), (None, "t90 other"), (5, "nowhere")]
    items = spark.createDataFrame([(i, t, None) for i, t in benchmark], "item_id long, text string, rank string")
    assert found(lexical_search.search(odd, items)) == expected(odd_rows, benchmark)
    assert lexical_search.search(none, items).count() == 0
    assert lexical_search.search(odd, items.filter("item_id < -5")).count() == 0


def test_search_over_many_shards_and_item_blocks(spark, monkeypatch):
    """Shards of 16 documents, items in several passes, thousands of equal rows, ties."""
    docs = list(enumerate(texts(1, 900, 60, 90))) + [(None, "w1 w2 w3")] * 30 + [(5000 + i % 7, "w4 w5 w6 w59") for i in range(2000)]
    benchmark = list(enumerate(texts(2, 40, 60, 25)))
    monkeypatch.setattr(lexical_search, "shard_docs", lambda terms: 16)
    documents, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(benchmark, "item_id long, text string")
    assert found(lexical_search.search(documents.repartition(5), items, k=7, block_bytes=2500)) == expected(docs, benchmark, k=7)


def test_blocks_bound_their_documents_and_are_skipped():
    """No document of a block scores above its bound; most blocks are never opened, and the best stay the same."""
    pick = np.random.default_rng(3)
    docs, terms = 1500, 80
    centres = pick.integers(0, terms, (10, 12))
    tf = np.zeros((docs, terms), np.int64)
    for d in range(docs):
        for t in centres[d % 10][pick.random(12) < 0.8]:
            tf[d, t] += pick.integers(1, 4)
    where, which = np.nonzero(tf)
    n = tf.sum(axis=1) + 5
    weights = np.floor(1000 * np.log((2 * docs + 2) / (2 * (tf > 0).sum(axis=0) + 1)))
    known = lexical_search.Statistics(docs, int(n.sum()), weights)
    wanted = [np.unique(centres[i % 10][pick.random(12) < 0.6]) for i in range(20)]
    items = lexical_search.Items(list(range(20)), np.arange(terms, dtype=np.uint64), wanted, [np.ones(len(w), np.int64) for w in wanted])
    search = lexical_search.Search(items, known, 5, [0.0] * 20)
    row = {"docs": list(range(docs)), "n": n, "counts": (tf > 0).sum(axis=1), "terms": which, "tf": tf[where, which]}
    shard = search.shard(row)
    search.look(shard)
    assert search.skipped > search.opened
    for q, (terms_q, w) in enumerate(zip(search.terms, search.weights, strict=True)):
        scores = shard.impact[:, terms_q].astype(float) @ w
        best = lexical_search.best_of([(s, d) for d, s in enumerate(scores.tolist()) if s > 0], 5)
        assert search.best[q] == best
    for t, blocks in shard.lists.items():
        assert sorted(blocks.members.tolist()) == np.flatnonzero(tf[:, t]).tolist()
        start = 0
        for end, top in zip(blocks.ends.tolist(), blocks.maxima, strict=True):
            assert (shard.impact[blocks.members[start:end]][:, search.around[t]] <= top).all()
            start = end
