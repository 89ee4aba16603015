"""Benchmark passages in training documents: a hash set of item windows, a scan of word windows, verified hits."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from personaloom.llm.batches import bounded
from personaloom.llm.columns import covered, uncovered
from personaloom.llm.storage import row_bytes
from personaloom.llm.wordhash import ALNUM, LOWER, Words, text_bytes, words, words_of

#: Item texts that one broadcast may hold; more items are scanned for in several such blocks.
BLOCK_BYTES = 32_000_000
_BITS = 22
SPANS = "array<struct<start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


@dataclass
class Windows:
    """Windows of some items: per length in words the sorted hashes, and per hash its texts with their items."""

    size: int
    hashes: dict[int, np.ndarray]
    filter: dict[int, np.ndarray]
    texts: dict[int, dict[bytes, list[str]]]


def windows_of(items: pa.Table, size: int) -> Windows:
    """All windows of `size` words of the items' texts; an item of fewer words, but not none, is one window."""
    found = words_of(items.column("text"), ALNUM)
    names = items.column("item_id").cast(pa.string()).to_pylist()
    counts, row = found.count(), found.row()
    texts: dict[int, dict[bytes, list[str]]] = {}
    by_length: dict[int, list[int]] = {}
    for n in sorted({min(size, c) for c in counts.tolist() if c}):
        place, value = found.grams(n)
        mine = (counts[row[place]] == n) | ((n == size) & (counts[row[place]] > size))
        for i, h in zip(place[mine].tolist(), value[mine].tolist(), strict=True):
            owners = texts.setdefault(h, {}).setdefault(window_text(found, i, n), [])
            name = names[row[i]]
            if name is not None and name not in owners:
                owners.append(name)
            by_length.setdefault(n, []).append(h)
    hashes = {n: np.unique(np.array(v, np.uint64)) for n, v in by_length.items()}
    bits = {}
    for n, v in hashes.items():
        bits[n] = np.zeros(1 << _BITS, bool)
        bits[n][(v >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    return Windows(size, hashes, bits, texts)


def window_text(found: Words, first: int, n: int) -> bytes:
    """n words joined by single blanks."""
    raw = LOWER[found.data[found.start[first] : found.end[first + n - 1]]].tobytes()
    at, low = int(found.start[first]), found.start[first : first + n] - found.start[first]
    return b" ".join(raw[a:b] for a, b in zip(low.tolist(), (found.end[first : first + n] - at).tolist(), strict=True))


def hits_of(found: Words, windows: Windows) -> Iterator[tuple[int, int, list[str]]]:
    """First word, length and items of every window that occurs, compared word by word after its hash matched."""
    for n, hashes in windows.hashes.items():
        place, value = found.grams(n)
        maybe = np.flatnonzero(windows.filter[n][(value >> np.uint64(64 - _BITS)).astype(np.int64)])
        if not len(maybe):
            continue
        at = np.searchsorted(hashes, value[maybe])
        maybe = maybe[hashes[np.minimum(at, len(hashes) - 1)] == value[maybe]]
        for i, h in zip(place[maybe].tolist(), value[maybe].tolist(), strict=True):
            items = windows.texts[h].get(window_text(found, i, n))
            if items is not None:
                yield i, n, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def scan(docs: DataFrame, benchmark: DataFrame, size: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every row of `docs` with hit_spans (words, end apart), hit_items and n_words; columns of these names are replaced.

    The windows of the items are broadcast, at most `block_bytes` of item texts at once: their bytes are counted
    first, and a larger benchmark is split by a hash of item_id into as many passes over the row's own texts, in
    one stage and without a shuffle. Rows of one item_id count as one item.

    Null and empty texts have no words and no hits; items without words or with a null id mark words only (a
    null id) or nothing. An empty benchmark hits nothing.
    """
    items = benchmark.select("item_id", "text")
    blocks = max(1, -(-row_bytes(items, "text") // block_bytes))
    kept = docs.drop("hit_spans", "hit_items", "n_words")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    schema += f", hit_spans {SPANS}, hit_items array<string>, n_words bigint"
    found = kept.withColumns(
        {"hit_spans": F.lit(None).cast(SPANS), "hit_items": F.lit(None).cast("array<string>"), "n_words": F.lit(0).cast("bigint")}
    )
    for k in range(blocks):
        block = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        sent = docs.sparkSession.sparkContext.broadcast(windows_of(block.toArrow(), size))

        def look(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in bounded(batches, "text"):
                text = words_of(batch.column("text"), ALNUM)
                row = text.row()
                spans: dict[int, list] = {}
                names: dict[int, set] = {}
                for i, n, owners in hits_of(text, sent.value):
                    r = int(row[i])
                    a = i - int(text.first[r])
                    spans.setdefault(r, []).append((a, a + n))
                    names.setdefault(r, set()).update(owners)
                old = zip(batch.column("hit_spans").to_pylist(), batch.column("hit_items").to_pylist(), strict=True)
                all_spans, all_names = [], []
                for r, (s, x) in enumerate(old):
                    both = merged([(e["start"], e["end"]) for e in s or ()] + spans.get(r, []))
                    all_spans.append([{"start": a, "end": b} for a, b in both])
                    all_names.append(sorted({*(x or ()), *names.get(r, ())}))
                yield pa.record_batch(
                    [
                        *(batch.column(c) for c in batch.schema.names[:-3]),
                        pa.array(all_spans, _SPANS),
                        pa.array(all_names, pa.list_(pa.string())),
                        pa.array(text.count().astype(np.int64)),
                    ],
                    names=batch.schema.names,
                )

        found = found.mapInArrow(look, schema)
    return found


def hit_words():
    """The number of words inside hits."""
    return F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])


def contaminated():
    """Some word is hit, and a twentieth of the words at least."""
    return (F.size("hit_spans") > 0) & (20 * hit_words() >= F.col("n_words"))


def without_documents(docs: DataFrame, benchmark: DataFrame, size: int = 13) -> DataFrame:
    """`docs` without its contaminated rows; the others keep all columns and whole texts."""
    return uncovered(scan(covered(docs), benchmark, size).filter(~contaminated()), docs)


def without_spans(docs: DataFrame, benchmark: DataFrame, size: int = 13) -> DataFrame:
    """`docs` with the hit passages cut out of `text`, from the first hit word to the last one's end."""
    found = scan(covered(docs), benchmark, size)

    def remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            data, offsets = text_bytes(batch.column("text"))
            text = words(data, offsets, ALNUM)
            out = []
            for r, (raw, spans) in enumerate(zip(batch.column("text").to_pylist(), batch.column("hit_spans").to_pylist(), strict=True)):
                if spans:
                    base, at, parts = int(text.first[r]), int(offsets[r]), []
                    for s in spans:
                        parts.append(data[at : text.start[base + s["start"]]])
                        at = int(text.end[base + s["end"] - 1])
                    raw = np.concatenate([*parts, data[at : offsets[r + 1]]]).tobytes().decode()
                out.append(raw)
            names = batch.schema.names
            yield pa.record_batch(
                [pa.array(out, pa.string()) if c == "text" else batch.column(c) for c in names], names=names
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields)
    return uncovered(found.mapInArrow(remove, schema), docs)


def report(docs: DataFrame, benchmark: DataFrame, size: int = 13) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 (of the sorted, comma-joined ids) and contaminated per row."""
    found = scan(docs.select("doc_id", "text"), benchmark, size)
    return found.select(
        "doc_id",
        "n_words",
        hit_words().alias("n_hit"),
        F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )

