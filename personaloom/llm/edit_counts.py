"""Token counts that follow edits: a segment tree of pre-tokens per document, of which edits re-encode a part.

A leaf covers LEAF pre-tokens and holds its characters and tokens; inner nodes hold sums. An edit is re-encoded
from the start of the leaf that lies at least CONTEXT characters before it (a pre-token's end depends on two
characters after it at most, but for white space, which it covers itself) to the first later leaf start
that is again the start of a pre-token. From there on the old pre-tokens hold, as matching looks only forward.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from personaloom.llm.batches import bounded
from personaloom.llm.pretokens import PieceEncoder, encoder
from personaloom.llm.wordhash import list_column

LEAF, CONTEXT = 32, 4
#: e-mail addresses, and runs of seven digits or more that single signs may part (fixed values)
PERSONAL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+|(?<!\d)\+?\d(?:[ ().-]?\d){6,}")
EDITS = "array<struct<start:int,end:int,replacement:string>>"
_EDITS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("replacement", pa.string())]))


def tree_of(leaves: np.ndarray) -> np.ndarray:
    """Sums in heap order: node i has children 2i and 2i + 1; the leaves are the second half."""
    width = 1
    while width < len(leaves):
        width *= 2
    tree = np.zeros(2 * width, np.int64)
    tree[width : width + len(leaves)] = leaves
    level = width
    while level > 1:
        tree[level // 2 : level] = tree[level : 2 * level : 2] + tree[level + 1 : 2 * level : 2]
        level //= 2
    return tree


def leaf_at(tree: np.ndarray, place: int) -> tuple[int, int]:
    """The leaf that covers a character, or the last one beyond the end, and the leaf's start."""
    width, node, start = len(tree) // 2, 1, 0
    while node < width:
        node *= 2
        if place >= start + tree[node] and tree[node + 1]:
            start += int(tree[node])
            node += 1
    return node - width, start


def set_leaf(tree: np.ndarray, leaf: int, value: int) -> None:
    node = len(tree) // 2 + leaf
    change = value - int(tree[node])
    while node and change:
        tree[node] += change
        node //= 2


def build(pieces: PieceEncoder, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Trees of characters and of tokens of each text."""
    for s in pieces.slices(texts):
        ends = np.append(s.starts, len(s.text))
        sizes, tokens = np.diff(ends), pieces.length[s.piece].astype(np.int64)
        for a, b in zip(s.first[:-1].tolist(), s.first[1:].tolist(), strict=True):
            at = np.arange(a, b, LEAF)
            yield tuple(tree_of(np.add.reduceat(x, at) if b > a else x[:0]) for x in (sizes[:b], tokens[:b]))


def spliced(text: str, start: int, stop: int, edits: list) -> str:
    parts, at = [], start
    for e in edits:
        parts += [text[at : e["start"]], e["replacement"] or ""]
        at = max(at, e["end"])
    return "".join([*parts, text[at:stop]])


def apply(pieces: PieceEncoder, text: str, chars: np.ndarray, tokens: np.ndarray, edits: list) -> int:
    """Brings both trees up to date with the edits of a text; returns how many pre-tokens were encoded for it."""
    edits = sorted(edits, key=lambda e: (e["start"], e["end"]))
    if any(a["end"] > b["start"] for a, b in zip(edits, edits[1:], strict=False)):
        raise ValueError("edits overlap")
    if edits and not 0 <= edits[0]["start"] <= edits[-1]["end"] <= len(text):
        raise ValueError("an edit lies outside its text")
    old, i, done, changes = chars.copy(), 0, 0, []
    while i < len(edits):
        leaf, begin = leaf_at(old, max(0, edits[i]["start"] - CONTEXT))
        k, reach = i + 1, max(edits[i]["end"], begin + 1)
        while True:
            # the first leaf that starts at or after `reach`, and the start of the leaf behind it
            last, at = leaf_at(old, max(reach - 1, 0))
            stop = min(at + int(old[len(old) // 2 + last]), len(text))
            look = stop
            if stop < len(text):
                follow, at = leaf_at(old, stop)
                look = at + int(old[len(old) // 2 + follow])
            if k < len(edits) and edits[k]["start"] < look + CONTEXT:
                reach, k = max(reach, edits[k]["end"], edits[k]["start"] + 1), k + 1
                continue
            new, ahead = spliced(text, begin, stop, edits[i:k]), text[stop:look]
            starts, piece = pieces.pieces(new + ahead, np.zeros(1, np.int64)) if new + ahead else (np.empty(0, np.int64),) * 2
            if stop >= len(text) or len(new) in starts:
                break
            reach = look
        keep = starts < len(new)
        done += int(keep.sum())
        changes.append((leaf, last, len(new), int(pieces.length[piece[keep]].sum())))
        i = k
    for leaf, last, size, count in changes:
        for n in range(leaf + 1, last + 1):
            set_leaf(chars, n, 0)
            set_leaf(tokens, n, 0)
        set_leaf(chars, leaf, size)
        set_leaf(tokens, leaf, count)
    return done


def personal_edits(text: str, replacement: str = "[removed]") -> list[dict]:
    return [{"start": m.start(), "end": m.end(), "replacement": replacement} for m in PERSONAL.finditer(text)]


def with_trees(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, text and the document's trees `tree_chars` and `tree_tokens`; a null text has trees of nothing.

    Row by row, without a shuffle. Strings of special tokens count as ordinary text. Other columns are left out.
    """

    def grow(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(tokenizer)
        for batch in bounded(batches, "text"):
            pairs = list(build(pieces, batch.column("text")))
            lists = []
            for k in (0, 1):
                trees = [p[k] for p in pairs]
                lists.append(list_column(np.concatenate(trees), np.array([len(t) for t in trees]), pa.int32()))
            yield pa.record_batch([batch.column("doc_id"), batch.column("text"), *lists], ["doc_id", "text", "tree_chars", "tree_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        grow, f"doc_id {kind}, text string, tree_chars array<int>, tree_tokens array<int>"
    )


def with_personal_edits(docs: DataFrame) -> DataFrame:
    """Adds `edits`: the spans of personal data of each text and what stands in for them."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            edits = [personal_edits(t or "") for t in batch.column("text").to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(edits, _EDITS)], [*batch.schema.names, "edits"])

    kept = docs.drop("edits")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(find, f"{schema}, edits {EDITS}")


def apply_edits(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Edits `text` and its trees: doc_id, text, both trees, n_tokens before, n_edits, n_tokens_edited, n_encoded.

    `docs` holds doc_id, text, tree_chars, tree_tokens and edits (start, end and replacement, in characters of
    the old text, not overlapping; null: none). `n_encoded` counts the pre-tokens that were encoded again.
    """

    def change(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(tokenizer)
        for batch in bounded(batches, "text"):
            texts, counts, trees = [], [], ([], [])
            for text, a, b, edits in zip(*(batch.column(c) for c in ("text", "tree_chars", "tree_tokens", "edits")), strict=True):
                chars, tokens = (np.array(x.values, np.int64) for x in (a, b))
                text, edits, before = text.as_py(), edits.as_py() or [], int(tokens[1])
                done = apply(pieces, text or "", chars, tokens, edits)
                texts.append(spliced(text or "", 0, len(text or ""), sorted(edits, key=lambda e: (e["start"], e["end"]))) if edits else text)
                counts.append((before, len(edits), int(tokens[1]), done))
                trees[0].append(chars)
                trees[1].append(tokens)
            lists = [list_column(np.concatenate(t), np.array([len(x) for x in t]), pa.int32()) for t in trees]
            numbers = [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string()), *lists, *numbers], names)

    names = ["doc_id", "text", "tree_chars", "tree_tokens", "n_tokens", "n_edits", "n_tokens_edited", "n_encoded"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "tree_chars", "tree_tokens", "edits").mapInArrow(
        change,
        f"doc_id {kind}, text string, tree_chars array<int>, tree_tokens array<int>, "
        "n_tokens bigint, n_edits bigint, n_tokens_edited bigint, n_encoded bigint",
    )
