"""Words and n-grams of a column of texts as 64-bit hashes, computed by numpy on UTF-8 bytes.

A word is a longest run of bytes of one class. Both classes in use treat every byte of a character beyond
ASCII alike, so runs of bytes and runs of characters are the same. A-Z count as a-z.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BYTES = np.arange(256)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing
ALNUM = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
#: `[^\x20\x09-\x0D]+`
NON_SPACE = ~((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)))

_BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_GRAM = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """The bits of 64-bit integers spread over the whole width; one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_POWERS: list[np.ndarray] = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def gram_of(hashes: np.ndarray) -> np.ndarray:
    """The hash of one run of words, as Words.grams() has it."""
    value = np.full(1, len(hashes), np.uint64)
    for k in range(len(hashes)):
        value = value * _GRAM + hashes[k : k + 1]
    return mixed(value)


@dataclass
class Words:
    """Words of a batch: byte places, hashes, and the first word of each row (one entry more than rows)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count())

    def bytes_of(self, i: int) -> bytes:
        return LOWER[self.data[self.start[i] : self.end[i]]].tobytes()

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (of first words) and hashes of all runs of n words inside a row."""
        if len(self.hash) < n:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        total = len(self.hash) - n + 1
        value = np.full(total, n, np.uint64)
        for k in range(n):
            value = value * _GRAM + self.hash[k : k + total]
        last = np.repeat(self.first[1:] - n, self.count())[:total]
        place = np.flatnonzero(np.arange(total) <= last)
        return place, mixed(value[place])


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column, nulls as empty, and each row's start in them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> Words:
    """All words of a batch, block by block, so that scratch memory does not follow the batch's size."""
    starts, ends, hashes = [], [], []
    i = 0
    while i < len(data):
        j = min(i + _BLOCK, len(data))
        while j < len(data) and is_word[LOWER[data[j]]]:  # a word is not cut
            tail = is_word[LOWER[data[j : j + 4096]]]
            gap = np.flatnonzero(~tail)
            if len(gap):
                j += int(gap[0])
                break
            j += len(tail)
        low = LOWER[data[i:j]]
        inside = is_word[low]
        before = np.zeros_like(inside)
        before[1:] = inside[:-1]
        after = np.zeros_like(inside)
        after[:-1] = inside[1:]
        rows = offsets[np.searchsorted(offsets, i, "left") : np.searchsorted(offsets, j, "left")] - i
        before[rows] = False
        after[rows[rows > 0] - 1] = False
        a, b = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        up, down = powers(j - i)
        total = np.zeros(j - i + 1, np.uint64)
        np.cumsum(_VALUE[low] * up, out=total[1:])
        starts.append(a + i)
        ends.append(b + i)
        hashes.append(mixed((total[b] - total[a]) * down[a]))
        i = j
    start = np.concatenate(starts) if starts else np.empty(0, np.int64)
    return Words(
        data,
        start,
        np.concatenate(ends) if ends else np.empty(0, np.int64),
        np.concatenate(hashes) if hashes else np.empty(0, np.uint64),
        np.searchsorted(start, offsets, "left"),
    )


def words_of(texts: pa.Array, is_word: np.ndarray) -> Words:
    return words(*text_bytes(texts), is_word)


def hash_words(parts: list[bytes]) -> np.ndarray:
    """Hashes of single words that are given as lower-case bytes."""
    if not parts:
        return np.empty(0, np.uint64)
    lengths = np.array([len(p) for p in parts])
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    found = words(np.frombuffer(b"".join(parts), np.uint8), offsets, np.ones(256, bool))
    return found.hash


def list_column(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column of the given values, cut by the rows' counts."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
