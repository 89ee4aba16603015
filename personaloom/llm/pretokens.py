"""Byte-level BPE of whole columns: pre-tokens found by numpy, each distinct one encoded once by `tokenizers`.

The BPE of these vocabularies never crosses a pre-token, so the ids of a text are those of its pre-tokens in
order. Finding the pre-tokens of a batch as arrays and asking the library for the distinct new ones gives the
library's own ids several times faster than encoding the texts one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from personaloom.llm.wordhash import mixed, powers, text_bytes

_SLICE = 1 << 19
_MARK = "<|endoftext|>"
_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3
#: Unicode's White_Space (fixed values)
_WHITE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _classes() -> np.ndarray:
    import regex

    table = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1]) + 1
            table[a:b] = kind
    table[_WHITE] = _SPACE
    return table


_TABLES: list[np.ndarray] = []


def tables() -> list[np.ndarray]:
    """Class and random value of every code point, made once per Python worker."""
    if not _TABLES:
        _TABLES.extend([_classes(), mixed(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))])
    return _TABLES


def cuts(cp: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Starts of all pre-tokens in code points `cp`; `rows` are the starts of its texts, which pre-tokens don't cross.

    Pattern: 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
    """
    n = len(cp)
    if not n:
        return np.empty(0, np.int64)
    kind = tables()[0][cp]
    opens = np.zeros(n + 3, bool)
    opens[rows[rows < n]] = True
    opens[n:] = True
    cut = opens.copy()
    cut[1:n] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(cut[:n])
    end = np.append(run[1:], n)
    # white space before something else of the same text leaves its last character apart; a blank joins what follows
    inner = (kind[run] == _SPACE) & ~opens[end]
    cut[end[inner & (end - run >= 2)] - 1] = True
    cut[end[inner & (cp[end - 1] == 32)]] = False
    quote = run[(cp[run] == 39) & (end - run == 1) & cut[run]]
    if len(quote):
        padded = np.append(cp, np.zeros(3, cp.dtype))
        a, b = padded[quote + 1], padded[quote + 2]
        a = np.where(opens[quote + 1], 0, a)
        b = np.where(opens[quote + 1] | opens[quote + 2], 0, b)
        two = np.isin(a, [ord(c) for c in "stmd"])
        three = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        cut[quote[two | three] + 1] = False
        cut[quote[two] + 2] = True
        cut[quote[three] + 3] = True
    return np.flatnonzero(cut[:n])


@dataclass
class Slice:
    """Pre-tokens of some rows: first row and row count, the cached piece of each, and counts per row."""

    row: int
    rows: int
    text: str
    starts: np.ndarray
    piece: np.ndarray
    first: np.ndarray


class PieceEncoder:
    """Ids of texts; keeps the ids of at most `limit` distinct pre-tokens, then starts anew."""

    def __init__(self, path: str, limit: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of_id = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of_id[i] = len(token)
        self.clear()

    def clear(self) -> None:
        self.count = 0
        self.table = np.zeros(1 << 14, np.uint64)  # keys by open addressing, and the number of each, -1 for none
        self.number = np.full(len(self.table), -1, np.int32)
        self.offset = np.zeros(1 << 12, np.int64)
        self.length = np.zeros(1 << 12, np.int32)
        self.ids = np.zeros(1 << 14, np.int32)
        self.used = 0

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for those that are not kept."""
        last = len(self.table) - 1
        slot = (keys & np.uint64(last)).astype(np.int64)
        found = self.number[slot]
        left = np.flatnonzero((found >= 0) & (self.table[slot] != keys))
        while len(left):  # their slot is another key's: the next one
            slot[left] = (slot[left] + 1) & last
            found[left] = self.number[slot[left]]
            left = left[(found[left] >= 0) & (self.table[slot[left]] != keys[left])]
        return found

    def _keep(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """Enters distinct keys that are not kept yet; the table stays at most half full."""
        if 2 * (self.count + len(keys)) > len(self.table):
            old = np.flatnonzero(self.number >= 0)
            keys, numbers = np.concatenate([self.table[old], keys]), np.concatenate([self.number[old], numbers])
            size = 1 << int(4 * len(keys) - 1).bit_length()
            self.table, self.number = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        last = len(self.table) - 1
        slot = (keys & np.uint64(last)).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.number[slot[left]] < 0]
            self.number[slot[free]] = numbers[free]  # of several keys at one slot the last one stays
            mine = free[self.number[slot[free]] == numbers[free]]
            self.table[slot[mine]] = keys[mine]
            left = np.setdiff1d(left, mine, assume_unique=True)
            slot[left] = (slot[left] + 1) & last

    def _append(self, numbers: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> None:
        while self.used + len(flat) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.length[numbers] = lengths
        self.offset[numbers] = self.used + np.cumsum(lengths) - lengths
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)

    def _add(self, keys: np.ndarray, pieces: list[str]) -> None:
        """Encodes pieces whose keys are not kept yet, and keeps their ids."""
        n = self.count
        while n + len(pieces) > len(self.offset):
            self.offset, self.length = np.resize(self.offset, 2 * len(self.offset)), np.resize(self.length, 2 * len(self.length))
        blank = [i for i, p in enumerate(pieces) if p.isspace()]
        if blank:
            found = [e.ids for e in self.tokenizer.encode_batch_fast([pieces[i] for i in blank], add_special_tokens=False)]
            flat = np.array([x for ids in found for x in ids], np.int32)
            self._append(n + np.array(blank), np.array([len(x) for x in found], np.int64), flat)
        solid = np.setdiff1d(np.arange(len(pieces)), blank)
        for k in range(0, len(solid), 4096):  # a line break never joins what stands around it
            group = solid[k : k + 4096]
            joined = "\n".join([pieces[i] for i in group.tolist()])
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int32)
            raw = np.frombuffer(joined.encode() + b"\n", np.uint8)
            ends = np.flatnonzero(raw == 10)
            at = np.cumsum(self.bytes_of_id[ids])
            stop = np.searchsorted(at, ends, "left") + 1
            if len(ends) != len(group) or not (at[stop - 1] == ends).all():
                raise ValueError("the tokenizer joined pre-tokens")
            own = np.ones(len(ids), bool)
            own[stop[:-1]] = False  # the line breaks
            self._append(n + group, np.diff(stop, prepend=-1) - 1, ids[own])
        self._keep(keys, n + np.arange(len(pieces)))
        self.count += len(pieces)

    def pieces(self, text: str, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the pre-tokens of joined texts, and the cached number of each."""
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        starts = cuts(cp, rows)
        ends = np.append(starts[1:], len(cp))
        up, down = powers(len(cp))
        total = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum(tables()[1][cp] * up, out=total[1:])
        keys = mixed((total[ends] - total[starts]) * down[starts])
        number = self._find(keys)
        new = np.flatnonzero(number < 0)
        if len(new):
            distinct, place, back = np.unique(keys[new], return_index=True, return_inverse=True)
            if self.count + len(distinct) > self.limit:
                self.clear()
                new = np.arange(len(keys))
                distinct, place, back = np.unique(keys, return_index=True, return_inverse=True)
            n, at = self.count, new[place]
            self._add(distinct, [text[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            number[new] = n + back
        return starts, number.astype(np.int64)

    def slices(self, texts: pa.Array) -> Iterator[Slice]:
        """The batch in slices of about half a megabyte, so that scratch memory stays small."""
        data, offsets = text_bytes(texts)
        i = 0
        while i < len(offsets) - 1:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _SLICE, "right")) - 1)
            raw = data[offsets[i] : offsets[j]]
            heads = np.zeros(len(raw) + 1, np.int64)
            np.cumsum((raw & 0xC0) != 0x80, out=heads[1:])
            rows = heads[offsets[i : j + 1] - offsets[i]]
            text = raw.tobytes().decode()
            starts, piece = self.pieces(text, rows[:-1])
            yield Slice(i, j - i, text, starts, piece, np.searchsorted(starts, rows, "left"))
            i = j

    def ids_of(self, piece: np.ndarray) -> np.ndarray:
        lengths = self.length[piece].astype(np.int64)
        total = np.cumsum(lengths)
        shift = np.repeat(self.offset[piece] - (total - lengths), lengths)
        return self.ids[shift + np.arange(len(shift))]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the batch and each row's number of them, as the library's encode() gives them.

        The end mark's string inside a text is one id, as the library has it by default.
        """
        parts, counts = [], []
        for s in self.slices(texts):
            sums = np.append(0, np.cumsum(self.length[s.piece]))
            each = sums[s.first[1:]] - sums[s.first[:-1]]
            if _MARK in s.text:
                own = []
                edges = np.append(s.starts, len(s.text))[s.first]
                for r in range(s.rows):
                    text = s.text[edges[r] : edges[r + 1]]
                    if _MARK in text:
                        own.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32))
                    else:
                        own.append(self.ids_of(s.piece[s.first[r] : s.first[r + 1]]))
                each = np.array([len(x) for x in own], np.int64)
                parts.extend(own)
            else:
                parts.append(self.ids_of(s.piece))
            counts.append(each)
        ids = np.concatenate(parts) if parts else np.empty(0, np.int32)
        return ids, np.concatenate(counts) if counts else np.empty(0, np.int64)


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder per Python worker and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]
