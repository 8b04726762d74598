"""Pre-tokens of many texts at once, and their distinct forms.

The splitting rule is the one of byte-level BPE vocabularies: contractions, then letters, digits or other signs
with one optional space before them, then blanks. Character classes come from a table over all code points, and
the boundaries follow from class changes between neighbouring bytes, so no text is walked character by character.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import regex

from spendmart.llm import textbytes as tb

OTHER, LETTER, DIGIT, BLANK = 0, 1, 2, 3
# What may follow an apostrophe as a token of its own
CONTRACTIONS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")

_tables: dict[str, np.ndarray] = {}


def _classes() -> np.ndarray:
    """Class of every code point."""
    if "classes" not in _tables:
        out = np.zeros(0x110000, np.uint8)
        text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", DIGIT), (r"\s+", BLANK)):
            for match in regex.finditer(pattern, text):
                a, b = (x if x < 0xD800 else x + 0x800 for x in match.span())
                out[a:b] = kind
        _tables["classes"] = out
    return _tables["classes"]


def byte_classes(data: np.ndarray) -> np.ndarray:
    """Class of the character that each byte belongs to."""
    table = _classes()
    out = table[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if not len(lead) and not (data >= 0x80).any():
        return out
    out[data >= 0x80] = OTHER
    padded = np.append(data, np.zeros(3, np.uint8)).astype(np.uint32)
    a, b, c, d = (padded[lead + k] for k in range(4))
    two = ((a & 0x1F) << 6) | (b & 0x3F)
    three = ((a & 0x0F) << 12) | ((b & 0x3F) << 6) | (c & 0x3F)
    four = ((a & 0x07) << 18) | ((b & 0x3F) << 12) | ((c & 0x3F) << 6) | (d & 0x3F)
    point = np.where(a < 0xE0, two, np.where(a < 0xF0, three, np.minimum(four, 0x10FFFF)))
    kinds = table[point]
    out[lead] = kinds
    for step, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
        more = a >= least
        at = lead[more] + step
        out[at[at < len(out)]] = kinds[more][at < len(out)]
    return out


def split(chunk: tb.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all pre-tokens, and the index of each row's first one; the tokens fill the bytes without gaps."""
    data, n = chunk.data, len(chunk.data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(chunk.offsets), np.int64)
    kinds = byte_classes(data)
    opens = np.zeros(n + 1, bool)
    opens[chunk.offsets] = True
    change = opens[:n].copy()
    change[1:] |= kinds[1:] != kinds[:-1]
    token = np.zeros(n + 1, bool)
    run = np.flatnonzero(change)
    token[run] = True
    ends = np.append(run[1:], n)
    # a run of blanks leaves its last character to what follows; a plain space joins it
    blank = kinds[run] == BLANK
    inner = blank & ~opens[ends]
    stop = ends[inner]
    last = stop - 1
    for _ in range(3):
        last = np.where((data[last] & 0xC0) == 0x80, last - 1, last)
    token[last] = True
    token[stop] = data[stop - 1] != 0x20
    _contractions(data, token, opens)
    token = token[:n]
    starts = np.flatnonzero(token)
    return starts, np.searchsorted(starts, chunk.offsets)


def _contractions(data: np.ndarray, token: np.ndarray, opens: np.ndarray) -> None:
    n = len(data)
    at = np.flatnonzero((data == 0x27) & token[:n])
    at = at[at + 1 < n]
    at = at[~opens[at + 1]]
    for letters in CONTRACTIONS:
        k = len(letters)
        fits = at[at + k < n]
        if k == 2:
            fits = fits[~opens[fits + 2]]
        for i, letter in enumerate(letters):
            fits = fits[data[fits + 1 + i] == letter]
        token[fits + 1] = False
        token[fits + 1 + k] = True


def distinct(chunk: tb.Chunk, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, last byte + 1) of every distinct pre-token, and for all tokens which one they are.

    The hash covers the length too.
    """
    ends = np.append(starts[1:], len(chunk.data))
    hashes = tb.slices(tb.running(tb.BYTE_VALUES[chunk.data]), starts, ends)
    hashes = tb.mix(hashes ^ (ends - starts).astype(np.uint64))
    unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    return unique, starts[first], ends[first], inverse


class Memo:
    """Ids of pre-tokens met before, by hash; only speed depends on it. Starts anew beyond `limit` entries.

    Entries stand in sorted arrays of falling size; a new one is merged with those before it that are not twice as long.
    """

    def __init__(self, limit: int = 3 << 20) -> None:
        self.limit = limit
        self._clear()

    def _clear(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # hashes, where their ids start, how many
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where the ids of each hash start, how many), -1 where unknown."""
        starts, sizes = np.full(len(hashes), -1), np.zeros(len(hashes), np.int64)
        for keys, begin, count in self.levels:
            at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == hashes)
            starts[hit], sizes[hit] = begin[at[hit]], count[at[hit]]
        return starts, sizes

    def _add(self, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        level = (hashes, self.used + np.cumsum(sizes) - sizes, sizes)
        self.used += len(ids)
        while self.levels and len(self.levels[-1][0]) < 2 * len(level[0]):
            both = [np.concatenate(pair) for pair in zip(self.levels.pop(), level, strict=True)]
            order = np.argsort(both[0], kind="stable")
            level = tuple(x[order] for x in both)
        self.levels.append(level)

    def lookup(self, hashes: np.ndarray, encode: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, how many per hash) of sorted distinct hashes; `encode` gives those never met, asked by position."""
        if sum(len(level[0]) for level in self.levels) > self.limit:
            self._clear()
        starts, sizes = self.find(hashes)
        new = np.flatnonzero(starts < 0)
        if len(new):
            ids, counts = encode(new)
            starts[new], sizes[new] = self.used + np.cumsum(counts) - counts, counts
            self._add(hashes[new], ids.astype(np.uint32), counts)
        return self.ids[tb.ragged(starts, sizes)], sizes


def spread(ids: np.ndarray, sizes: np.ndarray, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all tokens in text order, and how many each has, from those of the distinct ones."""
    starts = np.cumsum(sizes) - sizes
    return ids[tb.ragged(starts[inverse], sizes[inverse])], sizes[inverse]


def per_row(sizes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where each row's ids begin, one more than rows."""
    return np.append(0, np.cumsum(sizes))[first]
