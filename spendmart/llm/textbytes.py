"""Words and rolling hashes of many texts at once, as numpy arrays over their UTF-8 bytes.

Tasks hand in Arrow string columns. A column is cut into runs of whole rows of about a megabyte, so
memory follows the longest single text, not the batch. Hashes are polynomials modulo 2**64 with an odd
base (Rabin-Karp): one running sum gives the hash of every slice, because the base has an inverse.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_tables: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables["up"]) < n:
        size = 1 << max(21, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _tables[name] = np.cumprod(steps)
    return _tables["up"], _tables["down"]


def running(values: np.ndarray) -> np.ndarray:
    """Sums S with S[j] - S[i] = the polynomial of values[i:j] times base**i."""
    up, _ = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return sums


def slices(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed hash of every slice [start, end)."""
    _, down = _powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts])


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of `width` values."""
    sums = running(values)
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    _, down = _powers(len(sums))
    return mix((sums[width:] - sums[:n]) * down[:n])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of `width` values, by doubling."""
    if len(values) < width:
        return values[:0]
    out, span = values, 1
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[:-rest], out[rest:]) if rest else out


@dataclass
class Chunk:
    """Rows [first, last) of a column: their bytes end to end, and where each begins."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    def text(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()


def chunks(column: pa.Array, limit: int = CHUNK_BYTES, rows: int = 1 << 30) -> Iterator[Chunk]:
    """Runs of whole rows of about `limit` bytes and at most `rows` rows; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(first + 1, last), first + rows, n)
        yield Chunk(first, last, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


@dataclass
class Words:
    """starts, ends: byte positions; hashes: one per word; first[r]: index of row r's first word."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


# Word bytes: anything but blanks, and letters, digits and everything beyond ASCII
NOT_BLANK = ~byte_set((0x20, 0x20), (0x09, 0x0D))
ALPHANUMERIC = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def words(chunk: Chunk, word_bytes: np.ndarray = NOT_BLANK, lower: bool = False) -> Words:
    """Maximal runs of word bytes; a word never spans two rows."""
    data = LOWER[chunk.data] if lower else chunk.data
    n = len(data)
    inside = word_bytes[data]
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    edges = chunk.offsets[:-1][chunk.offsets[:-1] < n]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    last = chunk.offsets[1:]
    after[last[last > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    hashes = slices(running(BYTE_VALUES[data]), starts, ends)
    return Words(starts, ends, hashes, np.searchsorted(starts, chunk.offsets))


def shingles(words_: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every `width`-word shingle; a row with fewer words, but not none, has its whole sequence as one."""
    rows = words_.rows()
    n = len(rows)
    grams = rolling(words_.hashes, width)
    whole = np.arange(len(grams))
    whole = whole[whole + width <= words_.first[rows[: len(grams)] + 1]]
    counts = words_.counts
    short = np.flatnonzero((counts > 0) & (counts < width))
    out_rows, out = rows[whole], grams[whole]
    if len(short) and n:
        first, last = words_.first[short], words_.first[short + 1]
        out_rows = np.concatenate([out_rows, short])
        out = np.concatenate([out, slices(running(words_.hashes), first, last)])
    return out_rows, out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... of every slice, end to end."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    lead = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(lead - starts, lengths)


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as a Spark long."""
    return x.view(np.int64)
