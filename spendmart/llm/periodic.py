"""Periodic runs of words, by online dyadic square catching.

A square is a phrase said twice in a row: q words and the same q words again. Any q words in a row hold a whole
aligned block of L words, L the power of two with 2L - 1 <= q <= 4L - 2. So when a block of L words is complete, a
catcher waits for that block to come again 2L - 1 to 4L - 2 words later: with every appended word, the last L words
(the suffix, compared by its hash) are held against the two blocks at such a distance. A hit at distance q says that
w[i] = w[i + q] over that block; neighbouring blocks that hit at one distance are one comparison carried on. Where it
ends, it is extended on both sides in halving steps. A stretch of at least q such words is a square, and
all squares of a stretch merge into one run. Hashes of the blocks of 2L words come from those of L words, so a word
costs a constant number of steps per level, and there are log2 of the longest period of levels.

The catcher takes words in batches of any size and keeps, per level, the hashes of the words that a later comparison
may reach. Words of many short texts are appended end to end with a separator that equals nothing, not even itself.
Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spendmart.llm import textbytes as tb

_STEP = np.uint64(0x9E3779B97F4A7C15)
BATCH = 1 << 16  # words appended at a time


class SquareCatcher:
    """Append words, as hashes; `runs` gives the merged squares whose exponent and length suffice.

    `longest` bounds the distance of two equal words that belong to one run: with texts of n words and an exponent of
    e it is n / e, so no run is lost.
    """

    def __init__(self, longest: int, exponent: int, least: int) -> None:
        self.exponent, self.least, self.longest = exponent, least, longest
        self.levels = 1
        while 2 * (1 << self.levels) - 1 <= longest:
            self.levels += 1
        self.hashes = [np.zeros(0, np.uint64) for _ in range(self.levels)]
        self.size = 0
        self.hits: list[list[np.ndarray]] = [[] for _ in range(self.levels)]

    def append(self, words: np.ndarray) -> None:
        """Each word completes one suffix per level; suffixes are held against the completed blocks before them."""
        before, self.size = self.size, self.size + len(words)
        self._grow(0, words)
        for level in range(self.levels):
            width = 1 << level
            if level:
                below = self.hashes[level - 1]
                done, now = len(self.hashes[level]), max(0, self.size - width + 1)
                half = width >> 1
                self._grow(level, tb.mix(below[done:now] * _STEP + below[done + half : now + half]))
            self._catch(level, max(0, before - width + 1), max(0, self.size - width + 1))

    def _grow(self, level: int, more: np.ndarray) -> None:
        self.hashes[level] = np.concatenate([self.hashes[level], more]) if len(self.hashes[level]) else more

    def _catch(self, level: int, first: int, last: int) -> None:
        """Suffixes that begin in [first, last) against the two blocks 2L - 1 to 4L - 2 words before them."""
        width, known = 1 << level, self.hashes[level]
        at = np.arange(first, last)
        newest = (at - (2 * width - 1)) // width * width
        for block in (newest, newest - width):
            inside = block >= 0
            here, there = at[inside], block[inside]
            same = (known[here] == known[there]) & (here - there <= self.longest)
            if same.any():
                self.hits[level].append(np.stack([there[same], here[same] - there[same]]))

    def squares(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(start, length, distance) of maximal stretches that equal themselves `distance` words later, level by level."""
        for level, hits in enumerate(self.hits):
            if not hits:
                continue
            block, gap = np.concatenate(hits, axis=1)
            order = np.lexsort((block, gap))
            block, gap = block[order], gap[order]
            width = 1 << level
            fresh = np.ones(len(block), bool)
            fresh[1:] = (gap[1:] != gap[:-1]) | (block[1:] != block[:-1] + width)
            opens = np.flatnonzero(fresh)
            shuts = np.append(opens[1:], len(block)) - 1
            start, end, gap = block[opens], block[shuts] + width, gap[opens]
            for step in range(level - 1, -1, -1):  # a whole block more would have been a hit, so halving steps suffice
                w, known = 1 << step, self.hashes[step]
                ok = end + gap + w <= self.size
                ok[ok] = known[end[ok]] == known[end[ok] + gap[ok]]
                end += ok * w
                ok = start >= w
                ok[ok] = known[start[ok] - w] == known[start[ok] - w + gap[ok]]
                start -= ok * w
            yield start, end - start, gap

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, period) by start, then period; the period is the smallest of its stretch."""
        parts = list(self.squares())
        if not parts:
            return (np.zeros(0, np.int64),) * 3
        start, same, gap = (np.concatenate(p) for p in zip(*parts, strict=True))
        length = same + gap
        fits = (length >= self.exponent * gap) & (length >= self.least)
        start, length, gap = start[fits], length[fits], gap[fits]
        # multiples of a period give the very same stretch
        order = np.lexsort((gap, length, start))
        start, length, gap = start[order], length[order], gap[order]
        first = np.ones(len(start), bool)
        first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
        start, length, gap = start[first], length[first], gap[first]
        order = np.lexsort((gap, start))
        return start[order], length[order], gap[order]


def runs_of(words: tb.Words, exponent: int, least: int, batch: int = BATCH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start in the row, length, period) of all runs of the rows of a chunk."""
    n = len(words.first) - 1
    counts = words.counts
    # one separator after each row: all of them differ, and none is a word
    place = np.arange(len(words.hashes)) + words.rows()
    line = np.zeros(len(words.hashes) + n, np.uint64)
    line[place] = words.hashes
    bars = words.first[1:] + np.arange(n)
    line[bars] = tb.mix(np.arange(1, n + 1, dtype=np.uint64) * _STEP)
    catcher = SquareCatcher(int(counts.max(initial=0)) // exponent, exponent, least)
    if catcher.longest:
        for at in range(0, len(line), batch):
            catcher.append(line[at : at + batch])
    start, length, period = catcher.runs()
    row = np.searchsorted(bars, start)
    return row, start - (words.first[row] + row), length, period


def _runs_in(exponent: int, least: int, keep: list[str]):
    def run(batches):
        for batch in batches:
            for chunk in tb.chunks(batch.column("text")):
                n = chunk.last - chunk.first
                words = tb.words(chunk)
                row, start, length, period = runs_of(words, exponent, least)
                # what follows the first period of a run goes; intervals are opened and shut on one line of words
                change = np.zeros(len(words.hashes) + 1, np.int64)
                np.add.at(change, words.first[row] + start + period, 1)
                np.add.at(change, words.first[row] + start + length, -1)
                kept = np.cumsum(change)[:-1] == 0
                texts = pa.array(_joined(chunk, words, kept), pa.string())
                offsets = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
                spans = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], names=["start", "length", "period"])
                part = batch.slice(chunk.first, n)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array(words.counts), pa.ListArray.from_arrays(pa.array(offsets), spans), texts],
                    names=[*keep, "n_words", "runs", "collapsed_text"],
                )

    return run


def _joined(chunk: tb.Chunk, words: tb.Words, kept: np.ndarray) -> list[str]:
    """The kept words of each row, joined by one space."""
    n = chunk.last - chunk.first
    size = (words.ends - words.starts + 1)[kept]  # with the space after it
    where = tb.ragged(words.starts[kept], size - 1)
    into = np.cumsum(size) - size
    data = np.full(int(size.sum()), 0x20, np.uint8)
    data[tb.ragged(into, size - 1)] = chunk.data[where]
    ends = np.concatenate([[0], np.cumsum(size)])
    first = np.concatenate([[0], np.cumsum(kept)])[words.first]
    raw = data.tobytes()
    return [raw[ends[first[r]] : max(ends[first[r]], ends[first[r + 1]] - 1)].decode("utf-8", "replace") for r in range(n)]


def periodic_runs(docs: DataFrame, exponent: int = 4, least: int = 6, keep: list[str] | None = None) -> DataFrame:
    """Per row of docs (text, `keep` columns; doc_id by default): n_words, runs, collapsed_text.

    Words are maximal runs of anything but ASCII blanks. A run is a stretch of words with smallest period q, at least
    `least` words and `exponent` periods long, that no neighbouring word extends. runs: array<struct<start, length,
    period>> by start, then period. collapsed_text: the words that no run holds after its first period, joined by one
    space. Null and empty texts: no words, no runs, an empty collapsed text. Every row is judged by itself, so repeated
    rows and shared or null ids give one result row each. Memory follows the longest single text. Kept columns may not
    be named text, n_words, runs or collapsed_text (ValueError).
    """
    if exponent < 2 or least < 1:
        raise ValueError("a run repeats: exponent >= 2, least >= 1")
    keep = list(dict.fromkeys(keep or ["doc_id"]))
    if clash := {"text", "n_words", "runs", "collapsed_text"} & {c.lower() for c in keep}:
        raise ValueError(f"names taken by the result: {sorted(clash)}")
    rows = docs.select(*keep, "text")
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    schema += ", n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed_text string"
    return rows.mapInArrow(_runs_in(exponent, least, keep), schema)
