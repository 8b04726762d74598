"""Benchmark decontamination by suffix arrays of the training text.

The benchmark is a small stated table: its distinct windows travel to every task in blocks of bounded size, so no
training text is shuffled. A task takes a shard (a megabyte of documents), sorts its suffixes and binary-searches every
test suffix in them; equal prefixes give the occurrences of a window, the neighbours of the insertion point the longest
verbatim match. The array leaves out suffixes that begin with no word run of the benchmark: no match can begin there.
Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendmart.llm import textbytes as tb
from spendmart.llm.shared import materialize

BLOCK_WORDS = 2_000_000  # benchmark words broadcast at once
_HEAD = 3  # words by which a suffix is told to be able to match


@dataclass
class Tests:
    """A benchmark block. words: all items end to end; starts, sizes: distinct windows; item lists per window; heads: eligible first words."""

    ids: list
    words: np.ndarray
    stops: np.ndarray  # for every word, where its item ends
    starts: np.ndarray
    sizes: np.ndarray
    items: np.ndarray  # item numbers, end to end
    item_first: np.ndarray
    heads: dict[int, np.ndarray]
    width: int


def _tests(rows: list, width: int) -> Tests:
    chunk = next(tb.chunks(pa.array([r.text for r in rows], pa.string()), limit=1 << 60))
    words = tb.words(chunk, tb.ALPHANUMERIC, lower=True)
    counts = words.counts
    sizes_of_item = np.minimum(counts, width)
    windows = np.where(counts > 0, counts - sizes_of_item + 1, 0)
    starts = tb.ragged(words.first[:-1], windows)
    item = np.repeat(np.arange(len(rows)), windows)
    sizes = sizes_of_item[item]
    key = tb.slices(tb.running(words.hashes), starts, starts + sizes) ^ tb.mix(sizes.astype(np.uint64))
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    pairs = np.unique(np.stack([inverse, item], axis=1), axis=0) if len(item) else np.zeros((0, 2), np.int64)
    heads = {}
    sums = tb.running(words.hashes)
    for k in range(1, _HEAD + 1):
        mine = first[np.minimum(sizes[first], _HEAD) == k]
        heads[k] = np.unique(tb.slices(sums, starts[mine], starts[mine] + k))
    return Tests([r.item_id for r in rows], words.hashes, np.repeat(words.first[1:], counts), starts[first], sizes[first],
                 pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(first) + 1)), heads, width)


def _windows(words: np.ndarray, starts: np.ndarray, stops: np.ndarray, width: int) -> np.ndarray:
    """The `width` words from every start, zero beyond its stop; no word hashes to zero in practice, and a match is checked against stops."""
    at = starts[:, None] + np.arange(width)[None, :]
    inside = at < stops[:, None]
    return np.where(inside, words[np.minimum(at, max(0, len(words) - 1))], 0) if len(words) else np.zeros((len(starts), width), np.uint64)


def _before(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, upper: bool) -> np.ndarray:
    """Row by row: a sorts before b in b's first `sizes` words (upper: or equals it there)."""
    columns = np.arange(a.shape[1])[None, :]
    differ = (a != b) & (columns < sizes[:, None])
    first = np.argmax(differ, axis=1)
    row = np.arange(len(a))
    some = differ[row, first]
    return np.where(some, a[row, first] < b[row, first], upper)


def _search(suffixes: np.ndarray, tests: np.ndarray, sizes: np.ndarray, upper: bool) -> np.ndarray:
    """Insertion points of all tests in the sorted suffixes."""
    low, high = np.zeros(len(tests), np.int64), np.full(len(tests), len(suffixes))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        less = _before(suffixes[np.minimum(middle, len(suffixes) - 1)], tests, sizes, upper)
        low = np.where(open_ & less, middle + 1, low)
        high = np.where(open_ & ~less, middle, high)
    return low


@dataclass
class Shard:
    """Suffix array of a chunk of documents: `at` are word positions in the order of their suffixes."""

    words: tb.Words
    stops: np.ndarray
    at: np.ndarray
    suffixes: np.ndarray

    @classmethod
    def of(cls, chunk: tb.Chunk, tests: Tests) -> Shard:
        words = tb.words(chunk, tb.ALPHANUMERIC, lower=True)
        stops = np.repeat(words.first[1:], words.counts)
        fits = np.zeros(len(words.hashes), bool)
        for k, heads in tests.heads.items():
            if len(heads):
                grams = tb.rolling(words.hashes, k)
                fits[: len(grams)] |= np.isin(grams, heads)
        at = np.flatnonzero(fits)
        suffixes = _windows(words.hashes, at, stops[at], tests.width)
        order = np.lexsort(suffixes.T[::-1]) if len(at) else np.zeros(0, np.int64)
        return cls(words, stops, at[order], suffixes[order])

    def occurrences(self, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
        """(window, word position) of every occurrence of a test window."""
        if not len(self.at) or not len(tests.starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # distinct heads first: most test suffixes have no suffix with their first words here
        rows = _windows(tests.words, tests.starts, tests.starts + tests.sizes, tests.width)
        maybe = np.flatnonzero(np.isin(rows[:, 0], self.suffixes[:, 0]))
        rows, sizes = rows[maybe], tests.sizes[maybe]
        low = _search(self.suffixes, rows, sizes, upper=False)
        high = _search(self.suffixes, rows, sizes, upper=True)
        number = np.repeat(maybe, high - low)
        position = self.at[tb.ragged(low, high - low)]
        whole = position + tests.sizes[number] <= self.stops[position]
        return number[whole], position[whole]

    def longest(self, tests: Tests, number: np.ndarray, position: np.ndarray) -> np.ndarray:
        """How many words match from each occurrence on, to the end of item or document."""
        size = tests.sizes[number].copy()
        ours, theirs = self.words.hashes, tests.words
        live = np.arange(len(number))
        while len(live):
            a, b = position[live] + size[live], tests.starts[number[live]] + size[live]
            inside = (a < self.stops[position[live]]) & (b < tests.stops[tests.starts[number[live]]])
            live, a, b = live[inside], a[inside], b[inside]
            live = live[ours[a] == theirs[b]]
            size[live] += 1
        return size


def _hits(block, keep: list[str]):
    def run(batches):
        tests = block.value
        for batch in batches:
            for chunk in tb.chunks(batch.column("text")):
                shard = Shard.of(chunk, tests)
                number, position = shard.occurrences(tests)
                size = shard.longest(tests, number, position)
                row = shard.words.rows()[position] if len(position) else np.zeros(0, np.int64)
                order = np.argsort(row, kind="stable")
                edges = np.searchsorted(row[order], np.arange(chunk.last - chunk.first + 1))
                spans, items, matches = [], [], []
                for r in range(chunk.last - chunk.first):
                    mine = order[edges[r] : edges[r + 1]]
                    if not len(mine):
                        spans.append([]), items.append([]), matches.append([])
                        continue
                    base = shard.words.first[r]
                    spans.append(_merged(position[mine] - base, tests.sizes[number[mine]]))
                    found = np.unique(tests.items[tb.ragged(tests.item_first[number[mine]], np.diff(tests.item_first)[number[mine]])])
                    items.append(sorted({tests.ids[i] for i in found} - {None}))  # several texts may share an id, or have none
                    matches.append(_maximal(position[mine] - base, size[mine], [tests.ids[tests.items[tests.item_first[k]]] for k in number[mine]]))
                part = batch.slice(chunk.first, chunk.last - chunk.first)
                yield pa.RecordBatch.from_arrays([
                    *(part.column(c) for c in keep), pa.array(shard.words.counts, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                    pa.array(items, pa.list_(pa.string())),
                    pa.array(matches, pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))),
                ], names=[*keep, "n_words", "hits", "items", "matches"])

    return run


def _merged(starts: np.ndarray, sizes: np.ndarray) -> list[list[int]]:
    """Disjoint ranges [from, to) covering all slices."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate((starts + sizes)[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    first = np.flatnonzero(new)
    return np.stack([starts[first], ends[np.append(first[1:], len(starts)) - 1]], axis=1).tolist()


def _maximal(starts: np.ndarray, sizes: np.ndarray, items: list) -> list[dict]:
    """Longest matches: those not inside another that began earlier."""
    out, reach = [], -1
    for k in np.lexsort((-sizes, starts)):
        if starts[k] + sizes[k] > reach:
            out.append({"item_id": items[k], "start": int(starts[k]), "length": int(sizes[k])})
            reach = int(starts[k] + sizes[k])
    return out


_FOUND = "n_words long, hits array<array<long>>, items array<string>, matches array<struct<item_id: string, start: long, length: long>>"


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, width: int = 13, keep: list[str] | None = None) -> DataFrame:
    """Per row of docs (doc_id, text): `keep` columns (doc_id by default), n_words, hits, items, matches.

    hits: word ranges [from, to) inside an occurrence of a benchmark window; items: ids, as text, of the items whose windows occur;
    matches: longest verbatim matches as (item, first word, words). A window is `width` words of an item, or all of a
    shorter one. Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. Null or empty texts have no
    words; the windows of an item without an id hit like any other, it is only not listed; an empty benchmark hits nothing.
    A benchmark of more than BLOCK_WORDS words is searched block by block and the findings are merged per row.
    """
    keep = keep or ["doc_id"]
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").distinct()
    volume = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-volume // (4 * BLOCK_WORDS)))
    names = list(dict.fromkeys([*keep, "text"]))
    rows = docs.select(*names)
    schema = ", ".join(f"`{rows.schema[c].name}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    parts = []
    for b in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy(F.asc_nulls_last("item_id"), "text").collect() if blocks > 1 else items.orderBy(F.asc_nulls_last("item_id"), "text").collect()
        if mine:
            parts.append(spark.sparkContext.broadcast(_tests(mine, width)))
    if len(parts) <= 1:
        block = parts[0] if parts else spark.sparkContext.broadcast(_nothing(width))
        return rows.mapInArrow(_hits(block, keep), f"{schema}, {_FOUND}")
    numbered = materialize(rows.withColumn("_row", F.expr("uuid()")), "numbered")
    found = [numbered.mapInArrow(_hits(p, [*keep, "_row"]), f"{schema}, _row string, {_FOUND}") for p in parts]
    united = found[0]
    for more in found[1:]:
        united = united.unionByName(more)
    merged = united.groupBy("_row").agg(
        *(F.first(F.col(f"`{c}`")).alias(c) for c in keep), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("matches")).alias("matches"),
    )
    return merged.select(*keep, "n_words", "hits", "items", "matches")


def _nothing(width: int) -> Tests:
    none = np.zeros(0, np.int64)
    return Tests([], np.zeros(0, np.uint64), none, none, none, none, np.zeros(1, np.int64), {}, width)


def verdicts(found: DataFrame) -> DataFrame:
    """Adds n_hit, n_items, items_sha256 and contaminated: at least a twentieth of the words are hit."""
    text = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    covered = F.aggregate(
        F.array_sort("hits"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach")),
        lambda s, h: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), h[1] - F.greatest(h[0], s["reach"]))).alias("n"), F.greatest(s["reach"], h[1]).alias("reach")),
        lambda s: s["n"],
    )
    return (
        found.withColumn("n_hit", covered)
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("items_sha256", F.sha2(text.cast("binary"), 256))
        .withColumn("contaminated", F.expr("n_hit > 0 AND 20 * n_hit >= n_words"))
    )
