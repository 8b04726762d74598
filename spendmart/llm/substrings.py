"""Substring deduplication: Rabin-Karp hashes of fixed-length word windows, counted in Spark.

A word goes if a window covering it also starts in a document with a smaller id. Comparing all windows
by shuffling one row per word would move many times the text, so windows travel in runs:

1. Every window is represented by its anchor, the smallest hash of the shorter word runs inside it.
   Equal windows have equal anchors. Consecutive windows with one anchor form a run (about twenty of them),
   and a run travels as one row: anchor, hash of all words it covers, position.
2. Runs are counted. A run that a smaller document holds word for word is removed whole.
3. Only where one anchor occurs in different runs, at the rims of shared passages, are single windows
   hashed (two lanes) and counted, once per distinct run.

All counts are min/max aggregates, combined before the shuffle, so a passage held by a third of all
documents is one row per task. Nothing is collected; text is shuffled twice, by document. Runs, windows and
their counts are deleted once the cuts are known, before the text is shuffled for the second time.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendmart.llm import textbytes as tb
from spendmart.llm.shared import materialize, scratch

_RUNS = "doc_id long, fp long, anchor long, run long, start int, n int"
_WINDOWS = "doc_id long, fp long, lane1 long, lane2 long, start int"
_LANE = np.uint64(0xD6E8FEB86659FD93)


def _anchored(words: tb.Words, width: int):
    """Runs of windows with one anchor: (row, first word of the run, windows in it, anchor, hash of the words covered)."""
    inner = max(1, width // 5)
    rows = words.rows()
    anchors = tb.sliding_min(tb.rolling(words.hashes, inner), width - inner + 1)
    n = len(anchors)
    at = np.arange(n)
    valid = at + width <= words.first[rows[:n] + 1]
    at = at[valid]
    anchors, rows = anchors[valid], rows[:n][valid]
    if not len(at):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    new = np.ones(len(at), bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (rows[1:] != rows[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(at)))
    starts = at[first]
    covered = tb.slices(tb.running(words.hashes), starts, starts + size - 1 + width)
    return rows[first], starts, size, anchors[first], covered


def _batch(columns: dict, schema: str) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = [f.strip().split() for f in schema.split(",")]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[name], types[kind], from_pandas=False) for name, kind in fields],
        schema=pa.schema([(name, types[kind]) for name, kind in fields]),
    )


def _runs_of(width: int):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            prints = batch.column("fp").to_numpy(zero_copy_only=False)
            for chunk in tb.chunks(batch.column("text")):
                words = tb.words(chunk)
                rows, starts, size, anchors, covered = _anchored(words, width)
                yield _batch({
                    "doc_id": ids[chunk.first + rows], "fp": prints[chunk.first + rows], "anchor": tb.signed(anchors),
                    "run": tb.signed(covered), "start": starts - words.first[rows], "n": size,
                }, _RUNS)

    return run


def _windows_of(width: int):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            prints = batch.column("fp").to_numpy(zero_copy_only=False)
            wanted = batch.column("runs").combine_chunks() if isinstance(batch.column("runs"), pa.ChunkedArray) else batch.column("runs")
            for chunk in tb.chunks(batch.column("text")):
                words = tb.words(chunk)
                rows, starts, size, _, covered = _anchored(words, width)
                listed = wanted.slice(chunk.first, chunk.last - chunk.first)
                keep = np.isin(tb.signed(covered), listed.flatten().to_numpy(zero_copy_only=False))
                rows, starts, size = rows[keep], starts[keep], size[keep]
                at = tb.ragged(starts, size)
                rows = np.repeat(rows, size)
                yield _batch({
                    "doc_id": ids[chunk.first + rows], "fp": prints[chunk.first + rows],
                    "lane1": tb.signed(tb.rolling(words.hashes, width)[at]),
                    "lane2": tb.signed(tb.rolling(tb.mix(words.hashes ^ _LANE), width)[at]),
                    "start": at - words.first[rows],
                }, _WINDOWS)

    return run


def printed(docs: DataFrame) -> DataFrame:
    """Adds `fp`, which tells apart texts that share an id."""
    return docs.withColumn("fp", F.coalesce(F.xxhash64("text"), F.lit(0)))


def repeated_windows(docs: DataFrame, width: int = 50) -> DataFrame:
    """(doc_id, fp, cuts array<struct<start, n>>): starts of the windows that a smaller document also holds.

    docs: doc_id, text. A null text has no words; a null id neither owns nor loses a window; rows that share
    an id are one document to each other.
    """
    marked = printed(docs).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    runs = materialize(marked.select("doc_id", "fp", "text").mapInArrow(_runs_of(width), _RUNS), "runs")
    owners = materialize(
        runs.groupBy("anchor", "run").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")), "run-owners"
    )
    mixed = materialize(
        owners.groupBy("anchor")
        .agg(F.count(F.lit(1)).alias("kinds"), F.min("owner").alias("low"), F.max("last").alias("high"))
        .filter("kinds > 1 AND low < high")
        .select("anchor"),
        "mixed-anchors",
    )
    rims = owners.join(mixed, "anchor").groupBy(F.col("owner").alias("doc_id")).agg(F.collect_set("run").alias("runs"))
    windows = materialize(
        marked.join(rims, "doc_id").select("doc_id", "fp", "text", "runs").mapInArrow(_windows_of(width), _WINDOWS), "windows"
    )
    counted = materialize(
        windows.groupBy("lane1", "lane2")
        .agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"))
        .filter("owner < last")
        .select("lane1", "lane2", "owner"),
        "window-owners",
    )
    whole = runs.join(owners.filter("owner < last").select("anchor", "run", "owner"), ["anchor", "run"])
    single = windows.join(counted, ["lane1", "lane2"]).withColumn("n", F.lit(1))
    cuts = [x.filter("owner < doc_id").select("doc_id", "fp", F.struct("start", "n").alias("cut")) for x in (whole, single)]
    return cuts[0].unionByName(cuts[1]).groupBy("doc_id", "fp").agg(F.collect_list("cut").alias("cuts"))


def _removed(width: int, keep: list[str]):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            cuts = batch.column("cuts").to_pylist()
            out = {"n_words": [], "n_removed": [], "kept_sha256": [], "kept_text": [], "intervals": []}
            for text, cut in zip(texts, cuts, strict=True):
                words = (text or b"").split()
                spans: list[list[int]] = []
                for start, end in sorted((c["start"], c["start"] + c["n"] - 1 + width) for c in cut or ()):
                    if spans and start <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], end)
                    else:
                        spans.append([start, end])
                kept, at = [], 0
                for start, end in spans:
                    kept += words[at:start]
                    at = end
                kept += words[at:]
                joined = b" ".join(kept)
                out["n_words"].append(len(words))
                out["n_removed"].append(len(words) - len(kept))
                out["kept_sha256"].append(hashlib.sha256(joined).hexdigest())
                out["kept_text"].append(joined.decode("utf-8", "replace") if spans else None)
                out["intervals"].append(spans)
            arrays = [batch.column(c) for c in keep]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.list_(pa.int64()))]
            arrays += [pa.array(v, kind) for v, kind in zip(out.values(), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *out])

    return run


def remove_repeats(docs: DataFrame, width: int = 50, keep: list[str] | None = None) -> DataFrame:
    """Per row: doc_id, text, `keep` columns, n_words, n_removed, kept_sha256, kept_text, intervals.

    docs: doc_id, text. intervals are the maximal word ranges [from, to) removed; kept_text is the rest joined
    by one space, null where nothing was removed. Null text: no words. Empty table: empty result.
    """
    extra = [c for c in keep or [] if c not in ("doc_id", "text")]
    docs = docs.select("doc_id", "text", *extra)
    with scratch(docs.sparkSession) as keep_table:
        cuts = keep_table(repeated_windows(docs.select("doc_id", "text"), width), "cuts")
    names = ["doc_id", "text", *extra]
    kept = docs.select(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    schema += ", n_words long, n_removed long, kept_sha256 string, kept_text string, intervals array<array<long>>"
    return printed(docs).join(cuts, ["doc_id", "fp"], "left").select(*names, "cuts").mapInArrow(_removed(width, names), schema)
