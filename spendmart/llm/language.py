"""Language proportions of a document by expectation maximisation over n-gram likelihoods.

Training counts letter trigrams per language over all labelled documents in Spark; a task adds into a table of fixed
size, so it emits at most languages x FEATURES rows. The merged table is the model: its size follows the number of
languages. A document is a mixture: EM estimates each language's share of its trigrams. Sets of the 1, 2, 3 ... most
present languages compete by likelihood less a penalty per language; the best set's shares are the answer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendmart.llm import textbytes as tb

FEATURES = 1 << 15
SMOOTHING = 0.5
ROUNDS = 12
PENALTY = 1.5  # times the logarithm of the number of trigrams; every letter is in three of them
_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTERS[0x80:] = np.arange(0x80, 0x100)


def trigrams(chunk: tb.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the trigram around every letter byte; other bytes and the ends of a text count as a space."""
    row = np.repeat(np.arange(chunk.last - chunk.first), np.diff(chunk.offsets))
    at = np.arange(len(chunk.data)) + row + 1
    padded = np.full(len(chunk.data) + (chunk.last - chunk.first) + 2, 0x20, np.uint32)
    padded[at] = _LETTERS[chunk.data]
    keep = padded[at] != 0x20
    at, row = at[keep], row[keep]
    packed = (padded[at - 1] << np.uint32(16)) | (padded[at] << np.uint32(8)) | padded[at + 1]
    return row, ((packed * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int64)


def _counts(batches):
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        names = sorted(set(langs))
        number = np.array([names.index(x) for x in langs])
        for chunk in tb.chunks(batch.column("text")):
            row, feature = trigrams(chunk)
            seen = np.bincount(number[chunk.first + row] * FEATURES + feature, minlength=len(names) * FEATURES)
            for k, name in enumerate(names):
                part = seen[k * FEATURES : (k + 1) * FEATURES]
                totals[name] = totals[name] + part if name in totals else part
    for name, seen in totals.items():
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(seen[at])], names=["lang", "feature", "n"])


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their trigram probabilities, from (text, lang); rows without either are left out."""
    rows = labelled.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    counted = rows.mapInArrow(_counts, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(counted.column("lang").to_pylist()))
    counts = np.zeros((len(names), FEATURES))
    if names:
        place = {x: k for k, x in enumerate(names)}
        which = np.array([place[x] for x in counted.column("lang").to_pylist()])
        counts[which, counted.column("feature").to_numpy()] = counted.column("n").to_numpy()
    return names, (counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * FEATURES)


def _em(p: np.ndarray, count: np.ndarray, first: np.ndarray, sizes: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares per document and its log-likelihood. p: probability of each of its features by language."""
    total = np.add.reduceat(count, first)
    for _ in range(ROUNDS):
        weighted = p * np.repeat(share, sizes, axis=0)
        weighted *= (count / weighted.sum(axis=1))[:, None]
        new = np.add.reduceat(weighted, first, axis=0) / total[:, None]
        moved = np.abs(new - share).max() if len(new) else 0
        share = new
        if moved < 1e-3:
            break
    return share, np.add.reduceat(count * np.log((p * np.repeat(share, sizes, axis=0)).sum(axis=1)), first)


def _mixtures(chunk: tb.Chunk, prob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shares by language, whether any trigram was there) of every row."""
    n_rows, n_langs = chunk.last - chunk.first, len(prob)
    shares = np.zeros((n_rows, n_langs))
    row, feature = trigrams(chunk)
    packed, count = np.unique(row * FEATURES + feature, return_counts=True)
    row, feature = packed // FEATURES, packed % FEATURES
    docs, first, sizes = np.unique(row, return_index=True, return_counts=True)
    if not len(docs) or not n_langs:
        return shares, np.zeros(n_rows, bool)
    p, count = np.ascontiguousarray(prob[:, feature].T), count.astype(float)
    full, _ = _em(p, count, first, sizes, np.full((len(docs), n_langs), 1 / n_langs))
    order = np.argsort(-full, axis=1, kind="stable")
    grams = np.add.reduceat(count, first)
    alone = np.add.reduceat(count[:, None] * np.log(p), first, axis=0)
    lead = np.argmax(alone, axis=1)
    best = np.zeros_like(full)
    best[np.arange(len(docs)), lead] = 1
    value = alone[np.arange(len(docs)), lead]
    for k in range(2, n_langs + 1):
        open_ = np.flatnonzero(full[np.arange(len(docs)), order[:, k - 1]] > 0.01)
        if not len(open_):
            break
        at = tb.ragged(first[open_], sizes[open_])
        chosen = np.zeros((len(open_), n_langs), bool)
        np.put_along_axis(chosen, order[open_, :k], True, axis=1)
        began = np.cumsum(sizes[open_]) - sizes[open_]
        share, likelihood = _em(p[at], count[at], began, sizes[open_], np.where(chosen, 1 / k, 0.0))
        likelihood = likelihood - (k - 1) * PENALTY * np.log(grams[open_])
        better = likelihood > value[open_]
        best[open_[better]], value[open_[better]] = share[better], likelihood[better]
    shares[docs] = best
    there = np.zeros(n_rows, bool)
    there[docs] = True
    return shares, there


def _predicted(model, keep: list[str]):
    def run(batches):
        names, prob = model.value
        for batch in batches:
            for chunk in tb.chunks(batch.column("text")):
                shares, there = _mixtures(chunk, prob)
                for r in np.flatnonzero(there):
                    text = chunk.text(r)
                    # a row of digits and signs beyond ASCII has bytes that count as letters, but no letter
                    if not any(65 <= c <= 90 or 97 <= c <= 122 for c in text[:64]):
                        there[r] = any(c.isalpha() for c in text.decode("utf-8", "replace"))
                if not names:
                    there[:] = False
                top = np.argmax(shares, axis=1) if names else np.zeros(len(shares), np.int64)
                langs = [names[k] if ok else "und" for k, ok in zip(top, there, strict=True)]
                score = [float(min(1.0, s[k])) if ok else 0.0 for s, k, ok in zip(shares, top, there, strict=True)]
                mixed = [[(names[k], float(s[k])) for k in np.flatnonzero(s > 0)] if ok else [] for s, ok in zip(shares, there, strict=True)]
                part = batch.slice(chunk.first, chunk.last - chunk.first)
                yield pa.RecordBatch.from_arrays([
                    *(part.column(c) for c in keep), pa.array(langs, pa.string()), pa.array(score, pa.float64()),
                    pa.array(mixed, pa.map_(pa.string(), pa.float64())),
                ], names=[*keep, "lang_pred", "score", "shares"])

    return run


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str] | None = None) -> DataFrame:
    """Per row of docs: `keep` columns (doc_id by default), lang_pred, score, shares (language to proportion).

    score is lang_pred's proportion. A null text, one without letters, or a model without languages: `und`, 0 and no shares.
    Only the text is looked at.
    """
    keep = keep or ["doc_id"]
    names = list(dict.fromkeys([*keep, "text"]))
    rows = docs.select(*names)
    schema = ", ".join(f"`{rows.schema[c].name}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_predicted(sent, keep), schema + ", lang_pred string, score double, shares map<string, double>")
