"""Quality by a regularised quadratic discriminant over document statistics.

A whole text becomes a short vector of shape statistics (lengths, kinds of bytes, repetition of words, phrases and
lines), each on a log or logit scale. Either class is a normal density with its own mean and covariance. The class
covariance is shrunk twice: towards the pooled covariance of both classes, by what a small class lacks in rows, and
towards its own diagonal, by the analytic intensity of Ledoit and Wolf, so that no setting depends on the data's size.
The score is the posterior of label 1 from the difference of the two log densities; their Mahalanobis distances use
Cholesky factors that are computed once, when the model is fitted.

Texts are read once. Everything after that (labels, moments, scores) works on the vectors, which are a few hundred
bytes a row; moments are summed inside tasks before they are shuffled, so a fit sends a fixed number of rows a task.
All labelled rows are used.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendmart.llm import textbytes as tb
from spendmart.llm.shared import materialize

FEATURES = [
    "words", "word_length", "word_length_spread", "longest_word", "upper", "lower", "digits", "stops", "symbols", "beyond_ascii",
    "blanks", "byte_entropy", "distinct_words", "top_word", "stutter", "distinct_phrases", "line_length", "distinct_lines", "lone_symbols", "symbol_ends",
]
RIDGE = 1e-3  # least variance of a standardised statistic
ROWS = 2048  # rows of a chunk at most: the byte table of a chunk is 256 wide

_KINDS = np.zeros(256, np.int64)  # 0: control bytes
for _kind, _bytes in enumerate([range(0x41, 0x5B), range(0x61, 0x7B), range(0x30, 0x3A), b".,;:!?'\"()-", range(0x80, 0x100), b" \t\n\r\x0b\x0c"], 1):
    _KINDS[list(_bytes)] = _kind
_KINDS[[b for b in range(0x21, 0x7F) if not _KINDS[b]]] = 7
_NOT_NEWLINE = ~tb.byte_set((0x0A, 0x0A), (0x0D, 0x0D))


def _logit(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Log odds of a share, half a count added on either side."""
    return np.log((part + 0.5) / (whole - part + 0.5))


def _kept_apart(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first position, count) of each distinct (row, hash)."""
    keys = tb.mix(hashes ^ tb.mix(rows.astype(np.uint64) + np.uint64(1)))
    _, first, count = np.unique(keys, return_index=True, return_counts=True)
    return rows[first], first, count


def statistics(chunk: tb.Chunk) -> np.ndarray:
    """One row of FEATURES per text; a text without bytes has counts of zero, like any other."""
    n = chunk.last - chunk.first
    size = np.diff(chunk.offsets)
    row_of_byte = np.repeat(np.arange(n), size)
    table = np.bincount(row_of_byte * 256 + chunk.data, minlength=n * 256).reshape(n, 256).astype(float)
    kinds = np.zeros((n, 8))
    for kind in range(8):
        kinds[:, kind] = table[:, kind == _KINDS].sum(1)
    share = table / np.maximum(size, 1)[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(1)

    words = tb.words(chunk)
    rows, count = words.rows(), words.counts
    length = (words.ends - words.starts).astype(float)
    total = np.bincount(rows, length, n)
    mean = total / np.maximum(count, 1)
    spread = np.sqrt(np.maximum(np.bincount(rows, length**2, n) / np.maximum(count, 1) - mean**2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, rows, length)
    at, _, times = _kept_apart(rows, words.hashes)
    distinct = np.bincount(at, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, at, times)
    same = np.flatnonzero((words.hashes[1:] == words.hashes[:-1]) & (rows[1:] == rows[:-1]))
    stutter = np.bincount(rows[same], minlength=n)
    gram_rows, grams = tb.shingles(words, 3)
    phrases = np.bincount(gram_rows, minlength=n)
    distinct_phrases = np.bincount(_kept_apart(gram_rows, grams)[0], minlength=n)
    symbol = _KINDS[chunk.data[words.ends - 1]] == 7 if len(rows) else np.zeros(0, bool)
    lone = np.bincount(rows[symbol & (length == 1)], minlength=n)
    ends = np.bincount(rows[symbol & (length > 1)], minlength=n)

    lines = tb.words(chunk, _NOT_NEWLINE)
    line_rows = lines.rows()
    n_lines = lines.counts
    distinct_lines = np.bincount(_kept_apart(line_rows, lines.hashes)[0], minlength=n)
    return np.column_stack([
        np.log1p(count), np.log1p(mean), np.log1p(spread), np.log1p(longest), *(_logit(kinds[:, k], size) for k in (1, 2, 3, 4, 7, 5, 6)), entropy,
        _logit(distinct, count), _logit(top, count), _logit(stutter, count), _logit(distinct_phrases, phrases),
        np.log1p(size / np.maximum(n_lines, 1)), _logit(distinct_lines, n_lines), _logit(lone, count), _logit(ends, count),
    ])


def _vectors(keep: list[str]):
    def run(batches):
        for batch in batches:
            for chunk in tb.chunks(batch.column("text"), rows=ROWS):
                n = chunk.last - chunk.first
                flat = pa.array(statistics(chunk).ravel())
                stats = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(FEATURES)), flat)
                part = batch.slice(chunk.first, n)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), stats], names=[*keep, "stats"])

    return run


def document_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` columns and stats array<double> (FEATURES) of every text of docs (text and the kept columns)."""
    rows = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(_vectors(keep), schema + ", stats array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(centre: np.ndarray | None, scale: np.ndarray | None):
    """Per task and label one row of sums: first moments, or second and fourth ones about the class means."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            labels = batch.column("label").to_numpy()
            x = _matrix(batch.column("stats"))
            for label in (0, 1):
                z = x[labels == label]
                if centre is None:
                    part = np.concatenate([[len(z)], z.sum(0), (z**2).sum(0)])
                else:
                    z = (z - centre[label]) / scale
                    part = np.concatenate([[len(z), ((z**2).sum(1) ** 2).sum()], (z.T @ z).ravel()])
                sums[label] = sums.get(label, 0) + part
        for label, total in sums.items():
            if total[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(total), label)), pa.array(np.arange(len(total))), pa.array(total)], names=["label", "place", "value"]
                )

    return run


def _totals(known: DataFrame, centre=None, scale=None) -> dict[int, np.ndarray]:
    """label -> sums over all rows; a fixed number of numbers, whatever the table's size."""
    rows = known.mapInArrow(_sums(centre, scale), "label long, place long, value double").groupBy("label", "place").agg(F.sum("value").alias("value"))
    out: dict[int, np.ndarray] = {}
    for r in rows.orderBy("label", "place").collect():
        out.setdefault(r.label, []).append(r.value)
    return {label: np.array(values) for label, values in out.items()}


@dataclass
class Model:
    """Class means, inverses of the Cholesky factors of the shrunk covariances, and what else the log densities need."""

    share: float
    scale: np.ndarray | None = None
    means: np.ndarray | None = None
    whiten: np.ndarray | None = None
    offsets: np.ndarray | None = None
    shrinkage: tuple[float, float] = (0.0, 0.0)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Posterior of label 1 for rows of statistics."""
        if self.means is None:
            return np.full(len(x), self.share)
        log = [self.offsets[k] - 0.5 * ((((x - self.means[k]) / self.scale) @ self.whiten[k].T) ** 2).sum(1) for k in (0, 1)]
        return 1 / (1 + np.exp(-np.clip(log[1] - log[0], -700, 700)))


def _intensity(cov: np.ndarray, fourth: float, n: float) -> float:
    """Ledoit and Wolf's share of the diagonal target: expected error of the covariance over its distance from the target."""
    error = max(0.0, fourth / n - (cov**2).sum()) / n
    distance = ((cov - np.diag(np.diag(cov))) ** 2).sum()
    return 1.0 if distance <= 0 else min(1.0, error / distance)


def fit(known: DataFrame) -> Model:
    """From rows (stats, label 0 or 1). One kind of label, or none: a model that answers the share of label 1 (0.5 without rows)."""
    first = _totals(known)
    counts = np.array([first[k][0] if k in first else 0.0 for k in (0, 1)])
    if not counts.all():
        return Model(float(counts[1] / counts.sum()) if counts.sum() else 0.5)
    d = len(FEATURES)
    means = np.array([first[k][1 : d + 1] / counts[k] for k in (0, 1)])
    inner = sum(first[k][d + 1 :] - counts[k] * means[k] ** 2 for k in (0, 1))
    variance = inner / counts.sum()
    constant = variance <= 1e-12 * (1 + (means**2).max(0))  # what is left of a difference of sums
    scale = np.sqrt(np.where(constant, 1.0, variance))
    second = _totals(known, means, scale)
    scatter = [second[k][2:].reshape(d, d) for k in (0, 1)]
    pooled = sum(scatter) / counts.sum()
    whiten, offsets, used = [], [], []
    for k in (0, 1):
        towards = d / (d + counts[k])  # a class of few rows leans on both
        cov = (1 - towards) * scatter[k] / counts[k] + towards * pooled
        own = _intensity(scatter[k] / counts[k], second[k][1], counts[k])
        cov = (1 - own) * cov + own * np.diag(np.diag(cov))
        factor = np.linalg.cholesky(cov + RIDGE * np.eye(d))
        whiten.append(np.linalg.inv(factor))
        offsets.append(np.log(counts[k] / counts.sum()) - np.log(np.diag(factor)).sum())
        used.append(float(own))
    return Model(float(counts[1] / counts.sum()), scale, means, np.array(whiten), np.array(offsets), tuple(used))


def _scored(model: Model, keep: list[str], threshold: float):
    def run(batches):
        for batch in batches:
            score = model.score(_matrix(batch.column("stats"))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"]
            )

    return run


def classify(docs: DataFrame, labels: DataFrame, learn: str, threshold: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """Scores every row of docs (doc_id, text, `keep` columns), learning from the labelled rows that satisfy `learn`.

    labels: doc_id, label. Only labels 0 and 1 count; an id with both is not learned from, and repeated label rows
    count once. Rows of docs that share an id each count with its label; a null id has none. `learn` is a condition on
    the kept columns. Null and empty texts are texts without bytes. Result: the kept columns, score, predicted
    (score >= threshold). Kept columns may not be named text, stats, label, score or predicted (ValueError).
    """
    keep = list(dict.fromkeys(keep or ["doc_id"]))
    if clash := {"text", "stats", "label", "score", "predicted"} & {c.lower() for c in keep}:
        raise ValueError(f"names taken by the result: {sorted(clash)}")
    table = materialize(document_statistics(docs, list(dict.fromkeys([*keep, "doc_id"]))), "quality-statistics")
    told = labels.select("doc_id", F.col("label").cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IN (0, 1)")
    told = told.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other")
    known = table.filter(learn).join(told.select("doc_id", "label"), "doc_id").select("stats", "label")
    model = fit(materialize(known, "quality-known"))
    schema = ", ".join(f"`{c}` {table.schema[c].dataType.simpleString()}" for c in keep)
    return table.select(*keep, "stats").mapInArrow(_scored(model, keep, threshold), schema + ", score double, predicted int")
