"""Toxicity by a learned lexicon whose trie is intersected with Levenshtein automata, and context windows.

Lexicon: words and word beginnings that labelled toxic texts have and others lack, counted in Spark over at most LABELLED
labelled texts; a term needs support, lift and significance of its own, whatever the others have. The trie of all terms is walked
together with the automaton of "at most one edit" and made deterministic on the driver; the table has one row per state,
and its size follows the lexicon. Tasks run all words of a megabyte of text through that table at once. Hits are weighed
by what they meant in all labelled texts, summed over windows of neighbouring words, apart for words inside and outside
quotation marks, and a logistic model fitted on a bounded sample turns the window scores into a probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendmart.llm import pretokens
from spendmart.llm import textbytes as tb
from spendmart.llm.shared import materialize

LABELLED = 200_000  # labelled texts that terms and weights are learned from, at most half of either kind
SAMPLE = 20_000  # labelled rows the logistic model is fitted on, at most half of either kind
SUPPORT = 6  # toxic documents that hold a term, at least
LIFT = 8.0  # how many times more often toxic documents hold it
SIGNIFICANT = 10.83  # log-likelihood ratio of term against label: one chance in a thousand
WINDOW = 10  # words to either side
_QUOTES = [ord(c) for c in '"“”„«»']
_tables: dict[str, np.ndarray] = {}


@dataclass(frozen=True)
class Term:
    """A word, or with `stem` the beginning of words."""

    text: str
    stem: bool

    @property
    def edits(self) -> int:
        return int(len(self.text) >= (6 if self.stem else 5))


@dataclass
class Automaton:
    """next[state, letter class]; letters maps code points to classes; term and edits per state, term -1 where not accepting. State 0 is dead, 1 the start."""

    next: np.ndarray
    letters: np.ndarray
    term: np.ndarray
    edits: np.ndarray

    @classmethod
    def of(cls, terms: list[Term]) -> Automaton:
        children: list[dict[int, int]] = [{}]
        whole: dict[int, int] = {}
        stems: dict[int, int] = {}
        classes: dict[int, int] = {}
        for number, term in enumerate(terms):
            node = 0
            for letter in map(ord, term.text):
                kind = classes.setdefault(letter, len(classes) + 1)
                if kind not in children[node]:
                    children.append({})
                    children[node][kind] = len(children) - 1
                node = children[node][kind]
            (stems if term.stem else whole)[node] = number

        def close(found: dict[int, int], kept: tuple) -> tuple:
            """Adds what a dropped letter reaches; keeps the fewest edits per node; kept: the best stem passed, as (edits, term)."""
            for node, edits in list(found.items()):
                if not edits:
                    for child in children[node].values():
                        found.setdefault(child, 1)
            for node, edits in found.items():
                if node in stems and edits <= terms[stems[node]].edits:
                    kept = min(kept or (9, 0), (edits, stems[node]))
            return frozenset(found.items()), kept

        def step(nodes, kept, kind):
            found: dict[int, int] = {}
            for node, edits in nodes:
                if kind in children[node]:
                    child = children[node][kind]
                    found[child] = min(edits, found.get(child, 9))
                if not edits:
                    found.setdefault(node, 1)
                    for child in children[node].values():
                        found.setdefault(child, 1)
            return close(found, kept)

        start = close({0: 0}, ())
        dead = (frozenset(), ())
        index = {dead: 0, start: 1}
        queue, table = [dead, start], []

        def number_of(after):
            if after not in index:
                index[after] = len(index)
                queue.append(after)
            return index[after]

        for state in queue:
            # letters that lead on from none of the nodes all do the same, as does class 0
            row = np.full(len(classes) + 1, number_of(step(*state, 0)), np.int32)
            for kind in sorted(set().union(*(children[node] for node, _ in state[0]))):
                row[kind] = number_of(step(*state, kind))
            table.append(row)
        term, edits = np.full(len(queue), -1), np.zeros(len(queue), np.int64)
        for number, (nodes, kept) in enumerate(queue):
            ends = [(e, whole[n]) for n, e in nodes if n in whole and e <= terms[whole[n]].edits]
            if kept:
                ends.append(kept)
            if ends:
                edits[number], term[number] = min(ends)
        letters = np.zeros(0x110000, np.int32)
        letters[list(classes)] = list(classes.values())
        return cls(np.array(table, np.int32), letters, term, edits)

    def run(self, letters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """State after every word, all words side by side."""
        state = np.ones(len(starts), np.int32)
        live, at = np.arange(len(starts)), starts.copy()
        while len(live):
            state[live] = self.next[state[live], letters[at]]
            at = at + 1
            going = (at < ends[live]) & (state[live] != 0)
            live, at = live[going], at[going]
        return state


def _points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte position, code point) of every character."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    point = data[at].astype(np.uint32)
    wide = np.flatnonzero(point >= 0xC0)
    if len(wide):
        padded = np.append(data, np.zeros(3, np.uint8)).astype(np.uint32)
        a, b, c, d = (padded[at[wide] + k] for k in range(4))
        two = ((a & 0x1F) << 6) | (b & 0x3F)
        three = ((a & 0x0F) << 12) | ((b & 0x3F) << 6) | (c & 0x3F)
        four = ((a & 0x07) << 18) | ((b & 0x3F) << 12) | ((c & 0x3F) << 6) | (d & 0x3F)
        point[wide] = np.where(a < 0xE0, two, np.where(a < 0xF0, three, np.minimum(four, 0x10FFFF)))
    return at, point


def _lower() -> np.ndarray:
    if "lower" not in _tables:
        out = np.arange(0x110000, dtype=np.uint32)
        for p in range(0x20000):
            low = chr(p).lower()
            if len(low) == 1:
                out[p] = ord(low)
        _tables["lower"] = out
    return _tables["lower"]


@dataclass
class Hits:
    """Lexicon hits of a chunk: row, word number in the row, term, edits, quoted."""

    row: np.ndarray
    word: np.ndarray
    term: np.ndarray
    edits: np.ndarray
    quoted: np.ndarray


def scan(chunk: tb.Chunk, automaton: Automaton) -> Hits:
    """Runs of letters, lower-cased, through the automaton."""
    at, point = _points(chunk.data)
    first = np.searchsorted(at, chunk.offsets)
    point = _lower()[point]
    inside = np.append(pretokens._classes()[point] == pretokens.LETTER, False)
    opens = np.zeros(len(point) + 1, bool)
    opens[first] = True
    starts = np.flatnonzero(inside[:-1] & (opens[:-1] | ~np.append(False, inside[:-2])))
    ends = np.flatnonzero(inside[:-1] & (opens[1:] | ~inside[1:])) + 1
    letters = automaton.letters[point]
    state = automaton.run(letters, starts, ends)
    found = np.flatnonzero(automaton.term[state] >= 0)
    rows = np.searchsorted(first, starts[found], side="right") - 1
    marks = np.append(0, np.cumsum(np.isin(point, _QUOTES)))
    return Hits(rows, found - np.searchsorted(starts, first)[rows], automaton.term[state[found]], automaton.edits[state[found]],
                (marks[starts[found]] - marks[first[rows]]) % 2 == 1)


def _features(hits: Hits, weights: np.ndarray, n_rows: int) -> np.ndarray:
    """Per row: best window and whole weight of hits outside quotation marks, the same for those inside; logarithms."""
    out = np.zeros((n_rows, 4))
    value = weights[hits.term, hits.edits]
    for column, side in ((0, ~hits.quoted), (2, hits.quoted)):
        row, word, mine = hits.row[side], hits.word[side], value[side]
        if not len(row):
            continue
        sums = np.append(0.0, np.cumsum(mine))
        place = row * (1 << 40) + word
        low = np.searchsorted(place, place - WINDOW)
        high = np.searchsorted(place, place + WINDOW, side="right")
        # neighbours of another row are farther than any window
        np.maximum.at(out[:, column], row, np.maximum(0.0, sums[high] - sums[low]))
        np.add.at(out[:, column + 1], row, np.maximum(0.0, mine))
    return np.log1p(out)


def _counts_of(automaton):
    def run(batches):
        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
            for chunk in tb.chunks(batch.column("text")):
                hits = scan(chunk, automaton.value)
                seen = np.unique(np.stack([hits.row, hits.term, hits.edits], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seen[:, 1]), pa.array(seen[:, 2]), pa.array(toxic[chunk.first + seen[:, 0]].astype(np.int64))], names=["term", "edits", "toxic"]
                )

    return run


def _rows_of(automaton, weights: np.ndarray):
    def run(batches):
        for batch in batches:
            for chunk in tb.chunks(batch.column("text")):
                features = _features(scan(chunk, automaton.value), weights, chunk.last - chunk.first)
                part = batch.slice(chunk.first, chunk.last - chunk.first)
                yield pa.RecordBatch.from_arrays([part.column("toxic"), part.column("weight"), *(pa.array(features[:, k].copy()) for k in range(4))],
                                                 names=["toxic", "weight", "f0", "f1", "f2", "f3"])

    return run


def _lexicon(counted: pa.Table, toxic: int, clean: int) -> list[Term]:
    """Terms from (piece, bad, good): pieces end in $ for whole words. Shortest beginnings first; what one covers needs no other."""
    held = {p: (b, g) for p, b, g in zip(*(counted.column(c).to_pylist() for c in ("piece", "bad", "good")), strict=True)}
    sharp = lambda p: (held[p][0] / toxic) >= LIFT * (held[p][1] + 1) / (clean + 1)
    longest: dict[str, int] = {}
    for piece, (bad, _) in held.items():
        body = piece.rstrip("$")
        up = body if piece.endswith("$") else body[:-1]
        longest[up] = max(longest.get(up, 0), bad)
    terms: list[tuple[int, Term]] = []
    stems: set[str] = set()
    for piece in sorted(held, key=lambda p: (len(p.rstrip("$")), p)):
        body, stem = piece.rstrip("$"), not piece.endswith("$")
        if not sharp(piece) or any(body[:k] in stems for k in range(1, len(body) + 1)):
            continue
        if stem and longest.get(body, 0) >= 0.95 * held[piece][0]:
            continue  # a longer beginning, or the word itself, says the same
        if stem:
            stems.add(body)
        terms.append((held[piece][0], Term(body, stem)))
    terms.sort(key=lambda t: (-t[0], t[1].text, t[1].stem))
    return [t for _, t in terms]


@dataclass
class Model:
    automaton: Automaton | None
    terms: list[Term]
    weights: np.ndarray  # by term and edits
    coefficients: np.ndarray  # intercept last


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Newton's method with a little ridge."""
    x = np.column_stack([x, np.ones(len(x))])
    ridge = np.diag([1e-2] * (x.shape[1] - 1) + [1e-6])
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - ridge @ beta
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, gradient)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def _likelihood_ratio(bad, good, toxic: int, clean: int):
    """G² of the table that has `bad` of the toxic and `good` of the clean texts with a term, and the rest without."""
    part = lambda n: F.when(n > 0, n * F.log(n.cast("double"))).otherwise(0.0)
    inside = part(bad) + part(good) + part(F.lit(toxic) - bad) + part(F.lit(clean) - good)
    sides = part(bad + good) + part(F.lit(toxic + clean) - bad - good) + part(F.lit(toxic)) + part(F.lit(clean))
    return 2 * (inside - sides + part(F.lit(toxic + clean)))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on docs (doc_id, text) with labels (doc_id, toxic 0 or 1); other labels, null ids and null texts are left out.

    Terms and their weights come from at most LABELLED texts, the logistic model from SAMPLE: of each kind half, first by
    hash of the id are used. Without both kinds the model has no terms and answers the share of toxic labels, or 0.
    """
    spark = docs.sparkSession
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # copies would make every word of theirs look telling: of equal texts with one label the smallest id speaks
    told = docs.filter("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("fp"), "text")
    alone = told.select("doc_id", "fp").join(known, "doc_id").groupBy("fp", "toxic").agg(F.min("doc_id").alias("doc_id"))
    alone = materialize(alone, "toxic-labels")
    totals = {r.toxic: r["count"] for r in alone.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        share = totals.get(1, 0) / max(1, sum(totals.values()))
        return Model(None, [], np.zeros((0, 2)), np.array([0, 0, 0, 0, np.log((share + 1e-9) / (1 - share + 1e-9))]))
    half = SAMPLE // 2
    first = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")  # over LABELLED narrow rows
    drawn = [alone.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED // 2).withColumn("weight", F.lit(max(1.0, totals[k] / half))) for k in (0, 1)]
    drawn = materialize(drawn[0].unionByName(drawn[1]).withColumn("fit", F.row_number().over(first) <= half), "toxic-sample")
    # ids and fingerprints meet the documents where those lie: no text is shuffled
    whole = materialize(told.join(F.broadcast(drawn), ["doc_id", "fp"]).select("text", "toxic", "weight", "fit"), "toxic-texts")
    sample = whole.filter("fit")
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
    pieces = F.flatten(F.transform(F.filter(words, lambda w: F.length(w) >= 3), lambda w: F.concat(
        F.transform(F.sequence(F.lit(4), F.greatest(F.lit(4), F.least(F.length(w), F.lit(10)))), lambda k: F.substring(w, 1, k)),
        F.array(F.concat(w, F.lit("$"))))))
    seen = {r.toxic: r["count"] for r in whole.groupBy("toxic").count().collect()}
    toxic, clean = seen.get(1, 0), seen.get(0, 0)
    counted = (
        whole.select("toxic", F.explode(F.array_distinct(pieces)).alias("piece"))
        .groupBy("piece").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
        .filter((F.col("bad") >= SUPPORT) & (F.length(F.col("piece")) >= 4))
    )
    counted = counted.filter((F.col("bad") / max(1, toxic)) >= LIFT * (F.col("good") + 1) / (clean + 1))
    counted = counted.filter(_likelihood_ratio(F.col("bad"), F.col("good"), toxic, clean) >= SIGNIFICANT).toArrow()
    terms = _lexicon(counted, max(1, toxic), clean)
    automaton = Automaton.of(terms)
    sent = spark.sparkContext.broadcast(automaton)
    texts = sample.select("text", "toxic", "weight")
    hits = whole.mapInArrow(_counts_of(sent), "term long, edits long, toxic long").groupBy("term", "edits").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("all")).collect()
    weights = np.zeros((len(terms), 2))
    for r in hits:
        weights[r.term, r.edits] = np.log((r.bad + 0.5) / (toxic + 1)) - np.log((r["all"] - r.bad + 0.5) / (clean + 1))
    # a misspelling never seen counts half of the term itself
    unseen = np.ones(len(terms), bool)
    unseen[[r.term for r in hits if r.edits == 1]] = False
    weights[unseen, 1] = weights[unseen, 0] / 2
    fitted = texts.mapInArrow(_rows_of(sent, weights), "toxic int, weight double, f0 double, f1 double, f2 double, f3 double").toArrow()
    columns = [fitted.column(c).to_numpy() for c in ("f0", "f1", "f2", "f3")]
    beta = _logistic(np.column_stack(columns), fitted.column("toxic").to_numpy().astype(float), fitted.column("weight").to_numpy())
    if not any(columns[3]):
        beta[2:4] = beta[:2] / 2  # no quotation in the sample: half of what the same words weigh outside
    return Model(automaton, terms, weights, beta)


def _scored(model, keep: list[str]):
    def run(batches):
        m = model.value
        for batch in batches:
            for chunk in tb.chunks(batch.column("text")):
                n = chunk.last - chunk.first
                features, count = np.zeros((n, 4)), np.zeros(n, np.int64)
                if m.automaton is not None:
                    hits = scan(chunk, m.automaton)
                    features, count = _features(hits, m.weights, n), np.bincount(hits.row, minlength=n)
                score = 1 / (1 + np.exp(-np.clip(features @ m.coefficients[:4] + m.coefficients[4], -30, 30)))
                part = batch.slice(chunk.first, n)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(count)],
                                                 names=[*keep, "score", "predicted", "n_terms"])

    return run


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Per row of docs: `keep` columns (doc_id by default), score, predicted, n_terms. Null and empty texts have no terms."""
    keep = keep or ["doc_id"]
    rows = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = ", ".join(f"`{rows.schema[c].name}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_scored(sent, keep), schema + ", score double, predicted int, n_terms long")
