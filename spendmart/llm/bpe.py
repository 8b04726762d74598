"""Byte-level BPE in two tiers: a minimal perfect hash for pre-tokens that are whole vocabulary entries, and for the
rest a heap of merges over linked bytes.

The vocabulary's hash tables are built once on the driver and broadcast; their size follows the vocabulary, not the
corpus. Tasks split and look up a megabyte of text at a time; only pre-tokens a worker has not met reach the heap.
"""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spendmart.llm import pretokens
from spendmart.llm import textbytes as tb


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 entry and its id per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(entry): int(rank) for entry, rank in (line.split() for line in lines if line.strip())}


def _entry_hashes(entries: list[bytes]) -> np.ndarray:
    """The same hash that `pretokens.distinct` gives a pre-token."""
    data = np.frombuffer(b"".join(entries), np.uint8)
    sizes = np.array([len(e) for e in entries], np.int64)
    starts = np.cumsum(sizes) - sizes
    return tb.mix(tb.slices(tb.running(tb.BYTE_VALUES[data]), starts, starts + sizes) ^ sizes.astype(np.uint64))


@dataclass
class PerfectHash:
    """Every key has a slot of its own among exactly as many slots as keys: one displacement per bucket of keys."""

    shifts: np.ndarray
    keys: np.ndarray

    @classmethod
    def build(cls, keys: np.ndarray) -> tuple[PerfectHash, np.ndarray]:
        """The hash and the slot of every key. Large buckets are placed first; a shift is tried until all its keys fit."""
        n = len(keys)
        buckets = max(1, n // 3)
        bucket = (keys % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        sizes = np.diff(edges)
        shifts = np.zeros(buckets, np.uint64)
        slots = np.empty(n, np.int64)
        taken = np.zeros(n, bool)
        for b in np.argsort(-sizes, kind="stable"):
            members = order[edges[b] : edges[b + 1]]
            if not len(members):
                break
            mine = keys[members]
            for base in range(0, 1 << 30, 64):
                tries = np.arange(base, base + 64, dtype=np.uint64)
                at = cls._slot(mine[None, :], tries[:, None], n)
                fits = ~taken[at].any(axis=1)
                if len(members) > 1:
                    fits &= (np.diff(np.sort(at, axis=1), axis=1) > 0).all(axis=1)
                if fits.any():
                    k = int(np.argmax(fits))
                    shifts[b], slots[members] = tries[k], at[k]
                    taken[at[k]] = True
                    break
        placed = np.empty(n, np.uint64)
        placed[slots] = keys
        return cls(shifts, placed), slots

    @staticmethod
    def _slot(keys: np.ndarray, shifts: np.ndarray, n: int) -> np.ndarray:
        return (tb.mix(keys ^ (shifts * np.uint64(0x9E3779B97F4A7C15))) % np.uint64(n)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of every key, or -1 for a key that is not among those built in."""
        shifts = self.shifts[(keys % np.uint64(len(self.shifts))).astype(np.int64)]
        at = self._slot(keys, shifts, len(self.keys))
        return np.where(self.keys[at] == keys, at, -1)


@dataclass
class Vocabulary:
    """ranks: entry to id; perfect, ids: the hash of whole entries and the id in each slot; flat, starts: bytes of every id."""

    ranks: dict[bytes, int]
    perfect: PerfectHash
    ids: np.ndarray
    flat: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, ranks: dict[bytes, int]) -> Vocabulary:
        entries = list(ranks)
        perfect, slots = PerfectHash.build(_entry_hashes(entries))
        ids = np.empty(len(entries), np.uint32)
        ids[slots] = [ranks[e] for e in entries]
        by_id = [b""] * (max(ranks.values()) + 1)
        for entry, rank in ranks.items():
            by_id[rank] = entry
        sizes = np.array([len(e) for e in by_id], np.int64)
        return cls(ranks, perfect, ids, np.frombuffer(b"".join(by_id), np.uint8), np.append(0, np.cumsum(sizes)))

    def merge(self, word: bytes) -> list[int]:
        """Ids of a pre-token: the mergeable pair of lowest rank, leftmost first, until none is left."""
        ranks, n = self.ranks, len(word)
        after = list(range(1, n + 1))  # the next part's start; a part is named by its start
        before = list(range(-1, n - 1))
        end = list(range(1, n + 1))  # 0 for a part swallowed by the one before it
        heap = [(ranks[word[i : i + 2]], i, i + 2) for i in range(n - 1) if word[i : i + 2] in ranks]
        heapify(heap)
        while heap:
            _, left, stop = heappop(heap)
            right = after[left]
            if not end[left] or right >= n or end[right] != stop or end[left] != right:
                continue  # one of the two has changed since
            end[left], end[right] = stop, 0
            beyond = after[left] = after[right]
            if beyond < n:
                before[beyond] = left
                if (pair := word[left : end[beyond]]) in ranks:
                    heappush(heap, (ranks[pair], left, end[beyond]))
            ahead = before[left]
            if ahead >= 0 and (pair := word[ahead:stop]) in ranks:
                heappush(heap, (ranks[pair], ahead, stop))
        out, at = [], 0
        while at < n:
            out.append(ranks[word[at : end[at]]])
            at = after[at]
        return out

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids end to end, and how many each has."""
        starts = self.starts[ids]
        sizes = self.starts[ids.astype(np.int64) + 1] - starts
        return self.flat[tb.ragged(starts, sizes)], sizes


class Encoder:
    """A worker's view of a vocabulary."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.memo = vocabulary, pretokens.Memo()

    def encode(self, chunk: tb.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, and where each row's begin."""
        raw = chunk.data.tobytes()
        starts, first = pretokens.split(chunk)
        hashes, at, stop, inverse = pretokens.distinct(chunk, starts)
        slots = self.vocabulary.perfect.find(hashes)
        whole = slots >= 0
        sizes = np.ones(len(hashes), np.int64)
        missed = np.flatnonzero(~whole)

        def heap(new: np.ndarray):
            parts = [self.vocabulary.merge(raw[a:b]) for a, b in zip(at[missed[new]].tolist(), stop[missed[new]].tolist(), strict=True)]
            return np.array([x for p in parts for x in p], np.uint32), np.array([len(p) for p in parts], np.int64)

        ids, counts = self.memo.lookup(hashes[missed], heap) if len(missed) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        sizes[missed] = counts
        flat = np.empty(int(sizes.sum()), np.uint32)
        begin = np.cumsum(sizes) - sizes
        flat[begin[whole]] = self.vocabulary.ids[slots[whole]]
        flat[tb.ragged(begin[missed], counts)] = ids
        everything, each = pretokens.spread(flat, sizes, inverse)
        return everything, pretokens.per_row(each, first)


_encoders: dict[int, Encoder] = {}


def _coded(vocabulary, keep: list[str]):
    def run(batches):
        key = id(vocabulary.value)
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = Encoder(vocabulary.value)
        encoder = _encoders[key]
        for batch in batches:
            for chunk in tb.chunks(batch.column("text")):
                ids, rows = encoder.encode(chunk)
                decoded, sizes = encoder.vocabulary.decode(ids)
                cut = np.append(0, np.cumsum(sizes))[rows]
                raw = ids.astype("<u4").tobytes()
                codes = [raw[4 * a : 4 * b] for a, b in zip(rows, rows[1:], strict=False)]
                texts = [decoded[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)]
                part = batch.slice(chunk.first, chunk.last - chunk.first)
                yield pa.RecordBatch.from_arrays([
                    *(part.column(c) for c in keep),
                    pa.array(np.diff(rows)), pa.array([hashlib.sha256(x).hexdigest() for x in codes]),
                    pa.array([hashlib.sha256(x).hexdigest() for x in texts]),
                    pa.array(codes, pa.binary()), pa.array(texts, pa.binary()).cast(pa.string()),
                ], names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"])

    return run


def encode_decode(docs: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """Per row of docs (doc_id, text): `keep` columns (doc_id by default), n_tokens, ids_sha256, decoded_sha256, ids, decoded.

    path: a rank file. ids are little-endian unsigned 32-bit integers; decoded is the text got back from them. A null
    or empty text has no tokens. Special tokens do not exist here: their spelling is ordinary text.
    """
    keep = keep or ["doc_id"]
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.of(load_ranks(path)))
    names = list(dict.fromkeys([*keep, "text"]))
    rows = docs.select(*names)
    schema = ", ".join(f"`{rows.schema[c].name}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(_coded(vocabulary, keep), schema + ", n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary, decoded string")
