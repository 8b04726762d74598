"""Token-id files as directly addressable codes.

A segment holds the ids of consecutive documents. Level 0 has the lowest eight bits of every id; a bitmap marks the ids
that continue, whose next eight bits are on level 1, and so on. A rank directory counts the marks before every 512th
bit, so token i is read by one look-up per level, without decoding its neighbours. Segments travel as rows of a
Parquet table, which any Spark executor can write to and read from the shared store.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spendmart.llm import pretokens
from spendmart.llm import textbytes as tb
from spendmart.llm.shared import materialize

MAGIC = b"DAC1"
RANK_BITS = 512
SEGMENT_TOKENS = 1 << 20
_SEGMENTS = "part int, seq int, inside long, tokens long, doc_ids array<long>, sizes array<long>, dac binary"
_ONES = np.array([bin(x).count("1") for x in range(256)], np.uint8)


def _spelling() -> np.ndarray:
    """The character that byte-level vocabularies write each byte as: its own where printable, the rest from 256 on, in order."""
    printable = np.r_[0x21:0x7F, 0xA1:0xAD, 0xAE:0x100]
    others = np.setdiff1d(np.arange(256), printable)
    out = np.arange(256, dtype="<u4")
    out[others] = 256 + np.arange(len(others))
    return out


SPELLING = _spelling()


def pack(ids: np.ndarray) -> bytes:
    """The bytes of one segment."""
    levels = []
    rest = np.asarray(ids, np.uint32)
    while True:
        more = rest > 0xFF
        chunk = (rest & 0xFF).astype(np.uint8)
        if not more.any():
            levels.append(struct.pack("<QB", len(chunk), 0) + chunk.tobytes())
            break
        bits = np.packbits(more, bitorder="little")
        blocks = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype=np.uint32)
        ranks = (np.cumsum(blocks) - blocks).astype("<u4")
        levels.append(struct.pack("<QB", len(chunk), 1) + chunk.tobytes() + bits.tobytes() + ranks.tobytes())
        rest = rest[more] >> 8
    return MAGIC + struct.pack("<B", len(levels)) + b"".join(levels)


@dataclass
class Segment:
    """A packed segment; levels are (chunk bytes, continuation bitmap, rank directory), views into the file's bytes."""

    levels: list[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]]

    @classmethod
    def open(cls, data: bytes) -> Segment:
        if data[:4] != MAGIC:
            raise ValueError("not a token segment")
        at, levels = 5, []
        for _ in range(data[4]):
            n, more = struct.unpack_from("<QB", data, at)
            at += 9
            chunk = np.frombuffer(data, np.uint8, n, at)
            at += n
            bits = ranks = None
            if more:
                bits = np.frombuffer(data, np.uint8, -(-n // 8), at)
                at += len(bits)
                ranks = np.frombuffer(data, "<u4", -(-n // RANK_BITS), at)
                at += 4 * len(ranks)
            levels.append((chunk, bits, ranks))
        return cls(levels)

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def token(self, i: int) -> int:
        """One token, by one look-up per level."""
        out = 0
        for depth, (chunk, bits, ranks) in enumerate(self.levels):
            out |= int(chunk[i]) << (8 * depth)
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_BITS
            whole = _ONES[bits[block * RANK_BITS // 8 : i >> 3]].sum(dtype=np.int64)
            i = int(ranks[block]) + int(whole) + int(_ONES[bits[i >> 3] & ((1 << (i & 7)) - 1)])
        return out

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Tokens start..stop: on every level their chunks lie side by side, so a slice of each is read."""
        out = np.zeros(stop - start, np.uint32)
        where = np.arange(stop - start)
        for depth, (chunk, bits, ranks) in enumerate(self.levels):
            out[where] |= chunk[start:stop].astype(np.uint32) << np.uint32(8 * depth)
            if bits is None or start == stop:
                break
            more = np.unpackbits(bits[start >> 3 : (stop + 7) >> 3], bitorder="little")[start & 7 :][: stop - start].astype(bool)
            where = where[more]
            block = start // RANK_BITS
            before = np.unpackbits(bits[block * RANK_BITS // 8 : (start + 7) >> 3], bitorder="little")[: start - block * RANK_BITS]
            start = int(ranks[block]) + int(before.sum(dtype=np.int64)) if len(ranks) > block else 0
            stop = start + len(where)
        return out


class Library:
    """A worker's tokenizer: distinct pre-tokens go through the library's model once and are remembered by hash.

    Texts that spell a special token are encoded whole by the library, which has its own rule for them.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo = pretokens.Memo()
        self.model = self.tokenizer.model
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # every word it gets is new, so its own memory only costs

    def encode(self, chunk: tb.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, and where each row's begin."""
        whole = chunk.data.tobytes()
        starts, first = pretokens.split(chunk)
        hashes, at, stop, inverse = pretokens.distinct(chunk, starts)

        def ask(new: np.ndarray):
            spelled, tokenize = SPELLING[chunk.data].tobytes().decode("utf-32-le"), self.model.tokenize
            found, counts = [], []
            for a, b in zip(at[new].tolist(), stop[new].tolist(), strict=True):
                tokens = tokenize(spelled[a:b])
                counts.append(len(tokens))
                found += [t.id for t in tokens]
            return np.array(found, np.uint32), np.array(counts, np.int64)

        ids, sizes = self.memo.lookup(hashes, ask) if len(hashes) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        ids, sizes = pretokens.spread(ids, sizes, inverse)
        rows = pretokens.per_row(sizes, first)
        if not any(s in whole for s in self.special):
            return ids, rows
        parts = []
        for r in range(chunk.last - chunk.first):
            text = chunk.text(r)
            if any(s in text for s in self.special):
                parts.append(np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32))
            else:
                parts.append(ids[rows[r] : rows[r + 1]])
        return np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))


_libraries: dict[str, Library] = {}


def _with_end(ids: np.ndarray, rows: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids with one more at the end of every row, and the rows' sizes."""
    n = np.diff(rows)
    stops = np.cumsum(n + 1)
    out = np.full(int(stops[-1]) if len(stops) else 0, end_id, np.uint32)
    out[tb.ragged(stops - n - 1, n)] = ids
    return out, n + 1


def _segments(path: str, end_id: int):
    def run(batches):
        if path not in _libraries:
            _libraries[path] = Library(path)
        library, part, seq = _libraries[path], TaskContext.get().partitionId(), 0
        ids, docs, sizes, size, inside = [], [], [], 0, 0

        def flush():
            row = [[part], [seq], [inside], [size], [np.concatenate(docs).tolist()], [np.concatenate(sizes).tolist()], [pack(np.concatenate(ids))]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=[f.split()[0] for f in _SEGMENTS.split(", ")])

        for batch in batches:
            named = np.array(batch.column("doc_id").to_pylist(), dtype=object)
            for chunk in tb.chunks(batch.column("text")):
                found, each = _with_end(*library.encode(chunk), end_id)
                ids.append(found)
                docs.append(named[chunk.first : chunk.last])
                sizes.append(each)
                size += len(found)
                if size >= SEGMENT_TOKENS:
                    yield flush()
                    seq, inside = seq + 1, inside + size
                    ids, docs, sizes, size = [], [], [], 0
        if ids:
            yield flush()

    return run


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Encodes docs (doc_id, text) in ascending doc_id order and returns the written table of segments, read back.

    tokenizer: a file of the tokenizers library with byte-level pre-tokens. end_id ends every document. A null text is
    empty; null ids come first; rows that share an id follow each other in the order of their texts' hashes.
    Columns: part and seq order the segments, inside: tokens before in the part, base: in all, doc_ids, sizes, dac.
    """
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    segments = materialize(ordered.mapInArrow(_segments(tokenizer, end_id), _SEGMENTS), "tokens", compression="none")
    narrow = segments.groupBy("part").agg(F.sum("tokens").alias("all"))
    bases = narrow.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before"))
    # one row per task of the write, so the segments themselves are not shuffled
    return segments.join(F.broadcast(bases), "part").withColumn("base", F.col("before") + F.col("inside")).drop("before")


def _documents(batches):
    for batch in batches:
        for base, docs, sizes, dac in zip(*(batch.column(c).to_pylist() for c in ("base", "doc_ids", "sizes", "dac")), strict=True):
            segment = Segment.open(dac)
            stops = np.cumsum(np.array(sizes, np.int64))
            starts = stops - sizes
            every = segment.tokens(0, len(segment)).astype("<u4")
            sums = [zlib.crc32(every[a:b].tobytes()) for a, b in zip(starts, stops, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(base + starts), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_documents(segments: DataFrame) -> DataFrame:
    """Per document, from the segments' bytes: doc_id, start, n_tokens, ids_crc32."""
    return segments.select("base", "doc_ids", "sizes", "dac").mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")
