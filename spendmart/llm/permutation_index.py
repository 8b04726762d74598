"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. Pivot inverted files post every vector under each of them with
its rank. A query opens the files of its own pivots; for ranks counted from 0 to k-1 and absent pivots at k, the
footrule distance is k(k+1) minus twice the sum, over shared pivots, of the smaller of the two distances to k, so
postings of shared pivots are all it takes. The best share of a shard by footrule is reranked on the original vectors.

Inner products are turned into angles first: every vector gets one more component that brings it to the largest norm
of all, queries get a zero there, and pivots are vectors so extended.

Shards are rows of a table (vectors and inverted files of SHARD vectors); query blocks meet shards in units of
bounded size, and every unit keeps only its best per query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendmart.llm.shared import materialize

PIVOTS = 256  # drawn from a sample of PIVOT_SAMPLE rows by hash of the id: the only part that is fitted
PIVOT_SAMPLE = 2048
NEAREST = 32  # pivots per vector
OPENED = 0.3  # of every shard, by footrule, is reranked
SHARD = 8192
QUERIES = 4096  # per unit


def _matrix(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their vectors): none null, of other length, zero, or with null or non-finite components."""
    arrays = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    valid = arrays.is_valid().to_numpy(zero_copy_only=False)
    sizes = np.array(arrays.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    keep = np.flatnonzero(valid & (sizes == dimension) & (dimension > 0))
    if not len(keep):
        return keep, np.zeros((0, max(1, dimension)))
    flat = arrays.take(pa.array(keep)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    rows = flat.reshape(-1, dimension)
    good = np.isfinite(rows).all(axis=1) & (rows != 0).any(axis=1)
    return keep[good], rows[good]


def _sampled(vectors: DataFrame, column: str) -> pa.Table:
    """PIVOT_SAMPLE rows, the first by hash of the id."""
    return vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).select(column).toArrow()


def extended(rows: np.ndarray, norm: float | None = None) -> np.ndarray:
    """Rows with a last component that gives all the same norm; without a norm, zero."""
    rest = np.zeros(len(rows)) if norm is None else np.sqrt(np.maximum(0.0, norm * norm - (rows * rows).sum(axis=1)))
    return np.column_stack([rows, rest])


def fit_pivots(vectors: DataFrame, norm: float, pivots: int = PIVOTS) -> np.ndarray:
    """Distinct extended rows of a sample of the vectors that take part."""
    packed = _sampled(vectors, "vector").column("vector").to_pylist()
    rows = np.frombuffer(b"".join(packed), np.float64).reshape(len(packed), -1)
    _, first = np.unique(rows, axis=0, return_index=True)
    return extended(rows[np.sort(first)[:pivots]], norm)


def permutations(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Numbers of the nearest pivots of every row, nearest first, ties to the smaller number."""
    return np.argsort(-(rows @ pivots.T), axis=1, kind="stable")[:, : min(NEAREST, len(pivots))].astype(np.int16)


def _take_part(dimension: int):
    def run(batches):
        for batch in batches:
            at, rows = _matrix(batch.column("embedding"), dimension)
            rows = rows + 0.0  # no negative zeros: equal vectors have equal bytes
            ids = batch.column("vec_id").take(pa.array(at))
            norms = np.sqrt((rows * rows).sum(axis=1))
            yield pa.RecordBatch.from_arrays([ids, pa.array([r.tobytes() for r in rows], pa.binary()), pa.array(norms)], names=["vec_id", "vector", "norm"])

    return run


def _shard(pivots, norm: float):
    """One shard's rows to one row: ids, vectors, and the inverted files: postings of pivot p are files[edges[p]:edges[p+1]]."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        rows = np.frombuffer(b"".join(table.column("vector").to_pylist()), np.float64).reshape(len(ids), -1)[order]
        near = permutations(extended(rows, norm), pivots.value)
        k = near.shape[1]
        pivot, rank = near.ravel(), np.tile(np.arange(k), len(near))
        by_pivot = np.argsort(pivot, kind="stable")
        edges = np.searchsorted(pivot[by_pivot], np.arange(len(pivots.value) + 1)).astype(np.int32)
        posted = (by_pivot // k).astype(np.int32)
        weight = (k - rank[by_pivot]).astype(np.int32)
        return pa.table({
            "shard": table.column("shard").slice(0, 1), "ids": pa.array([ids[order].tobytes()], pa.binary()), "vectors": pa.array([rows.tobytes()], pa.binary()),
            "edges": pa.array([edges.tobytes()], pa.binary()), "posted": pa.array([posted.tobytes()], pa.binary()), "weight": pa.array([weight.tobytes()], pa.binary()),
        })

    return run


_SHARDS = "shard long, ids binary, vectors binary, edges binary, posted binary, weight binary"


def build_index(rows: DataFrame, pivots, norm: float) -> tuple[DataFrame, int]:
    """Table of shards, and their number, over all rows (vec_id, vector); pivots: a broadcast of fit_pivots()."""
    shards = max(1, -(-rows.count() // SHARD))
    # different vectors may share an id, so the vector takes part in the dealing
    dealt = rows.select("vec_id", "vector", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards)).alias("shard"))
    return materialize(dealt.groupBy("shard").applyInArrow(_shard(pivots, norm), _SHARDS), "shards"), shards


def _search(pivots, best: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return empty
        one = lambda c, kind: np.frombuffer(left.column(c)[0].as_py(), kind)
        ids, edges, posted, weight = one("ids", np.int64), one("edges", np.int32), one("posted", np.int32), one("weight", np.int32)
        vectors = one("vectors", np.float64).reshape(len(ids), -1)
        asked = right.column("vec_id").to_numpy()
        queries = np.frombuffer(b"".join(right.column("vector").to_pylist()), np.float64).reshape(len(asked), -1)
        near = permutations(extended(queries), pivots.value)
        k = near.shape[1]
        opened = min(len(ids), max(4 * best, int(np.ceil(OPENED * len(ids)))))
        out = []
        for q, vector, order in zip(asked, queries, near, strict=True):
            shared = np.zeros(len(ids), np.int32)  # half of k(k+1) less the footrule distance
            for rank, pivot in enumerate(order):
                a, b = edges[pivot], edges[pivot + 1]
                shared[posted[a:b]] += np.minimum(weight[a:b], k - rank)
            reach = np.partition(shared, len(ids) - opened)[len(ids) - opened]
            at = np.flatnonzero(shared >= reach)
            at = at[ids[at] != q]
            if not len(at):
                continue
            rough = vectors[at] @ vector
            wanted = best
            while True:
                held = at
                if len(at) > wanted:
                    # whatever rounding could lift into the best stays in, ties with it
                    last = np.partition(rough, len(at) - wanted)[len(at) - wanted]
                    held = at[rough >= last - 1e-9 * max(1.0, abs(last))]
                score = np.cumsum(vectors[held] * vector, axis=1)[:, -1]
                top = np.lexsort((ids[held], -score))
                mine, theirs = ids[held][top], score[top]
                # rows of one id and score are one neighbour
                new = np.append(True, (mine[1:] != mine[:-1]) | (theirs[1:] != theirs[:-1]))
                if new.sum() >= best or len(held) == len(at):
                    break
                wanted *= 2
            mine, theirs = mine[new][:best], theirs[new][:best]
            out.append((np.full(len(mine), q), mine, theirs))
        if not out:
            return empty
        query, found, score = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"query_id": query, "vec_id": found, "score": score})

    return run


def search(vectors: DataFrame, asked: str, best: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for every row that meets the SQL condition `asked` against all other rows.

    vectors: vec_id long, embedding array; `asked` may name vec_id only. score is the inner product of the originals in double precision, summed in
    order; ties go to the smaller vec_id. Null, zero or non-finite vectors, and those of another length than most of the
    sample, take no part; neither do null ids. A row is no candidate for its own id; copies under other ids are. A query
    whose id occurs twice is answered for both rows together. Repeated rows count once.
    """
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    known = vectors.filter("vec_id IS NOT NULL AND embedding IS NOT NULL")
    sizes = np.array([len(x) for x in _sampled(known, "embedding").column("embedding").to_pylist()], np.int64)
    dimension = int(np.bincount(sizes).argmax()) if len(sizes) else 0
    # copies would use up the places in a unit and the opened share of a shard
    rows = materialize(known.mapInArrow(_take_part(dimension), "vec_id long, vector binary, norm double").distinct(), "vectors")
    norm = rows.agg(F.max("norm")).first()[0]
    if norm is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    pivots = spark.sparkContext.broadcast(fit_pivots(rows, norm))
    shards, parts = build_index(rows, pivots, norm)
    queries = rows.filter(asked).select("vec_id", "vector")
    blocks = max(1, -(-queries.count() // QUERIES))
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    dealt = dealt.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<long>")))
    held = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
    met = held.groupBy("shard", "block").cogroup(dealt.groupBy("shard", "block")).applyInArrow(_search(pivots, best), "query_id long, vec_id long, score double")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = met.distinct().withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= best)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
