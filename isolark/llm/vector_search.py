"""Exact nearest vectors by a block matrix join.

Vectors are cut into blocks. Every block of queries meets every block of
candidates by a join on the block numbers, as packed rows. In a task, a tile of
int8 products (exact in float32 matrix products) gives the distance of the
quantised vectors, and the norms of the quantisation errors bound how far the
true distance lies from it. Pairs that can't beat the k best upper bounds of
their query fall away, the others are computed in double precision from the
original vectors. Each task keeps a heap per query over its tiles, and the best
k of all tasks follow by a ranked window, which Spark trims before the shuffle.

Defined results: vectors that are null, zero or hold null or non-finite
components take no part, and neither do rows without an id; vectors meet those
of their own length only; ties go to the smaller id; of rows that share the
query's id none is its candidate; repeated candidates are found as often as
they stand in the table.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isolark.llm.common import everywhere, map_batches
from isolark.session import cut_lineage

#: Vectors in a block of candidates and of queries.
CANDIDATES, QUERIES = 4096, 2048
#: Queries of a tile that are compared at once.
SLICE = 256


def usable(df: DataFrame) -> DataFrame:
    """vec_id and ``vector`` (doubles) of the rows that take part."""
    return df.select("vec_id", F.col("embedding").cast("array<double>").alias("vector")).where(
        F.col("vec_id").isNotNull()
        & F.col("vector").isNotNull()
        & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("vector", lambda x: x != 0)
    )


def _block(size: int):
    """Pack the rows of one task into blocks: dimension, ids and vectors as bytes."""

    def run(batches):
        held: dict[int, list] = {}

        def out(dim):
            ids, vectors = zip(*held.pop(dim), strict=True)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([np.array(ids, "<i8").tobytes()]), pa.array([np.array(vectors, "<f8").tobytes()])], ["dim", "n", "ids", "vectors"])

        for batch in batches:
            vectors = batch.column("vector")
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(vectors.value_lengths().to_numpy(zero_copy_only=False))
            for vec_id, v in zip(batch.column("vec_id").to_pylist(), np.split(flat, ends[:-1]), strict=True):
                held.setdefault(len(v), []).append((vec_id, v))
                if len(held[len(v)]) == size:
                    yield out(len(v))
        for dim in list(held):
            yield out(dim)

    return run


def packed(rows: DataFrame, size: int) -> DataFrame:
    """One row per block with a dense number, written so that the numbers stay."""
    blocks = map_batches(rows, _block(size), "dim int, n int, ids binary, vectors binary")
    return cut_lineage(blocks)


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values (as float32), scale and norm of the error of each row."""
    scale = np.abs(vectors).max(axis=1) / 127
    scale[scale == 0] = np.finfo(float).tiny
    codes = np.rint(vectors / scale[:, None])
    error = np.sqrt(((vectors - codes * scale[:, None]) ** 2).sum(axis=1))
    return codes.astype(np.float32), scale, error


def nearest_in_tile(query_ids, queries, ids, vectors, k: int, heaps: dict) -> None:
    """Put the candidates of one tile that may be among a query's best into its heap of (-distance, -id)."""
    qc, qs, qe = quantised(queries)
    vc, vs, ve = quantised(vectors)
    # 127 * 127 * length stays below 2**24 for up to 1040 components, so a float32 product of a slice is exact.
    product = np.zeros((len(queries), len(vectors)))
    for at in range(0, queries.shape[1], 1024):
        product += qc[:, at : at + 1024] @ vc[:, at : at + 1024].T
    square = (qs**2 * (qc.astype(float) ** 2).sum(1))[:, None] + (vs**2 * (vc.astype(float) ** 2).sum(1))[None, :] - 2 * (qs[:, None] * vs[None, :]) * product
    near = np.sqrt(np.maximum(square, 0))
    # Rounding of the products themselves is far below this margin.
    slack = qe[:, None] + ve[None, :] + 1e-6 * (1 + near)
    for i, query in enumerate(query_ids.tolist()):
        upper = near[i] + slack[i]
        other = ids != query
        heap = heaps.setdefault(query, [])
        own = upper[other]
        bound = np.partition(own, k - 1)[k - 1] if len(own) > k else np.inf
        if len(heap) == k:
            bound = min(bound, -heap[0][0])
        chosen = np.flatnonzero(other & (near[i] - slack[i] <= bound))
        exact = np.sqrt(((vectors[chosen] - queries[i]) ** 2).sum(axis=1))
        order = np.lexsort((ids[chosen], exact))[:k]
        for d, v in zip(exact[order].tolist(), ids[chosen[order]].tolist(), strict=True):
            if len(heap) < k:
                heapq.heappush(heap, (-d, -v))
            elif (-d, -v) > heap[0]:
                heapq.heapreplace(heap, (-d, -v))
            else:
                break


def _tiles(k: int):
    def run(batches):
        heaps: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                query_ids, ids = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["ids"], "<i8")
                queries, vectors = (np.frombuffer(row[c], "<f8").reshape(-1, row["dim"]) for c in ("q_vectors", "vectors"))
                for at in range(0, len(query_ids), SLICE):
                    nearest_in_tile(query_ids[at : at + SLICE], queries[at : at + SLICE], ids, vectors, k, heaps)
            if len(heaps) > 8 * 2048:
                yield found(heaps)
                heaps = {}
        yield found(heaps)

    def found(heaps):
        rows = [(q, -v, -d) for q, heap in heaps.items() for d, v in heap]
        columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query_id", "vec_id", "score"])

    return run


def search(embeddings: DataFrame, is_query, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the ``k`` nearest of each row that ``is_query`` selects.

    A query id that several rows carry asks once, with the smallest of their vectors.
    """
    rows = usable(embeddings)
    candidates = packed(rows, CANDIDATES).withColumn("block", F.xxhash64(F.monotonically_increasing_id()))
    queries = cut_lineage(rows.where(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector")))
    asked = packed(queries.repartition(max(1, -(-queries.count() // QUERIES))), QUERIES)
    sent = asked.select("dim", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    found = map_batches(everywhere(candidates, sent, candidates.count()), _tiles(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
