"""Exact top-k search by distributed histogram selection.

Vectors become whole numbers, so scores (inner products) are exact. All scores of a group of queries
are computed again in each round, block by block, and only counted: a histogram of HISTOGRAM bins
over each query's current score range, added up over all partitions. The bin that holds the kth
highest score becomes the next range, until the range is one score or few candidates are at or
above it. A last round keeps candidates at or above it, the k best of each partition under the
order (score descending, id ascending), and merges those.

Queries come in groups of at most about GROUP, so what is broadcast is bounded; candidates are
never shuffled, and no row per (query, candidate) is made but for the last few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm import common

HISTOGRAM, GROUP, ROWS = 64, 4096, 1024
#: A query whose range leaves at most so many candidates above it needs no further round.
FEW = 64
CHOSEN = "query_id long, length long, place long, vec_id long, score long"


def whole_numbers(vectors: DataFrame, scale: int = 256, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(id, q) with q the components floor(scale * x). Null ids and vectors, empty vectors, and
    vectors with null or non-finite components are left out."""
    x = F.col(vector)
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("id"), x.cast("array<double>").alias("x")).where("id IS NOT NULL AND x IS NOT NULL AND size(x) > 0")
    return rows.where(F.forall("x", fine)).select("id", F.transform("x", lambda v: F.floor(v * scale)).alias("q"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of at most ROWS vectors of one length."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        lists = batch.column(1)
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        starts = np.cumsum(sizes) - sizes
        for d in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == d)
            for i in range(0, len(rows), ROWS):
                r = rows[i : i + ROWS]
                yield ids[r], flat[starts[r][:, None] + np.arange(d)]


def _scores(matrix: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Exact inner products: floats where every sum stays under 2^53, whole numbers else."""
    most = float(np.abs(matrix).max(initial=0)) * float(np.abs(queries).max(initial=0)) * matrix.shape[1]
    if most < 2**53:
        return (matrix.astype(np.float64) @ queries.T.astype(np.float64)).astype(np.int64)
    return matrix @ queries.T


class _Group:
    """Queries of one length, with their score ranges [low, high) and how many stand above each."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, bound: int, k: int):
        self.ids, self.matrix, self.k = ids, matrix, k
        self.low = np.full(len(ids), -bound, dtype=np.int64)
        self.high = np.full(len(ids), bound + 1, dtype=np.int64)
        self.above = np.zeros(len(ids), dtype=np.int64)  # candidates at or over high
        self.open = np.ones(len(ids), dtype=bool)

    def widths(self) -> np.ndarray:
        return np.maximum(1, -(-(self.high - self.low) // HISTOGRAM))

    def refine(self, counts: np.ndarray) -> None:
        """counts: (queries, HISTOGRAM) of this round."""
        width = self.widths()
        from_top = np.cumsum(counts[:, ::-1], axis=1) + self.above[:, None]
        enough = from_top >= self.k
        for i in np.flatnonzero(self.open).tolist():
            if not enough[i].any():  # fewer candidates than k in all
                self.open[i] = False
                continue
            bin_ = HISTOGRAM - 1 - int(enough[i].argmax())
            at_or_over = int(from_top[i, HISTOGRAM - 1 - bin_])
            high = self.low[i] + (bin_ + 1) * width[i]
            self.above[i] = at_or_over - int(counts[i, bin_])
            self.low[i], self.high[i] = self.low[i] + bin_ * width[i], min(self.high[i], high)
            self.open[i] = self.high[i] - self.low[i] > 1 and at_or_over > max(FEW, self.k)


def _counted(rows: DataFrame, groups) -> dict[int, np.ndarray]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = groups.value
        sums = {d: np.zeros((len(g.ids), HISTOGRAM), dtype=np.int64) for d, g in held.items()}
        for ids, matrix in _blocks(batches):
            g = held.get(matrix.shape[1])
            if g is None:
                continue
            live = np.flatnonzero(g.open)
            score = _scores(matrix, g.matrix[live])
            low, high, width = g.low[live], g.high[live], g.widths()[live]
            inside = (score >= low) & (score < high) & (ids[:, None] != g.ids[live])
            r, q = np.nonzero(inside)
            cell = live[q] * HISTOGRAM + (score[r, q] - low[q]) // width[q]
            sums[matrix.shape[1]] += np.bincount(cell, minlength=len(g.ids) * HISTOGRAM).reshape(-1, HISTOGRAM)
        for d, s in sums.items():
            flat = s.reshape(-1)
            at = np.flatnonzero(flat)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), d)), pa.array(at), pa.array(flat[at])], names=["d", "cell", "n"])

    got = rows.mapInArrow(count, "d long, cell long, n long").groupBy("d", "cell").agg(F.sum("n").alias("n"))
    out = {d: np.zeros(len(g.ids) * HISTOGRAM, dtype=np.int64) for d, g in groups.value.items()}
    for r in got.toLocalIterator():
        out[r.d][r.cell] = r.n
    return {d: x.reshape(-1, HISTOGRAM) for d, x in out.items()}


def _chosen(rows: DataFrame, groups, k: int) -> DataFrame:
    """The k best of each partition for each query, of those at or over the query's low."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = groups.value
        kept: dict[int, list[np.ndarray]] = {d: [np.empty(0, np.int64)] * 3 for d in held}
        for ids, matrix in _blocks(batches):
            d = matrix.shape[1]
            if d not in held:
                continue
            g = held[d]
            score = _scores(matrix, g.matrix)
            r, q = np.nonzero((score >= g.low) & (ids[:, None] != g.ids))
            query, vec, value = (np.concatenate([a, b]) for a, b in zip(kept[d], (q, ids[r], score[r, q]), strict=True))
            order = np.lexsort((vec, -value, query))
            query, vec, value = query[order], vec[order], value[order]
            first = np.searchsorted(query, query, side="left")
            best = np.arange(len(query)) - first < k
            kept[d] = [query[best], vec[best], value[best]]
        for d, (query, vec, value) in kept.items():
            if len(query):
                yield pa.RecordBatch.from_arrays([pa.array(held[d].ids[query]), pa.array(np.full(len(query), d)), pa.array(query), pa.array(vec), pa.array(value)], names=["query_id", "length", "place", "vec_id", "score"])

    return rows.mapInArrow(choose, CHOSEN)


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query, exactly.

    is_query: a condition on a Column of ids. Every row but those with the query's own id is a
    candidate; fewer than k candidates are all returned. Ties go to the smaller id. Vectors that
    whole_numbers() leaves out take no part, and vectors meet only those of their own length.
    Repeated rows are candidates each; a query id that occurs twice is asked twice. Only key and
    vector are read. No rows or no queries: an empty result. Vectors so long that a score could pass
    64 bits are refused with an error.
    """
    spark = vectors.sparkSession
    rows = common.written(whole_numbers(vectors, scale, vector, key), "whole-vectors")
    queries = rows.where(is_query(F.col("id")))
    n, most = queries.count(), rows.agg(F.max(F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x))).first()[0]
    bound = int(most * 1.01) + 2 if most is not None else 1
    if bound >= 1 << 62:
        raise ValueError("scores of these vectors don't fit into 64 bits")
    parts = max(1, -(-n // GROUP))
    path = common.shared_path(spark, "top-k")
    for p in range(parts):
        own = queries if parts == 1 else queries.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == p)
        by_length: dict[int, list] = {}
        for r in own.orderBy("id").collect():
            by_length.setdefault(len(r.q), []).append((r.id, r.q))
        held = {d: _Group(np.array([i for i, _ in x], dtype=np.int64), np.array([q for _, q in x], dtype=np.int64), bound, k) for d, x in by_length.items()}
        while any(g.open.any() for g in held.values()):
            groups = spark.sparkContext.broadcast(held)
            counts = _counted(rows, groups)
            for d, g in held.items():
                g.refine(counts[d])
            groups.unpersist()
        groups = spark.sparkContext.broadcast(held)
        _chosen(rows, groups, k).write.mode("append").parquet(path)  # so the plan does not grow with the queries
        groups.unpersist()
    out = spark.read.schema(CHOSEN).parquet(path)
    order = Window.partitionBy("query_id", "length", "place").orderBy(F.desc("score"), "vec_id")
    ranked = out.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
