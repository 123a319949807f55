"""Exact top-k inner product search over an impact-ordered index, score at a time.

Vectors are cut into shards. A shard's postings (vector, value) are kept by dimension and quantised
impact, the power of two below |value|: a segment for each. The index is built once for each shard,
and queries stream through it in batches. Segments are processed from the highest impact down, each
adding its part to the scores of the vectors that it lists. After each impact, what is still to come
for a vector is at most |query| times the norm of its unprocessed values (Cauchy and Schwarz), so a
query stops only when a proof holds: every vector outside its possible members has an upper bound
below the k-th best lower bound. Possible members are scored again exactly in 64-bit integers.
Shards' best k are merged in an aggregation.

A vector is shuffled once and a query once to each shard. Every query meets every vector by contract,
so work grows with the product of both; larger shards need fewer copies of queries and more memory.

Defined results: vectors that are null or hold null, NaN or infinite components take no part, nor do
rows with a null id; shorter vectors count as ended by zeros; ties go to the smaller id; a query's
own row is known by its id, so rows that repeat an id are no candidates for that id's query; a
query asked twice is answered once, by its least vector; with fewer candidates than k, all are
returned. A component for which |scale * x| is 2^24 or more is an error, as scores could not be exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from relata.llm.common import prepare

#: Vectors of a shard, the least for which another shard pays, and queries of a batch.
SHARD_ROWS, LEAST_ROWS, BLOCK_ROWS = 32_768, 1024, 128
#: Rounding in double precision is far below this share of |query| * |vector|.
SLACK = 1e-9
LARGEST = 1 << 24


class ImpactIndex:
    """A shard's vectors, and its postings by falling impact and dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        size = np.abs(vectors)
        impact = np.zeros(vectors.shape, dtype=np.int8)
        impact[size > 0] = np.floor(np.log2(size[size > 0])) + 1
        levels = sorted(set(impact[impact > 0].tolist()), reverse=True)
        if len(levels) > 3:  # the highest impacts are few: join them until each group holds a share of the postings
            levels = [levels[i] for i in range(len(levels)) if i == len(levels) - 1 or (impact >= levels[i]).mean() >= 0.05]
        left = (vectors.astype(np.float64) ** 2).sum(axis=1)
        self.norms = np.sqrt(left)
        #: For each impact: (dimension, vectors, values) of its segments, and the norms of what comes after it.
        self.impacts: list[tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray]] = []
        above = 127
        for level in levels:
            inside = (impact >= level) & (impact < above)
            segments = []
            for d in np.flatnonzero(inside.any(axis=0)).tolist():
                rows = np.flatnonzero(inside[:, d])
                segments.append((d, rows, vectors[rows, d].astype(np.float64)))
            left = left - np.where(inside, vectors, 0).astype(np.float64).__pow__(2).sum(axis=1)
            self.impacts.append((segments, np.sqrt(np.maximum(left, 0))))
            above = level

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vector, score) of each query's k best in this shard."""
        open_, q = np.arange(len(query_ids)), np.ascontiguousarray(queries.T.astype(np.float64))
        norm = np.sqrt((q * q).sum(axis=0))
        own = self.ids[:, None] == query_ids[None, :]
        score, members = np.zeros(own.shape), {}
        for i, (segments, rest) in enumerate(self.impacts or [([], np.zeros(len(self.ids)))]):
            for d, rows, values in segments:
                score[rows] += values[:, None] * q[d]
            margin = (rest + SLACK * self.norms)[:, None] * norm
            lower = np.where(own, -np.inf, score - margin)
            kth = np.partition(lower, -k, axis=0)[-k] if len(lower) > k else np.full(len(open_), -np.inf)
            possible = (score + margin >= kth) & ~own
            done = (possible.sum(axis=0) <= 4 * k) | (i >= len(self.impacts) - 1)
            members |= {int(open_[j]): np.flatnonzero(possible[:, j]) for j in np.flatnonzero(done).tolist()}
            if done.all():
                break
            if done.any():
                open_, q, norm, own, score = open_[~done], q[:, ~done], norm[~done], own[:, ~done], score[:, ~done]
        out = []
        for j, rows in members.items():
            exact = self.vectors[rows] @ queries[j]
            best = np.lexsort((self.ids[rows], -exact))[:k]
            out.append((np.full(len(best), query_ids[j]), self.ids[rows[best]], exact[best]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.array([], dtype=np.int64),) * 3


def quantised(vector: Column, scale: int) -> Column:
    def whole(x: Column) -> Column:
        y = x.cast("double") * scale
        return F.when(F.abs(y) < LARGEST, F.floor(y)).otherwise(F.raise_error(F.lit(f"a component is {LARGEST} or more"))).cast("long")

    return F.transform(vector, whole)


def _matrix(vectors: list[np.ndarray], width: int) -> np.ndarray:
    """Vectors as rows, cut or filled by zeros to a width."""
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : min(len(v), width)] = v[:width]
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, *, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's k best vectors: query_id, rank, vec_id, score.

    A partition holds whole shards, each with its vectors first, so a task's memory is bounded by a
    shard and a batch of queries. Only k rows for each query and shard come out.
    """
    spark = vectors.sparkSession
    prepare(spark, 4096)
    sound = lambda v: v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    clean = lambda df: df.where(F.col(id_col).isNotNull() & sound(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v"))
    base, asked = clean(vectors), clean(queries).groupBy("id").agg(F.min("v").alias("v"))
    n = base.count()
    n_shards = max(1, -(-n // SHARD_ROWS), min(spark.sparkContext.defaultParallelism, n // LEAST_ROWS))
    shards = F.array(*map(F.lit, range(n_shards))) if n_shards <= 64 else F.sequence(F.lit(0), F.lit(n_shards - 1))
    asked = asked.select(F.explode(shards).alias("shard"), F.lit(True).alias("is_query"), "id", "v")
    base = base.select(F.pmod(F.xxhash64("id"), F.lit(n_shards)).cast("int").alias("shard"), F.lit(False).alias("is_query"), "id", "v")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, shard, index = ["query_id", "vec_id", "score"], None, None
        ids: list[int] = []
        held: list[np.ndarray] = []

        def answers() -> Iterator[pa.RecordBatch]:
            if ids and index is not None and len(index.ids):
                found = index.search(np.array(ids), _matrix(held, index.vectors.shape[1]), k)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names)

        for batch in batches:
            lists = batch.column(3)
            flat, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for i, (own, is_query, id_) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True)):
                if own != shard:
                    yield from answers()
                    shard, index, ids, held = own, None, [], []
                if is_query and index is None:
                    index, ids, held = ImpactIndex(np.array(ids, dtype=np.int64), _matrix(held, max([1, *map(len, held)]))), [], []
                ids.append(id_)
                held.append(flat[at[i] : at[i + 1]])
                if is_query and len(ids) == BLOCK_ROWS:
                    yield from answers()
                    ids, held = [], []
        yield from answers()

    rows = base.union(asked).repartition(n_shards, "shard").sortWithinPartitions("shard", "is_query")
    found = rows.mapInArrow(search, "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
