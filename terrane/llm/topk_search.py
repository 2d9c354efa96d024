"""Exact top-k search by inner product, pruned with segment means and deviations from coarse to fine.

A vector is cut into 1, 4 and 16 segments. With means m and deviations s of a segment of length n, the sum over
segments of n * ((mq - mx) ** 2 + (sq - sx) ** 2) bounds the squared distance from below, which is the same as
q.x <= sum of n * (mq * mx + sq * sx). Pairs whose bound at a level is under the query's k-th score so far go no
further; the others meet the next level, and at last the exact integer product.

Queries go in blocks of a fixed number; each block is sent to all tasks (its size is bounded) and met with every
vector; a task returns k rows a query at most. Nothing is dealt out by a key of the data.

Defined results: vectors that are null, or hold null, NaN or infinite components take no part; vectors of another
length than the query's don't either. Rows with the query's id are left out. Equal scores go by the smaller id; a
repeated candidate row counts each time; repeated query rows get one list (of the least vector). Empty tables give no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.common import cut

#: Segments by level, queries in a block, vectors in one numpy pass.
LEVELS, QUERY_BLOCK, PASS_ROWS = (1, 4, 16), 1024, 1024
_RESULT = "query_id long, vec_id long, score long"


def segment_summary(x: np.ndarray, parts: int) -> np.ndarray:
    """Means and deviations of the segments, each times the root of the segment's length: products of these rows are the bounds."""
    edges = np.linspace(0, x.shape[1], min(parts, max(1, x.shape[1])) + 1).astype(int)
    out = []
    for a, b in itertools.pairwise(edges):
        part = x[:, a:b]
        root = np.sqrt(max(1, b - a))
        out += [part.mean(axis=1) * root, part.std(axis=1) * root] if b > a else []
    return np.stack(out, axis=1) if out else np.zeros((len(x), 1))


class _Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.q = self.x = self.score = np.zeros(0, np.int64)
        self.least = np.full(n, -np.inf)

    def add(self, q: np.ndarray, x: np.ndarray, score: np.ndarray) -> None:
        q, x, score = np.concatenate([self.q, q]), np.concatenate([self.x, x]), np.concatenate([self.score, score])
        order = np.lexsort((x, -score, q))
        q, x, score = q[order], x[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        self.q, self.x, self.score = q[keep], x[keep], score[keep]
        last = rank == self.k - 1
        self.least[q[last]] = score[last]


def _products(queries: np.ndarray, vectors: np.ndarray, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products of the pairs."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, vectors.shape[1])
    if bound < 2**52 and len(q) * 8 > len(queries) * len(vectors):
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T)[q, x].astype(np.int64)
    if bound < 2**62:
        return np.einsum("ij,ij->i", queries[q], vectors[x])
    whole = (queries[q].astype(object) * vectors[x].astype(object)).sum(axis=1)
    if any(abs(v) >= 1 << 63 for v in whole):
        raise OverflowError("an inner product is beyond 64 bits")
    return whole.astype(np.int64)


def _scan(ids: np.ndarray, queries: np.ndarray, k: int):
    """A scan of vectors for the given queries; the queries all have one length."""
    float_queries = queries.astype(np.float64)
    summaries = [segment_summary(float_queries, n) for n in LEVELS]
    norms = np.sqrt((float_queries**2).sum(axis=1))

    def scan(best: _Best, vec_id: np.ndarray, vectors: np.ndarray) -> None:
        real = vectors.astype(np.float64)
        size = np.sqrt((real**2).sum(axis=1))
        q, x = None, None
        for n, own in zip(LEVELS, summaries, strict=True):
            other = segment_summary(real, n)
            if q is None:
                upper = own @ other.T
                slack = 1e-9 * (norms[:, None] * size[None, :]) + 1e-6
                q, x = np.nonzero(upper + slack >= best.least[:, None])
            else:
                if len(q) * 8 > len(ids) * len(vec_id):
                    upper = (own @ other.T)[q, x]
                else:
                    upper = np.einsum("ij,ij->i", own[q], other[x])
                alive = upper + 1e-9 * norms[q] * size[x] + 1e-6 >= best.least[q]
                q, x = q[alive], x[alive]
        alive = ids[q] != vec_id[x]
        q, x = q[alive], x[alive]
        if len(q):
            score = _products(queries, vectors, q, x)
            alive = score >= best.least[q]
            best.add(q[alive], vec_id[x[alive]], score[alive])

    return scan


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 10, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k largest integer products of each query with all other vectors.

    vectors: vec_id long, vector array<long>. is_query: the condition on vectors that makes a row a query.
    """
    spark = vectors.sparkSession
    vectors = vectors.select("vec_id", "vector").where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull()))
    asked = vectors.where(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector")).toLocalIterator()
    found = []
    while rows := list(itertools.islice(asked, block)):
        by_length: dict[int, dict[int, list[int]]] = {}
        for r in rows:
            by_length.setdefault(len(r.vector), {}).setdefault(r.vec_id, r.vector)
        sent = spark.sparkContext.broadcast({n: (np.array(list(own), np.int64), np.array(list(own.values()), np.int64).reshape(len(own), n)) for n, own in by_length.items()})
        part = vectors.mapInArrow(_task(sent, k), _RESULT)
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        part = part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        found.append(part)
        if len(found) > 1 or len(rows) == block:  # each further block is its own job, written down before the next
            found[-1] = cut(part)
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def _task(sent, k: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {n: (ids, _scan(ids, queries, k), _Best(len(ids), k)) for n, (ids, queries) in sent.value.items()}
        for batch in batches:
            vec_id, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            offsets = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False).astype(np.int64)
            length = np.diff(offsets)
            for n, (_, scan, best) in kinds.items():
                rows = np.flatnonzero(length == n)
                for at in range(0, len(rows), PASS_ROWS):
                    these = rows[at : at + PASS_ROWS]
                    scan(best, vec_id[these], values[offsets[these][:, None] + np.arange(n)[None, :]])
        for ids, _, best in kinds.values():
            if len(best.q):
                yield pa.RecordBatch.from_arrays([pa.array(ids[best.q]), pa.array(best.x), pa.array(best.score)], names=["query_id", "vec_id", "score"])

    return task
