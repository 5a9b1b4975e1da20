"""Nearest vectors of a stated query set among all rows, exact.

The queries are taken in blocks of ``block`` vectors, each with one pass over the table: a task multiplies its vectors with
the block's and keeps, for each query, its own best. What is shuffled is k rows for each query and task.

Rows with NULL, empty or non-finite vectors, or another length than the queries', are left out, as are zero vectors for
cosine. Equal distances: the smaller id. Repeated ids: one of them. Empty tables: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _matrix(ids: list, vectors: list, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    kept = [(i, v) for i, v in zip(ids, vectors) if i is not None and v and None not in v and (width is None or len(v) == width)]
    if not kept:
        return np.zeros(0, np.int64), np.zeros((0, width or 1))
    width = width or len(kept[0][1])
    kept = [x for x in kept if len(x[1]) == width]
    m = np.array([v for _, v in kept], np.float64)
    ids_ = np.array([i for i, _ in kept], np.int64)
    good = np.isfinite(m).all(axis=1)
    return ids_[good], m[good]


def nearest(table: DataFrame, queries: DataFrame, k: int, *, block: int = 4096, digits: int = 6) -> DataFrame:
    """table and queries: (id bigint, vector array). Result: (q, id, d, rank): Euclidean distance, rounded, the query itself left out."""
    out: DataFrame | None = None
    rows = queries.select("id", "vector").toLocalIterator()
    while chunk := [r for _, r in zip(range(block), rows)]:
        part = _search(table, *_matrix([r.id for r in chunk], [r.vector for r in chunk]), k, digits)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = _search(table, np.zeros(0, np.int64), np.zeros((0, 1)), k, digits)
    w = Window.partitionBy("q").orderBy("d", "id")
    best = out.groupBy("q", "id").agg(F.min("d").alias("d")).withColumn("rank", F.row_number().over(w))
    return best.where(F.col("rank") <= k)


def _search(table: DataFrame, ids: np.ndarray, asked: np.ndarray, k: int, digits: int) -> DataFrame:
    sent = table.sparkSession.sparkContext.broadcast((ids, asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, q = sent.value
        norms = (q * q).sum(axis=1)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                own, m = _matrix(part.column("id").to_pylist(), part.column("vector").to_pylist(), q.shape[1])
                if not len(own) or not len(q):
                    continue
                # rounded before ranking, so that ties fall alike however rows are batched
                d2 = np.maximum(norms[:, None] + (m * m).sum(axis=1)[None, :] - 2 * (q @ m.T), 0)
                d = np.round(np.sqrt(d2), digits)
                d[queries[:, None] == own[None, :]] = np.inf
                order = np.lexsort((np.broadcast_to(own, d.shape), d), axis=1)[:, :k]
                rows = np.repeat(np.arange(len(q)), order.shape[1])
                cols = order.ravel()
                found = d[rows, cols]
                good = np.isfinite(found)
                yield pa.RecordBatch.from_arrays([pa.array(queries[rows[good]]), pa.array(own[cols[good]]), pa.array(found[good])], ["q", "id", "d"])

    return table.select("id", "vector").mapInArrow(run, "q bigint, id bigint, d double")


def count_within(table: DataFrame, queries: DataFrame, radius: float, *, block: int = 4096, digits: int = 6) -> DataFrame:
    """(q, n): how many other rows lie within ``radius`` of each query that has any; each task sends one count a query."""
    out: DataFrame | None = None
    rows = queries.select("id", "vector").toLocalIterator()
    while chunk := [r for _, r in zip(range(block), rows)]:
        sent = table.sparkSession.sparkContext.broadcast(_matrix([r.id for r in chunk], [r.vector for r in chunk]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            n, norms = np.zeros(len(ids), np.int64), (q * q).sum(axis=1)
            for batch in batches:
                for at in range(0, batch.num_rows, 2048):
                    part = batch.slice(at, 2048)
                    own, m = _matrix(part.column("id").to_pylist(), part.column("vector").to_pylist(), q.shape[1])
                    if len(own) and len(ids):
                        d2 = np.maximum(norms[:, None] + (m * m).sum(axis=1)[None, :] - 2 * (q @ m.T), 0)
                        n += ((np.round(np.sqrt(d2), digits) <= radius) & (ids[:, None] != own[None, :])).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], ["q", "n"])

        part = table.select("id", "vector").mapInArrow(run, "q bigint, n bigint")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return table.sparkSession.createDataFrame([], "q bigint, n bigint")
    return out.groupBy("q").agg(F.sum("n").alias("n")).where("n > 0")
