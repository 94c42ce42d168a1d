"""Exact search of vectors by cosine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import ship

#: Queries that are sent to every task; more of them meet the vectors in blocks.
SENT_QUERIES, BLOCK = 20_000, 4_096
#: Queries and vectors of one matrix product: 8 MB of scores, whatever the tables' size.
TILE = 1_024
#: Numbers of a block of vectors that meets a block of queries: the larger, the fewer rows leave the pairs of blocks.
BLOCK_NUMBERS = 4_000_000
PAIRS = "query_id {0}, source_id {1}, score double"


def _by_length(a: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length -> (rows, matrix) of the arrays of numbers that are not null, hold no null and are not zero."""
    out, size = {}, pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False)
    for n in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == n)
        x = a.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
        fit = np.isfinite(x).all(1) & (x != 0).any(1)
        out[n] = rows[fit], x[fit]
    return out


def _block_top(q: dict, qid: pa.Array, v: pa.Array, vid: pa.Array, top_k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, vector, score) of the top_k of each query among the vectors: matrix products of TILE by TILE, whatever the batch's size."""
    found, order = [], None
    for n, (rows, x) in _by_length(v).items():
        if n not in q or not len(rows) or not len(q[n][0]):
            continue
        if order is None:  # places of the ids in their own order, for ties
            order = np.empty(len(vid), np.int64)
            order[pc.sort_indices(vid).to_numpy()] = np.arange(len(vid))
        # in the order of ids, so that a tie is the earlier column
        by = np.argsort(order[rows], kind="stable")
        rows, x = rows[by], x[by]
        norm = np.sqrt((x * x).sum(1))
        who, a = q[n]
        for lo in range(0, len(who), TILE):
            part = a[lo : lo + TILE]
            own = np.sqrt((part * part).sum(1))[:, None]
            best = None
            for at in range(0, len(rows), TILE):
                s = part @ x[at : at + TILE].T
                s /= own
                s /= norm[None, at : at + TILE]
                best = _better(best, np.round(s, 9, out=s), at, top_k)
            i, j, s = best
            found.append((who[lo + i], rows[j], s))
    return found


def _better(best: tuple | None, s: np.ndarray, at: int, top_k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, column, score), sorted: the top_k of each query of those before and of the scores of columns from `at` on; ties to earlier columns."""
    k = min(top_k, s.shape[1])
    edge = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
    i, j = np.nonzero(s >= edge[:, None])
    score, j = s[i, j], j + at
    if best is not None:
        i, j, score = (np.concatenate(c) for c in zip(best, (i, j, score), strict=True))
    by = np.lexsort((j, -score, i))
    i, j, score = i[by], j[by], score[by]
    kept = np.arange(len(i)) - np.searchsorted(i, i) < top_k
    return i[kept], j[kept], score[kept]


def _pairs(found: list, qid: pa.Array, vid: pa.Array) -> pa.RecordBatch:
    who, row, score = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return pa.RecordBatch.from_arrays([qid.take(pa.array(who)), vid.take(pa.array(row)), pa.array(score)], names=["query_id", "source_id", "score"])


def nearest(vectors: DataFrame, queries: DataFrame, top_k: int = 8, kind: str | None = None) -> DataFrame:
    """(query_id, rank, source_id, score): exact top_k by cosine, in double precision and rounded to 9 places; ties by source_id.

    Every vector meets every query, as an exact search must, in matrix products of Arrow batches; each batch
    passes on its top_k alone. Up to SENT_QUERIES queries, by count, are sent to every task. More of them are cut
    into blocks of BLOCK, as are the vectors into larger ones, and each pair of blocks is a task. Vectors of other lengths than a
    query's, null ones and zero ones are not met.
    """
    if top_k < 1:
        raise ValueError("limit must be at least 1")
    spark = vectors.sparkSession
    ship(spark)
    v = (vectors.where(F.col("kind") == kind) if kind else vectors).select("source_id", F.col("vector").alias("v"))
    q = queries.select("query_id", F.col("vector").alias("v"))
    types = PAIRS.format(q.schema["query_id"].dataType.simpleString(), v.schema["source_id"].dataType.simpleString())
    sent = q.limit(SENT_QUERIES + 1).toArrow()
    if sent.num_rows <= SENT_QUERIES:
        held = spark.sparkContext.broadcast(sent)

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = held.value.combine_chunks()
            qid = t["query_id"].combine_chunks() if t.num_rows else pa.array([], t.schema.field("query_id").type)
            own = _by_length(t["v"].combine_chunks()) if t.num_rows else {}
            for b in batches:
                yield _pairs(_block_top(own, qid, b.column(1), b.column(0), top_k), qid, b.column(0))

        scored = v.mapInArrow(meet, types)
    else:
        blocks = lambda n: -(-n // BLOCK)
        size = v.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
        nv = max(1, -(-size["n"] // max(BLOCK, BLOCK_NUMBERS // max(size["dim"] or 1, 1))))
        nq = blocks(q.count())
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = v.select("*", F.pmod(F.xxhash64("source_id"), F.lit(nv)).cast("int").alias("a"), every(nq).alias("b"))
        right = q.select("*", every(nv).alias("a"), F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("int").alias("b"))

        def pair(vs: pa.Table, qs: pa.Table) -> pa.Table:
            if not vs.num_rows or not qs.num_rows:
                return pa.Table.from_batches([_pairs([], pa.array([], qs.schema.field("query_id").type), pa.array([], vs.schema.field("source_id").type))])
            qid, vid = qs["query_id"].combine_chunks(), vs["source_id"].combine_chunks()
            return pa.Table.from_batches([_pairs(_block_top(_by_length(qs["v"].combine_chunks()), qid, vs["v"].combine_chunks(), vid, top_k), qid, vid)])

        scored = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(pair, types)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "source_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k).select("query_id", "rank", "source_id", "score")
