"""Exact cosine search that skips by distances to pivots.

On unit vectors the order by cosine is that by distance, and distances obey the triangle inequality. Each vector is
dealt to the nearest of a bounded number of pivots and stored in blocks of one cell and of nearly one distance to its
pivot. For a query with distance d to a cell's pivot, nothing in a block of distances between a and b is nearer than
max(d - b, a - d), nor than half of what d exceeds the query's distance to its own nearest pivot. A search meets the
blocks that may be nearest first, so as to have a bound on the k-th neighbour, once more with a wider choice, and then
every block that is not beyond that bound. So the result is that of meeting every vector; how few are met depends
on how far the data cluster.

Vectors and queries that are null, zero, not finite or of another length than the index's take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tessera.operators.nearest import PAIRS, _block_top, _by_length, _pairs
from tessera.runtime import partitions, settle, ship, small

#: Pivots at most, rows that they are chosen from, rows of a block, queries that meet a block at once.
PIVOTS, SAMPLE, ROWS, AT_ONCE = 256, 8_192, 256, 4_096
#: Rows that the two first rounds meet, as multiples of the results asked for.
ROUNDS = (4, 64)
#: What rounding may change in a distance, and in a score.
NEAR, SCORE = 1e-7, 1e-8


@dataclass(frozen=True)
class PivotIndex:
    dim: int
    pivots: np.ndarray  # unit vectors, a row each
    cells: np.ndarray  # least and largest distance of each pivot's vectors; none: inf, -inf
    rows: DataFrame  # block, source_id, v
    blocks: DataFrame  # block, cell, n, low, high
    count: int


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Of unit vectors, row by row; small ones exactly, as 2 - 2 cos loses their digits."""
    d = np.sqrt(np.maximum(2 - 2 * (x @ pivots.T), 0))
    for i, j in zip(*np.nonzero(d < 1e-3), strict=True):
        d[i, j] = np.linalg.norm(x[i] - pivots[j])
    return d


def _spread(x: np.ndarray, count: int) -> np.ndarray:
    """Up to count rows, each the farthest from those before."""
    chosen, far = [0], np.linalg.norm(x - x[0], axis=1)
    while len(chosen) < min(count, len(x)) and far.max() > 1e-6:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(x - x[chosen[-1]], axis=1))
    return x[chosen]


def build(vectors: DataFrame, dim: int, kind: str | None = None) -> PivotIndex:
    """Index the vectors (source_id, vector[, kind]) of length dim: pivots from a bounded sample, every row in a block."""
    spark = vectors.sparkSession
    ship(spark)
    v = (vectors.where(F.col("kind") == kind) if kind else vectors).select("source_id", F.col("vector").alias("v")).where(F.size("v") == dim)
    sample = v.orderBy(F.xxhash64("source_id"), "source_id").limit(SAMPLE).toArrow().combine_chunks()
    found = _by_length(sample["v"].combine_chunks()).get(dim) if sample.num_rows else None
    pivots = _spread(_unit(found[1]), PIVOTS) if found is not None and len(found[1]) else np.zeros((0, dim))
    source = v.schema["source_id"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = _by_length(b.column(1)).get(dim, (np.zeros(0, np.int64), np.zeros((0, dim))))
            for lo in range(0, len(rows), 4096):
                d = _distances(_unit(x[lo : lo + 4096]), pivots) if len(pivots) else np.zeros((len(rows[lo : lo + 4096]), 1))
                cell = d.argmin(1)
                part = b.take(pa.array(rows[lo : lo + 4096]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], names=["source_id", "v", "cell", "r"])

    dealt = settle(v.mapInArrow(assign, f"source_id {source}, v {v.schema['v'].dataType.simpleString()}, cell int, r double"), "pivot-cells")
    ranges = dealt.repartitionByRange(partitions(spark), "cell", "r", "source_id").sortWithinPartitions("cell", "r", "source_id").withColumn("block", F.lit(0).cast(LongType()))
    ranges = ranges.withColumn("part", F.spark_partition_id())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, at = 0, 0, None  # blocks follow the order and end with their cell
        for b in batches:
            cell, number = b.column("cell").to_numpy(), np.zeros(b.num_rows, np.int64)
            for i, c in enumerate(cell.tolist()):
                if c != at or held == ROWS:
                    block, held, at = block + 1, 0, c
                held += 1
                number[i] = block
            number += b.column("part").to_numpy().astype(np.int64) << 40
            yield b.set_column(b.schema.get_field_index("block"), "block", pa.array(number))

    rows = settle(ranges.mapInArrow(cut, ranges.schema), "pivot-rows")
    blocks = settle(rows.groupBy("block", "cell").agg(F.count("*").alias("n"), F.min("r").alias("low"), F.max("r").alias("high")), "pivot-blocks")
    cells = np.tile([np.inf, -np.inf], (max(1, len(pivots)), 1))
    count = 0
    for r in blocks.groupBy("cell").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).collect():  # a row for each pivot
        cells[r["cell"]], count = (r["low"], r["high"]), count + r["n"]
    return PivotIndex(dim, pivots, cells, rows.select("block", "source_id", "v"), blocks, count)


def _cells(index: PivotIndex, asked: DataFrame) -> DataFrame:
    """(query_id, cell, d, least, score): the cells that may hold a neighbour of a query (query_id, v[, score: of the k-th so far])."""
    bounded, dim, pivots, cells = "score" in asked.columns, index.dim, index.pivots, index.cells  # not the frames

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = _by_length(b.column(1)).get(dim, (np.zeros(0, np.int64), np.zeros((0, dim))))
            if not len(rows) or not len(pivots):
                continue
            d = _distances(_unit(x), pivots)
            score = b.column(2).to_numpy(zero_copy_only=False)[rows] if bounded else np.full(len(rows), -2.0)
            least = np.maximum(np.maximum(d - cells[:, 1], cells[:, 0] - d), (d - d.min(1)[:, None]) / 2)
            least = np.maximum(least - NEAR, 0)
            i, j = np.nonzero((1 - least * least / 2 >= score[:, None] - SCORE) & (cells[:, 0] < np.inf))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows[i])), pa.array(j.astype(np.int32)), pa.array(d[i, j]), pa.array(least[i, j]), pa.array(score[i])], names=["query_id", "cell", "d", "least", "score"])

    return asked.mapInArrow(run, f"query_id {asked.schema['query_id'].dataType.simpleString()}, cell int, d double, least double, score double")


def _visits(index: PivotIndex, asked: DataFrame) -> DataFrame:
    """(query_id, block, n, least): the blocks that may hold a neighbour."""
    near = _cells(index, asked).join(small(index.blocks), "cell")
    gap = F.greatest(F.col("least"), F.col("d") - F.col("high") - NEAR, F.col("low") - F.col("d") - NEAR)
    near = near.select("query_id", "block", "n", gap.alias("least"), "score")
    return near.where(1 - F.col("least") * F.col("least") / 2 >= F.col("score") - SCORE).select("query_id", "block", "n", "least")


def _meet(index: PivotIndex, asked: DataFrame, visits: DataFrame, top_k: int, groups: int) -> DataFrame:
    """(query_id, source_id, score): the top_k of each visited block for each of its queries."""
    qs = visits.select("query_id", "block").join(asked.select("query_id", "v"), "query_id").withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"))
    parts = qs.select("block", F.col("part").alias("of")).distinct()
    vs = index.rows.join(parts, "block").select("block", "of", "source_id", "v")
    query, source = (f.schema[c].dataType.simpleString() for f, c in ((asked, "query_id"), (index.rows, "source_id")))

    def pair(v: pa.Table, q: pa.Table) -> pa.Table:
        qid, vid = q["query_id"].combine_chunks(), v["source_id"].combine_chunks()
        return pa.Table.from_batches([_pairs(_block_top(_by_length(q["v"].combine_chunks()), qid, v["v"].combine_chunks(), vid, top_k), qid, vid)])

    return vs.groupBy("block", "of").cogroup(qs.groupBy("block", "part")).applyInArrow(pair, PAIRS.format(query, source))


@dataclass(frozen=True)
class Found:
    hits: DataFrame  # query_id, rank, source_id, score
    met: DataFrame  # query_id, blocks, vectors: what was met


def search(index: PivotIndex, queries: DataFrame, top_k: int = 8) -> Found:
    """The top_k of each query (query_id, vector) as `nearest` gives them, and how much was met for them."""
    if top_k < 1:
        raise ValueError("limit must be at least 1")
    asked = settle(queries.select("query_id", F.col("vector").alias("v")).where(F.size("v") == index.dim), "asked")
    groups = max(1, -(-asked.count() // AT_ONCE))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "source_id")
    top = lambda scored: scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k)
    visited, bounded = None, asked
    for times in ROUNDS:
        order = Window.partitionBy("query_id").orderBy("least", "block").rowsBetween(Window.unboundedPreceding, -1)
        first = _visits(index, bounded).withColumn("__before", F.coalesce(F.sum("n").over(order), F.lit(0))).where(F.col("__before") < times * top_k)
        first = settle(first.select("query_id", "block", "n"), "visits")
        kth = top(_meet(index, asked, first, top_k, groups)).where(F.col("rank") == top_k).select("query_id", "score")
        bounded = settle(asked.join(kth, "query_id", "left").select("query_id", "v", F.coalesce("score", F.lit(-2.0)).alias("score")), "bounds")
        visited = first if visited is None else visited.union(first)
    last = settle(_visits(index, bounded).select("query_id", "block", "n"), "visits")
    hits = top(_meet(index, asked, last, top_k, groups)).select("query_id", "rank", "source_id", "score")
    met = visited.union(last).distinct().groupBy("query_id").agg(F.count("*").alias("blocks"), F.sum("n").alias("vectors"))
    return Found(hits, met)
