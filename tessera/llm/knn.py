"""Approximate nearest neighbours: hierarchical k-means tree, best-bin-first.

Equal vectors collapse first: each distinct one keeps its smallest ids, as many as a
result can hold, so a vector that a third of all rows share is one row from there on.

A k-means tree is fitted on a bounded sample (SAMPLE distinct vectors, those of the
smallest hash, half of the table at most) and holds every row of the table. The number
of cells follows the table, about CELL_ROWS rows each: beyond what the sample can fit,
each leaf of the tree is the root of a second tree, fitted on what the leaves' centres
leave over and shared by all leaves, so SAMPLE / LEAST leaves of either tree make their
product of cells while both stay small enough to send to every task. A query visits
cells through a priority queue of branches, nearest first. How many it visits is
calibrated: queries from outside of the sample are compared with every row by brute
force, and visits widen until the share of true neighbours in the visited cells
reaches the target recall.

Cells are dealt into groups of about GROUP_ROWS rows by a hash, larger groups into
parts. A task holds one part at a time and streams the queries that visit it, each once
with its cells, so neither many queries nor many rows have to fit into memory. Scores
are cosines of the original vectors in double precision. What is broadcast or collected
is bounded: the two trees, and CALIBRATION queries with their neighbours.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite
component take no part; of several lengths the most frequent takes part (the smaller
in a tie). Rows that share a vec_id with different vectors are rows of their own, repeated
rows count once, and none is a neighbour of a query with its vec_id; each query id has
one list, of its nearest by any of its vectors. A query without candidates has no rows.
Null vec_ids take no part. Extra columns are left out.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.runtime import partitions, settle, ship, small, table

SAMPLE, BRANCH, LEAST, CELL_ROWS = 20_000, 12, 10, 128
GROUP_ROWS, CALIBRATION, TARGET = 16_384, 128, 0.985


class Tree:
    """Centres of a k-means tree; leaves are numbered from 0 and hold at most `most` rows of x, but for copies."""

    def __init__(self, x: np.ndarray, most: int, seed: int = 0):
        rng, centre = np.random.default_rng(seed), []
        self.nodes: list = [None]  # (centres, kids) of inner nodes
        self.leaf_of: list[int] = [-1]  # of each node, -1 for inner ones
        todo = [(0, x)]
        while todo:
            at, rows = todo.pop(0)
            k = min(BRANCH, -(-len(rows) // max(most, 1)), len(np.unique(rows, axis=0))) if len(rows) > most else 1
            centres, label = self._kmeans(rows, k, rng) if k > 1 else (rows[:1], None)
            if len(centres) < 2:
                self.leaf_of[at] = len(centre)
                centre.append(rows.mean(0))
                continue
            kids = list(range(len(self.nodes), len(self.nodes) + len(centres)))
            self.nodes[at] = (centres, kids)
            self.nodes += [None] * len(kids)
            self.leaf_of += [-1] * len(kids)
            todo += [(k, rows[label == i]) for i, k in enumerate(kids)]
        self.centre = np.stack(centre)

    @property
    def leaves(self) -> int:
        return len(self.centre)

    def _kmeans(self, x: np.ndarray, k: int, rng) -> tuple[np.ndarray, np.ndarray]:
        u = np.unique(x, axis=0)
        c = u[rng.choice(len(u), k, replace=False)]
        for _ in range(8):
            label = self._nearest(x, c)
            used = np.unique(label)
            c = np.stack([x[label == i].mean(0) for i in used])
        label = self._nearest(x, c)
        used, label = np.unique(label, return_inverse=True)
        return c[used], label

    @staticmethod
    def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return ((c * c).sum(1)[None, :] - 2 * (x @ c.T)).argmin(1)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            if not len(rows):
                continue
            if self.nodes[at] is None:
                out[rows] = self.leaf_of[at]
                continue
            centres, kids = self.nodes[at]
            label = self._nearest(x[rows], centres)
            todo += [(k, rows[label == i]) for i, k in enumerate(kids)]
        return out


class Cells:
    """The tree, and under each of its leaves the shared second one, if there is one."""

    def __init__(self, x: np.ndarray, rows: int):
        wanted = max(1, -(-rows // CELL_ROWS))
        self.coarse = Tree(x, max(LEAST, len(x) // wanted))
        self.fine = None
        if self.coarse.leaves < wanted and len(x) // wanted < LEAST:
            left = x - self.coarse.centre[self.coarse.assign(x)]
            self.fine = Tree(left, max(LEAST, len(x) * self.coarse.leaves // wanted), 1)

    def assign(self, x: np.ndarray) -> np.ndarray:
        leaf = self.coarse.assign(x)
        return leaf if self.fine is None else leaf * self.fine.leaves + self.fine.assign(x - self.coarse.centre[leaf])

    def visit(self, q: np.ndarray) -> Iterator[int]:
        """Cells in best-bin-first order: always the branch whose centre is nearest."""
        heap, n = [(0.0, 0, 0, -1)], 0
        while heap:
            _, _, at, leaf = heapq.heappop(heap)
            while True:
                tree, x = (self.coarse, q) if leaf < 0 else (self.fine, q - self.coarse.centre[leaf])
                if tree.nodes[at] is not None:
                    centres, kids = tree.nodes[at]
                    d = ((centres - x) ** 2).sum(1)
                    order = d.argsort(kind="stable").tolist()
                    for i in order[1:]:
                        n += 1
                        heapq.heappush(heap, (float(d[i]), n, kids[i], leaf))
                    at = kids[order[0]]
                elif leaf < 0 and self.fine is not None:
                    leaf, at = tree.leaf_of[at], 0
                else:
                    yield tree.leaf_of[at] if leaf < 0 else leaf * self.fine.leaves + tree.leaf_of[at]
                    break


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(a: pa.Array) -> np.ndarray:
    flat = np.asarray(a.flatten(), np.float64)
    return flat.reshape(len(a), -1)


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v, h1, h2) of the rows that take part: floats stay floats, other numbers become doubles; h1 and h2 hash v."""
    floats = isinstance(vectors.schema[vector].dataType, T.ArrayType) and isinstance(vectors.schema[vector].dataType.elementType, T.FloatType)
    v = F.col(f"`{vector}`")
    v = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), (v if floats else v.cast("array<double>")).alias("v"))
    v = v.where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(v, x -> x <> 0)")
    v = v.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(7), F.col("v")))
    length = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return v if length is None else v.where(F.size("v") == length["n"])


def _top(q: np.ndarray, x: np.ndarray, least: np.ndarray, m: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of each query's m nearest rows, best first; ties by least. skip: (query, row) flags to leave out."""
    s = _unit(q) @ _unit(x).T
    if skip is not None:
        s[skip] = -np.inf
    n = min(m, len(x))
    edge = np.partition(s, len(x) - n, axis=1)[:, len(x) - n]
    who, row = np.nonzero((s >= edge[:, None] - 1e-9) & np.isfinite(s))
    # the exact measure, pair by pair, the same in whatever company a row is met
    exact = np.einsum("ij,ij->i", q[who], x[row]) / (np.sqrt(np.einsum("ij,ij->i", q, q))[who] * np.sqrt(np.einsum("ij,ij->i", x, x))[row])
    return _ranked(who, row, exact, least[row], m)


def _ranked(who: np.ndarray, row: np.ndarray, score: np.ndarray, least: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((least, -score, who))
    who, row, score = who[order], row[order], score[order]
    if not len(who):
        return who, row, score
    begin = np.r_[True, who[1:] != who[:-1]]
    at = np.arange(len(who)) - np.maximum.accumulate(np.where(begin, np.arange(len(who)), 0))
    return who[at < m], row[at < m], score[at < m]


def _best(pairs: DataFrame, key: list[str], *order: str | Column, k: int) -> DataFrame:
    """The k first of each key by order; the limit also applies before the shuffle."""
    first = Window.partitionBy(*key).orderBy(*order)
    return pairs.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def search(vectors: DataFrame, is_query: Column, k: int = 5, target: float = TARGET, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where is_query (of column vec_id) holds."""
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors, vec_id, vector)
    queries = settle(rows.where(is_query).select(F.col("vec_id").alias("query_id"), "h1", "h2").distinct(), "queries")
    # as many results more as one query id has vectors, which are all its own
    own = queries.groupBy("query_id").count().agg(F.max("count")).first()[0] or 1
    m = k + own
    near = Window.partitionBy("h1", "h2").orderBy("vec_id")
    firsts = rows.withColumn("rank", F.dense_rank().over(near)).where(F.col("rank") <= m)
    distinct = settle(firsts.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.array_sort(F.collect_set("vec_id")).alias("ids")), "vectors")
    total = distinct.count()
    picked = distinct.orderBy(F.xxhash64("h1"), "h1", "h2").limit(min(SAMPLE + CALIBRATION, -(-total // 2) + CALIBRATION)).select("h1", "h2", "v").toPandas()  # SAMPLE + CALIBRATION rows at most
    if picked.empty:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    aside = min(CALIBRATION, total // 2)
    x = np.stack(picked["v"].to_numpy()).astype(np.float64)
    cells = Cells(_unit(x[aside:]), total)
    sent = spark.sparkContext.broadcast(pickle.dumps(cells))
    kind = rows.schema["v"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = pickle.loads(sent.value)
        for b in batches:
            cell = c.assign(_unit(_matrix(b.column(2)))) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], names=[*b.schema.names, "cell"])

    placed = settle(distinct.select("h1", "h2", "v", "ids").mapInArrow(place, f"h1 bigint, h2 bigint, v {kind}, ids array<bigint>, cell bigint"), "cells")
    visits = _calibrate(spark, placed, cells, x[:aside], k, target)
    groups = max(1, -(-total // GROUP_ROWS))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = pickle.loads(sent.value)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                q = _unit(_matrix(part.column(2)))
                seen = [[cell for _, cell in zip(range(visits), c.visit(v), strict=False)] for v in q]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(seen, pa.list_(pa.int64()))], names=["h1", "h2", "v", "cells"])

    of = lambda cell: F.pmod(F.xxhash64(cell), F.lit(groups))
    held = placed.withColumn("grp", of(F.col("cell")))
    parts = settle(held.groupBy("grp").count().where(F.col("count") > 2 * GROUP_ROWS).select("grp", F.ceil(F.col("count") / GROUP_ROWS).alias("parts")), "parts")
    parts = small(parts)
    asked = queries.select("h1", "h2").distinct().join(distinct.select("h1", "h2", "v"), ["h1", "h2"])
    routed = asked.select("h1", "h2", "v").mapInArrow(route, f"h1 bigint, h2 bigint, v {kind}, cells array<bigint>")
    # each query goes once to each group, with the cells that it visits there
    by_group = F.transform(F.array_distinct(F.transform("cells", of)), lambda g: F.struct(g.alias("grp"), F.filter("cells", lambda c: of(c) == g).alias("cells")))
    to = routed.select("h1", "h2", "v", F.explode(by_group).alias("to")).select("h1", "h2", "v", "to.grp", "to.cells")
    n = F.coalesce("parts", F.lit(1))
    left = held.join(parts, "grp", "left").select("grp", F.pmod("h1", n).alias("part"), F.lit(0).alias("side"), "h1", "h2", "v", "ids", F.array("cell").alias("cells"))
    right = to.join(parts, "grp", "left").select("grp", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("part"), F.lit(1).alias("side"), "h1", "h2", "v", F.array().cast("array<bigint>").alias("ids"), "cells")
    stream = left.unionByName(right).repartition(partitions(spark), "grp", "part").sortWithinPartitions("grp", "part", "side")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held_, block = None, [], None
        for b in batches:
            key = np.stack([b.column(i).to_numpy() for i in range(3)], 1) if b.num_rows else np.zeros((0, 3), np.int64)
            cut = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)] if len(key) else [0]
            for lo, hi in zip(cut, cut[1:], strict=False):
                now, side = tuple(key[lo, :2].tolist()), key[lo, 2]
                if now != at:
                    at, held_, block = now, [], None
                if side == 0:
                    held_.append(b.slice(lo, hi - lo))
                    continue
                if not held_:
                    continue
                block = block or _Block(pa.Table.from_batches(held_))
                for i in range(lo, hi, 2048):
                    yield from block.answer(b.slice(i, min(2048, hi - i)), m)

    met = stream.mapInArrow(meet, "h1 bigint, h2 bigint, score double, least bigint, ids array<bigint>")
    best = _best(met, ["h1", "h2"], F.desc("score"), "least", k=m).select("h1", "h2", "score", F.explode("ids").alias("vec_id"))
    named = queries.join(best, ["h1", "h2"]).where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score")) if own > 1 else queries.join(best, ["h1", "h2"]).where("vec_id <> query_id")
    return _best(named, ["query_id"], F.desc("score"), "vec_id", k=k).select("query_id", "rank", "vec_id", "score")


class _Block:
    """A part's rows in order of their cells."""

    def __init__(self, t: pa.Table):
        t = t.combine_chunks()
        cell = t["cells"].combine_chunks().flatten().to_numpy()
        order = np.argsort(cell, kind="stable")
        cell, self.ids = cell[order], t["ids"].combine_chunks().take(pa.array(order))
        self.x = _matrix(t["v"].combine_chunks())[order]
        self.least = np.array([i[0].as_py() for i in self.ids], np.int64)
        begin = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        self.of = {int(c): (int(lo), int(hi)) for c, lo, hi in zip(cell[begin], begin, [*begin[1:], len(cell)], strict=True)}

    def answer(self, b: pa.RecordBatch, m: int) -> Iterator[pa.RecordBatch]:
        """The m nearest rows in its cells of each query of the batch."""
        q, lists = _matrix(b.column(5)), b.column(7)
        asked = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
        cell = lists.flatten().to_numpy()
        order = np.argsort(cell, kind="stable")
        cell, asked = cell[order], asked[order]
        begin = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        found = []
        for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(cell)], strict=True):
            if span := self.of.get(int(cell[lo])):
                for i in range(span[0], span[1], 4096):
                    x = slice(i, min(i + 4096, span[1]))
                    who, row, score = _top(q[asked[lo:hi]], self.x[x], self.least[x], m)
                    found.append((asked[lo:hi][who], row + i, score))
        if found:
            who, row, score = (np.concatenate(c) for c in zip(*found, strict=True))
            who, row, score = _ranked(who, row, score, self.least[row], m)
            yield pa.RecordBatch.from_arrays([b.column(3).take(pa.array(who)), b.column(4).take(pa.array(who)), pa.array(score), pa.array(self.least[row]), self.ids.take(pa.array(row))], names=["h1", "h2", "score", "least", "ids"])


def _calibrate(spark: SparkSession, placed: DataFrame, cells: Cells, q: np.ndarray, k: int, target: float) -> int:
    """The number of cells to visit, from brute force of a few queries, which the trees do not know, over all rows."""
    if not len(q):
        return 1
    asked = spark.sparkContext.broadcast(pickle.dumps(q))

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = pickle.loads(asked.value)
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                x, cell = _matrix(part.column(2)), part.column(4).to_numpy()
                who, row, s = _top(a, x, np.arange(len(x)), k + 1)
                yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(s), part.column(0).take(pa.array(row)), pa.array(cell[row])], names=["query", "score", "h1", "cell"])

    met = placed.mapInArrow(brute, "query bigint, score double, h1 bigint, cell bigint")
    true: dict[int, list[int]] = {}
    for r in _best(met, ["query"], F.desc("score"), "h1", k=k + 1).collect():  # CALIBRATION queries with k + 1 rows each
        if r["rank"] > 1:  # the first is the query itself
            true.setdefault(r["query"], []).append(r["cell"])
    need: list[int] = []
    for query, wanted in true.items():
        at: dict[int, int] = {}
        left = set(wanted)
        for i, cell in enumerate(cells.visit(_unit(q[query][None])[0])):
            if cell in left:
                at[cell] = i + 1
                left.discard(cell)
                if not left:
                    break
        need += [at[w] for w in wanted]
    return int(np.quantile(need, target, method="higher")) if need else 1


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)
