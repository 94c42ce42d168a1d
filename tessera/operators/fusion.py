"""Reciprocal rank fusion of rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FUSION_DEPTH, RRF_K = 20, 60


def fuse(rankings: dict[str, DataFrame], top_k: int = 8, k: int = RRF_K) -> DataFrame:
    """(query_id, rank, id, score, rrf_ranks) from named frames of (query_id, id, rank).

    Score: the sum of 1 / (k + rank) over the rankings that hold an id, added in the
    order of the names; an id's first place in a ranking counts. Ties go by best rank,
    then id. One full outer join for each ranking after the first, on the same keys.
    """
    if top_k < 1 or k < 1:
        raise ValueError("top_k and k must be at least 1")
    firsts = {n: df.groupBy("query_id", "id").agg(F.min("rank").alias(f"__{n}")) for n, df in rankings.items()}
    joined = reduce(lambda a, b: a.join(b, ["query_id", "id"], "full"), firsts.values())
    cols = [F.col(f"__{n}") for n in rankings]
    score = reduce(lambda a, b: a + b, (F.coalesce(1.0 / (F.lit(k) + c), F.lit(0.0)) for c in cols))
    ranks = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(n).alias("name"), c.alias("rank")) for n, c in zip(rankings, cols, strict=True))), lambda x: x["rank"].isNotNull()))
    least = F.least(*cols) if len(cols) > 1 else cols[0]
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "best", "id")
    out = joined.select("query_id", "id", score.alias("score"), least.alias("best"), ranks.alias("rrf_ranks")).withColumn("rank", F.row_number().over(best))
    return out.where(F.col("rank") <= top_k).select("query_id", "rank", "id", "score", "rrf_ranks")


def hybrid(lexical, dense, queries: DataFrame, top_k: int = 8, depth: int = FUSION_DEPTH, k: int = RRF_K) -> DataFrame:
    """Fuse two retrievers (queries, limit) -> ranking, both asked for max(top_k, depth) rows."""
    if depth < 1:
        raise ValueError("depth must be at least 1")
    n = max(top_k, depth)
    return fuse({"bm25": lexical(queries, n), "vector": dense(queries, n)}, top_k, k)
