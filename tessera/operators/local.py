"""Local graph search: ranked nodes, edges, reports and sources for batches of questions."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import local_tokens, shorten
from tessera.operators.graph import degrees
from tessera.runtime import settle, ship, small


def node_text() -> Column:
    return F.concat_ws(" ", "name", "type", "description")


def edge_text() -> Column:
    return F.concat_ws(" ", "u", "v", F.array_join("relations", " "), F.array_join("descriptions", " "))


def report_text() -> Column:
    return F.concat_ws(" ", "title", F.array_join("entity_names", " "), "summary")


@dataclass(frozen=True)
class GraphIndex:
    """Tokens worked out once for any number of questions."""

    nodes: DataFrame
    edges: DataFrame
    reports: DataFrame
    units: DataFrame


def build(nodes: DataFrame, edges: DataFrame, reports: DataFrame, units: DataFrame) -> GraphIndex:
    n = nodes.join(degrees(nodes, edges).select("name", "degree"), "name").withColumn("tok", local_tokens(node_text()))
    return GraphIndex(
        settle(n, "local-nodes"),
        settle(edges.withColumn("tok", local_tokens(edge_text())), "local-edges"),
        settle(reports.withColumn("tok", local_tokens(report_text())), "local-reports"),
        settle(units.withColumn("tok", local_tokens(F.col("text"))).withColumn("title_tok", local_tokens(F.col("document_title"))), "local-units"),
    )


def asked(queries: DataFrame) -> DataFrame:
    """(query_id, q, n): the distinct tokens of each question."""
    return queries.select("query_id", local_tokens(F.col("question")).alias("q")).withColumn("n", F.size("q"))


def matches(rows: DataFrame, key: list[str], tokens: str, queries: DataFrame) -> DataFrame:
    """(query_id, *key, text_score) of the rows that share a token with a question: a join on tokens."""
    q = small(queries.select("query_id", "n", F.explode("q").alias("t")))
    met = rows.select(*key, F.explode(tokens).alias("t")).join(q, "t")
    score = F.count("*").cast("double") / F.sqrt(F.col("n").cast("double"))
    return met.groupBy("query_id", "n", *key).agg(score.alias("text_score")).drop("n")


def _rank(df: DataFrame, *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), *order)))


def rank_nodes(index: GraphIndex, queries: DataFrame) -> DataFrame:
    """(query_id, name, seq, degree, score, rank); hubs of degree over 12 count 0.65 unless a question names them."""
    q = small(queries.select("query_id", "q"))
    m = matches(index.nodes, ["name", "seq", "degree"], "tok", queries).join(q, "query_id")
    hub = (F.col("degree") > 12) & ~F.array_contains("q", F.lower("name"))
    return _rank(m.withColumn("score", F.when(hub, F.col("text_score") * 0.65).otherwise(F.col("text_score"))).drop("q", "text_score"), "seq")


def rank_edges(index: GraphIndex, queries: DataFrame, seeds: DataFrame) -> DataFrame:
    """(query_id, u, v, seq, score, rank): token overlap plus 0.8 for each end that is a seed."""
    text = matches(index.edges, ["u", "v", "seq"], "tok", queries).withColumnRenamed("text_score", "s")
    s = small(seeds.select("query_id", "name"))
    ends = [index.edges.select("u", "v", "seq", F.col(e).alias("name")).join(s, "name").select("query_id", "u", "v", "seq", F.lit(0.8).alias("s")) for e in ("u", "v")]
    both = text.unionByName(ends[0]).unionByName(ends[1])
    return _rank(both.groupBy("query_id", "u", "v", "seq").agg(F.round(F.sum("s"), 12).alias("score")), "seq", "u", "v")


def rank_reports(index: GraphIndex, queries: DataFrame, selected: DataFrame) -> DataFrame:
    """(query_id, id, seq, score, rank): token overlap plus 0.4 for each of up to five selected nodes."""
    text = matches(index.reports, ["id", "seq"], "tok", queries)
    held = index.reports.select("id", "seq", F.explode(F.array_distinct("entity_names")).alias("name")).join(small(selected.select("query_id", "name").distinct()), "name")
    shared = held.groupBy("query_id", "id", "seq").agg(F.count("*").alias("n"))
    both = text.join(shared, ["query_id", "id", "seq"], "full")
    score = F.coalesce("text_score", F.lit(0.0)) + F.least(F.coalesce("n", F.lit(0)), F.lit(5)) * 0.4
    return _rank(both.select("query_id", "id", "seq", F.round(score, 12).alias("score")).where("score > 0"), "seq")


def rank_sources(index: GraphIndex, queries: DataFrame, source_scores: DataFrame) -> DataFrame:
    """(query_id, id, seq, score, rank): score of the unit's id, its text's overlap, 1.5 times its title's."""
    text = matches(index.units, ["id", "seq"], "tok", queries).withColumnRenamed("text_score", "s")
    title = matches(index.units, ["id", "seq"], "title_tok", queries).select("query_id", "id", "seq", (F.col("text_score") * 1.5).alias("s"))
    own = index.units.select("id", "seq").join(source_scores.withColumnRenamed("source_id", "id"), "id").select("query_id", "id", "seq", F.col("score").alias("s"))
    both = text.unionByName(title).unionByName(own)
    return _rank(both.groupBy("query_id", "id", "seq").agg(F.round(F.sum("s"), 12).alias("score")).where("score > 0"), "seq")


def source_scores(index: GraphIndex, edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """(query_id, source_id, score): an edge gives its score to each of its sources, a chosen node 0.5."""
    by_edge = index.edges.select("u", "v", "source_ids").join(small(edges.select("query_id", "u", "v", "score")), ["u", "v"]).select("query_id", F.explode("source_ids").alias("source_id"), "score")
    by_node = index.nodes.select("name", "source_ids").join(small(chosen), "name").select("query_id", F.explode("source_ids").alias("source_id"), F.lit(0.5).alias("score"))
    return by_edge.union(by_node).groupBy("query_id", "source_id").agg(F.sum("score").alias("score"))


@dataclass(frozen=True)
class LocalResult:
    nodes: DataFrame
    edges: DataFrame
    reports: DataFrame
    sources: DataFrame


def search(index: GraphIndex, queries: DataFrame, top_k: int = 8) -> LocalResult:
    """What a local context shows of each question, as ranked frames."""
    if top_k < 1:
        raise ValueError("top_k must be at least 1")
    q = settle(asked(queries), "local-queries")
    nodes = settle(rank_nodes(index, q), "ranked-nodes")
    seeds = nodes.where(F.col("rank") <= max(top_k, 8))
    edges = settle(rank_edges(index, q, seeds).where(F.col("rank") <= max(4 * top_k, 24)), "ranked-edges")
    chosen = settle(seeds.select("query_id", "name").union(edges.select("query_id", "u")).union(edges.select("query_id", "v")).distinct(), "selected")
    reports, sources = rank_reports(index, q, chosen), rank_sources(index, q, source_scores(index, edges, chosen))
    top = F.max("score").over(Window.partitionBy("query_id"))
    reports = reports.withColumn("least", F.greatest(F.lit(1.5), top * 0.55)).where((F.col("rank") <= min(top_k, 5)) & (F.col("score") >= F.col("least"))).drop("least")
    sources = sources.withColumn("least", F.greatest(F.lit(2.0), top * 0.20)).where((F.col("rank") <= min(top_k, 6)) & (F.col("score") >= F.col("least"))).drop("least")
    shown = nodes.where((F.col("rank") <= max(3 * top_k, 24)) & (F.col("score") >= 0.75)).join(chosen, ["query_id", "name"], "left_semi")
    return LocalResult(shown, edges.where("score >= 1.0"), reports, sources)


def context(index: GraphIndex, queries: DataFrame, result: LocalResult) -> DataFrame:
    """(query_id, id, score, text): the four sections as one text for each question."""
    ship(queries.sparkSession)
    n = result.nodes.join(index.nodes.select("name", "type", "description"), "name").select("query_id", F.lit("n").alias("part"), "rank", F.struct("name", "type", "degree", "description", "score").alias("n"))
    e = result.edges.join(index.edges.select("u", "v", "relations", F.slice("descriptions", 1, 2).alias("d")), ["u", "v"]).select("query_id", F.lit("e").alias("part"), "rank", F.struct("u", "v", "relations", "d", "score").alias("e"))
    r = result.reports.join(index.reports.select("id", "title", "summary"), "id").select("query_id", F.lit("r").alias("part"), "rank", F.struct("id", "title", "score", F.col("summary").alias("text")).alias("r"))
    s = result.sources.join(index.units.select("id", "document_title", "text"), "id").select("query_id", F.lit("s").alias("part"), "rank", F.struct("id", F.coalesce("document_title", F.lit("")).alias("title"), "score", shorten(F.col("text")).alias("text")).alias("r"))
    rows = n.unionByName(e, True).unionByName(r, True).unionByName(s, True)
    lines = rows.select("query_id", "part", "rank", F.pandas_udf(render_lines, "string")(F.struct("part", "n", "e", "r")).alias("line"))
    packed = lines.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("part", "rank", "line"))).alias("x"))
    full = queries.select("query_id").join(packed, "query_id", "left")
    sec = lambda p, sep: F.coalesce(F.nullif(F.array_join(F.transform(F.filter("x", lambda y: y["part"] == p), lambda y: y["line"]), sep), F.lit("")), F.lit("(none)"))
    text = F.concat_ws("\n\n", F.lit("-----Reports-----"), sec("r", "\n\n"), F.lit("-----Entities-----"), sec("n", "\n"), F.lit("-----Relationships-----"), sec("e", "\n"), F.lit("-----Sources-----"), sec("s", "\n\n"))
    return full.select("query_id", F.lit("local_context").alias("id"), F.lit(1.0).alias("score"), text.alias("text"))


def render_lines(rows: pd.DataFrame) -> pd.Series:
    """A line of a context; Python formats the numbers and lists, whose rounding Spark does not share."""
    out = []
    for part, n, e, r in zip(rows["part"], rows["n"], rows["e"], rows["r"], strict=True):
        if part == "n":
            out.append(f"- {n['name']} | score={n['score']:.2f} | type={n['type']} | degree={n['degree']} | description={n['description']}")
        elif part == "e":
            out.append(f"- {e['u']} -- {list(e['relations'])} -- {e['v']}; score={e['score']:.2f}; descriptions={list(e['d'])}")
        else:
            out.append(f"[{r['id']}] {r['title']} | score={r['score']:.2f}\n{r['text']}")
    return pd.Series(out)
