"""Frames that describe a stored graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import shorten
from tessera.operators.graph import both_ways, components, degrees


def type_counts(nodes: DataFrame, top: int | None = None) -> DataFrame:
    c = nodes.groupBy("type").agg(F.count("*").alias("n"), F.min("seq").alias("first")).orderBy(F.desc("n"), "first", "type").select("type", "n")
    return c.limit(top) if top else c


def relation_counts(edges: DataFrame, top: int | None = None) -> DataFrame:
    c = edges.select(F.explode("relations").alias("relation"), "seq").groupBy("relation").agg(F.count("*").alias("n"), F.min("seq").alias("first")).orderBy(F.desc("n"), "first", "relation").select("relation", "n")
    return c.limit(top) if top else c


def top_by_degree(nodes: DataFrame, edges: DataFrame, top: int = 10) -> DataFrame:
    return degrees(nodes, edges).orderBy(F.desc("degree"), "seq", "name").limit(top).select("name", "degree")


def largest_components(nodes: DataFrame, edges: DataFrame, top: int = 10) -> DataFrame:
    """(component, size, sample of eight names)."""
    c = components(nodes, edges).groupBy("component").agg(F.count("*").alias("size"))
    big = c.orderBy(F.desc("size"), "component").limit(top)
    names = components(nodes, edges).join(F.broadcast(big.select("component")), "component")  # top rows
    sample = names.groupBy("component").agg(F.slice(F.array_sort(F.collect_list("name")), 1, 8).alias("sample"))
    return big.join(sample, "component").orderBy(F.desc("size"), "component")


def communities(nodes: DataFrame) -> DataFrame:
    """(community, size, sample): nodes without a community stand under NA."""
    c = F.coalesce(F.col("community_id").cast("string"), F.lit("NA"))
    n = nodes.select(c.alias("community"), "name")
    few = n.withColumn("rank", F.row_number().over(Window.partitionBy("community").orderBy("name"))).where("rank <= 8")
    sample = few.groupBy("community").agg(F.array_sort(F.collect_list("name")).alias("sample"))
    return n.groupBy("community").agg(F.count("*").alias("size")).join(sample, "community").orderBy(F.desc("size"), "community")


def find_entity(nodes: DataFrame, name: str, top: int = 20) -> DataFrame:
    """The entity of that name, or up to `top` whose names hold it, whatever the case."""
    exact = nodes.where(F.col("name") == name)
    if exact.take(1):
        return exact
    return nodes.where(F.contains(F.lower("name"), F.lit(name.lower()))).orderBy("seq").limit(top)


def entity_detail(nodes: DataFrame, edges: DataFrame, units: DataFrame, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(node, neighbours, source snippets) of one entity; at most five sources."""
    node = nodes.where(F.col("name") == name)
    near = edges.where((F.col("u") == name) | (F.col("v") == name)).select(F.when(F.col("u") == name, F.col("v")).otherwise(F.col("u")).alias("neighbour"), "relations", "weight", "seq").orderBy("seq")
    ids = node.select(F.posexplode(F.slice("source_ids", 1, 5)).alias("pos", "id"))
    snippets = units.join(F.broadcast(ids), "id").orderBy("pos").select("id", "document_title", shorten(F.col("text"), 500).alias("text"))
    return node, near, snippets


def relations_labelled(edges: DataFrame, label: str, limit: int = 50) -> DataFrame:
    """Edges with a relation label: three descriptions and five sources each."""
    want = label.lower().replace(" ", "_").replace("-", "_")
    hit = edges.where(F.array_contains("relations", want)).orderBy("seq").limit(limit)
    return hit.select("u", "v", "relations", F.transform(F.slice("descriptions", 1, 3), lambda d: shorten(d, 220)).alias("descriptions"), F.slice("source_ids", 1, 5).alias("source_ids"))


def neighbours(edges: DataFrame) -> DataFrame:
    return both_ways(edges)
