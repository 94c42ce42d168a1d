"""Communities by modularity, their payloads, and report sources."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import components
from tessera.operators.louvain import louvain
from tessera.runtime import numbered, settle, ship, sized


def greedy_modularity(nodes: list[int], edges: list[tuple[int, int, float]], total: float) -> list[list[int]]:
    """Clauset, Newman and Moore's merging of the pair with the largest gain, while a gain is positive.

    nodes: numbers in order of preference; total: the weight of the whole graph. Ties go
    to the pair with the smallest numbers, so the result does not depend on the input's order.
    """
    weight: dict[int, dict[int, float]] = {n: {} for n in nodes}
    for a, b, w in edges:
        if a != b:
            weight[a][b] = weight[a].get(b, 0.0) + w
            weight[b][a] = weight[b].get(a, 0.0) + w
    if total <= 0:
        return [[n] for n in nodes]
    share = {n: sum(weight[n].values()) / (2 * total) for n in nodes}
    members = {n: [n] for n in nodes}
    gain = lambda a, b: 2 * (weight[a][b] / (2 * total) - share[a] * share[b])
    heap = [(-gain(a, b), a, b) for a in nodes for b in weight[a] if a < b]
    heapq.heapify(heap)
    while heap:
        g, a, b = heapq.heappop(heap)
        if a not in members or b not in members or b not in weight[a]:
            continue
        if abs(gain(a, b) + g) > 1e-15:
            continue  # an older value; the newer one is in the heap too
        if -g <= 1e-15:
            break
        for c, w in weight.pop(b).items():
            del weight[c][b]
            if c != a:
                weight[a][c] = weight[a].get(c, 0.0) + w
                weight[c][a] = weight[a][c]
        share[a] += share.pop(b)
        members[a] += members.pop(b)
        for c in weight[a]:
            heapq.heappush(heap, (-gain(*sorted((a, c))), *sorted((a, c))))
    return list(members.values())


def detect(nodes: DataFrame, edges: DataFrame, method: str = "louvain") -> DataFrame:
    """(name, community_id): communities numbered by size, then by their first node.

    louvain: distributed, for graphs of any size. greedy: the merging of one pair after the other, one group task a
    connected component (about 300 bytes for each of its edges), as the merging is one sequence of steps by nature.
    """
    if method not in ("louvain", "greedy"):
        raise ValueError(f"no such method: {method}")
    all_ = settle((louvain if method == "louvain" else _greedy)(nodes, edges), "communities")
    groups = all_.groupBy("head").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    ranked = numbered(groups, "community_id", F.desc("n"), "first", "head").select("head", F.col("community_id").cast("int").alias("community_id"))
    return all_.join(sized(ranked.count())(ranked), "head").select("name", "community_id")


def _greedy(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, seq, head): merging never gains across connected components, so each is one task, with the whole graph's weight."""
    ship(nodes.sparkSession)
    part = settle(components(nodes, edges).join(nodes.select("name", "seq"), "name"), "component-nodes")
    total = float(edges.agg(F.sum("weight")).first()[0] or 0.0)
    tagged = edges.select("u", "v", F.col("weight").cast("double").alias("w")).join(part.select(F.col("name").alias("u"), "component", F.col("seq").alias("us")), "u").join(part.select(F.col("name").alias("v"), F.col("seq").alias("vs")), "v")

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        seqs = dict(zip(rows["u"], rows["us"], strict=True)) | dict(zip(rows["v"], rows["vs"], strict=True))
        order = sorted(seqs, key=lambda x: (seqs[x], x))
        number = {x: i for i, x in enumerate(order)}
        pairs = sorted((*sorted((number[a], number[b])), w) for a, b, w in zip(rows["u"], rows["v"], rows["w"], strict=True))
        out = [(order[m], order[min(group)]) for group in greedy_modularity(list(range(len(order))), pairs, total) for m in group]
        return pd.DataFrame(out, columns=["name", "head"])

    solved = tagged.groupBy("component").applyInPandas(solve, "name string, head string")
    return part.join(solved, "name", "left").select("name", "seq", F.coalesce("head", "name").alias("head"))


def attach(nodes: DataFrame, communities: DataFrame) -> DataFrame:
    return nodes.drop("community_id").join(communities.select("name", "community_id"), "name", "left")


def induced_edges(nodes: DataFrame, edges: DataFrame, missing: int | None = None) -> DataFrame:
    """Edges with both ends in one community, with its id; nodes without one are left out, or take `missing`."""
    c = nodes.select("name", F.coalesce("community_id", F.lit(missing)).alias("c") if missing is not None else F.col("community_id").alias("c"))
    a, b = c.select(F.col("name").alias("u"), F.col("c").alias("cu")), c.select(F.col("name").alias("v"), F.col("c").alias("cv"))
    return edges.join(a, "u").join(b, "v").where("cu = cv").withColumn("community_id", F.col("cu")).drop("cu", "cv")


def payloads(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(community_id, payload JSON, entity_names, source_ids) of each community of nodes with a community_id."""
    n = nodes.where("community_id IS NOT NULL")
    ent = n.groupBy("community_id").agg(F.array_sort(F.collect_list(F.struct("seq", "name", "type", "description"))).alias("e"))
    inner = induced_edges(n, edges)
    rel = inner.groupBy("community_id").agg(F.array_sort(F.collect_list(F.struct("seq", "u", "v", "relations", "descriptions", "weight"))).alias("r"))
    ids = report_sources(n, edges)
    out = ent.join(rel, "community_id", "left").join(ids, "community_id", "left")
    e = F.transform("e", lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"), x["description"].alias("description")))
    r = F.transform("r", lambda x: F.struct(x["u"].alias("source"), x["v"].alias("target"), x["relations"].alias("relations"), x["descriptions"].alias("descriptions"), x["weight"].alias("weight")))
    none = F.array().cast("array<struct<source: string, target: string, relations: array<string>, descriptions: array<string>, weight: double>>")
    payload = F.to_json(F.struct(e.alias("entities"), F.coalesce(r, none).alias("relationships")))
    return out.select("community_id", payload.alias("payload"), F.transform("e", lambda x: x["name"]).alias("entity_names"), F.coalesce("source_ids", F.array().cast("array<string>")).alias("source_ids"))


def report_sources(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(community_id, source_ids): the sorted sources of a community's nodes and inner edges."""
    n = nodes.where("community_id IS NOT NULL").select("community_id", F.explode("source_ids").alias("s"))
    both = n.union(induced_edges(nodes.where("community_id IS NOT NULL"), edges).select("community_id", F.explode("source_ids").alias("s")))
    return both.groupBy("community_id").agg(F.array_sort(F.collect_set("s")).alias("source_ids"))


def complete(frame: DataFrame, prompt: str, client, out: str = "answer") -> DataFrame:
    """frame plus the client's answer to its prompt column; client() is built once a task.

    Answers cost money and may differ when asked again, so they are written before use.
    """
    ship(frame.sparkSession)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = client()
        for s in batches:
            yield s.map(c.complete)

    return settle(frame.withColumn(out, run(F.col(prompt))), "answers")
