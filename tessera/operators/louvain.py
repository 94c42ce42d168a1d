"""Communities by distributed modularity: local moves, coarsening, and moves on the whole graph again.

A round of moves adds up each node's weight to the communities around it, and moves a part of the nodes, chosen by a
hash of node and round, to the community of largest gain: were all nodes to move at once, neighbours would change
places for ever. A round counts only if the modularity of the whole partition has grown; if not, a smaller part of
the nodes is tried. Where no round helps any more, communities become the nodes of a smaller graph, and so on until
nothing moves. At last the nodes themselves move once more, until none of them would gain: one node of very many adds
less to the modularity than a round is worth otherwise. All of it is joins and sums over edges, so no task holds a
component or a community, and a node with very many edges is summed up in parts first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.runtime import numbered, settle, sized

#: Growth of modularity that is worth a further round, or level; rounds without any after which a level ends.
GROWTH, IDLE = 1e-4, 4
#: Bounds of rounds and levels.
ROUNDS, LEVELS = 40, 20


def _value(edges: DataFrame, labels: DataFrame, total: float, fit: Callable) -> tuple[float, float, int]:
    """The modularity of a partition, what the moves of single nodes would add to it, one by one, and its communities' number.

    For a coarse graph the weight inside of its nodes is left out, which is the same for all partitions of it.
    """
    of = lambda c, name: fit(labels.select(F.col("node").alias(c), F.col("label").alias(name)))
    inside = edges.join(of("a", "x"), "a").join(of("b", "y"), "b").where("x = y").agg(F.sum("w").alias("v"), F.lit(0.0).alias("n"), F.lit(0).alias("c"))
    own = labels.groupBy("label").agg(F.sum("k").alias("t"), F.sum("gains").alias("g")).agg((-F.sum(F.col("t") * F.col("t")) / (4 * total)).alias("v"), F.sum("g").alias("n"), F.count("*").alias("c"))
    found = inside.union(own).agg(F.sum("v").alias("v"), F.sum("n").alias("n"), F.sum("c").alias("c")).first()
    return (found["v"] or 0.0) / total, (found["n"] or 0.0) / total, found["c"]


def _moved(both: DataFrame, labels: DataFrame, total: float, chosen: Column, fit: Callable, few: Callable) -> DataFrame:
    """labels after those of the nodes that gain most elsewhere, and are chosen, have gone there; gains: what each would gain.

    both: edges with the weight k of node a; fit, few: hints for a row a node, and a row a community.
    """
    near = both.join(fit(labels.select(F.col("node").alias("b"), "label")), "b").select(F.col("a").alias("node"), "k", "label", "w", F.lit(False).alias("is_own"))
    sums = few(labels.groupBy("label").agg(F.sum("k").alias("t")))
    # a node's own community, without the node, stands beside those around it
    stay = labels.select("node", "k", "label", F.lit(0.0).alias("w"), F.lit(True).alias("is_own"))
    options = near.unionByName(stay).groupBy("node", "label").agg(F.max("k").alias("k"), F.sum("w").alias("w"), F.max("is_own").alias("is_own")).join(sums, "label")
    is_own = F.col("is_own")
    gain = F.col("w") - F.col("k") * (F.col("t") - F.when(is_own, F.col("k")).otherwise(0.0)) / (2 * total)
    best = options.groupBy("node").agg(F.max("k").alias("k"), F.max(F.when(is_own, F.col("label"))).alias("own"), F.max(F.struct(F.round(gain, 9).alias("gain"), is_own.alias("is_own"), (-F.col("label")).alias("less"))).alias("best"), F.max(F.when(is_own, gain)).alias("before"))
    goes = ~F.col("best.is_own")
    return best.select("node", "k", F.when(goes & chosen, -F.col("best.less")).otherwise(F.col("own")).alias("label"), F.when(goes, F.col("best.gain") - F.col("before")).otherwise(0.0).alias("gains"))


def _moves(edges: DataFrame, labels: DataFrame, total: float, seed: int, last: bool = False) -> tuple[DataFrame, bool]:
    """The partition after rounds of moves, and whether it is better than before by GROWTH at least.

    last: go on below GROWTH, as long as what is left to gain halves from round to round.
    """
    labels = settle(labels.withColumn("gains", F.lit(0.0)), "labels")
    nodes = labels.count()
    fit = sized(nodes)
    both = settle(edges.union(edges.select("b", "a", "w")).join(fit(labels.select(F.col("node").alias("a"), "k")), "a"), "both-ways")
    value, _, groups = _value(edges, labels, total, fit)
    first = value
    part, idle, before = 2, 0, float("inf")
    for round_ in range(ROUNDS):
        chosen = F.pmod(F.xxhash64("node", F.lit(seed * ROUNDS + round_)), F.lit(part)) == 0
        new = settle(_moved(both, labels, total, chosen, fit, sized(groups)), "labels", nodes)
        now, gains, now_groups = _value(edges, new, total, fit)
        if gains <= 0 or gains < GROWTH and not last:  # of the partition before
            break
        idle = 0 if now > value + GROWTH / 10 or last and gains <= before / 2 else idle + 1
        before = min(before, gains)
        if now > value:
            labels, value, groups = new, now, now_groups
            if gains < GROWTH:
                part = 1  # the few that are left
        elif now < value:
            part += 1  # too many at once
        else:
            part = 1  # none of those that would gain
        if idle == IDLE:
            break
    return labels.select("node", "k", "label"), value - first >= GROWTH


def louvain(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, seq, head): each node's community, told by its first node in the order of seq and name."""
    ids = settle(numbered(nodes.select("name", "seq"), "node", "seq", "name").select("name", "seq", F.col("node").cast("bigint").alias("node")), "numbered")
    count = ids.count()
    fit = sized(count)
    of = lambda c, name: fit(ids.select(F.col("name").alias(c), F.col("node").alias(name)))
    e = edges.join(of("u", "x"), "u").join(of("v", "y"), "v").where("x <> y")
    e = e.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum(F.col("weight").cast("double")).alias("w"))
    first = e = settle(e.where("w > 0"), "numbered-edges")
    total = float(e.agg(F.sum("w")).first()[0] or 0.0)
    if total <= 0:
        return ids.select("name", "seq", F.col("name").alias("head"))
    ends = e.select(F.col("a").alias("node"), "w").union(e.select("b", "w")).groupBy("node").agg(F.sum("w").alias("k"))
    weights = k = settle(ends, "degrees")
    member = weights.select("node", F.col("node").alias("label"))
    for level in range(LEVELS):
        labels, changed = _moves(e, k.withColumn("label", F.col("node")), total, level)
        if not changed:
            break
        fit_level = sized(labels.count())
        member = settle(member.join(fit_level(labels.select(F.col("node").alias("old"), F.col("label").alias("new"))), F.col("label") == F.col("old")).select("node", F.col("new").alias("label")), "members", count)
        k = settle(labels.groupBy(F.col("label").alias("node")).agg(F.sum("k").alias("k")), "degrees", count)
        to = lambda c, name: fit_level(labels.select(F.col("node").alias(c), F.col("label").alias(name)))  # noqa: B023, E731
        e = e.join(to("a", "x"), "a").join(to("b", "y"), "b").where("x <> y").groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("w").alias("w"))
        e = settle(e, "coarse-edges")
    labels, _ = _moves(first, weights.join(fit(member), "node").select("node", "k", "label"), total, LEVELS, last=True)
    least = settle(labels.groupBy("label").agg(F.min("node").alias("node")), "heads", count)
    few = sized(least.count())
    heads = few(least).join(ids, "node").select("label", F.col("name").alias("head"))
    found = labels.join(few(heads), "label").select("node", "head")
    return ids.join(fit(found), "node", "left").select("name", "seq", F.coalesce("head", "name").alias("head"))
