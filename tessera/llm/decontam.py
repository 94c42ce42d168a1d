"""Benchmark decontamination by spaced seeds.

Native: DataFrame functions alone. Texts become lower-cased runs of letters and
digits, each by a 64-bit hash. A document overlaps an item if, with the item laid over
it on some diagonal, a window of WINDOW item tokens (all of them in a shorter item)
agrees in at least 4 of 5 tokens.

Fixed masks look at some tokens and ignore the others, so substitutions there do not
matter. A mask's hash is taken at every position of the documents and of the benchmark,
and the two are joined. An item is seeded by the masks of its length (FAMILIES): they
are such that every window that the rule accepts, wherever its substitutions stand, has
a seed that avoids them all, so nothing is missed. Where a run of hits begins, the item
is laid over the document, and agreeing tokens are counted in a sliding window.

A benchmark of up to SEED_TOKENS tokens (counted; its seeds and tokens are then some
100 MB at most) is broadcast, and documents are read once without a shuffle. Beyond
that, hashes are joined by a shuffle that carries numbers alone; a hit then takes the
part of the document under its item along, never a whole text. Both ways give the same.

Defined results: items of fewer than SHORTEST tokens match nothing. Null or empty texts
overlap nothing. Of several windows of a pair, the one with the largest share counts,
then the widest, then the first. Rows that share a doc_id are told apart by a hash of
the text, repeated rows share their result. Null doc_ids stay rows of their own. Extra
columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.runtime import settle, small, table

SHORTEST, WINDOW, SEED_TOKENS = 5, 20, 500_000
#: Least number of item tokens -> the token positions that each of its masks looks at.
FAMILIES = {
    5: ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4)),
    6: ((0, 1, 2, 3), (0, 1, 4, 5)),
    8: ((0, 1, 2, 4, 5), (0, 1, 5, 6, 7)),
    10: ((0, 1, 2, 4, 5), (0, 1, 4, 6, 7), (0, 1, 5, 6, 7)),
    15: ((0, 1, 2, 3, 5, 6), (0, 1, 6, 8, 9, 10), (0, 2, 4, 7, 8, 9)),
}


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), "")


def _hashes(text: Column) -> Column:
    return F.transform(tokens(text), lambda t: F.xxhash64(t))


def family_of(n: int) -> int:
    return max(least for least in FAMILIES if least <= n)


def _masks(families: list[int]) -> list[tuple[int, int, tuple[int, ...]]]:
    """(tag, family, mask); the tag keeps masks apart."""
    return [(10 * f + i, f, mask) for f in sorted(families) for i, mask in enumerate(FAMILIES[f])]


def _hash(at: str, mask: tuple[int, ...], tag: int) -> str:
    """SQL: hash of the masked tokens from 0-based position `at`."""
    return f"xxhash64({tag}, {', '.join(f'get(tok, {at} + {o})' for o in mask)})"


def seeds(items: DataFrame, families: list[int]) -> DataFrame:
    """(h, before, item, n, j): each seed with the hash of the one before it under its mask."""
    each = ", ".join(
        f"if(family = {f} AND j + {max(mask)} < n, named_struct('h', {_hash('j', mask, tag)}, 'before', if(j > 0, {_hash('j - 1', mask, tag)}, null)), null)"
        for tag, f, mask in _masks(families)
    )
    at = items.select("item", "n", "family", "tok", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"))
    return at.selectExpr("item", "n", "j", f"explode(array_compact(array({each}))) AS s").select("s.h", "s.before", "item", "n", "j")


def overlaps(docs: DataFrame, bench: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, tid, item_id, at, matched, width): the best window of each overlapping pair.

    tid: hash of the text; at: the document token under the item's first token.
    """
    own = F.col(f"`{text}`")
    items = bench.where("text is not null").select("item_id", "text").distinct().select(F.xxhash64("item_id", "text").alias("item"), "item_id", _hashes(F.col("text")).alias("tok"))
    family = F.lit(None).cast("int")
    for least in sorted(FAMILIES, reverse=True):
        family = F.coalesce(family, F.when(F.col("n") >= least, least))
    items = settle(items.withColumn("n", F.size("tok")).where(f"n >= {SHORTEST}").withColumn("family", family), "benchmark")
    used = items.groupBy("family").agg(F.sum("n").alias("n")).collect()  # a row a family
    families = [r["family"] for r in used] or [SHORTEST]
    found = settle(seeds(items, families), "seeds")
    laid = items.select("item", "item_id", F.col("tok").alias("want"))
    few = sum(r["n"] for r in used) <= SEED_TOKENS
    if few:
        found, laid = F.broadcast(found), F.broadcast(laid)
    d = docs.select("doc_id", F.xxhash64(own).alias("tid"), _hashes(own).alias("tok")).where(f"size(tok) >= {SHORTEST - 1}")
    at = d.select("doc_id", "tid", "tok", F.explode(F.expr("sequence(0, size(tok) - 4)")).alias("i"))  # no mask is shorter than four tokens
    masks = _masks(families)
    here = ", ".join(f"named_struct('m', {tag}, 'h', {_hash('i', mask, tag)})" for tag, _, mask in masks)
    before = " ".join(f"WHEN {tag} THEN {_hash('i - 1', mask, tag)}" for tag, _, mask in masks)
    prior = f"if(i = 0, null, CASE m {before} END)"
    part = "slice(tok, greatest(i - j, 0) + 1, n) AS got"  # of the document, under the item
    begins = "before IS NULL OR prior IS NULL OR before <> prior"
    if few:
        hit = at.selectExpr("doc_id", "tid", "tok", "i", f"inline(array({here}))").join(found, "h").withColumn("prior", F.expr(prior)).where(begins)
        run = hit.selectExpr("doc_id", "tid", "item", "n", "i - j AS at", part)
    else:
        hashed = at.selectExpr("doc_id", "tid", "tok", "i", f"inline(array({here}))").selectExpr("doc_id", "tid", "i", "h", f"{prior} AS prior")
        met = hashed.join(found, "h").where(begins).selectExpr("doc_id AS __d", "tid AS __t", "item", "n", "i - j AS at").distinct()
        run = met.join(d, d["doc_id"].eqNullSafe(met["__d"]) & (d["tid"] == met["__t"])).selectExpr("doc_id", "tid", "item", "n", "at", part.replace("i - j", "at"))
    agree = run.join(laid, "item").withColumn("eq", F.expr("transform(want, (w, x) -> if(at + x >= 0 AND w <=> get(got, x - greatest(-at, 0)), 1, 0))")).withColumn("width", F.least("n", F.lit(WINDOW)))
    best = F.expr("aggregate(sequence(0, n - 1), named_struct('now', 0, 'most', 0), (a, x) -> named_struct('now', a.now + eq[x] - if(x >= width, eq[greatest(x - width, 0)], 0), 'most', greatest(a.most, a.now + eq[x] - if(x >= width, eq[greatest(x - width, 0)], 0)))).most")
    scored = agree.select("doc_id", "tid", "item_id", "at", "width", best.alias("matched")).where("5 * matched >= 4 * width")
    rank = F.struct((F.col("matched") / F.col("width")).alias("share"), "width", "matched", (-F.col("at")).alias("at"))
    top = scored.groupBy("doc_id", "tid", "item_id").agg(F.max(rank).alias("r"))
    return top.select("doc_id", "tid", "item_id", (-F.col("r.at")).alias("at"), "r.matched", "r.width")


def decontaminate(docs: DataFrame, bench: DataFrame, text: str = "text") -> DataFrame:
    """docs without the rows that overlap an item of the benchmark."""
    hits = settle(overlaps(docs, bench, text).select("doc_id", "tid").distinct(), "contaminated")
    hits = small(hits.select(F.col("doc_id").alias("__d"), F.col("tid").alias("__t")))
    same = docs["doc_id"].eqNullSafe(hits["__d"]) & (F.xxhash64(docs[f"`{text}`"]) == hits["__t"])
    return docs.join(hits, same, "left_anti")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and item that overlap: doc_id, item_id, matched and width in tokens, of one window."""
    out = overlaps(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    best = F.max(F.struct((F.col("matched") / F.col("width")).alias("share"), F.col("width").cast("long").alias("width"), F.col("matched").cast("long").alias("matched"))).alias("r")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "r.matched", "r.width")
