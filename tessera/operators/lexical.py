"""BM25 over text units: blocked postings with their largest contributions, and batched search that skips by them.

Units are dealt to cells of CELL in their order, and a term's postings in a cell are one block, with what its largest
contribution to a score follows from. So a block is small however frequent its term is, and the blocks of
different terms in a cell cover the same units. Every file of blocks is sorted by term, so that the terms of a few
questions are pruned at the scan.

A search that meets up to DIRECT postings adds all of them up, cell by cell, in one pass over the blocks of its terms.
Beyond that (or where it is asked to) it looks at the metadata of these blocks first, and most are never read:

1. Each question's blocks of largest contribution give a few units, which are scored fully; the k-th of these scores
   is a bound that the result cannot be under.
2. A question's terms whose largest contributions together stay under the bound are left out of the search for
   units (a unit with no other terms cannot reach it), and so are cells in which the blocks' largest contributions
   together stay under it.
3. The postings of what is left are read and added up. The units that look best then give a higher bound, and those
   that reach it with all that the left-out terms could add are scored fully, from the blocks of their cells.

Both ways give the result of scoring everything.

Where nothing but the answers is wanted, the texts' counts are taken with the questions known (naive_search): postings are
kept of the questions' terms alone, and neither texts nor postings are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.runs import byte_set, runs
from tessera.functions.text import SEPARATORS, STOP_COMMON, bm25_tokens
from tessera.runtime import partitions, settle, ship, small

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Units of a cell; units that a bound is taken from, as a multiple of the results; terms that are told to the scan.
CELL, FIRST, TOLD = 1024, 4, 200
#: Postings, counted once for each question, that are added up without choosing among their blocks: one pass, which takes less than the choice does.
DIRECT = 10_000_000_000
#: What rounding and the order of additions may change in a score.
SLACK = 1e-6
#: Contributions to scores that are added up at once.
ADDED = 2_000_000
BLOCKS = "term string, cell bigint, n bigint, tops array<struct<tf: int, dl: int>>, at array<int>, tf array<int>, dl array<int>, ids array<string>, seqs array<bigint>"
#: What tokens are made of; what separates their parts does not begin one.
HELD, APART = byte_set("abcdefghijklmnopqrstuvwxyz0123456789_-."), re.compile(SEPARATORS)
#: Units whose counts are taken at once; pairs of a question and its term up to which naive_search tells them to the tasks.
COUNTED, KNOWN = 4096, 50_000
COUNTS = "term string, n bigint, known boolean, no bigint, place array<int>, ids array<string>, documents array<string>, seqs array<bigint>, dl array<int>, code array<int>, at array<int>, tf array<int>"


@dataclass(frozen=True)
class Bm25Index:
    rows: DataFrame  # as in BLOCKS: what is written
    blocks: DataFrame  # term, cell, n, most, postings (no, gain): the same, with the contributions worked out
    idf: DataFrame  # term, idf, df
    count: int
    cell: int
    mean_length: float

    @property
    def units(self) -> DataFrame:
        """(no, id, seq, dl), from the cells' own rows."""
        own = self.rows.where("term = ''").select("cell", F.explode(F.arrays_zip("at", "ids", "seqs", "dl")).alias("u"))
        return own.select((F.col("cell") * self.cell + F.col("u.at")).alias("no"), F.col("u.ids").alias("id"), F.col("u.seqs").alias("seq"), F.col("u.dl").cast("bigint").alias("dl"))


def _gain(tf, dl, mean: float):
    """What a term that a unit of dl tokens holds tf times adds to a score of weight one; of Columns or of numpy arrays."""
    return (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * dl / mean))


def _cell(no: str, size: int) -> Column:
    return F.floor(F.col(no) / size).alias("cell")


def build_index(units: DataFrame) -> Bm25Index:
    """Index "{title}, newline, {text}" of each unit; units without a token are left out.

    One pass: texts are dealt to the cells by whole units, and each cell's tokens are counted into its blocks in one
    Arrow group. Blocks hold counts and lengths, so that the mean length may be known afterwards; two numbers reach
    the driver.
    """
    spark, size = units.sparkSession, CELL
    dealt = units.select(F.monotonically_increasing_id().alias("no"), "id", "seq", F.lower(_text(units)).alias("text"))
    dealt = dealt.select(_cell("no", size), "*").repartition(partitions(spark), "cell")
    ship(spark)
    rows = dealt.groupBy("cell").applyInArrow(lambda group: cell_blocks(group, size), BLOCKS)
    rows = settle(rows.sortWithinPartitions("term", "cell"), "blocks")
    stats = rows.where("term = ''").select(F.explode("dl").alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("mean")).first()
    n, mean = stats["n"], stats["mean"] or 1.0
    df = rows.where("term <> ''").groupBy("term").agg(F.sum("n").alias("df"))
    return _index(rows, _idf(df, n, "df"), n, size, mean)


def _index(rows: DataFrame, idf: DataFrame, n: int, size: int, mean: float) -> Bm25Index:
    most = F.array_max(F.transform("tops", lambda x: _gain(x["tf"], x["dl"], mean)))
    gains = F.transform(F.arrays_zip("at", "tf", "dl"), lambda x: F.struct((F.col("cell") * size + x["at"]).alias("no"), _gain(x["tf"], x["dl"], mean).alias("gain")))
    blocks = rows.where("term <> ''").select("term", "cell", "n", most.alias("most"), gains.alias("postings"))
    return Bm25Index(rows, blocks, idf, n, size, mean)


def cell_blocks(group: pa.Table, size: int) -> pa.Table:
    """The blocks of the units (cell, no, id, seq, lower-case text) of one cell, and a row of the term '' for the units themselves.

    tops holds each count that occurs with the least length it occurs with: whatever the mean length, one of them has
    the largest contribution.
    """
    group = group.sort_by("no")
    cell, units = group["cell"][0].as_py(), len(group)
    terms, term, unit, tf, lengths = _counts(group["text"].combine_chunks())
    dl, place = lengths[unit], group["no"].to_numpy() - cell * size
    ends = np.append(np.flatnonzero(np.diff(term, prepend=-1)), len(term))
    # least lengths of each (term, count)
    kind = term * (tf.max(initial=0) + 1) + tf
    order = np.argsort(kind, kind="stable")
    first = np.flatnonzero(np.diff(kind[order], prepend=-1))
    least = np.minimum.reduceat(dl[order], first) if len(first) else dl
    tops = pa.StructArray.from_arrays([_ints(tf[order][first]), _ints(least)], names=["tf", "dl"])
    tops = pa.ListArray.from_arrays(_ints(np.searchsorted(term[order][first], np.arange(len(terms) + 1))), tops)
    lists = [pa.ListArray.from_arrays(_ints(ends), _ints(x)) for x in (place[unit], tf, dl)]
    none = pa.nulls(len(terms))
    schema = pa.schema([("term", pa.string()), ("cell", pa.int64()), ("n", pa.int64()), ("tops", tops.type), *((c, pa.list_(pa.int32())) for c in ("at", "tf", "dl")), ("ids", pa.list_(pa.string())), ("seqs", pa.list_(pa.int64()))])
    blocks = [terms, pa.array(np.full(len(terms), cell)), pa.array(np.diff(ends)), tops, *lists, none.cast(pa.list_(pa.string())), none.cast(pa.list_(pa.int64()))]
    held = np.flatnonzero(lengths)
    own = {"term": "", "cell": cell, "n": len(held), "tops": [], "at": place[held], "tf": [], "dl": lengths[held], "ids": group["id"].take(held).to_pylist(), "seqs": group["seq"].take(held).to_pylist()}
    return pa.concat_tables([pa.Table.from_arrays(blocks, schema=schema), pa.Table.from_pylist([own], schema=schema)])


def _counts(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-case texts: the terms; each posting's term, text and count, by term and text; each text's length."""
    units = len(texts)
    raw, unit = runs(texts, HELD)
    key, times = np.unique(raw.indices.to_numpy().astype(np.int64) * units + unit, return_counts=True)
    # what each distinct token counts for: as bm25_tokens, twice for itself, or once each for itself and its parts
    words = pc.ascii_ltrim(raw.dictionary, "_-.")
    apart = pc.match_substring_regex(words, SEPARATORS)
    plain = np.flatnonzero(pc.invert(pc.or_(apart, pc.is_in(words, pa.array([*STOP_COMMON, ""])))).to_numpy(zero_copy_only=False))
    parts = [(i, t) for i, word in zip(np.flatnonzero(apart), words.filter(apart).to_pylist(), strict=True) for t in (word, *APART.split(word)) if t and t not in STOP_COMMON]
    of = np.concatenate([plain, np.array([i for i, _ in parts], np.int64)])
    terms = pa.concat_arrays([words.take(pa.array(plain)), pa.array([t for _, t in parts], pa.string())]).dictionary_encode()
    term, terms = terms.indices.to_numpy().astype(np.int64), terms.dictionary
    starts = np.searchsorted(key, np.arange(len(words) + 1) * units)
    at, each = _ranges(starts[of], starts[of + 1] - starts[of])
    key, tf = term[each] * units + key[at] % max(units, 1), times[at] * np.where(each < len(plain), 2, 1)
    order = np.argsort(key)
    key, tf = key[order], tf[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    key, tf = key[first], np.add.reduceat(tf, first) if len(first) else tf
    term, unit = np.divmod(key, max(units, 1))
    return terms, term, unit, tf, np.bincount(unit, tf, units).astype(np.int64)


def _ints(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int32))


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each start on, one range after the other, and which range each number is of."""
    each = np.repeat(np.arange(len(starts)), lengths)
    return np.arange(len(each)) + (starts - np.cumsum(lengths) + lengths)[each], each


def term_idf(units: DataFrame) -> DataFrame:
    """(term, idf) as in the index of the units, by one pass over them: without postings, and with what a task counts combined before the shuffle."""
    # distinct by sorting, as array_distinct compares every pair of strings; no token is empty, so the empty one stands for the unit itself
    once = F.flatten(F.transform(F.array(F.sort_array(F.array_append("t", F.lit("")))), lambda t: F.filter(t, lambda x, i: (i == 0) | (x != F.get(t, i - 1)))))
    counts = _tokens(units).select(F.explode(once).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    counts = settle(counts, "document-frequencies")
    n = counts.where("term = ''").agg(F.sum("df")).first()[0] or 0
    return _idf(counts.where("term <> ''"), n)


def _text(units: DataFrame) -> Column:
    return F.concat_ws("\n", F.coalesce("document_title", F.lit("")), F.coalesce("text", F.lit("")))


def _tokens(units: DataFrame) -> DataFrame:
    """(id, seq, t) of the units with a token."""
    return units.select("id", "seq", F.explode(F.array(bm25_tokens(_text(units)))).alias("t")).where(F.size("t") > 0)  # bound, so that it is worked out once


def _idf(df: DataFrame, n: int, *more: str) -> DataFrame:
    """(term, idf, *more) from (term, df, *more) over n units; a negative weight becomes a part of the mean one."""
    plain = settle(df.select("term", _plain(n).alias("idf"), *more), "idf")
    return _floored(plain, plain.agg(F.avg("idf")).first()[0], *more)


def _plain(n: int) -> Column:
    return F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def _floored(plain: DataFrame, mean: float | None, *more: str) -> DataFrame:
    return plain.select("term", F.when(F.col("idf") < 0, F.lit(EPSILON * (mean or 0.0))).otherwise(F.col("idf")).alias("idf"), *more)


def _weights(index: Bm25Index, queries: DataFrame) -> DataFrame:
    """(query_id, term, weight, df) of the questions' terms."""
    asked = queries.select("query_id", F.explode(bm25_tokens(F.col("question"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    return settle(asked.join(index.idf, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight"), "df"), "asked")


def _asked(index: Bm25Index, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The questions' terms as _weights has them, and the metadata of their blocks."""
    asked = _weights(index, queries)
    return asked, _metadata(index, asked)


def _only(index: Bm25Index, asked: DataFrame) -> Bm25Index:
    """The index with the blocks of the asked terms alone, for a search that reads them several times."""
    rows = index.rows
    few = [r["term"] for r in asked.select("term").distinct().limit(TOLD + 1).collect()]
    if len(few) <= TOLD:
        rows = rows.where(F.col("term").isin([*few, ""]))
    else:
        rows = rows.join(small(asked.select("term").distinct().union(asked.sparkSession.createDataFrame([("",)], "term string"))), "term", "left_semi").select(rows.columns)
    return _index(settle(rows, "asked-index"), index.idf, index.count, index.cell, index.mean_length)


def _metadata(index: Bm25Index, asked: DataFrame) -> DataFrame:
    """(query_id, term, cell, n, weight, most) of the blocks of the asked terms; most: the largest contribution to a score of any unit in it."""
    blocks = index.blocks.select("term", "cell", "n", F.col("most").alias("gain"))
    few = [r["term"] for r in asked.select("term").distinct().limit(TOLD + 1).collect()]
    if len(few) <= TOLD:
        blocks = blocks.where(F.col("term").isin(few))
    met = blocks.join(small(asked.select("query_id", "term", "weight")), "term")
    return settle(met.select("query_id", "term", "cell", "n", "weight", F.greatest(F.col("weight") * F.col("gain"), F.lit(0.0)).alias("most")), "asked-blocks")


def _sums(index: Bm25Index, chosen: DataFrame, top_k: int = 0, floor: Column | None = None) -> DataFrame:
    """(query_id, no, part): contributions of the chosen (query_id, term, weight) added up, in every cell or in a cell that is a fourth column.

    Blocks are shuffled once, however many questions they are for, and added up cell by cell. Sums under the floor (a
    question's own, if given) and, with top_k, those not over zero or surely not among a cell's top_k are left out.
    """
    on = ["term", "cell"] if "cell" in chosen.columns else ["term"]
    asking = F.struct("query_id", "weight", (F.lit(float("-inf")) if floor is None else floor).alias("floor"))
    who = settle(chosen.groupBy(*on).agg(F.collect_list(asking).alias("who")), "chosen")
    rows = index.rows.where("term <> ''").select("term", "cell", "at", "tf", "dl").join(small(who), on)
    size, mean, kind = index.cell, index.mean_length, chosen.schema["query_id"].dataType.simpleString()
    ship(chosen.sparkSession)
    return rows.drop("term").groupBy("cell").applyInArrow(lambda group: cell_sums(group, size, mean, top_k), f"query_id {kind}, no bigint, part double")


def cell_sums(group: pa.Table, size: int, mean: float, top_k: int = 0) -> pa.Table:
    """(query_id, no, part) of one cell from its blocks (cell, at, tf, dl, who: query_id, weight, floor), some questions at a time."""
    at, tf, dl, who = (group[c].combine_chunks() for c in ("at", "tf", "dl", "who"))
    lengths = pc.list_value_length(at).to_numpy()
    starts, place = np.cumsum(lengths) - lengths, at.flatten().to_numpy()
    gain, who_lengths = _gain(tf.flatten().to_numpy(), dl.flatten().to_numpy(), mean), pc.list_value_length(who).to_numpy()
    who = who.flatten()
    ids = pc.struct_field(who, "query_id").dictionary_encode()
    q, weight, block = ids.indices.to_numpy(), pc.struct_field(who, "weight").to_numpy(), np.repeat(np.arange(len(group)), who_lengths)
    floor = np.empty(len(ids.dictionary))
    floor[q] = pc.struct_field(who, "floor").to_numpy()
    hit, no, part = _added(q, weight, block, starts, lengths, place, gain, floor, size, top_k)
    return pa.table({"query_id": ids.dictionary.take(pa.array(hit)), "no": pa.array(no + group["cell"][0].as_py() * size), "part": pa.array(part)})


def _added(q, weight, block, starts, lengths, place, gain, floor, size: int, top_k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(question, unit, sum) of questions' weighted blocks (ranges of postings: place, gain) over `size` units, some questions at a time."""
    order = np.argsort(q, kind="stable")
    q, weight, block = q[order], weight[order], block[order]
    work = np.cumsum(np.bincount(q, lengths[block], len(floor)) + size) // ADDED
    firsts = np.append(np.flatnonzero(np.diff(work, prepend=-1)), len(work))
    found = []
    for low, high in zip(firsts[:-1], firsts[1:], strict=True):
        e = slice(*np.searchsorted(q, [low, high]))
        post, each = _ranges(starts[block[e]], lengths[block[e]])
        key = (q[e][each] - low) * size + place[post]
        total = np.bincount(key, weight[e][each] * gain[post], (high - low) * size).reshape(-1, size)
        keep = (np.bincount(key, minlength=total.size) > 0).reshape(-1, size) & (total >= floor[low:high, None])
        if top_k:
            keep &= total > 0
            if top_k < size:
                keep &= total >= np.partition(total, size - top_k, axis=1)[:, size - top_k, None] - SLACK
        hit, no = np.nonzero(keep)
        found.append((hit + low, no, total[hit, no]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _scores(index: Bm25Index, asked: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, no, score) of the given (query_id, no), by all terms, from the blocks of their cells."""
    cells = found.select("query_id", _cell("no", index.cell)).distinct()
    chosen = settle(cells, "cells").join(small(asked), "query_id").select("query_id", "term", "cell", "weight")
    rows = _sums(index, chosen).join(small(found), ["query_id", "no"], "left_semi")
    return rows.select("query_id", "no", F.round("part", 9).alias("score"))


def _bounds(scored: DataFrame, top_k: int) -> DataFrame:
    """(query_id, bound): a score that the k-th of the result cannot be under; questions with fewer scores have none."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    return scored.withColumn("__rn", place).where(F.col("__rn") == top_k).select("query_id", F.greatest(F.col("score"), F.lit(0.0)).alias("bound"))


def blocks_left(index: Bm25Index, asked: DataFrame, metadata: DataFrame, top_k: int = 8) -> DataFrame:
    """(query_id, term, cell, n, weight, bound, spare): the blocks to read, and what the terms left out could add to a score."""
    best = Window.partitionBy("query_id").orderBy(F.desc("most"), "term", "cell").rowsBetween(Window.unboundedPreceding, -1)
    # of each question, blocks enough to hold FIRST * top_k postings: no more blocks than that, as each holds one
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("most"), "term", "cell"))
    first = metadata.where("most > 0").withColumn("__rn", place).where(F.col("__rn") <= FIRST * top_k)
    first = first.withColumn("__before", F.coalesce(F.sum("n").over(best), F.lit(0))).where(F.col("__before") < FIRST * top_k)
    units = settle(_sums(index, first.select("query_id", "term", "cell", "weight")).select("query_id", "no"), "first-units")
    bound = settle(_bounds(_scores(index, asked, units), top_k), "bounds")
    # the terms of least contribution, as long as they stay under the bound together, are not searched for
    up = Window.partitionBy("query_id").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)
    asked = metadata.groupBy("query_id", "term").agg(F.max("most").alias("most"))
    terms = asked.join(small(bound), "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(0.0))).withColumn("__sum", F.sum("most").over(up))
    terms = terms.withColumn("spared", (F.col("__sum") < F.col("bound") - SLACK) | (F.col("most") <= 0))
    spare = F.coalesce(F.sum(F.when(F.col("spared"), F.col("most"))).over(Window.partitionBy("query_id")), F.lit(0.0))
    wanted = settle(terms.withColumn("spare", spare).where("NOT spared").select("query_id", "term", "bound", "spare"), "wanted-terms")
    cells = metadata.groupBy("query_id", "cell").agg(F.sum("most").alias("most")).join(small(bound), "query_id", "left").where(F.col("most") >= F.coalesce("bound", F.lit(0.0)) - SLACK)
    left = metadata.join(small(wanted), ["query_id", "term"]).join(small(settle(cells.select("query_id", "cell"), "cells")), ["query_id", "cell"], "left_semi")
    return settle(left.select("query_id", "term", "cell", "n", "weight", "bound", "spare"), "blocks-left")


def search(index: Bm25Index, queries: DataFrame, top_k: int = 8, direct: int = DIRECT) -> DataFrame:
    """(query_id, rank, id, score) of the top_k units of each (query_id, question); scores over zero only.

    direct: up to so many postings of the questions' terms, by count, are all added up.
    """
    if top_k < 1:
        raise ValueError("top_k must be at least 1")
    asked = _weights(index, queries)
    if (asked.agg(F.sum("df")).first()[0] or 0) <= direct:
        scored = _sums(index, asked.select("query_id", "term", "weight"), top_k).select("query_id", "no", F.round("part", 9).alias("score"))
    else:
        index = _only(index, asked)
        left = blocks_left(index, asked, _metadata(index, asked), top_k)
        parts = _sums(index, left.select("query_id", "term", "cell", "weight", "bound", "spare"), floor=F.col("bound") - F.col("spare") - SLACK)
        parts = settle(parts.join(small(left.select("query_id", "spare").distinct()), "query_id"), "parts")
        # the bound once more, from the units that look best now
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("part"), "no"))
        likely = settle(parts.withColumn("__rn", place).where(F.col("__rn") <= FIRST * top_k).select("query_id", "no"), "likely")
        higher = settle(_bounds(_scores(index, asked, likely), top_k), "bounds")
        found = parts.join(small(higher), "query_id", "left").where(F.col("part") + F.col("spare") >= F.coalesce("bound", F.lit(0.0)) - SLACK)
        scored = _scores(index, asked, settle(found.select("query_id", "no"), "candidates"))
    # ties go by seq, which only units that may be among the first are asked for
    place = F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    near = settle(scored.where("score > 0").withColumn("__place", place).where(F.col("__place") <= top_k).drop("__place"), "near")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "seq")
    named = index.units.join(small(near), "no")
    return named.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k).select("query_id", "rank", "id", "score")


def postings_read(index: Bm25Index, queries: DataFrame, top_k: int = 8) -> DataFrame:
    """(query_id, blocks, blocks_read, postings, postings_read): how much of its terms' postings each question reads, where it chooses."""
    asked, metadata = _asked(index, queries)
    every = metadata.groupBy("query_id").agg(F.count("*").alias("blocks"), F.sum("n").alias("postings"))
    read = blocks_left(index, asked, metadata, top_k).groupBy("query_id").agg(F.count("*").alias("blocks_read"), F.sum("n").alias("postings_read"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return every.join(read, "query_id", "left").select("query_id", "blocks", zero("blocks_read"), "postings", zero("postings_read"))


def results(hits: DataFrame, units: DataFrame) -> DataFrame:
    """Hits with text and metadata for a prompt: the title stands above the title and the text."""
    u = units.select("id", "document_id", F.coalesce("document_title", F.lit("")).alias("title"), "text")
    body = F.substring(F.concat_ws("\n", "title", "text"), 1, 1600)
    text = F.concat(F.lit("["), F.col("id"), F.lit("] "), F.col("title"), F.lit("\n"), body)
    meta = F.struct("document_id", F.lit("bm25").alias("retriever"))
    return hits.join(u, "id").select("query_id", "rank", "id", "score", text.alias("text"), meta.alias("metadata"))


def naive_search(units: DataFrame, queries: DataFrame, top_k: int = 8, known: int = KNOWN, direct: int = DIRECT) -> DataFrame:
    """(query_id, rank, id, document_id, score): index and search in one, with the same result.

    The questions' terms are told to the pass over the texts, which keeps their postings alone. Where they have more than
    `known` pairs of a question and its term, or meet more than `direct` postings, a whole index is built and searched.
    """
    if top_k < 1:
        raise ValueError("top_k must be at least 1")
    spark = units.sparkSession
    whole = lambda: search(build_index(units), queries, top_k, direct).join(units.select("id", "document_id").distinct(), "id").select("query_id", "rank", "id", "document_id", "score")
    asked = settle(queries.select("query_id", F.explode(bm25_tokens(F.col("question"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf")), "asked")
    if asked.limit(known + 1).count() > known:
        return whole()
    terms = sorted({r["term"] for r in asked.select("term").collect()})
    ship(spark)
    texts = units.select(F.monotonically_increasing_id().alias("no"), "id", "document_id", "seq", F.lower(_text(units)).alias("text"))
    size = COUNTED
    rows = settle(texts.mapInArrow(lambda batches: counts(batches, pa.array(terms, pa.string()), size), COUNTS), "counts")
    own = rows.where("term = ''")
    stats = own.select(F.explode("dl").alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("mean")).first()
    n, mean = stats["n"], stats["mean"] or 1.0
    df = rows.where("known").groupBy("term").agg(F.sum("n").alias("df"))
    every = rows.where("term <> ''").groupBy("term").agg(F.sum("n").alias("df")).agg(F.avg(_plain(n))).first()[0]
    asked = asked.join(_floored(df.select("term", _plain(n).alias("idf"), "df"), every, "df"), "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight"), "df").toArrow()
    if (pc.sum(asked["df"]).as_py() or 0) > direct:
        return whole()
    ids = asked["query_id"].combine_chunks().dictionary_encode(null_encoding="encode")
    q, code, weight = ids.indices.to_numpy(), pc.index_in(asked["term"], pa.array(terms, pa.string())).to_numpy(), asked["weight"].to_numpy()
    kind = queries.schema["query_id"].dataType.simpleString()
    found = own.select("no", "place", "seqs", "dl", "code", "at", "tf").mapInArrow(lambda batches: count_sums(batches, ids.dictionary, q, code, weight, mean, top_k), f"query_id {kind}, no bigint, seq bigint, part double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "seq")
    found = found.select("query_id", "no", "seq", F.round("part", 9).alias("score")).where("score > 0")
    near = settle(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k).drop("seq"), "near")
    named = own.select("no", F.explode(F.arrays_zip("place", "ids", "documents")).alias("u")).select((F.col("no") + F.col("u.place")).alias("no"), F.col("u.ids").alias("id"), F.col("u.documents").alias("document_id"))
    return named.join(small(near), "no").select("query_id", "rank", "id", "document_id", "score")


def counts(batches: Iterable[pa.RecordBatch], known: pa.Array, size: int) -> Iterator[pa.RecordBatch]:
    """Rows of COUNTS from units (no, id, document_id, seq, lower-case text), `size` at most at a time.

    A row for each term, with the number of units that hold it, and one of the term '' for the units themselves, with the
    postings of the known terms.
    """
    schema = pa.schema([("term", pa.string()), ("n", pa.int64()), ("known", pa.bool_()), ("no", pa.int64()), ("place", pa.list_(pa.int32())), ("ids", pa.list_(pa.string())), ("documents", pa.list_(pa.string())), ("seqs", pa.list_(pa.int64())), *((c, pa.list_(pa.int32())) for c in ("dl", "code", "at", "tf"))])
    for part in (b.slice(low, size) for b in batches for low in range(0, b.num_rows, size)):
        terms, term, unit, tf, lengths = _counts(part["text"])
        code = pc.index_in(terms, known)
        own = np.flatnonzero(lengths)
        yield pa.record_batch([terms, pa.array(np.bincount(term, minlength=len(terms))), code.is_valid(), *(pa.nulls(len(terms), f.type) for f in list(schema)[3:])], schema=schema)
        code = code.fill_null(-1).to_numpy()[term]
        hit = np.flatnonzero(code >= 0)
        hit = hit[np.argsort(code[hit], kind="stable")]
        one = {"place": _ints(own), "ids": part["id"].take(pa.array(own)), "documents": part["document_id"].take(pa.array(own)), "seqs": part["seq"].take(pa.array(own)), "dl": _ints(lengths[own]), "code": _ints(code[hit]), "at": _ints((np.cumsum(lengths > 0) - 1)[unit[hit]]), "tf": _ints(tf[hit])}
        lists = [pa.ListArray.from_arrays(_ints(np.array([0, len(x)])), x.cast(schema.field(c).type.value_type)) for c, x in one.items()]
        yield pa.record_batch([pa.array([""]), pa.array([len(own)]), pa.array([False]), part["no"].slice(0, 1), *lists], schema=schema)


def count_sums(batches: Iterable[pa.RecordBatch], ids: pa.Array, q: np.ndarray, code: np.ndarray, weight: np.ndarray, mean: float, top_k: int) -> Iterator[pa.RecordBatch]:
    """(query_id, no, seq, part) from the units' own rows of COUNTS: the sums that may be among a question's top_k."""
    floor = np.full(len(ids), float("-inf"))
    for batch in batches:
        for i in range(batch.num_rows):
            place, seqs, dl, held, at, tf = (batch[c][i].values.to_numpy() for c in ("place", "seqs", "dl", "code", "at", "tf"))
            if len(held) and len(q):
                starts = np.searchsorted(held, np.arange(code.max() + 2))
                hit, unit, part = _added(q, weight, code, starts[:-1], np.diff(starts), at, _gain(tf, dl[at], mean), floor, len(dl), top_k)
                yield pa.record_batch({"query_id": ids.take(pa.array(hit)), "no": pa.array(batch["no"][i].as_py() + place[unit].astype(np.int64)), "seq": pa.array(seqs[unit]), "part": pa.array(part)})
