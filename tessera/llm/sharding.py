"""Sharding by jump consistent hashing: no ring, no table of ranges, no state but the number of shards.

The key of a row is its doc_id alone. A 64-bit linear congruential generator, seeded with the mixed key, draws
the shards that the key would jump to as shards are appended one by one; the last jump below the number of shards
is its shard. So one more shard takes the share 1 / (shards + 1) of all keys, out of every old shard alike, and
nothing moves between old shards.

Slots number the rows of a shard without a gap, in the order of (doc_id, size, text_crc32), nulls first. Rows are
dealt to ranges sorted by shard and that order, numbered within a range, and a count for each range and shard (at
most ranges + shards rows) tells where it starts, so no shard has to fit into a task. A number given to each row
before takes part in the order, so a doc_id that a third of all rows share is spread over ranges as well, also
where its rows are equal. Text never crosses a shuffle for this: only its length and checksum do.

Defined results: a null text has no bytes (size 8, checksum 0), as an empty one. Null doc_ids are one key. Rows that
share a doc_id share a shard, whatever their texts: `key` is the law, and equal texts with different ids are not
kept together. Keys that are no whole numbers are hashed to one first. Other columns pass through place and
write_shards; columns named like the outputs are replaced. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.runtime import partitions, settle, ship, table

#: Bytes that a row takes besides its text.
ROW_BYTES = 8
#: The generator's multiplier, of the published algorithm (fixed value).
STEP = np.uint64(2862933555777941757)
#: Multipliers that mix a key before the generator (fixed values of a public 64-bit finalizer).
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: The key of null doc_ids.
NULL_KEY = -1


def mixed(key: np.ndarray) -> np.ndarray:
    """Keys whose bits are spread, so that neighbouring numbers do not go the same way."""
    k = key.astype(np.int64).view(np.uint64)
    k = (k ^ (k >> np.uint64(30))) * MIX[0]
    k = (k ^ (k >> np.uint64(27))) * MIX[1]
    return k ^ (k >> np.uint64(31))


def jump(key: np.ndarray, shards: int) -> np.ndarray:
    """The shard, from 0, of each 64-bit key; all keys jump at once until none is below the number of shards."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    k, at, nxt = mixed(key), np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    todo = np.arange(len(key))
    while len(todo):
        at[todo] = nxt[todo]
        k[todo] = k[todo] * STEP + np.uint64(1)
        nxt[todo] = ((at[todo] + 1) * (2.0**31 / ((k[todo] >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        todo = todo[nxt[todo] < shards]
    return at


def key_of(docs: DataFrame, doc_id: str = "doc_id") -> Column:
    """The whole number that stands for a row's id."""
    c = F.col(f"`{doc_id}`")
    whole = isinstance(docs.schema[doc_id].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    return F.coalesce(c.cast("long") if whole else F.xxhash64(c), F.lit(NULL_KEY).cast("long"))


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a key column, in Arrow batches of numbers alone."""

    @F.pandas_udf("int")
    def run(keys: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for k in keys:
            yield pd.Series(jump(k.to_numpy(np.int64), shards).astype(np.int32))

    return run(key)


def place(docs: DataFrame, shards: int, doc_id: str = "doc_id", name: str = "shard") -> DataFrame:
    """docs plus its shard. No shuffle, and rows do not pass through Python, only their keys."""
    ship(docs.sparkSession)
    return docs.withColumn(name, shard_of(key_of(docs, doc_id), shards))


def moved(docs: DataFrame, shards: int, more: int, doc_id: str = "doc_id") -> DataFrame:
    """The rows whose shard changes when `more` shards are appended, with shard and grown_shard: all go into new shards."""
    both = place(place(docs, shards, doc_id), shards + more, doc_id, "grown_shard")
    return both.where("shard <> grown_shard")


def slots(placed: DataFrame, *order: str) -> DataFrame:
    """placed (with shard) plus slot: rows of a shard counted from 0 in the given order, nulls first."""
    spark = placed.sparkSession
    by = [F.col(f"`{c}`").asc_nulls_first() for c in order]
    # a number that stays as it is once written, so that equal rows are told apart
    once = settle(placed.withColumn("__row", F.monotonically_increasing_id()), "sharded")
    ranges = once.repartitionByRange(partitions(spark), "shard", *by, "__row").withColumn("__range", F.spark_partition_id())
    held = settle(ranges, "shard-ranges")
    before = Window.partitionBy("shard").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = held.groupBy("shard", "__range").agg(F.count("*").alias("n"))
    starts = counts.select("shard", "__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    within = F.row_number().over(Window.partitionBy("shard", "__range").orderBy(*by, "__row")) - 1
    # ranges are sorted by shard first, so starts has at most ranges + shards rows
    return held.withColumn("__within", within).join(F.broadcast(starts), ["shard", "__range"]).withColumn("slot", (F.col("__start") + F.col("__within")).cast("long")).drop("__row", "__range", "__start", "__within")


def manifest(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, grown_shard): where each document lies, and where with one shard more."""
    t = F.col(f"`{text}`")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), (F.coalesce(F.octet_length(t), F.lit(0)) + ROW_BYTES).cast("long").alias("size"), F.crc32(F.coalesce(t, F.lit("")).cast("binary")).alias("text_crc32"))
    both = place(place(rows, shards), shards + 1, name="grown_shard")
    return slots(both, "doc_id", "size", "text_crc32")


def write_shards(docs: DataFrame, path: str, shards: int, doc_id: str = "doc_id", files: int = 1) -> None:
    """Write docs as Parquet folders shard=0 to shards - 1, each of at most `files` files, of about equal rows.

    Rows of a shard are dealt to its files at random (by all columns but the text's order), so a doc_id with very
    many rows is spread over all files of its shard.
    """
    spread = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)), F.lit(files))
    placed = place(docs.drop("shard"), shards, doc_id).withColumn("__file", spread)
    placed.repartition(shards * files, "shard", "__file").drop("__file").write.partitionBy("shard").parquet(path)


def append_shards(spark: SparkSession, path: str, target: str, shards: int, more: int, doc_id: str = "doc_id", files: int = 1) -> None:
    """Write under target only what changes in the shards at path when `more` are appended.

    moved/shard=N holds the rows of the new shards; left/shard=N the rows that stay in the old shards, without
    a shuffle: rows of an old shard go nowhere but into a new one.
    """
    held = spark.read.parquet(path).withColumn("__old", F.col("shard")).drop("shard")
    placed = place(held, shards + more, doc_id)
    gone = placed.where("shard <> __old").drop("__old")
    spread = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in gone.columns)), F.lit(files))
    gone.repartition(more * files, "shard", spread).write.partitionBy("shard").parquet(f"{target}/moved")
    placed.where("shard = __old").drop("__old").write.partitionBy("shard").parquet(f"{target}/left")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = manifest(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


WORD = "18446744073709551616::UHUGEINT"
#: Jump hashing in 128-bit integers, and the CRC-32 byte by byte (reflected polynomial 0xEDB88320), from the definitions.
SQL = f"""
WITH RECURSIVE docs AS (SELECT doc_id, coalesce(doc_id, -1) AS id, coalesce(text, '') AS text FROM documents),
keys AS (SELECT DISTINCT id, CAST(CASE WHEN id < 0 THEN 18446744073709551616::HUGEINT + id ELSE id END AS UHUGEINT) AS k FROM docs),
mix1 AS (SELECT id, xor(k, k >> 30) * {int(MIX[0])}::UHUGEINT % {WORD} AS k FROM keys),
mix2 AS (SELECT id, xor(k, k >> 27) * {int(MIX[1])}::UHUGEINT % {WORD} AS k FROM mix1),
jumps AS (
  SELECT id, xor(k, k >> 31) AS k, -1::BIGINT AS here, 0::BIGINT AS nxt FROM mix2
  UNION ALL
  SELECT id, k, nxt, CAST(floor((nxt + 1) * (2147483648.0::DOUBLE / CAST((k >> 33) + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT id, (k * {int(STEP)}::UHUGEINT + 1) % {WORD} AS k, nxt FROM jumps WHERE nxt < 25)),
law AS (SELECT id, max(here) FILTER (WHERE here < 24) AS shard, max(here) AS grown_shard FROM jumps GROUP BY id),
crcs AS (SELECT list(list_reduce(range(8), lambda c, j: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) AS t FROM range(256) AS x(i)),
told AS (SELECT doc_id, id, strlen(text) + 8 AS size,
  xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT)),
    lambda c, b: xor(t[xor(c, b) % 256 + 1], c // 256), 4294967295::BIGINT)) AS text_crc32
  FROM docs, crcs)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot
FROM told JOIN law USING (id)
"""
