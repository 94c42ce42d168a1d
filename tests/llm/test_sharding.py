import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import sharding
from tessera.runtime import shared_dir

SF = "/root/testdata/sf0.001"


def plain_jump(key, shards):
    """The published algorithm for one key, after the mixing."""
    m = (1 << 64) - 1
    k = key & m
    k = (k ^ (k >> 30)) * 0xBF58476D1CE4E5B9 & m
    k = (k ^ (k >> 27)) * 0x94D049BB133111EB & m
    k ^= k >> 31
    b, j = -1, 0
    while j < shards:
        b = j
        k = (k * 2862933555777941757 + 1) & m
        j = int((b + 1) * (float(1 << 31) / float((k >> 33) + 1)))
    return b


def test_jump_equals_the_plain_form():
    keys = [0, 1, -1, 5, 2**62, -(2**63), *range(1000, 1400)]
    for shards in (1, 2, 24, 25, 1000):
        assert sharding.jump(np.array(keys), shards).tolist() == [plain_jump(k, shards) for k in keys]
    with pytest.raises(ValueError):
        sharding.jump(np.array([1]), 0)


def test_growth_moves_the_necessary_share_into_the_new_shard():
    keys = np.arange(200_000)
    old, new = sharding.jump(keys, 24), sharding.jump(keys, 25)
    assert set(new[old != new]) == {24}
    assert abs((old != new).mean() - 1 / 25) < 0.002
    assert np.bincount(old).min() > 0.95 * len(keys) / 24


def test_sql_twin(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cur = con.execute(sharding.SQL)
    names = [x[0] for x in cur.description]
    got = sharding.op11(spark, SF)
    assert sorted(map(tuple, got.select(names).collect())) == sorted(cur.fetchall())
    assert dict(got.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}


def test_nulls_ties_repeated_rows_and_a_hot_id(docs):
    rows = [(None, "a"), (None, None), (7, "é"), (7, "é"), (7, ""), (8, "x" * 300_000)] + [(5, "copy")] * 500 + [(9, f"t{i}") for i in range(300)]
    out = sharding.manifest(docs(rows), 3).collect()
    assert len(out) == len(rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    for r in out:
        key = -1 if r["doc_id"] is None else r["doc_id"]
        assert (r["shard"], r["grown_shard"]) == (plain_jump(key, 3), plain_jump(key, 4))
    for s in {r["shard"] for r in out}:
        own = sorted((r["slot"], r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in out if r["shard"] == s)
        assert [x[0] for x in own] == list(range(len(own)))
        assert [x[1:] for x in own] == sorted(x[1:] for x in own)


def test_empty_table_and_clashing_columns(docs, spark):
    assert sharding.manifest(docs([]), 24).collect() == []
    d = docs([(1, "a"), (2, "b")]).withColumn("shard", F.lit("own")).withColumn("slot", F.lit("x"))
    assert {r["doc_id"]: r["shard"] for r in sharding.place(d, 24).collect()} == {i: plain_jump(i, 24) for i in (1, 2)}
    assert sharding.place(d, 24).columns == d.columns
    assert sharding.manifest(d, 24).count() == 2
    named = spark.createDataFrame([("a",), ("b",), (None,)], "doc_id string")
    assert {r["shard"] for r in sharding.place(named, 1).collect()} == {0}


def test_written_shards_and_their_growth(docs, spark):
    rows = [(i, f"text {i}") for i in range(400)] + [(3, "more")] * 5
    path = f"{shared_dir(spark)}/shards-test-{id(rows)}"
    sharding.write_shards(docs(rows), path, 5, files=2)
    back = spark.read.parquet(path)
    assert Counter((r["doc_id"], r["text"], r["shard"]) for r in back.collect()) == Counter((i, t, plain_jump(i, 5)) for i, t in rows)
    sharding.append_shards(spark, path, f"{path}-grown", 5, 2)
    went = spark.read.parquet(f"{path}-grown/moved")
    assert {r["shard"] for r in went.collect()} == {5, 6}
    both = went.unionByName(spark.read.parquet(f"{path}-grown/left"))
    assert Counter((r["doc_id"], r["text"], r["shard"]) for r in both.collect()) == Counter((i, t, plain_jump(i, 7)) for i, t in rows)
    assert went.count() == sharding.moved(docs(rows), 5, 2).count() == sum(plain_jump(i, 5) != plain_jump(i, 7) for i, _ in rows)
