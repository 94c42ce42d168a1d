import os
from threading import Thread
from uuid import uuid4

import pytest
from pyspark.sql import functions as F

from tessera.operators import store
from tessera.operators.store import VectorStore
from tessera.runtime import shared_dir

COLS = "kind string, source_id string, text string, vector array<float>, metadata string"


def rows(spark, ids, text="x", kind="entity"):
    return spark.createDataFrame([(kind, f"e{i}", text, [float(i), 1.0], "{}") for i in ids], COLS)


def many(spark, n, text, every=1):
    """n points with vectors that do not compress."""
    v = F.array(*(F.rand(i).cast("float") for i in range(32)))
    return spark.range(0, n, every).select(F.lit("entity").alias("kind"), F.concat(F.lit("e"), "id").alias("source_id"), F.lit(text).alias("text"), v.alias("vector"), F.lit("{}").alias("metadata"))


@pytest.fixture
def path(spark):
    return f"{shared_dir(spark)}/store-test-{uuid4().hex}"


def local(path):
    return path.removeprefix("file://")


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(local(path)) for f in names if f.endswith(".parquet"))


def texts(s, version=None):
    return {r["source_id"]: r["text"] for r in s.frame(version).collect()}


def test_a_small_change_writes_a_small_share(spark, path):
    s = VectorStore(spark, path, 32)
    s.upsert(many(spark, 20_000, "old"))
    before = size(path)
    s.upsert(many(spark, 20_000, "new", 100))
    assert size(path) - before < 0.03 * before
    s.delete(many(spark, 20_000, "", 200))
    assert size(path) - before < 0.04 * before
    assert s.count() == 19_900 and s.frame().where("text = 'new'").count() == 100
    assert len(s.manifest()["layers"]) == 2


def test_reading_does_not_shuffle_the_base_under_few_changes(spark, path):
    s = VectorStore(spark, path, 32)
    s.upsert(many(spark, 5_000, "old"))
    s.upsert(many(spark, 5_000, "new", 100))
    plan = s.frame()._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_layers_merge_and_buckets_compact(spark, path, monkeypatch):
    monkeypatch.setattr(store, "LAYERS", 2)
    s, want = VectorStore(spark, path, 2, buckets=4), {f"e{i}": "x" for i in range(400)}
    s.upsert(rows(spark, range(400)))
    for k in range(4):
        s.upsert(rows(spark, [k, k + 1, 1000 + k], f"c{k}"))
        want |= {f"e{i}": f"c{k}" for i in (k, k + 1, 1000 + k)}
        s.delete(rows(spark, [300 + k, 7777]))
        want.pop(f"e{300 + k}")
        assert texts(s) == want
        assert len(s.manifest()["layers"]) <= 2
    old = {b: x["path"] for b, x in s.manifest()["base"].items()}
    assert s.compact({0, 2}) and texts(s) == want
    new = {b: x["path"] for b, x in s.manifest()["base"].items()}
    assert {b for b in old if old[b] != new[b]} == {"0", "2"}
    s.upsert(rows(spark, range(300), "most"))  # more than a quarter of every bucket
    assert s.manifest()["layers"] == [] and texts(s) == want | {f"e{i}": "most" for i in range(300)}


def test_a_second_writer_between_write_and_manifest_is_not_lost(spark, path, monkeypatch):
    a, b = VectorStore(spark, path, 2), VectorStore(spark, path, 2)
    a.upsert(rows(spark, range(50)))
    put, met = VectorStore._put, []

    def slow(self, manifest):
        if self is a and not met:
            met.append(1)
            b.upsert(rows(spark, [1, 100], "b"))
        return put(self, manifest)

    monkeypatch.setattr(VectorStore, "_put", slow)
    a.upsert(rows(spark, [1, 2], "a"))
    assert met and texts(b) == {f"e{i}": "x" for i in range(50)} | {"e1": "a", "e2": "a", "e100": "b"}


def test_two_first_writers(spark, path, monkeypatch):
    a, b = VectorStore(spark, path, 2), VectorStore(spark, path, 2)
    put, met = VectorStore._put, []

    def slow(self, manifest):
        if self is a and not met:
            met.append(1)
            b.upsert(rows(spark, [1, 2], "b"))
        return put(self, manifest)

    monkeypatch.setattr(VectorStore, "_put", slow)
    a.upsert(rows(spark, [2, 3], "a"))
    assert texts(b) == {"e1": "b", "e2": "a", "e3": "a"}


def test_writers_at_once(spark, path):
    VectorStore(spark, path, 2).upsert(rows(spark, range(100)))
    failed = []

    def write(k):
        try:
            for i in range(3):
                VectorStore(spark, path, 2).upsert(rows(spark, [1000 + 10 * k + i], f"t{k}"))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [Thread(target=write, args=(k,)) for k in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed
    assert texts(VectorStore(spark, path, 2)) == {f"e{i}": "x" for i in range(100)} | {f"e{1000 + 10 * k + i}": f"t{k}" for k in range(3) for i in range(3)}


def test_a_compaction_gives_up_where_another_went_before(spark, path, monkeypatch):
    a, b = VectorStore(spark, path, 2), VectorStore(spark, path, 2)
    a.upsert(rows(spark, range(100)))
    a.upsert(rows(spark, [1], "new"))
    put, met = VectorStore._put, []

    def slow(self, manifest):
        if self is a and not met:
            met.append(1)
            assert b.compact()
        return put(self, manifest)

    monkeypatch.setattr(VectorStore, "_put", slow)
    assert not a.compact()
    assert texts(a) == {f"e{i}": "x" for i in range(100)} | {"e1": "new"}
    held = {x["path"] for x in a.manifest()["base"].values()} | {x["path"] for v in a.versions() for x in [*a.manifest(v)["base"].values(), *a.manifest(v)["layers"]]}
    assert {x for x in os.listdir(local(path)) if x.startswith(("base-", "layer-"))} == held


def test_versions_stay_readable_and_older_ones_go(spark, path):
    with VectorStore(spark, path, 2) as s:
        for i in range(4):
            s.upsert(rows(spark, [i], f"v{i}"))
        now, before = s.versions()[-1], s.versions()[-2]
        assert len(s.versions()) == 2 and len(texts(s, now)) == 4 and len(texts(s, before)) >= 3
        named = {f.split("/")[0] for v in s.versions() for f in s._files(s.manifest(v))}
        assert {x for x in os.listdir(local(path)) if x.startswith(("base-", "layer-"))} == named
    with pytest.raises(ValueError, match="closed"):
        s.count()
    with VectorStore(spark, path, 2) as again:
        assert again.count("entity") == 4 and again.count("text_unit") == 0


def test_get_reads_the_buckets_of_its_keys(spark, path):
    s = VectorStore(spark, path, 2, buckets=8)
    s.upsert(rows(spark, range(200)))
    s.delete(rows(spark, [3]))
    s.upsert(rows(spark, [4], "new"))
    asked = rows(spark, [3, 4, 5, 999])
    assert {r["source_id"]: r["text"] for r in s.get(asked).collect()} == {"e4": "new", "e5": "x"}
    one = s.get(rows(spark, [5]))
    assert len({f.split("/bucket=")[1].split("/")[0] for f in one.inputFiles() if "/bucket=" in f}) == 1


def test_empty_changes_and_wrong_sizes(spark, path):
    s = VectorStore(spark, path, 2)
    s.upsert(rows(spark, []))
    s.delete(rows(spark, [1]))
    assert s.count() == 0 and s.versions() == [0]
    with pytest.raises(ValueError, match="dim and buckets"):
        VectorStore(spark, path, 0)
    with pytest.raises(ValueError, match="1 components, the collection 2"):
        s.upsert(spark.createDataFrame([("entity", "e", "x", [1.0], "{}")], COLS))
    s.upsert(rows(spark, [1]).unionByName(rows(spark, [1], "later")).withColumn("seq", F.when(F.col("text") == "later", 1).otherwise(0)))
    assert texts(s) == {"e1": "later"}
    s.delete(rows(spark, [1]))
    assert s.count() == 0 and s.counts().collect() == []


def test_pruned_queries_follow_the_store(spark, path):
    s = VectorStore(spark, path, 2)
    s.upsert(rows(spark, range(60)))
    q = spark.createDataFrame([(0, [7.0, 1.0]), (1, [0.0, 1.0])], "query_id int, vector array<float>")
    same = lambda: sorted(map(tuple, s.query(q, 3, pruned=True).collect())) == sorted(map(tuple, s.query(q, 3).collect()))
    assert same()
    s.delete(rows(spark, [7]))
    assert same() and "e7" not in {r["source_id"] for r in s.query(q, 3, pruned=True).collect()}
    assert s.query(q, 3, "text_unit", pruned=True).collect() == []
