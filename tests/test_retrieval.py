import re
from uuid import uuid4

import pytest
from pyspark.sql import functions as F

from tessera.operators import chunk, dense, evaluation, fusion, lexical
from tessera.runtime import shared_dir

UNITS = [("kafka", "issue-944", "Kafka consumer unsubscribe blocking"), ("vector", "issue-875", "dense semantic embeddings"), ("graph", "issue-922", "graph traversal latency")]


@pytest.fixture
def units(spark):
    return spark.createDataFrame([(i, d, d, t, n) for n, (i, d, t) in enumerate(UNITS)], "id string, document_id string, document_title string, text string, seq bigint")


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, question string")


def test_bm25(spark, units):
    index = lexical.build_index(units)
    hits = lexical.search(index, ask(spark, "Kafka unsubscribe", "", "the of"), 2)
    rows = lexical.results(hits, units).collect()
    assert [(r["query_id"], r["id"], r["metadata"]["document_id"], r["metadata"]["retriever"]) for r in rows] == [(0, "kafka", "issue-944", "bm25")]
    assert rows[0]["text"].startswith("[kafka] issue-944\nissue-944\nKafka")
    with pytest.raises(ValueError):
        lexical.search(index, ask(spark, "x"), 0)


def test_bm25_like_plain_python(spark, units):
    import math

    docs = {i: spark.range(1).select(__import__("tessera.functions.text", fromlist=["x"]).bm25_tokens(F.lit(f"{d}\n{t}"))).first()[0] for i, d, t in UNITS}
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    df = {w: sum(w in d for d in docs.values()) for d in docs.values() for w in d}
    idf = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    avg = sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else 0.25 * avg for w, v in idf.items()}
    q = ["graph", "graph", "latency", "latency"]
    want = {i: sum(idf.get(w, 0) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / mean)) for w in q) for i, d in docs.items()}
    got = {r["id"]: r["score"] for r in lexical.naive_search(units, ask(spark, "graph latency")).collect()}
    assert got == pytest.approx({i: s for i, s in want.items() if s > 0}, abs=1e-8)


def test_fusion(spark):
    a = spark.createDataFrame([(0, "a", 1), (0, "b", 2)], "query_id int, id string, rank int")
    b = spark.createDataFrame([(0, "b", 1), (0, "c", 2), (0, "b", 3)], "query_id int, id string, rank int")
    rows = fusion.fuse({"bm25": a, "vector": b}).orderBy("rank").collect()
    assert [r["id"] for r in rows] == ["b", "a", "c"]
    assert rows[0]["score"] == 1 / 62 + 1 / 61 and rows[0]["rrf_ranks"] == {"bm25": 2, "vector": 1}
    x, y = (spark.createDataFrame([(0, i, 1)], "query_id int, id string, rank int") for i in "ab")
    assert [r["id"] for r in fusion.fuse({"p": y, "q": x}).orderBy("rank").collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        fusion.fuse({"p": x}, 0)


def test_hybrid_asks_for_depth(spark):
    asked = []

    def fake(q, n):
        asked.append(n)
        return spark.createDataFrame([(0, "a", 1)], "query_id int, id string, rank int")

    fusion.hybrid(fake, fake, None, top_k=1)
    assert asked == [20, 20]


def test_cosine_and_ties(spark):
    v = spark.createDataFrame([("t", "b", [1.0, 0.0]), ("t", "a", [2.0, 0.0]), ("t", "z", [0.0, 0.0]), ("u", "c", [1.0, 0.0])], "kind string, source_id string, vector array<float>")
    q = spark.createDataFrame([(1, [1.0, 1.0])], "query_id int, vector array<float>")
    rows = dense.nearest(v, q, 5, "t").orderBy("rank").collect()
    assert [(r["source_id"], round(r["score"], 6)) for r in rows] == [("a", 0.707107), ("b", 0.707107)]


@pytest.mark.parametrize("sent", [20_000, 0])
def test_nearest_like_brute_force(spark, monkeypatch, sent):
    import numpy as np

    monkeypatch.setattr("tessera.operators.nearest.SENT_QUERIES", sent)
    monkeypatch.setattr("tessera.operators.nearest.BLOCK", 16)
    r = np.random.default_rng(2)
    rows = [("t", f"v{i:02}", [float(x) for x in r.integers(-2, 3, 3)]) for i in range(60)] + [("t", "n", None), ("t", "s", [1.0, 2.0]), ("t", "e", []), ("t", "h", [1.0, None, 2.0])]
    v = spark.createDataFrame(rows, "kind string, source_id string, vector array<double>")
    qs = [(f"q{i}", [float(x) for x in r.integers(-2, 3, 3)]) for i in range(25)] + [("two", [2.0, 4.0]), ("zero", [0.0, 0.0, 0.0]), ("none", None)]
    got = {}
    for x in dense.nearest(v, spark.createDataFrame(qs, "query_id string, vector array<double>"), 7).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["source_id"], x["score"]))
    for q, a in qs:
        near = []
        for _, i, b in rows:
            if a and b and len(a) == len(b) and None not in b and any(a) and any(b):
                near.append((-round(float(np.dot(a, b) / np.sqrt(np.dot(a, a)) / np.sqrt(np.dot(b, b))), 9), i))
        want = [(k + 1, i, pytest.approx(-s, abs=1e-9)) for k, (s, i) in enumerate(sorted(near)[:7])]
        assert sorted(got.get(q, [])) == want
    empty = dense.nearest(v.limit(0), spark.createDataFrame(qs, "query_id string, vector array<double>"))
    assert empty.count() == 0 and dense.nearest(v, spark.createDataFrame([], "query_id string, vector array<double>")).count() == 0


@pytest.mark.parametrize("tile", [1, 7, 64, 1024])
def test_tiles_find_what_the_whole_product_finds(monkeypatch, tile):
    """Ties across tiles go to the smaller id, and no more than a tile of scores is held at once."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from tessera.operators import nearest

    monkeypatch.setattr(nearest, "TILE", tile)
    r = np.random.default_rng(4)
    v, q = r.integers(-1, 2, (90, 3)).astype(float), r.integers(-1, 2, (20, 3)).astype(float)
    ids = pa.array(r.permutation(90))
    of = lambda x: pa.array(x.tolist(), pa.list_(pa.float64()))
    pairs = nearest._pairs(nearest._block_top(nearest._by_length(of(q)), pa.array(range(20)), of(v), ids, 5), pa.array(range(20)), ids)
    got = sorted(zip(*(pairs.column(k).to_pylist() for k in range(3)), strict=True))
    want = []
    for i, a in enumerate(q):
        near = [(-round(float(a @ b) / float(np.sqrt(a @ a) * np.sqrt(b @ b)), 9), n) for b, n in zip(v, ids.to_pylist(), strict=True) if a.any() and b.any()]
        want += [(i, n, pytest.approx(-s, abs=1e-9)) for s, n in sorted(near)[:5]]
    assert sorted((a, b) for a, b, _ in got) == sorted((a, b) for a, b, _ in want) and got == sorted(want, key=lambda x: x[:2])
    if tile == 64:
        big = nearest._by_length(of(r.normal(size=(1500, 4))))
        many, numbers = of(r.normal(size=(6000, 4))), pa.array(range(6000))
        tracemalloc.start()
        nearest._block_top(big, numbers.slice(0, 1500), many, numbers, 5)
        assert tracemalloc.get_traced_memory()[1] < 8 << 20  # all scores at once: 72 MB
        tracemalloc.stop()


def test_store(spark):
    path = f"{shared_dir(spark)}/test-store-{uuid4().hex}"
    s = dense.VectorStore(spark, path, 3)
    cols = "kind string, source_id string, text string, vector array<float>, metadata string, seq int"
    s.upsert(spark.createDataFrame([("text_unit", "u", "old", [1.0, 0.0, 0.0], "{}", 0), ("text_unit", "u", "new", [0.0, 1.0, 0.0], "{}", 1), ("entity", "e", "x", [0.0, 0.0, 1.0], "{}", 2)], cols))
    s.upsert(spark.createDataFrame([], cols))
    s = dense.VectorStore(spark, path, 3)
    assert (s.count(), s.count("text_unit")) == (2, 1)
    assert s.frame().where("kind = 'text_unit'").first()["text"] == "new"
    q = spark.createDataFrame([(0, [0.0, 1.0, 0.0])], "query_id int, vector array<float>")
    assert s.query(q, 1).first()["source_id"] == "u"
    s.delete(spark.createDataFrame([("text_unit", "u")], "kind string, source_id string"))
    assert (s.count(), s.count("text_unit")) == (1, 0)
    with pytest.raises(ValueError, match="3 components, not 2"):
        dense.VectorStore(spark, path, 2)
    with pytest.raises(ValueError, match="2 components"):
        s.query(spark.createDataFrame([(0, [0.0, 1.0])], "query_id int, vector array<float>"))


def test_embedding(spark):
    d = spark.createDataFrame([(1, "a b"), (2, " "), (3, None)], "id int, text string")
    rows = {r["id"]: r["vector"] for r in dense.embed(d, lambda: dense.HashingEmbedder(8)).collect()}
    assert sum(x * x for x in rows[1]) == pytest.approx(1) and rows[2] is None and rows[3] is None
    with pytest.raises(ImportError, match="sentence-transformers"):
        dense.SentenceEmbedder()


def test_vector_documents(spark, units):
    e = spark.createDataFrame([("Kafka", "TECH", "a bus", ["u"])], "name string, type string, description string, source_ids array<string>")
    rows = chunk.vector_documents(units.withColumn("order", F.lit(0)), e).collect()
    assert [r["text"] for r in rows if r["kind"] == "entity"] == ["Kafka\nType: TECH\na bus"] and len(rows) == 4


def test_metrics(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    e, r = arr("a", "b"), arr("x", "a", "b")
    assert one(evaluation.recall_at(e, r, 2)) == 0.5 and one(evaluation.recall_at(e, r, 3)) == 1.0
    assert one(evaluation.reciprocal_rank(e, r)) == 0.5 and one(evaluation.reciprocal_rank(arr("q"), r)) == 0.0
    assert one(evaluation.reciprocal_rank(arr(), r)) is None and one(evaluation.recall_at(arr(), r, 2)) is None
    assert one(evaluation.missing(arr("q", "a", "q"), r)) == ["q", "q"]
    assert one(evaluation.modes_for(F.lit("global_theme"), ["global", "naive"])) == ["global", "naive"]
    assert one(evaluation.modes_for(F.lit("single_lookup"), ["global", "naive"])) == ["naive"]
    assert one(evaluation.modes_for(F.lit("x"), ["global"], True)) == ["global"]


def test_cases_are_checked(spark):
    cols = "id string, category string, question string, expected_entities array<string>, expected_source_documents array<string>, expected_community_entities array<string>"
    ok = ("a", "c", "q", ["e"], [], [])
    evaluation.check_cases(spark.createDataFrame([ok], cols))
    for bad in ([ok, ok], [("b", "c", " ", ["e"], [], [])], [("b", "c", "q", [], [], [])]):
        with pytest.raises(ValueError):
            evaluation.check_cases(spark.createDataFrame(bad, cols))


def test_evaluation(spark):
    nodes = spark.createDataFrame([("Kafka",), ("Consumer",), ("Re",)], "name string")
    reports = spark.createDataFrame([("0", "Vectors", "s", ["Qdrant"], ["u2"]), ("1", "Streams", "s", ["Kafka"], ["u1"])], "id string, title string, summary string, entity_names array<string>, source_ids array<string>")
    units = spark.createDataFrame([("u1", "d1"), ("u2", "d2")], "id string, document_id string")
    t = spark.createDataFrame([("q", "c", "global", "[0] Vectors\n\n[1] Streams of Kafka by a consumer", ["0", "1"], 1.0, ["Kafka", "Streams", "Missing Entity"], ["d1"], ["Kafka"])], "query_id string, category string, mode string, context string, community_ids array<string>, latency_ms double, expected_entities array<string>, expected_source_documents array<string>, expected_community_entities array<string>")
    r = evaluation.evaluate(evaluation.documents_of_reports(t, reports, units), nodes, reports).first()
    assert r["entity_recall"] == pytest.approx(2 / 3) and r["missing_entities"] == ["Missing Entity"]
    assert r["source_recall_at_k"] == 1.0 and r["source_mrr"] is None and r["retrieved_source_documents"] == ["d2", "d1"]
    assert r["community_recall"] == 1.0 and r["community_mrr"] == 0.5 and r["noise_entities"] == 1
    s = evaluation.summarize(spark.createDataFrame([("m", 1.0, None, None, None, None, 3.0, 1), ("m", None, None, None, None, None, 5.0, 2)], "mode string, entity_recall double, source_recall_at_k double, source_mrr double, community_recall double, community_mrr double, latency_ms double, noise_entities int")).first()
    assert (s["queries"], s["entity_recall"], s["source_mrr"], s["median_latency_ms"], s["avg_noise_entities"]) == (2, 1.0, None, 4.0, 1.5)


def test_medians_of_large_groups(spark):
    rows = spark.range(300_001).select(F.when(F.col("id") < 300_000, "big").otherwise("one").alias("mode"), F.when(F.col("id") % 3 > 0, (F.col("id") * 7919 % 300_007).cast("double")).alias("x"))
    rows = rows.union(spark.createDataFrame([(None, 4.0), (None, 1.0), ("none", None)], "mode string, x double"))
    got = {r["mode"]: r["median"] for r in evaluation.medians(rows, "mode", "x").collect()}
    want = {r["mode"]: r["m"] for r in rows.where("x IS NOT NULL").groupBy("mode").agg(F.median("x").alias("m")).collect()}
    assert got == want and got[None] == 2.5 and "none" not in got


def test_documents_that_hold_a_passage(spark):
    """Short passages, and last words that go on, as SQL's contains has it; in several passes, the same."""
    texts = ["One two THREE four five six", "two three", "zwei-drei. two", "onetwo three", "three fourth", None, "", "two\nthree four fives", "x" * 50 + " two three"]
    asked = ["two three", "three four", "tw", "two three four five", "one two three four five six", "...", "two", "five six seven", "x"]
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "id string, text string")
    passages = spark.createDataFrame(list(enumerate(asked)), "query_id bigint, text string")
    norm = lambda t: " ".join(re.findall("[a-z0-9]+", (t or "").lower()))
    want = sorted((i, f"d{j}") for i, p in enumerate(asked) for j, t in enumerate(texts) if norm(p) and " " + norm(p) in " " + norm(t))
    assert sorted(map(tuple, evaluation.holding(docs, passages).collect())) == want
    assert sorted(map(tuple, evaluation.holding(docs, passages, at_once=3).collect())) == want
