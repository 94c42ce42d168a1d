import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera import runtime
from tessera.functions.runs import runs
from tessera.operators import chunk, lexical
from tessera.plans import catalog


def corpus(spark, n=900, seed=5):
    """Units of frequent and rare words, some of them holding whole passages."""
    rng = random.Random(seed)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(2000)]
    texts = [" ".join(rng.choices(common, k=rng.randint(1, 60)) + rng.choices(rare, k=rng.randint(0, 12))) for _ in range(n)]
    for i in range(0, n, 40):
        texts[i] += " passage " + " ".join(rare[i % 100 : i % 100 + 8])
    return spark.createDataFrame([(f"u{i}", f"d{i}", f"t{i}", x, i) for i, x in enumerate(texts)], "id string, document_id string, document_title string, text string, seq bigint"), texts


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, question string")


@pytest.mark.parametrize("top_k", [1, 8, 2000])
def test_choosing_blocks_gives_what_adding_up_gives(spark, monkeypatch, top_k):
    monkeypatch.setattr(lexical, "CELL", 16)
    units, texts = corpus(spark)
    index = lexical.build_index(units)
    asked = ask(spark, "r3 r4 c1 c2 c3", "c0", "r10 r11 r12 c5 passage", texts[40], texts[7] + " c1 c1", "nothing here", "", "t5")
    every = [tuple(r) for r in lexical.search(index, asked, top_k).orderBy("query_id", "rank").collect()]
    chosen = [tuple(r) for r in lexical.search(index, asked, top_k, direct=0).orderBy("query_id", "rank").collect()]
    assert every == chosen and len(every) >= 4 * min(top_k, 8)


def test_few_postings_are_read(spark, monkeypatch):
    monkeypatch.setattr(lexical, "CELL", 16)
    units, texts = corpus(spark)
    index = lexical.build_index(units)
    read = {r["query_id"]: r for r in lexical.postings_read(index, ask(spark, "passage r0 r1 r2 r3 c1 c2 c3 c4", "c0 c1")).collect()}
    assert read[0]["postings_read"] < 0.2 * read[0]["postings"] and read[0]["blocks_read"] < read[0]["blocks"]
    assert read[1]["postings_read"] <= read[1]["postings"]


def test_blocks_cover_the_postings_and_bound_them(spark):
    units, texts = corpus(spark, 300)
    index = lexical.build_index(units)
    rows = index.blocks.collect()
    assert all(r["n"] == len(r["postings"]) and r["most"] == max(p["gain"] for p in r["postings"]) for r in rows)
    assert len({(r["term"], r["cell"]) for r in rows}) == len(rows) and max(r["n"] for r in rows) <= 300
    df = {r["term"]: sum(1 for x in texts if r["term"] in x.split()) for r in index.idf.collect() if r["term"][0] in "cr"}
    held = {}
    for r in rows:
        held[r["term"]] = held.get(r["term"], 0) + r["n"]
    assert all(held[t] == n for t, n in df.items())


def test_idf_alone_is_that_of_the_index(spark):
    units, _ = corpus(spark, 120)
    index = {r["term"]: r["idf"] for r in lexical.build_index(units).idf.collect()}
    assert {r["term"]: r["idf"] for r in lexical.term_idf(units).collect()} == pytest.approx(index, abs=1e-9)
    assert "" not in index and lexical.term_idf(units.limit(0)).count() == 0


def test_no_row_a_token_is_shuffled(spark, monkeypatch):
    """What is dealt to the cells is one row a unit, and each cell is one group."""
    seen = []
    monkeypatch.setattr(lexical, "settle", lambda df, label, rows=None: (seen.append((label, df._jdf.queryExecution().executedPlan().toString())), runtime.settle(df, label))[1])
    units, _ = corpus(spark, 60)
    lexical.build_index(units)
    plan = next(p for label, p in seen if label == "blocks")
    assert plan.count("Exchange") == 1 and "Generate" not in plan and "HashAggregate" not in plan


def test_terms_of_few_questions_are_told_to_the_scan(spark):
    index = lexical.build_index(corpus(spark, 60)[0])
    _, metadata = lexical._asked(index, ask(spark, "r3 c1"))
    assert {r["term"] for r in metadata.collect()} <= {"r3", "c1"}
    plan = index.blocks.where(F.col("term").isin(["r3"]))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "term" in plan.split("PushedFilters: [")[1].split("]")[0]


def test_empty_index_and_negative_weights(spark):
    none = spark.createDataFrame([], "id string, document_id string, document_title string, text string, seq bigint")
    assert lexical.search(lexical.build_index(none), ask(spark, "a b"), direct=0).collect() == []
    same = spark.createDataFrame([(f"u{i}", "d", "", "word other", i) for i in range(5)], none.schema)
    index = lexical.build_index(same)  # every term is in all units, so no weight is over zero
    assert lexical.search(index, ask(spark, "word")).collect() == lexical.search(index, ask(spark, "word"), direct=0).collect() == []


def test_the_index_is_one_pass_that_writes_blocks_alone(spark, monkeypatch):
    """Neither tokens nor units are written beside the blocks, and the units are known from the cells' own rows."""
    seen = []
    monkeypatch.setattr(lexical, "settle", lambda df, label, rows=None: (seen.append(label), runtime.settle(df, label))[1])
    monkeypatch.setattr(lexical, "CELL", 16)
    units, texts = corpus(spark, 60)
    index = lexical.build_index(units)
    assert seen == ["blocks", "idf"] and index.count == 60
    own = {r["id"]: (r["seq"], r["dl"], r["no"]) for r in index.units.collect()}
    assert {i: x[:2] for i, x in own.items()} == {f"u{i}": (i, 2 * (len(x.split()) + 1)) for i, x in enumerate(texts)} and len({x[2] for x in own.values()}) == 60


def test_a_cells_tokens_are_those_of_the_questions(spark):
    texts = ["The graph-rag_v1.2. of a.the.b -x", "İstanbul \u212aelvin ÑANDÚ a1-", "", "... - _", "the of", "x" * 5000 + " x_ _x x..y"]
    units = spark.createDataFrame([(f"u{i}", "d", None, x, i) for i, x in enumerate(texts)], "id string, document_id string, document_title string, text string, seq bigint")
    index = lexical.build_index(units)
    no = {r["no"]: r["id"] for r in index.units.collect()}
    rows = index.rows.where("term <> ''").collect()
    held = sorted((no[r["cell"] * index.cell + a], r["term"], n) for r in rows for a, n in zip(r["at"], r["tf"], strict=True))
    want = lexical._tokens(units).select("id", F.explode("t").alias("term")).groupBy("id", "term").count()
    assert held == sorted(map(tuple, want.collect())) and len(no) == 3


def test_postings_are_added_up_by_cell(spark):
    """No row a posting is made or shuffled."""
    index = lexical.build_index(corpus(spark, 60)[0])
    chosen = lexical._weights(index, ask(spark, "r3 c1", "c2")).select("query_id", "term", "weight")
    plan = lexical._sums(index, chosen, 8)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "Generate" not in plan


def test_many_questions_are_added_up_a_few_at_a_time(spark, monkeypatch):
    units, texts = corpus(spark, 120)
    index = lexical.build_index(units)
    group = lexical._only(index, asked := lexical._weights(index, ask(spark, *texts[:20]))).rows.where("term <> '' AND cell = 0").select("term", "cell", "at", "tf", "dl")
    who = asked.groupBy("term").agg(F.collect_list(F.struct("query_id", "weight", F.lit(0.0).alias("floor"))).alias("who"))
    group = group.join(who, "term").drop("term").toArrow()
    once = lexical.cell_sums(group, index.cell, index.mean_length, 8)
    monkeypatch.setattr(lexical, "ADDED", 2000)
    assert lexical.cell_sums(group, index.cell, index.mean_length, 8).equals(once) and once.num_rows >= 8


def test_a_search_of_a_large_table_takes_one_pass(spark, monkeypatch):
    """Three billion postings, as 200 questions meet over 6 GB, are still added up without metadata or bounds."""
    seen, weights = [], lexical._weights
    monkeypatch.setattr(lexical, "_weights", lambda index, queries: weights(index, queries).withColumn("df", F.lit(1_500_000_000)))
    index = lexical.build_index(corpus(spark, 60)[0])
    monkeypatch.setattr(lexical, "settle", lambda df, label, rows=None: (seen.append(label), runtime.settle(df, label))[1])
    assert lexical.search(index, ask(spark, "r3 c1")).count() > 0 and seen == ["asked", "chosen", "near"]


def test_a_cells_first_rows_hold_the_depth_of_fusion(spark):
    """Fusion asks for more rows than a result has: a cell passes on as many, with ties."""
    index = lexical.build_index(corpus(spark, 200)[0])
    chosen = lexical._weights(index, ask(spark, "c1 c2 r3")).select("query_id", "term", "weight")
    every = sorted((r["part"] for r in lexical._sums(index, chosen).collect() if r["part"] > 0), reverse=True)
    kept = sorted((r["part"] for r in lexical._sums(index, chosen, 20).collect()), reverse=True)
    assert kept[:20] == every[:20] and all(p > 0 for p in kept)


def test_equal_scores_of_different_cells_go_by_seq(spark, monkeypatch):
    """What a cell passes on holds its ties; the reciprocal ranks of an evaluation hang on their order."""
    monkeypatch.setattr(lexical, "CELL", 4)
    rows = [(f"u{i}", "d", "", "alike passage" if i % 2 else f"other{i} thing", 100 - i) for i in range(20)]
    index = lexical.build_index(spark.createDataFrame(rows, "id string, document_id string, document_title string, text string, seq bigint").union(corpus(spark, 60)[0].where("text NOT LIKE '%passage%'")))
    assert index.cell == 4 and index.rows.select("cell").distinct().count() > 5
    for direct in (lexical.DIRECT, 0):
        assert [r["id"] for r in lexical.search(index, ask(spark, "alike"), 3, direct=direct).orderBy("rank").collect()] == ["u19", "u17", "u15"]


@pytest.mark.parametrize("top_k", [1, 8, 2000])
def test_a_search_without_an_index_gives_what_the_index_gives(spark, monkeypatch, top_k):
    monkeypatch.setattr(lexical, "COUNTED", 64)
    units, texts = corpus(spark)
    asked = ask(spark, "r3 r4 c1 c2 c3", "c0", "r10 r11 r12 c5 passage", texts[40], texts[7] + " c1 c1", "nothing here", "", "t5")
    want = [tuple(r) for r in lexical.search(lexical.build_index(units), asked, top_k).orderBy("query_id", "rank").collect()]
    for limits in ({}, {"known": 3}, {"direct": 3}):
        got = lexical.naive_search(units, asked, top_k, **limits).orderBy("query_id", "rank").collect()
        assert [(r["query_id"], r["rank"], r["id"], r["score"]) for r in got] == want and all(r["document_id"] == "d" + r["id"][1:] for r in got)
    assert lexical.naive_search(units.limit(0), asked).count() == lexical.naive_search(units, asked.limit(0)).count() == 0


def test_a_search_without_an_index_shuffles_and_keeps_no_texts(spark, monkeypatch):
    """The texts are passed once, and only the counts of the terms and the questions' postings are written."""
    seen = {}
    monkeypatch.setattr(lexical, "settle", lambda df, label, rows=None: (seen.update({label: df._jdf.queryExecution().executedPlan().toString()}), runtime.settle(df, label))[1])
    assert lexical.naive_search(corpus(spark, 60)[0], ask(spark, "r3 c1")).count() == 8
    assert list(seen) == ["asked", "counts", "near"] and "MapInArrow" in seen["counts"] and "Exchange" not in seen["counts"]


def test_documents_are_cut_once(spark):
    """A filter on the number of pieces would have each document cut twice."""
    docs = spark.createDataFrame([("d0", "t", "a b c " * 9, 0), ("d1", "t", None, 1), ("d2", "t", " \u3000\n", 2)], "id string, title string, text string, seq bigint")
    units = chunk.text_units(docs, 20, 5)
    assert not re.search(r"Filter .*size\(", units._jdf.queryExecution().optimizedPlan().toString()) and units.select("document_id").distinct().count() == 1


def test_runs_are_those_of_the_pattern():
    rng = random.Random(3)
    for _ in range(200):
        texts = ["".join(rng.choices("ab1 -_.\né漢", k=rng.randint(0, 9))) for _ in range(rng.randint(0, 6))]
        whole = pa.array(["zz", *texts, None])
        found, text = runs(whole[1:], lexical.HELD)
        assert list(zip(text.tolist(), found.to_pylist(), strict=True)) == [(i, x) for i, t in enumerate(texts) for x in re.findall(r"[a-z0-9_\-.]+", t)]


def test_fusion_takes_the_documents_from_the_search(spark, monkeypatch, tmp_path):
    """Neither the units nor an index of theirs are written for the lexical half."""
    seen = []
    for module in (lexical, catalog):
        monkeypatch.setattr(module, "settle", lambda df, label, rows=None: (seen.append(label), runtime.settle(df, label))[1])
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    put("documents", [(i, t, "en", "web", len(t)) for i, t in enumerate(["red fox", "blue whale song", "red blue bird"] + ["filler"] * 6)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    put("embeddings", [(i, [1.0, float(i)], i) for i in range(3)], "vec_id bigint, embedding array<float>, label int")
    put("benchmark", [(1, "whale song")], "item_id bigint, text string")
    rows = catalog.hybrid_search(spark, str(tmp_path)).orderBy("rank").collect()
    assert [(r["rank"], r["id"]) for r in rows][0] == (1, "doc-1") and len(rows) == 3
    assert "counts" in seen and not {"units", "blocks"} & set(seen)


def test_recall_of_short_passages(spark, tmp_path):
    """Passages of few words, and one whose last word goes on in the document, are expected as in SQL."""
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    texts = ["red fox", "A blue-whale song", "one two three four five sixty", "blue whale"] + ["filler"] * 9
    put("documents", [(i, t, "en", "web", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    put("benchmark", [(0, "Red fox"), (1, "blue whale"), (2, "one two three four five six"), (3, "nowhere to be found")], "item_id bigint, text string")
    rows = {r["query_id"]: (r["recall"], r["mrr"]) for r in catalog.recall_mrr(spark, str(tmp_path)).collect()}
    assert rows == {0: (1.0, 1.0), 1: (1.0, 1.0), 2: (1.0, 1.0)}
    assert {tuple(r) for r in catalog.missing_sources(spark, str(tmp_path)).collect()} == set()
