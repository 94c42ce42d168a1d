import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from tessera import cli, runtime
from tessera.operators import community, evaluation, graph, inspection, local, louvain, models, summary
from tessera.operators.components import connected_components
from tessera.plans import catalog
from tessera.sources import artifacts, issues, schemas


def relations(spark, rows):
    return spark.createDataFrame([(s, t, r, d, 1.0, [i], n) for n, (s, t, r, d, i) in enumerate(rows)], schemas.RELATIONSHIPS)


def test_merge_and_rewrite(spark):
    e = spark.createDataFrame([("TG", "CONCEPT", "", ["s1"], 0), ("TrustGraph", "PROJECT", "p", ["s2"], 1), ("Graph-RAG", "METHOD", "m", ["s1"], 2), ("graph_rag", "CONCEPT", "x", ["s2"], 3), ("rrf", "CONCEPT", "", ["s1"], 4)], schemas.ENTITIES)
    m = {r["name"]: r for r in graph.merge_entities(e).collect()}
    assert set(m) == {"TrustGraph", "Graph RAG", "RRF"} and m["TrustGraph"]["source_ids"] == ["s1", "s2"]
    assert (m["TrustGraph"]["type"], m["TrustGraph"]["description"], m["Graph RAG"]["description"]) == ("PROJECT", "p", "m")
    r = relations(spark, [("TG", "graph_rag", "use", "", "s1"), ("Trust Graph", "TG", "x", "", "s1"), ("Graph-RAG", "rrf", "requires", "", "s1"), ("TG", "Graph RAG", "uses", "", "s9")])
    got = graph.normalize_relations(r, graph.name_map(e)).orderBy("seq").collect()
    assert [(x["source"], x["target"], x["relation"], x["source_ids"]) for x in got] == [("TrustGraph", "Graph RAG", "uses", ["s1"]), ("Graph RAG", "RRF", "depends_on", ["s1"])]


def test_edges(spark):
    r = relations(spark, [("a", "b", "x", "", "1"), ("b", "a", "y", "d", "2"), ("a", "b", "x", "", "1"), ("c", "d", "z", "", "3"), ("e", "f", "z", "t", "3"), ("e", "f", "z", "", "3"), ("g", "g", "z", "", "3")])
    e = {(x["u"], x["v"]): x for x in graph.graph_edges(r).collect()}
    assert e["a", "b"]["relations"] == ["x", "y"] and e["a", "b"]["weight"] == 3.0 and e["a", "b"]["source_ids"] == ["1", "2"]
    assert e["a", "b"]["descriptions"] == ["", "d"] and e["c", "d"]["descriptions"] == [] and e["e", "f"]["descriptions"] == ["", "t"]
    n = graph.graph_nodes(spark.createDataFrame([("a", "T", "t", ["1"], 0)], schemas.ENTITIES), r).collect()
    assert {x["name"]: x["type"] for x in n} == {"a": "T"} | dict.fromkeys("bcdefg", "CONCEPT")


def test_repeated_relations_are_one_row_before_names_are_rewritten(spark):
    """Each distinct relation is canonicalised once, and the first row of those that become equal stays whole."""
    rows = [(" TG ", "Kafka", "use", "", f"d{i}") for i in range(500)] + [("Trust Graph", "kafka", "Uses", None, "x")] + [("kafka", "KAFKA", "uses", "", "y"), (None, "Kafka", "uses", "", "z"), ("", "Kafka", "uses", "", "z")]
    r = relations(spark, rows).withColumn("seq", F.when(F.col("description").isNull(), F.lit(-1)).otherwise(F.col("seq")))
    names = spark.createDataFrame([("TG", "TrustGraph")], "observed string, canonical string")
    raw = graph.first_rows(r.withColumn("description", F.coalesce("description", F.lit(""))), "source", "target", "relation", "description")
    assert raw.count() == 5 and raw.columns == r.columns
    assert [tuple(x) for x in graph.normalize_relations(r, names).select("source", "target", "relation", "description", "source_ids", "seq").collect()] == [("TrustGraph", "Kafka", "uses", "", ["x"], -1)]
    plan = graph.normalize_relations(r, names)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_components_like_union_find(spark):
    rnd = random.Random(3)
    pairs = [(rnd.randrange(120), rnd.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    assert got == {x: find(x) for x in linked}
    assert connected_components(spark.createDataFrame([(1, 1)], "u bigint, v bigint")).count() == 0


def modularity(groups, edges):
    total = sum(w for *_, w in edges)
    of = {n: i for i, g in enumerate(groups) for n in g}
    deg = [sum(w * ((of[a] == i) + (of[b] == i)) for a, b, w in edges) for i in range(len(groups))]
    return sum(w for a, b, w in edges if of[a] == of[b]) / total - sum((d / (2 * total)) ** 2 for d in deg)


def test_greedy_modularity():
    rnd = random.Random(1)
    for _ in range(10):
        n = 12
        edges = [(a, b, float(rnd.randint(1, 3))) for a, b in itertools.combinations(range(n), 2) if rnd.random() < (0.7 if a // 4 == b // 4 else 0.08)]
        if not edges:
            continue
        groups = community.greedy_modularity(list(range(n)), edges, sum(w for *_, w in edges))
        assert sorted(x for g in groups for x in g) == list(range(n))
        assert modularity(groups, edges) >= modularity([[i] for i in range(n)], edges)
    two = [(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0), (3, 4, 1.0), (4, 5, 1.0), (3, 5, 1.0), (2, 3, 1.0)]
    assert sorted(map(sorted, community.greedy_modularity(list(range(6)), two, 7.0))) == [[0, 1, 2], [3, 4, 5]]


def small_graph(spark):
    r = relations(spark, [("a", "b", "x", "kafka link", "1"), ("b", "c", "x", "", "1"), ("a", "c", "x", "", "2"), ("d", "e", "y", "", "3")])
    e = spark.createDataFrame([(x, "T", f"about {x}", ["1"], i) for i, x in enumerate("abcdez")], schemas.ENTITIES)
    return graph.graph_nodes(e, r), graph.graph_edges(r)


def test_detect(spark):
    n, e = small_graph(spark)
    got = {r["name"]: r["community_id"] for r in community.detect(n, e).collect()}
    assert got == {"a": 0, "b": 0, "c": 0, "d": 1, "e": 1, "z": 2}


def of_labels(edges, label):
    total = sum(w for *_, w in edges)
    ends = {}
    for a, b, w in edges:
        for x in (a, b):
            ends[label[x]] = ends.get(label[x], 0) + w
    return sum(w for a, b, w in edges if label[a] == label[b]) / total - sum(x * x for x in ends.values()) / (4 * total * total)


def as_graph(spark, edges, alone=()):
    names = sorted({x for a, b, _ in edges for x in (a, b)} | set(alone))
    return spark.createDataFrame([(x, i) for i, x in enumerate(names)], "name string, seq bigint"), spark.createDataFrame(edges or [("", "", 0.0)], "u string, v string, weight double").where("u <> ''")


def test_distributed_communities_are_as_good_as_the_sequence_of_merges(spark):
    rng = random.Random(7)
    edges = [(f"{g}-{a:02}", f"{g}-{b:02}", 1.0) for g in range(6) for a in range(15) for b in range(a) if rng.random() < 0.4]
    edges += [(f"{rng.randrange(6)}-{rng.randrange(15):02}", f"{rng.randrange(6)}-{rng.randrange(15):02}", 1.0) for _ in range(60)]
    edges = [e for e in edges if e[0] != e[1]]
    n, e = as_graph(spark, edges)
    found = {m: {r["name"]: r["community_id"] for r in community.detect(n, e, m).collect()} for m in ("louvain", "greedy")}
    assert set(found["louvain"]) == {r["name"] for r in n.collect()}
    assert of_labels(edges, found["louvain"]) >= of_labels(edges, found["greedy"]) - 0.01
    assert len(set(found["louvain"].values())) == 6
    with pytest.raises(ValueError):
        community.detect(n, e, "other")


@pytest.mark.parametrize("strays", [1, 4])
def test_nodes_that_add_little_to_the_whole_move_at_last(spark, strays):
    """Pairs without number, and a star some of whose leaves start outside: each adds under a tenth of louvain.GROWTH."""
    pairs = spark.range(110_000).selectExpr("100 + 2 * id AS a", "101 + 2 * id AS b", "1.0D AS w")
    edges = pairs.union(spark.range(1, 21).selectExpr("0L", "id", "1.0D"))
    ends = edges.select(F.col("a").alias("node"), "w").union(edges.select("b", "w")).groupBy("node").agg(F.sum("w").alias("k"))
    label = F.when(F.col("node") < 100, F.when(F.col("node").between(1, strays), F.col("node")).otherwise(0)).otherwise(F.col("node") - F.col("node") % 2)
    labels, _ = louvain._moves(edges, ends.withColumn("label", label), 110_020.0, 0, last=True)
    assert labels.where("node < 100 AND label <> 0").count() == 0 and labels.where("node >= 100 AND label <> node - node % 2").count() == 0


def test_communities_of_a_hub_of_pairs_and_of_none(spark):
    star = [("hub", f"x{i}", 1.0) for i in range(40)] + [("p", "q", 2.0)]
    n, e = as_graph(spark, star, alone=["z"])
    got = {r["name"]: r["community_id"] for r in community.detect(n, e).collect()}
    assert {got[f"x{i}"] for i in range(40)} | {got["hub"]} == {0} and got["p"] == got["q"] == 1 and got["z"] == 2
    n, e = as_graph(spark, [], alone=["a", "b"])
    assert sorted(r["community_id"] for r in community.detect(n, e).collect()) == [0, 1]


def test_sides_of_more_rows_than_may_be_broadcast_are_merged_whatever_their_files_size(spark, monkeypatch, tmp_path):
    """zstd makes millions of numbers a file under Spark's threshold, which as a broadcast fill the driver's memory."""
    spark.range(30).selectExpr("id AS c_custkey", "format_string('c%02d', id) AS c_name", "id % 2 AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(2).selectExpr("id AS n_nationkey", "concat('n', id) AS n_name").write.parquet(f"{tmp_path}/nation.parquet")
    plans = {}

    def seen(df, label, rows=None):
        plans.setdefault(label, []).append(df._jdf.queryExecution().executedPlan().toString())
        return runtime.settle(df, label, rows)

    monkeypatch.setattr(runtime, "BROADCAST_ROWS", 10)
    for module in (louvain, community, catalog):
        monkeypatch.setattr(module, "settle", seen)
    out = catalog.community_planted(spark, str(tmp_path))
    assert {tuple(r) for r in out.collect()} == {(f"c{i:02}", f"c{i % 2:02}") for i in range(30)} | {("n0", "c00"), ("n1", "c01")}
    assert "SortMergeJoin" in plans["labels"][1] and "BroadcastHashJoin" not in plans["labels"][1]  # in the first round each node is a community
    assert plans["numbered-edges"][0].count("BroadcastHashJoin") == 1  # the two nations


def test_reports_and_inspection(spark):
    n, e = small_graph(spark)
    n = community.attach(n, community.detect(n, e, "greedy"))
    p = {r["community_id"]: r for r in community.payloads(n, e).collect()}
    assert [x["name"] for x in json.loads(p[0]["payload"])["entities"]] == ["a", "b", "c"] and p[0]["source_ids"] == ["1", "2"]
    assert json.loads(p[2]["payload"])["relationships"] == []
    r = models.reports(n, e, models.MockClient).orderBy("seq").collect()
    assert [(x["id"], x["title"], x["summary"], x["rating"]) for x in r] == [(str(i), f"Community {i}", "", 1.0) for i in range(3)]
    assert graph.stats(n, e).first().asDict() == {"nodes": 6, "edges": 4, "connected_components": 3}
    assert [tuple(x) for x in inspection.top_by_degree(n, e, 2).collect()] == [("a", 2), ("b", 2)]
    assert inspection.find_entity(n, "Z").first()["name"] == "z"
    assert inspection.relations_labelled(e, "Y").first()["u"] == "d"
    assert [r["size"] for r in inspection.communities(n).collect()] == [3, 2, 1]


def test_local_search(spark):
    n, e = small_graph(spark)
    reports = spark.createDataFrame([("0", "Kafka", "kafka sums", ["a", "b"], ["1"], 2.0, 0), ("1", "Other", "o", ["d"], [], 5.0, 1)], schemas.REPORTS)
    units = spark.createDataFrame([("1", "d1", "kafka text", "Kafka", 0), ("9", "d9", "none", "None", 1)], "id string, document_id string, text string, document_title string, seq bigint")
    q = spark.createDataFrame([("q", "kafka link"), ("none", "")], "query_id string, question string")
    g = local.build(n, e, reports, units)
    res = local.search(g, q)
    assert [(r["u"], r["v"]) for r in res.edges.collect()] == [("a", "b")]
    assert [r["id"] for r in res.sources.collect()] == ["1"]
    found = {r["id"]: r["score"] for r in res.reports.collect()}
    assert found == {"0": pytest.approx(6 / 7**0.5 + 0.8)}  # six of the seven expanded tokens, two selected nodes
    text = {r["query_id"]: r["text"] for r in local.context(g, q, res).collect()}
    assert "- a -- ['x'] -- b; score=" in text["q"] and "[1] Kafka | score=" in text["q"]
    assert text["none"].count("(none)") == 4
    assert [r["id"] for r in summary.top_reports(reports, 1).collect()] == ["1"]
    assert summary.map_reduce(q, reports, models.MockClient).count() == 2
    assert summary.context(reports.limit(0)).count() == 0


def test_extraction(spark):
    good = '{"entities": [{"name": " Graph  RAG "}, {"name": " "}], "relationships": [{"source": "a", "target": "b", "relation": "Depends on"}, {"source": "a", "target": " a", "relation": "x"}]}'
    cols = "unit_id string, seq bigint, answer string"
    e, r = models.parse_extractions(spark.createDataFrame([("u", 0, good)], cols))
    assert [(x["name"], x["type"], x["source_ids"]) for x in e.collect()] == [("Graph RAG", "CONCEPT", ["u"])]
    assert [(x["source"], x["target"], x["relation"], x["weight"]) for x in r.collect()] == [("a", "b", "depends_on", 1.0)]
    bad = spark.createDataFrame([("u", 0, "nothing"), ("v", 1, good)], cols)
    with pytest.raises(Exception, match="no JSON"):
        models.parse_extractions(bad)[0].collect()
    assert models.parse_extractions(bad, permissive=True)[0].count() == 1


def test_clients():
    with pytest.raises(ValueError):
        models.make_client("nobody")
    slept = []
    c = models.HttpClient("http://127.0.0.1:9", "m", tries=3, sleep=slept.append)
    with pytest.raises(RuntimeError):
        c.complete("x")
    assert slept == [1, 2] and models.backoff(9) == 30


def test_issues(spark):
    raw = [{"number": 1, "title": "", "body": None, "state": "open", "html_url": "u", "labels": [{"name": "bug"}]}, {"number": 2, "pull_request": None, "title": "pr"}]
    d = issues.issues_to_documents(issues.read_issues(spark, raw), "o/r").collect()
    assert len(d) == 1 and d[0]["id"] == "o/r#issue-1" and d[0]["text"] == "Issue #1: Issue #1\n\n" and d[0]["metadata"]["labels"] == ["bug"]
    assert issues.parse_repo(" o/r ") == ("o", "r")
    with pytest.raises(ValueError):
        issues.parse_repo("o")


def test_index_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([("d", "T", "some text on Kafka", "doc", None, None, 0)], schemas.SOURCE_DOCUMENTS)
    index = cli.build_index(docs, models.MockClient, str(tmp_path / "index"))
    assert index["text_units"].count() == 1 and index["nodes"].count() == 0
    mode, rows = cli.ask(index, "kafka text", "naive")
    assert mode == "naive"
    assert cli.ask(index, "kafka")[0] == "local" and "(none)" in cli.ask(index, "kafka")[1][0]["text"]
    assert cli.ask(index, "overview") == ("global", [])
    assert cli.prompt_context([{"id": "a", "score": 1.0, "text": "t"}]) == "### a | score=1.000\n\nt"


def test_sweep_over_all_modes(spark, tmp_path):
    n, e = small_graph(spark)
    n = community.attach(n, community.detect(n, e, "greedy"))
    units = spark.createDataFrame([("1", "d1", "kafka link text", 0, "Kafka", "doc", None, None, 0), *((str(i), f"d{i}", "none of it", 0, "None", "doc", None, None, i) for i in (7, 8, 9))], schemas.TEXT_UNITS)
    reports = spark.createDataFrame([("0", "Kafka", "kafka sums", ["a", "b"], ["1"], 2.0, 0)], schemas.REPORTS)
    entities = spark.createDataFrame([("a", "T", "about a", ["1"], 0)], schemas.ENTITIES)
    index = {"text_units": units, "entities": entities, "nodes": n, "edges": e, "community_reports": reports}
    s = artifacts.Settings()
    assert cli.build_vectors(index, s, str(tmp_path / "v")) == {"text_unit": 4, "entity": 1, "community_report": 1}
    (tmp_path / "cases.json").write_text(json.dumps([{"id": "q", "category": "global_theme", "question": "kafka link", "expected_entities": ["Kafka"], "expected_source_documents": ["d1"], "expected_community_entities": ["a"]}]))
    took: dict = {}
    run, cases = cli.retrievers(index, s, str(tmp_path / "v"), depth=5, rrf_k=10, timings=took), evaluation.load_cases(spark, str(tmp_path / "cases.json"))
    assert set(took) == {"bm25_index", "graph_index", "embedding_model_load", "vector_store_open"}
    calls = []
    once = evaluation.sweep(cases, {"naive": lambda q: calls.append(q.count()) or run["naive"](q)}, units, reports, n, ["naive"], repeats=3, one_by_one=True)
    assert calls == [1, 1, 1] and once.count() == 1 and once.first()["latency_ms"] > 0
    for bad in ({"repeats": 0}, {"top_k": 0}, {"modes": ["nothing"]}):
        with pytest.raises(ValueError):
            evaluation.sweep(cases, run, units, reports, n, **bad)
    rows = evaluation.sweep(cases, run, units, reports, n)
    got = {r["mode"]: r for r in rows.collect()}
    assert set(got) == {"naive", "local", "global", "vector", "hybrid"}
    assert all(r["entity_recall"] == 1.0 and r["source_recall_at_k"] == 1.0 for r in got.values())
    assert got["global"]["source_mrr"] is None and got["naive"]["source_mrr"] == 1.0 and got["naive"]["community_recall"] is None
    text = artifacts.metrics_markdown(rows.drop("missing_entities"), evaluation.summarize(rows), {"x": 1.0}, {"top_k": 8})
    assert "n/a" in text and "| hybrid |" in text
    artifacts.write_metrics_csv(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 5


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    docs = [{"id": f"d{i}", "title": f"T{i}", "text": t, "source_type": "doc"} for i, t in enumerate(["kafka consumer blocks", "graph latency", "dense vectors", "other words"])]
    raw, home = tmp_path / "raw", tmp_path / "out"
    raw.mkdir()
    (raw / "docs.json").write_text(json.dumps(docs))
    for k, v in {"RAW_DATA_DIR": raw, "PROCESSED_DATA_DIR": home, "VECTOR_DIR": home / "vectors", "LLM_PROVIDER": "mock", "EMBEDDING_PROVIDER": "mock"}.items():
        monkeypatch.setenv(k, str(v))
    cli.main(["build", "docs.json"])
    cli.main(["regenerate-reports"])
    cli.main(["build-vectors", "--batch-size", "2"])
    said = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert said["points"] == {"text_unit": 4} and {"model_load", "embed_text_unit", "embed_entity", "embed_community_report", "upsert"} == set(said["ms"])
    (tmp_path / "cases.json").write_text(json.dumps([{"id": "q", "category": "single_lookup", "question": "kafka consumer", "expected_source_documents": ["d0"]}]))
    cli.main(["evaluate", str(tmp_path / "cases.json"), "--out", str(tmp_path / "eval"), "--modes", "naive", "vector", "hybrid", "--repeats", "1", "--top-k", "2", "--rrf-k", "5", "--fusion-depth", "3"])
    text = (tmp_path / "eval" / "results.md").read_text()
    assert "rrf_k: 5" in text and "| hybrid |" in text and "vector_store_open" in text
    with pytest.raises(SystemExit):
        cli.main(["evaluate", "x", "--repeats", "0"])


def test_regenerated_reports_take_effect(spark, tmp_path):
    n, e = small_graph(spark)
    n = community.attach(n, community.detect(n, e, "greedy").where("name <> 'z'"))

    class Rater:
        def complete(self, prompt):
            return json.dumps({"title": "T", "summary": "s", "rating": float(prompt.count("about"))})

    index = {"nodes": n, "edges": e}
    cli.regenerate_reports(index, Rater, str(tmp_path))
    rows = spark.read.schema(schemas.REPORTS).parquet(f"{tmp_path}/community_reports").orderBy("seq").collect()
    assert [(r["id"], len(r["entity_names"])) for r in rows] == [("0", 3), ("1", 2), ("-1", 1)] and [r["seq"] for r in rows] == [0, 1, 2]


def test_settled_tables_are_cleared(spark):
    from tessera import runtime

    since = len(runtime.SETTLED)
    a, b = runtime.settle(spark.range(3), "a"), runtime.settle(spark.range(4), "b")
    runtime.clear(spark, since, last=False)
    assert len(runtime.SETTLED) == since + 1 and b.count() == 4
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FILE"):
        spark.read.parquet(a.inputFiles()[0]).count()
    runtime.clear(spark, since)
    assert len(runtime.SETTLED) == since


def test_numbered(spark):
    from tessera.runtime import numbered

    df = spark.createDataFrame([(i * 7 % 50, i) for i in range(50)] + [(None, 99)], "a int, b int").repartition(9)
    assert [r["a"] for r in numbered(df, "n", F.desc("a")).orderBy("n").collect()] == [*range(49, -1, -1), None]
    assert sorted(r["n"] for r in numbered(df, "n", "a").collect()) == list(range(51))
    assert numbered(df.limit(0), "n", "a").count() == 0


def test_demo_page(spark):
    from tessera import app

    reports = spark.createDataFrame([("0", "Kafka <b>", "sums", ["a"], ["1"], 2.0, 0)], schemas.REPORTS)
    index = {"community_reports": reports, "text_units": spark.createDataFrame([], schemas.TEXT_UNITS)}
    found = app.respond(index, models.MockClient, "an overview, please")
    assert found["mode"] == "global" and found["answer"] == "A mock answer." and "Kafka" in found["context"]
    assert set(app.respond(index, models.MockClient, "overview", answer=False, context=False)) == {"mode"}
    html = app.page({"question": "<q>", "mode": "naive"}, found)
    assert "&lt;q&gt;" in html and "<option selected>naive" in html and "Kafka &lt;b&gt;" in html and "<b>" not in html


def test_guards(spark):
    n, e = small_graph(spark)
    reports, q = spark.createDataFrame([], schemas.REPORTS), spark.createDataFrame([("q", "a")], "query_id string, question string")
    for run in (lambda: summary.top_reports(reports, 0), lambda: local.search(local.build(n, e, reports, spark.createDataFrame([], schemas.TEXT_UNITS)), q, 0)):
        with pytest.raises(ValueError, match="top_k"):
            run()


def test_graph_files(spark, tmp_path):
    n, e = small_graph(spark)
    n = n.withColumn("community_id", F.lit(0))
    artifacts.write_graph(n, e, str(tmp_path / "g.json"))
    n2, e2 = artifacts.read_graph(spark, str(tmp_path / "g.json"))
    assert {r["name"] for r in n2.collect()} == {r["name"] for r in n.collect()} and e2.count() == e.count()
    artifacts.write_json(n.select("name"), str(tmp_path / "x" / "n.json"))
    assert len(json.loads((tmp_path / "x" / "n.json").read_text())) == n.count()


def test_settings(tmp_path):
    f = tmp_path / ".env"
    f.write_text("LLM_PROVIDER=openai\nLLM_MODEL='m'\n# x=1\n")
    s = artifacts.load_settings(str(f), {"LLM_MODEL": "own"})
    assert (s.llm_provider, s.llm_model, s.raw_data_dir) == ("openai", "own", "data/raw")
    assert artifacts.input_path("a.json", s) == "data/raw/a.json" and artifacts.input_path("/a.json", s) == "/a.json"


def test_exports_are_whole_and_in_order(spark, tmp_path):
    path = tmp_path / "deep" / "rows.json"
    df = spark.range(30_000, numPartitions=7).select(F.col("id").alias("a"), F.concat(F.lit('line\n"é", '), "id").alias("b"), F.when(F.col("id") % 2 == 0, F.array("id")).alias("c"))
    artifacts.write_json(df, str(path))
    artifacts.write_json(df, str(path))  # in place of the first
    got = json.loads(path.read_text(encoding="utf-8"))
    assert got == [{"a": i, "b": f'line\n"é", {i}'} | ({"c": [i]} if i % 2 == 0 else {}) for i in range(30_000)]
    assert {x.name for x in path.parent.iterdir() if not x.name.endswith(".crc")} == {"rows.json"}
    artifacts.write_json(df.limit(0), str(path))
    assert json.loads(path.read_text()) == []
    n, e = small_graph(spark)
    n = n.withColumn("community_id", F.lit(1))
    artifacts.write_graph(n, e, str(tmp_path / "g.json"))
    back = artifacts.read_graph(spark, str(tmp_path / "g.json"))
    assert [r["name"] for r in back[0].orderBy("seq").collect()] == [r["name"] for r in n.orderBy("seq").collect()]
    assert sorted((r["u"], r["v"], r["weight"]) for r in back[1].collect()) == sorted((r["u"], r["v"], r["weight"]) for r in e.collect())
