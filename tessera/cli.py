"""Command line: fetch issues, build an index, ask, inspect, evaluate, and write reports anew."""

from __future__ import annotations

import argparse
import json
import time
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.misc import route
from tessera.operators import chunk, community, dense, evaluation, fusion, graph, inspection, lexical, local, models, summary
from tessera.runtime import settle
from tessera.sources import artifacts, issues


class Retriever(Protocol):
    """Ranks a batch of questions (query_id, question): rows (query_id, rank, id, text)."""

    def __call__(self, queries: DataFrame) -> DataFrame: ...


def client_factory(s: artifacts.Settings):
    options = {} if s.llm_provider == "mock" else {"base_url": s.llm_base_url, "model": s.llm_model, "api_key": s.llm_api_key}
    models.make_client(s.llm_provider, **options)  # fails here, not on an executor
    return lambda: models.make_client(s.llm_provider, **options)


def build_index(documents, client, path: str) -> dict:
    """Documents to the tables of an index, written under path."""
    spark = documents.sparkSession
    units = chunk.text_units(documents)
    raw_e, raw_r = models.extract(units, client)
    entities = graph.merge_entities(raw_e)
    relations = graph.normalize_relations(raw_r, graph.name_map(raw_e))
    nodes, edges = graph.renormalize(graph.graph_nodes(entities, relations), graph.graph_edges(relations))
    nodes = community.attach(nodes, community.detect(nodes, edges))
    frames = {"text_units": units, "entities": entities, "relationships": relations, "nodes": nodes, "edges": edges, "community_reports": models.reports(nodes, edges, client), "stats": graph.stats(nodes, edges)}
    artifacts.write_index(frames, path)
    return artifacts.read_index(spark, path)


def ask(index: dict, question: str, mode: str = "auto", top_k: int = 8) -> tuple[str, list]:
    """(mode, rows of id, score, text) for one question."""
    spark = index["text_units"].sparkSession
    q = spark.createDataFrame([("q", question)], "query_id string, question string")
    mode = q.select(route(F.col("question"), mode)).first()[0]
    if mode == "global":
        return mode, summary.context(index["community_reports"], top_k).collect()
    if mode == "naive":
        hits = lexical.search(lexical.build_index(index["text_units"]), q, top_k)
        return mode, lexical.results(hits, index["text_units"]).orderBy("rank").collect()
    g = local.build(index["nodes"], index["edges"], index["community_reports"], index["text_units"])
    return mode, local.context(g, q, local.search(g, q, top_k)).collect()


def build_vectors(index: dict, settings: artifacts.Settings, path: str, batch_size: int = 32, timings: dict | None = None) -> dict[str, int]:
    """Embed the index's units, entities and reports into a vector store, in batches; points of each kind.

    timings, if given, gets the milliseconds of loading the model, of embedding each kind and of the upsert.
    """
    spark, provider, model = index["text_units"].sparkSession, settings.embedding_provider, settings.embedding_model
    make, took = (lambda: dense.make_embedder(provider, model, batch_size)), {} if timings is None else timings

    def clock(what: str, run):
        began = time.perf_counter()
        out = run()
        took[what] = (time.perf_counter() - began) * 1000
        return out

    dim = clock("model_load", lambda: make().dim)
    parts = {"text_unit": (index["text_units"], None, None), "entity": (None, index["entities"], None), "community_report": (None, None, index["community_reports"])}
    done = [clock(f"embed_{kind}", lambda f=frames: settle(dense.embed(chunk.vector_documents(*f), make).where("vector IS NOT NULL"), "embedded")) for kind, frames in parts.items()]
    with dense.VectorStore(spark, path, dim) as store:
        clock("upsert", lambda: store.upsert(done[0].unionByName(done[1]).unionByName(done[2])))
        return {r["kind"]: r["n"] for r in store.counts().collect()}  # a row for each kind


def retrievers(index: dict, settings: artifacts.Settings, vectors: str | None = None, top_k: int = 8, depth: int = fusion.FUSION_DEPTH, rrf_k: int = fusion.RRF_K, timings: dict | None = None) -> dict[str, Retriever]:
    """Batch retrievers by mode; the dense ones need a vector store with text units at `vectors`.

    timings, if given, gets the milliseconds of each step of the set-up.
    """
    u, reports, took = index["text_units"], index["community_reports"], {} if timings is None else timings

    def clock(what: str, run):
        began = time.perf_counter()
        out = run()
        took[what] = (time.perf_counter() - began) * 1000
        return out

    bm25 = clock("bm25_index", lambda: lexical.build_index(u))
    graph_ = clock("graph_index", lambda: local.build(index["nodes"], index["edges"], reports, u))
    glob = summary.context(reports, top_k).collect()

    def global_(q):
        found = glob[0] if glob else {"id": None, "text": None}
        out = q.select("query_id", F.lit(1).alias("rank"), F.lit(found["id"]).cast("string").alias("id"), F.lit(found["text"]).cast("string").alias("text"))
        return out if glob else out.limit(0)

    modes = {
        "naive": lambda q: lexical.results(lexical.search(bm25, q, top_k), u),
        "local": lambda q: local.context(graph_, q, local.search(graph_, q, top_k)).withColumn("rank", F.lit(1)),
        "global": global_,
    }
    if vectors is not None:
        provider, model = settings.embedding_provider, settings.embedding_model
        make = lambda: dense.make_embedder(provider, model)
        dim = clock("embedding_model_load", lambda: make().dim)
        frame = clock("vector_store_open", lambda: dense.VectorStore(u.sparkSession, vectors, dim).frame())
        if not frame.where("kind = 'text_unit'").take(1):
            raise ValueError("the vector store holds no text units")
        near = lambda q, n: dense.vector_search(frame, q, make, n)
        modes["vector"] = lambda q: dense.results(near(q, top_k), frame)
        modes["hybrid"] = lambda q: lexical.results(fusion.hybrid(lambda x, n: lexical.search(bm25, x, n), near, q, top_k, depth, rrf_k), u)
    return modes


def regenerate_reports(index: dict, client, home: str) -> DataFrame:
    """Write the communities' reports anew, best rated first, in the place of the old ones."""
    new = settle(models.reports(index["nodes"], index["edges"], client, regenerate=True), "reports")
    new.write.mode("overwrite").parquet(f"{home}/community_reports")
    return new


def prompt_context(rows: list) -> str:
    return "\n\n".join(f"### {r['id']} | score={r['score']:.3f}\n\n{r['text']}" for r in rows)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("fetch")
    c.add_argument("repo")
    c.add_argument("--state", choices=["open", "closed", "all"], default="open")
    c.add_argument("--limit", type=int, default=30)
    sub.add_parser("build").add_argument("input")
    c = sub.add_parser("query")
    c.add_argument("question")
    c.add_argument("--mode", default="auto")
    c.add_argument("--top-k", type=int, default=8)
    c.add_argument("--answer", action="store_true")
    c.add_argument("--show-context", action="store_true")
    sub.add_parser("inspect").add_argument("--entity")
    sub.add_parser("relations").add_argument("label")
    sub.add_parser("regenerate-reports")
    c = sub.add_parser("evaluate")
    c.add_argument("cases")
    c.add_argument("--out", default="eval", help="folder of results.md and of the table results_csv")
    c.add_argument("--modes", nargs="+", choices=evaluation.MODES, default=["naive", "local", "global"])
    c.add_argument("--all-modes", action="store_true", help="every mode on every case, whatever its category")
    c.add_argument("--top-k", type=int, default=8)
    c.add_argument("--repeats", type=int, default=3, help="runs whose median time counts")
    c.add_argument("--one-by-one", action="store_true", help="time each question alone instead of the batch")
    c.add_argument("--fusion-depth", type=int, default=fusion.FUSION_DEPTH)
    c.add_argument("--rrf-k", type=int, default=fusion.RRF_K)
    sub.add_parser("build-vectors").add_argument("--batch-size", type=int, default=32)
    c = sub.add_parser("demo")
    c.add_argument("--port", type=int, default=8501)
    a = p.parse_args(argv)
    for name in ("top_k", "repeats", "fusion_depth", "rrf_k", "batch_size"):
        if getattr(a, name, 1) < 1:
            p.error(f"--{name.replace('_', '-')} must be at least 1")
    spark, s = SparkSession.builder.appName("tessera").getOrCreate(), artifacts.load_settings()
    home = f"{s.processed_data_dir}/index"
    if a.command == "fetch":
        owner, name = issues.parse_repo(a.repo)
        docs = issues.issues_to_documents(issues.fetch_issues(spark, a.repo, s.github_token or None, a.state, a.limit), f"{owner}/{name}")
        artifacts.write_json(docs.orderBy("seq"), f"{s.raw_data_dir}/{owner}__{name}_issues.json")
    elif a.command == "build":
        from tessera.sources.schemas import SOURCE_DOCUMENTS

        build_index(artifacts.read_json(spark, artifacts.input_path(a.input, s), SOURCE_DOCUMENTS), client_factory(s), home)
    else:
        index = artifacts.read_index(spark, home)
        if a.command == "query":
            mode, rows = ask(index, a.question, a.mode, a.top_k)
            text = prompt_context(rows)
            if a.answer:
                print(client_factory(s)().complete(models.ANSWER_PROMPT.replace("{question}", a.question).replace("{context}", text)))
            if a.show_context or not a.answer:
                print(f"mode: {mode}\n\n{text}")
        elif a.command == "inspect":
            n, e = index["nodes"], index["edges"]
            if a.entity:
                inspection.find_entity(n, a.entity).show(truncate=False)
                for f in inspection.entity_detail(n, e, index["text_units"], a.entity)[1:]:
                    f.show(truncate=False)
            else:
                for f in (graph.stats(n, e), inspection.type_counts(n), inspection.relation_counts(e), inspection.top_by_degree(n, e), inspection.largest_components(n, e), inspection.communities(n), index["community_reports"].orderBy("seq").limit(10)):
                    f.show(truncate=False)
        elif a.command == "relations":
            inspection.relations_labelled(index["edges"], a.label).show(50, truncate=False)
        elif a.command == "build-vectors":
            took: dict = {}
            print(json.dumps({"points": build_vectors(index, s, s.vector_dir, a.batch_size, took), "ms": took}))
        elif a.command == "demo":
            from tessera import app

            app.serve(index, client_factory(s), a.port)
        elif a.command == "regenerate-reports":
            regenerate_reports(index, client_factory(s), home)
        else:
            cases = evaluation.load_cases(spark, a.cases)
            setup: dict = {}
            dense_ = {"vector", "hybrid"} & set(a.modes)
            run = retrievers(index, s, s.vector_dir if dense_ else None, a.top_k, a.fusion_depth, a.rrf_k, setup)
            rows = settle(evaluation.sweep(cases, run, index["text_units"], index["community_reports"], index["nodes"], a.modes, a.all_modes, a.top_k, a.repeats, a.one_by_one), "metrics")
            artifacts.write_metrics_csv(rows, f"{a.out}/results_csv")
            Path(a.out).mkdir(parents=True, exist_ok=True)
            Path(f"{a.out}/results.md").write_text(artifacts.metrics_markdown(rows, evaluation.summarize(rows), setup, {"cases": a.cases, "modes": ", ".join(a.modes), "top_k": a.top_k, "repeats": a.repeats, "fusion_depth": a.fusion_depth, "rrf_k": a.rrf_k}), encoding="utf-8")
            print(json.dumps(setup))


if __name__ == "__main__":
    main()
