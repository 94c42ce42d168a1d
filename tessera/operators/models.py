"""Language-model clients, prompts, extraction and community reports."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.misc import json_object
from tessera.functions.names import extracted_relation
from tessera.functions.text import collapse
from tessera.operators.community import complete, payloads
from tessera.runtime import numbered
from tessera.sources.schemas import EXTRACTION

EXTRACT_PROMPT = """Build a small knowledge graph from a passage of a software project: an issue, a change or a document.

What counts as an entity:
* algorithms, modules, files, APIs, tools, services, features, defects, and issue or change numbers;
* not everyday words, unless the project gives them a meaning of their own;
* one name for one thing: where the passage uses an abbreviation and the full form, take the better known one.

What counts as a relationship:
* a short verb as its label, in snake case: uses, depends_on, affects, improves, fixes, proposes, combines, conflicts_with, mentions;
* only what the passage states; let the description say where it does.

Answer in strict JSON and nothing else:
{"entities": [{"name": "Kafka", "type": "TOOL", "description": "message broker behind the consumer"}],
 "relationships": [{"source": "Consumer", "target": "Kafka", "relation": "depends_on", "description": "reads its topics", "weight": 1.0}]}

Passage:
{text}
"""
REPORT_PROMPT = """Write a community report on one group of a project's knowledge graph.
Readers use it to search the whole project, to sort its issues, and to find work that they could take on.
Take facts from the community data alone; add no issue number, file or feature.

Cover, in Markdown bullets:
* theme: what holds the group together;
* key entities: the files, modules, APIs, tools and issues that matter most;
* opportunities: what could be built, fixed or looked into, as concretely as the data allow;
* evidence: what the data support, and what stays open.

How to rate, from 1 to 5:
* 5: work that someone could start at once;
* 4: a useful theme that several entities share;
* 3: relevant, with thin evidence;
* 2: narrow, or loosely connected;
* 1: a single entity, or of little use.

Answer in strict JSON and nothing else:
{"title": "a short and specific title", "summary": "the bullets", "rating": 3.0}

Community data:
{community_data}
"""
MAP_PROMPT = """From the reports below, list the points that help to answer the question.
Answer in strict JSON and nothing else:
{"points": [{"description": "what a report says", "score": 75}]}
Score a point from 0 to 100 by how much it helps; 0 means not at all.

Question:
{question}

Reports:
{reports}
"""
REDUCE_PROMPT = """Answer the question from the ranked points below.
Join points that say the same, claim nothing beyond them, say where they are weak or silent, and keep to short bullets.

Question:
{question}

Points:
{points}
"""
ANSWER_PROMPT = """Answer a question about a software project from the context alone.

* Where the parts of the context disagree, trust the sources first: the direction of a relationship may be wrong, its description less so.
* Reports give the background, entities the concepts, relationships the links, sources the wording.
* Name the issues that you rely on; a bare community number is no source.
* If something is missing, say what. Be brief and technical.

Question:
{question}

Context:
{context}
"""


class Client(Protocol):
    def complete(self, prompt: str) -> str: ...


class MockClient:
    """Fixed answers by what a prompt asks for, tested in this order."""

    def complete(self, prompt: str) -> str:
        asked = prompt.lower()
        if all(x in asked for x in ("strict json", "entities", "relationships")):
            return json.dumps({"entities": [], "relationships": []})
        if "community report" in asked or "community data" in asked:
            return json.dumps({"title": "Untitled community", "summary": "A mock summary.", "rating": 1.0})
        if "points" in asked and "score" in asked:
            return json.dumps({"points": []})
        return "A mock answer."


def backoff(attempt: int) -> int:
    return min(2**attempt, 30)


class HttpClient:
    """A chat completion endpoint of the common form; network errors are tried again."""

    def __init__(self, base_url: str, model: str, api_key: str = "", tries: int = 5, sleep=time.sleep):
        self.url, self.model, self.key, self.tries, self.sleep = base_url.rstrip("/") + "/chat/completions", model, api_key, tries, sleep

    def complete(self, prompt: str) -> str:
        body = json.dumps({"model": self.model, "temperature": 0, "messages": [{"role": "user", "content": prompt}]}).encode()
        head = {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"}
        last: Exception | None = None
        for attempt in range(self.tries):
            try:
                with urllib.request.urlopen(urllib.request.Request(self.url, body, head), timeout=120) as answer:
                    return json.load(answer)["choices"][0]["message"]["content"]
            except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
                last = e
                if attempt < self.tries - 1:
                    self.sleep(backoff(attempt))
        raise RuntimeError(f"no answer after {self.tries} tries") from last


def make_client(provider: str, **options) -> Client:
    if provider == "mock":
        return MockClient()
    if provider in ("openai", "openai_compatible", "http"):
        return HttpClient(**options)
    raise ValueError(f"no such provider: {provider}")


def parse_extractions(answers: DataFrame, permissive: bool = False) -> tuple[DataFrame, DataFrame]:
    """(entities, relationships) from rows (unit_id, seq, answer).

    An answer without JSON, or an entity or relationship without its names, fails the
    query, or is left out if permissive. Names are collapsed; empty ones and self-loops go.
    """
    found = answers.withColumn("j", json_object(F.col("answer")))
    if permissive:
        found = found.where("j IS NOT NULL")
    else:
        found = found.withColumn("j", F.coalesce("j", F.raise_error(F.concat(F.lit("no JSON in the answer for "), F.col("unit_id")))))
    x = found.withColumn("x", F.from_json("j", EXTRACTION))
    ids = F.array("unit_id").alias("source_ids")
    e = x.select("unit_id", "seq", F.posexplode("x.entities").alias("i", "e"))
    r = x.select("unit_id", "seq", F.posexplode("x.relationships").alias("i", "r"))
    if permissive:
        e, r = e.where("e.name IS NOT NULL"), r.where("r.source IS NOT NULL AND r.target IS NOT NULL AND r.relation IS NOT NULL")
    else:
        need = lambda c, what: F.coalesce(c, F.raise_error(F.lit(f"an extraction lacks {what}")))
        e = e.withColumn("e", F.col("e").withField("name", need(F.col("e.name"), "a name")))
        for k in ("source", "target", "relation"):
            r = r.withColumn("r", F.col("r").withField(k, need(F.col(f"r.{k}"), k)))
    few = F.when(F.col("i") < 10_000, F.col("i")).otherwise(F.raise_error(F.lit("an answer names 10,000 things or more")))
    at = (F.col("seq") * 10_000 + few).alias("seq")
    entities = e.select(collapse(F.col("e.name")).alias("name"), F.coalesce("e.type", F.lit("CONCEPT")).alias("type"), F.coalesce("e.description", F.lit("")).alias("description"), ids, at).where("name <> ''")
    relations = r.select(collapse(F.col("r.source")).alias("source"), collapse(F.col("r.target")).alias("target"), extracted_relation(F.col("r.relation")).alias("relation"), F.coalesce("r.description", F.lit("")).alias("description"), F.coalesce("r.weight", F.lit(1.0)).alias("weight"), ids, at)
    return entities, relations.where("source <> '' AND target <> '' AND source <> target")


def extract(units: DataFrame, client) -> tuple[DataFrame, DataFrame]:
    """Ask for the entities and relationships of every text unit."""
    asked = units.select(F.col("id").alias("unit_id"), "seq", F.replace(F.lit(EXTRACT_PROMPT), F.lit("{text}"), F.col("text")).alias("prompt"))
    return parse_extractions(complete(asked, "prompt", client).select("unit_id", "seq", "answer"))


def reports(nodes: DataFrame, edges: DataFrame, client, regenerate: bool = False) -> DataFrame:
    """A report on each community. An answer that is not JSON is the summary itself, rated 1.

    seq: by community id, or, when regenerated, by rating and number of entities, largest first; then
    nodes without a community make one of their own, -1.
    """
    p = payloads(nodes.withColumn("community_id", F.coalesce("community_id", F.lit(-1))) if regenerate else nodes, edges)
    asked = p.withColumn("prompt", F.replace(F.lit(REPORT_PROMPT), F.lit("{community_data}"), F.col("payload")))
    a = complete(asked, "prompt", client).withColumn("j", json_object(F.col("answer"))).withColumn("x", F.from_json("j", "title string, summary string, rating double"))
    title = F.coalesce(F.nullif("x.title", F.lit("")), F.concat(F.lit("Community "), F.col("community_id").cast("string")))
    summary = F.when(F.col("j").isNull(), F.btrim("answer")).otherwise(F.coalesce("x.summary", F.lit("")))
    out = a.select(F.col("community_id").cast("string").alias("id"), title.alias("title"), summary.alias("summary"), "entity_names", "source_ids", F.coalesce("x.rating", F.lit(1.0)).alias("rating"), F.col("community_id").cast("bigint").alias("seq"))
    if regenerate:
        out = out.withColumn("__size", F.size("entity_names")).withColumnRenamed("seq", "__seq")
        out = numbered(out, "seq", F.desc("rating"), F.desc("__size"), "__seq").drop("__size", "__seq")
    return out
