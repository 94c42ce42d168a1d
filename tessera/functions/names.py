"""Canonical names of entities and relations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import collapse

# Alias keys that a look-up can reach (lower case, spaces for underscores), and their canonical forms.
ENTITY_ALIASES = {
    "tg": "TrustGraph",
    "trust graph": "TrustGraph",
    "trustgraph": "TrustGraph",
    "graph-rag": "Graph RAG",
    "graph rag": "Graph RAG",
    "graph.rag": "Graph RAG",
    "graph rag processor": "Graph RAG",
    "graphrag": "Graph RAG",
    "document.rag": "Document RAG",
    "trustgraph 2.3.21": "TrustGraph",
    "trustgraph community": "TrustGraph",
    "document-rag": "Document RAG",
    "document rag": "Document RAG",
    "hybrid retrieval": "Hybrid Retrieval",
    "reciprocal rank fusion": "RRF",
    "rrf": "RRF",
    "bm25": "BM25",
    "tf-idf": "TF-IDF",
    "tfidf": "TF-IDF",
    "kafka": "Kafka",
    "pulsar": "Pulsar",
    "neo4j": "Neo4j",
    "memgraph": "Memgraph",
    "qdrant": "Qdrant",
    "cohere rerank": "Cohere Rerank API",
    "cohere rerank api": "Cohere Rerank API",
    "jina reranker": "Jina Reranker",
    "cross-encoder reranking": "Cross-encoder Reranking",
    "kafkabackendconsumer.unsubscribe()": "unsubscribe()",
}
# Relation labels that become another one; all others stay.
RELATION_ALIASES = {
    "use": "uses",
    "requires": "depends_on",
    "related_to": "mentions",
    "affect": "affects",
    "impacts": "affects",
    "improve": "improves",
    "propose": "proposes",
    "combine": "combines",
}
# Types whose names can be paths.
PATH_TYPES = ("FILE", "SCRIPT", "PROMPT_TEMPLATE")


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def issue_name(cleaned: Column) -> Column:
    """'Issue #n' for a number with or without 'issue' and '#' before it, else null."""
    n = F.regexp_extract(cleaned, r"(?iU)^(?:issue\s*)?#?(\d+)$", 1)
    return F.when(n != "", F.concat(F.lit("Issue #"), n))


def canonical_entity(name: Column, kind: Column | None = None) -> Column:
    cleaned = collapse(name)
    key = F.replace(F.lower(cleaned), F.lit("_"), F.lit(" "))
    tail = F.element_at(F.split(cleaned, "/"), -1)
    path = F.when(F.upper(F.coalesce(kind, F.lit(""))).isin(*PATH_TYPES) & F.contains(cleaned, F.lit("/")) & F.contains(tail, F.lit(".")), tail) if kind is not None else F.lit(None)
    return F.coalesce(issue_name(cleaned), _lookup(ENTITY_ALIASES, F.btrim(key)), _lookup(ENTITY_ALIASES, F.btrim(F.replace(key, F.lit("-"), F.lit(" ")))), path, cleaned)


def canonical_relation(label: Column) -> Column:
    key = F.replace(collapse(F.replace(F.lower(F.coalesce(label, F.lit(""))), F.lit("-"), F.lit("_"))), F.lit(" "), F.lit("_"))
    return F.coalesce(_lookup(RELATION_ALIASES, key), key)


def extracted_relation(label: Column) -> Column:
    """The label as an extraction has it: lower case, underscores for spaces, hyphens kept."""
    from tessera.functions.text import strip

    return F.replace(F.lower(strip(label)), F.lit(" "), F.lit("_"))
