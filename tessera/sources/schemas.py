"""Schemas of the model's tables. seq columns carry the input order, which breaks ties."""

from __future__ import annotations

META = "struct<repo: string, number: int, state: string, labels: array<string>, created_at: string, updated_at: string>"
SOURCE_DOCUMENTS = f"id string, title string, text string, source_type string, url string, metadata {META}, seq bigint"
TEXT_UNITS = "id string, document_id string, text string, `order` int, document_title string, source_type string, url string, metadata " + META + ", seq bigint"
ENTITIES = "name string, type string, description string, source_ids array<string>, seq bigint"
RELATIONSHIPS = "source string, target string, relation string, description string, weight double, source_ids array<string>, seq bigint"
NODES = "name string, type string, description string, source_ids array<string>, community_id int, seq bigint"
EDGES = "u string, v string, relations array<string>, descriptions array<string>, weight double, source_ids array<string>, seq bigint"
REPORTS = "id string, title string, summary string, entity_names array<string>, source_ids array<string>, rating double, seq bigint"
VECTORS = "point_id string, kind string, source_id string, text string, vector array<float>, metadata string"
EVAL_CASES = "id string, category string, question string, expected_entities array<string>, expected_source_documents array<string>, expected_community_entities array<string>"
#: What a model answers to an extraction prompt.
EXTRACTION = "entities array<struct<name: string, type: string, description: string>>, relationships array<struct<source: string, target: string, relation: string, description: string, weight: double>>"
