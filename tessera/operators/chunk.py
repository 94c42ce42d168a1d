"""Overlapping character chunks of documents, and texts for ranking and embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import strip, strip_ends


def chunk_array(text, max_chars: int = 2500, overlap: int = 250):
    """Array of stripped, non-empty windows of max_chars that start every max_chars - overlap."""
    if max_chars <= overlap:
        raise ValueError("max_chars must be larger than overlap")
    step = max_chars - overlap

    def cut(t):
        last = F.greatest(F.lit(1), F.ceil((F.char_length(t) - overlap) / step).cast("int")) - 1
        return F.transform(F.transform(F.sequence(F.lit(0), last), lambda i: t.substr(i * step + 1, F.lit(max_chars))), strip_ends)

    # an array of one element binds the stripped text, so that it is worked out once a document, not once a chunk
    return F.filter(F.flatten(F.transform(F.transform(F.array(text), strip_ends), cut)), lambda p: p != "")


def text_units(documents: DataFrame, max_chars: int = 2500, overlap: int = 250) -> DataFrame:
    """One row a chunk: order counts the kept chunks of a document; seq follows the documents' seq.

    A text of 2 GB, the largest that a string holds, has fewer than the million chunks that seq leaves room for.
    """
    own = documents.columns
    rest = [c for c in ("source_type", "url", "metadata") if c in own]
    # not by a column of its own: Spark would ask for its size before, and cut each document twice
    parts = F.posexplode(chunk_array(F.col("text"), max_chars, overlap)).alias("order", "text")
    u = documents.select(F.col("id").alias("document_id"), F.col("title").alias("document_title"), *rest, F.col("seq").alias("__doc"), parts)
    name = F.md5(F.concat_ws("::", F.col("document_id"), F.col("order").cast("string"), F.substring("text", 1, 80)))
    return u.select(name.alias("id"), "document_id", "text", "order", "document_title", *rest, (F.col("__doc") * 1_000_000 + F.col("order")).alias("seq"))


def vector_documents(units: DataFrame | None = None, entities: DataFrame | None = None, reports: DataFrame | None = None) -> DataFrame:
    """(kind, source_id, text, metadata as JSON) of the given frames, one after the other."""
    parts = []
    lines = lambda *c: strip(F.concat_ws("\n", *c))
    if units is not None:
        parts.append(units.select(F.lit("text_unit").alias("kind"), F.col("id").alias("source_id"), lines("document_title", "text").alias("text"), F.to_json(F.struct("document_id", "document_title", "order")).alias("metadata")))
    if entities is not None:
        parts.append(entities.select(F.lit("entity").alias("kind"), F.col("name").alias("source_id"), lines("name", F.concat(F.lit("Type: "), F.col("type")), "description").alias("text"), F.to_json(F.struct("type", "source_ids")).alias("metadata")))
    if reports is not None:
        named = F.concat(F.lit("Entities: "), F.array_join("entity_names", ", "))
        parts.append(reports.select(F.lit("community_report").alias("kind"), F.col("id").alias("source_id"), lines("title", named, "summary").alias("text"), F.to_json(F.struct("title", "entity_names", "source_ids", "rating")).alias("metadata")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
