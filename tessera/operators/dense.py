"""Vectors: what a store offers, exact search by cosine, and embedders."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.nearest import nearest
from tessera.operators.store import VectorStore
from tessera.runtime import ship

__all__ = ["Embedder", "HashingEmbedder", "SentenceEmbedder", "Store", "VectorStore", "embed", "make_embedder", "nearest", "results", "vector_search"]


class Store(Protocol):
    """What a vector store offers; frames stand for batches of records, queries and keys."""

    def upsert(self, records: DataFrame) -> None: ...

    def query(self, queries: DataFrame, limit: int = 8, kind: str | None = None) -> DataFrame: ...

    def delete(self, keys: DataFrame) -> None: ...

    def count(self, kind: str | None = None) -> int: ...

    def close(self) -> None: ...


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """Deterministic unit vectors from hashed words, for use without a model."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        import math
        import zlib

        out = []
        for t in texts:
            v = [0.0] * self.dim
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                v[h % self.dim] += 1.0 if h >> 31 else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out


class SentenceEmbedder:
    """A sentence-transformers model, if that package is installed; unit vectors."""

    def __init__(self, model: str = "all-MiniLM-L6-v2", batch_size: int = 32):
        if batch_size < 1:
            raise ValueError("batch_size must be at least 1")
        try:
            from sentence_transformers import SentenceTransformer
        except ImportError as e:
            raise ImportError("install sentence-transformers to embed with a model") from e
        self.model, self.batch_size = SentenceTransformer(model), batch_size
        self.dim = int(self.model.get_sentence_embedding_dimension() or 0)
        if self.dim < 1:
            raise ValueError("the model reports no dimension")

    def embed(self, texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        return [list(map(float, v)) for v in self.model.encode(texts, batch_size=self.batch_size, normalize_embeddings=True)]


def embed(docs: DataFrame, make, text: str = "text") -> DataFrame:
    """docs plus vector; make() builds the embedder once a worker batch stream. Blank texts have none."""
    ship(docs.sparkSession)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = make()
        for s in batches:
            yield pd.Series(e.embed([x or "" for x in s]))

    return docs.withColumn("vector", F.when(F.btrim(F.coalesce(F.col(text), F.lit(""))) != "", run(F.coalesce(F.col(text), F.lit("")))))


def vector_search(vectors: DataFrame, queries: DataFrame, make, top_k: int = 8) -> DataFrame:
    """(query_id, rank, id, score) of text units for (query_id, question); blank questions find nothing."""
    asked = embed(queries.where(F.btrim(F.coalesce("question", F.lit(""))) != ""), make, "question").select("query_id", "vector")
    return nearest(vectors, asked, top_k, "text_unit").withColumnRenamed("source_id", "id")


def results(hits: DataFrame, vectors: DataFrame) -> DataFrame:
    """Hits with text and metadata for a prompt."""
    v = vectors.where("kind = 'text_unit'").select(F.col("source_id").alias("id"), F.substring("text", 1, 1600).alias("t"), "metadata")
    text = F.concat(F.lit("["), F.col("id"), F.lit("] "), F.col("t"))
    meta = F.struct(F.get_json_object("metadata", "$.document_id").alias("document_id"), F.lit("vector").alias("retriever"))
    return hits.join(v, "id").select("query_id", "rank", "id", "score", text.alias("text"), meta.alias("metadata"))


def make_embedder(provider: str, model: str = "all-MiniLM-L6-v2", batch_size: int = 32) -> Embedder:
    if provider == "mock":
        return HashingEmbedder()
    if provider == "sentence-transformers":
        return SentenceEmbedder(model, batch_size)
    raise ValueError(f"no such embedding provider: {provider}")
