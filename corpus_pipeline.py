"""From raw documents to token ids: five stages, each on all that the one before it kept.

Defined results: null and empty texts are kept (the near-dedup keeps one document without words). Rows of one or
no doc_id are told apart by their texts; of repeated rows that share both, the near-dedup keeps one. Extra columns
pass through, also those named like an operator's outputs; only the last stage replaces n_tokens, ids and
round_trip. An empty table passes all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontam, lines, simhash, toxicity
from tessera.runtime import SETTLED, clear, settle, table

#: The score from which a document is rejected as toxic.
TOXIC = 0.7


def _aside(docs: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """docs with the columns of these names under others, so that an operator's outputs do not replace them."""
    return docs.select(*(F.col(f"`{c}`").alias(f"__own_{c}" if c in names else c) for c in docs.columns))


def _back(out: DataFrame, docs: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return out.select(*(F.col(f"`__own_{c}`" if c in names else f"`{c}`").alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), usable=~toxicity.held_out(F.col("doc_id")))
    new = ("toxicity",)
    return _back(toxicity.score(_aside(docs, new), model).where(F.col("toxicity") < TOXIC), docs, new)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated long lines go; every document stays, and n_chars follows its text."""
    new = ("n_lines", "n_dropped", "keep_bitmap")
    out = lines.dedup_lines(_aside(docs, new))
    return _back(out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out, docs, new)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text again."""
    new, last = ("decoded",), ("n_tokens", "ids", "round_trip")
    docs = docs.drop(*last)
    out = bpe.encode_decode(_aside(docs, new))
    out = out.withColumn("round_trip", F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary"))
    own = [F.col(f"`__own_{c}`" if c in new else f"`{c}`").alias(c) for c in docs.columns if c != "text"]
    return out.select(*own, *last)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", decontaminate),
    ("byte_bpe", encode),
]

#: A trained model decides the first stage and XXH64 the third, so SQL cannot give the rows; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of what all stages keep. What a stage has settled is deleted when the stage is written."""
    docs, since = table(spark, sf_dir, "documents"), len(SETTLED)
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
        clear(spark, since, last=False)
    return docs
