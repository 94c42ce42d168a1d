"""Global search over community reports, and its map and reduce by a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.misc import json_object
from tessera.operators.community import complete
from tessera.operators.models import MAP_PROMPT, REDUCE_PROMPT


def top_reports(reports: DataFrame, top_k: int = 8) -> DataFrame:
    """The best rated reports, whatever the question; ties by seq."""
    if top_k < 1:
        raise ValueError("top_k must be at least 1")
    return reports.orderBy(F.desc("rating"), "seq").limit(top_k)


def report_entry() -> Column:
    """A report in a context: its first 20 entities, rating and summary."""
    names = F.array_join(F.slice("entity_names", 1, 20), ", ")
    return F.concat(F.lit("["), F.col("id"), F.lit("] "), F.col("title"), F.lit("\nEntities: "), names, F.lit("\nRating: "), F.col("rating").cast("string"), F.lit("\n"), F.col("summary"))


def context(reports: DataFrame, top_k: int = 8) -> DataFrame:
    """One row (id, score, text), or none without reports; top_k rows meet in one task."""
    top = top_reports(reports, top_k).select(F.struct((-F.col("rating")).alias("r"), "seq", report_entry().alias("t")).alias("x"))
    joined = top.agg(F.array_sort(F.collect_list("x")).alias("x")).where("size(x) > 0")
    return joined.select(F.lit("global_context").alias("id"), F.lit(1.0).alias("score"), F.array_join(F.transform("x", lambda y: y["t"]), "\n\n").alias("text"))


def useful_points(answer: Column) -> Column:
    """Points (description, score) of an answer with a positive score, best first; without JSON the answer is one point."""
    j = json_object(answer)
    read = F.coalesce(F.from_json(j, "points array<struct<description: string, score: double>>")["points"], F.array().cast("array<struct<description: string, score: double>>"))
    points = F.when(j.isNull(), F.array(F.struct(answer.alias("description"), F.lit(1.0).alias("score")))).otherwise(read)
    kept = F.filter(points, lambda p: (p["score"] > 0) & (F.coalesce(p["description"], F.lit("")) != ""))
    ranked = F.array_sort(F.transform(kept, lambda p, i: F.struct((-p["score"]).alias("s"), i.alias("i"), p["description"].alias("d"))))
    return F.transform(ranked, lambda p: F.struct(p["d"].alias("description"), (-p["s"]).alias("score")))


def map_reduce(queries: DataFrame, reports: DataFrame, client, top_k: int = 8) -> DataFrame:
    """(query_id, answer) of each question: points from the reports, then one answer from the points."""
    found = context(reports, top_k).select("text").first()
    if found is None:
        return queries.select("query_id", F.lit("No community reports are available.").alias("answer"))
    asked = queries.withColumn("prompt", F.replace(F.replace(F.lit(MAP_PROMPT), F.lit("{question}"), F.col("question")), F.lit("{reports}"), F.lit(found["text"])))
    mapped = complete(asked, "prompt", client, "raw")
    lines = F.array_join(F.transform(useful_points(F.col("raw")), lambda p: F.concat(F.lit("- score="), p["score"].cast("string"), F.lit(": "), p["description"])), "\n")
    points = F.coalesce(F.nullif(lines, F.lit("")), F.lit(found["text"]))
    final = mapped.select("query_id", F.replace(F.replace(F.lit(REDUCE_PROMPT), F.lit("{question}"), F.col("question")), F.lit("{points}"), points).alias("prompt"))
    return complete(final, "prompt", client).select("query_id", "answer")


