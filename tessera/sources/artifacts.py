"""Settings, and an index folder's tables: Parquet inside, JSON, CSV and Markdown for others."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.runtime import PLAIN, shared_dir
from tessera.sources import schemas

TABLES = {"text_units": schemas.TEXT_UNITS, "entities": schemas.ENTITIES, "relationships": schemas.RELATIONSHIPS, "nodes": schemas.NODES, "edges": schemas.EDGES, "community_reports": schemas.REPORTS}


@dataclass(frozen=True)
class Settings:
    """Read from the environment and a .env file; the environment wins."""

    github_token: str = ""
    llm_provider: str = "mock"
    llm_base_url: str = ""
    llm_api_key: str = ""
    llm_model: str = ""
    embedding_provider: str = "mock"
    embedding_model: str = "all-MiniLM-L6-v2"
    raw_data_dir: str = "data/raw"
    processed_data_dir: str = "data/processed"
    vector_dir: str = "data/processed/vectors"
    vector_collection: str = "documents"


def load_settings(env_file: str = ".env", environ: dict[str, str] | None = None) -> Settings:
    env = dict(os.environ if environ is None else environ)
    if Path(env_file).exists():
        for line in Path(env_file).read_text(encoding="utf-8").splitlines():
            k, eq, v = line.strip().partition("=")
            if eq and not k.startswith("#"):
                env.setdefault(k.strip(), v.strip().strip("'\""))
    return Settings(**{f.name: env.get(f.name.upper()) or f.default for f in fields(Settings)})


def input_path(path: str, settings: Settings) -> str:
    return path if os.path.isabs(path) or "://" in path else f"{settings.raw_data_dir}/{path}"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file with a JSON array as rows in order (seq, where the schema has it); wrong types are an error."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def _write_joined(spark: SparkSession, path: str, pieces: list[str | DataFrame]) -> None:
    """One file of the pieces in order: texts, and frames of one text column, whose rows are joined by a comma and a line end.

    Tasks write the rows as parts in the shared folder; the parts' bytes are then copied behind each other, a buffer at
    a time, and the file is put in place when it is whole. No row reaches the driver's Python or is held by the driver.
    """
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    at, copy, stage = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.commons.io.IOUtils.copyLarge, f"{shared_dir(spark)}/export-{uuid4().hex}"
    shared, target = at(stage).getFileSystem(hadoop), at(path)
    for i, x in enumerate(pieces):
        if not isinstance(x, str):
            x.write.options(lineSep=",\n", **PLAIN).text(f"{stage}/{i}")
    fs, draft = target.getFileSystem(hadoop), target.suffix(f".{uuid4().hex}")
    if target.getParent() is not None:
        fs.mkdirs(target.getParent())
    out = fs.create(draft, True)
    for i, x in enumerate(pieces):
        if isinstance(x, str):
            out.write(bytearray(x.encode()))
            continue
        parts = sorted((f.getPath().getName(), f.getLen()) for f in shared.listStatus(at(f"{stage}/{i}")) if f.getPath().getName().startswith("part-") and f.getLen())
        for k, (name, size) in enumerate(parts, 1):
            held = shared.open(at(f"{stage}/{i}/{name}"))
            copy(held, out, 0, size - 2 * (k == len(parts)))  # without what would follow the last row
            held.close()
    out.close()
    fs.delete(target, False)
    if not fs.rename(draft, target):
        raise OSError(f"{path} could not be put in place")
    shared.delete(at(stage), True)


def write_json(df: DataFrame, path: str) -> None:
    """One file with an indented JSON array, in the frame's order."""
    row = F.regexp_replace(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"pretty": "true"}), "(?m)^", "  ")
    _write_joined(df.sparkSession, path, ["[\n", df.select(row.alias("value")), "\n]\n"])


def write_index(frames: dict[str, DataFrame], path: str) -> None:
    """Write the tables of an index; stats go beside them as one JSON row."""
    for name, df in frames.items():
        if name == "stats":
            df.coalesce(1).write.mode("overwrite").json(f"{path}/stats")
        else:
            df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in TABLES.items()}


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges from node-link JSON ({"nodes": [...], "links": [...]})."""
    node = "struct<id: string, type: string, description: string, source_ids: array<string>, community_id: int>"
    link = "struct<source: string, target: string, relations: array<string>, descriptions: array<string>, weight: double, source_ids: array<string>>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"nodes array<{node}>, links array<{link}>").alias("g"))
    n = raw.select(F.posexplode("g.nodes").alias("seq", "n")).select(F.col("n.id").alias("name"), "n.type", "n.description", "n.source_ids", "n.community_id", F.col("seq").cast("bigint"))
    e = raw.select(F.posexplode("g.links").alias("seq", "e")).select(F.col("e.source").alias("u"), F.col("e.target").alias("v"), "e.relations", "e.descriptions", "e.weight", "e.source_ids", F.col("seq").cast("bigint"))
    return n, e


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Node-link JSON in one file, nodes and edges in the order of seq."""
    row = lambda df, *cols: df.orderBy("seq").select(F.to_json(F.struct(*cols)).alias("value"))
    n = row(nodes, F.col("name").alias("id"), "type", "description", "source_ids", "community_id")
    e = row(edges, F.col("u").alias("source"), F.col("v").alias("target"), "relations", "descriptions", "weight", "source_ids")
    _write_joined(nodes.sparkSession, path, ['{"directed": false, "multigraph": false, "graph": {}, "nodes": [\n', n, '\n], "links": [\n', e, "\n]}\n"])


def write_metrics_csv(rows: DataFrame, path: str) -> None:
    """Metric rows as CSV; lists are joined by "; "."""
    cols = [F.array_join(c, "; ").alias(c) if t.startswith("array") else F.col(c) for c, t in rows.dtypes]
    rows.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def metrics_markdown(rows: DataFrame, summary: DataFrame, setup: dict[str, float], config: dict[str, object]) -> str:
    """A report of a sweep; missing values print as n/a, times with two digits, others with three."""

    def show(k: str, v) -> str:
        if v is None:
            return "n/a"
        if isinstance(v, float):
            return f"{v:.2f}" if k.endswith("_ms") else f"{v:.3f}"
        return "; ".join(v) if isinstance(v, list) else str(v)

    def grid(df: DataFrame) -> list[str]:
        body = [f"| {' | '.join(show(c, r[c]) for c in df.columns)} |" for r in df.collect()]  # a row a case and mode
        return [f"| {' | '.join(df.columns)} |", "|" + "---|" * len(df.columns), *body]

    lines = ["# Retrieval evaluation", "", *(f"- {k}: {v}" for k, v in config.items()), "", "Times within one machine and run compare; others do not.", "", "## Set-up", "", *(f"- {k}: {v:.2f} ms" for k, v in setup.items()), "", "## Summary", "", *grid(summary), "", "## Details", "", *grid(rows)]
    return "\n".join(lines) + "\n"
