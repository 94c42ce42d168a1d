"""Issues as documents, and the tables of the test data as the model's frames."""

from __future__ import annotations

import json
import re
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.runtime import table
from tessera.sources import schemas

ISSUE = "number int, title string, body string, state string, html_url string, labels array<struct<name: string>>, created_at string, updated_at string, pull_request string"


def parse_repo(slug: str) -> tuple[str, str]:
    m = re.fullmatch(r"([^/\s]+)/([^/\s]+)", (slug or "").strip())
    if not m:
        raise ValueError(f"a repository is named owner/name, not {slug!r}")
    return m[1], m[2]


def fetch_issues(spark: SparkSession, slug: str, token: str | None = None, state: str = "open", limit: int = 30, base: str = "https://api.github.com") -> DataFrame:
    """One page of a repository's issues by REST; pull requests leave after the page is fetched."""
    owner, name = parse_repo(slug)
    request = urllib.request.Request(f"{base}/repos/{owner}/{name}/issues?state={state}&per_page={limit}")
    request.add_header("Accept", "application/vnd.github+json")
    if token:
        request.add_header("Authorization", f"Bearer {token}")
    with urllib.request.urlopen(request, timeout=30) as answer:
        return read_issues(spark, json.load(answer))


def read_issues(spark: SparkSession, issues: list[dict] | str) -> DataFrame:
    """Issues from parsed JSON or a path of JSON arrays, in order (seq); rows with the key pull_request go."""
    if isinstance(issues, str):
        raw = spark.read.text(issues, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("seq", "row"))
    else:
        raw = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(issues)], "seq int, row string")
    keyed = raw.where(~F.coalesce(F.array_contains(F.json_object_keys("row"), "pull_request"), F.lit(False)))
    return keyed.select(F.from_json("row", ISSUE).alias("i"), F.col("seq").cast("bigint")).select("i.*", "seq").drop("pull_request")


def issues_to_documents(issues: DataFrame, slug: str) -> DataFrame:
    n = F.col("number").cast("string")
    title = F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("Issue #"), n))
    meta = F.struct(F.lit(slug).alias("repo"), "number", "state", F.transform("labels", lambda x: x["name"]).alias("labels"), "created_at", "updated_at")
    return issues.select(
        F.concat(F.lit(slug), F.lit("#issue-"), n).alias("id"),
        title.alias("title"),
        F.concat(F.lit("Issue #"), n, F.lit(": "), title, F.lit("\n\n"), F.coalesce("body", F.lit(""))).alias("text"),
        F.lit("github_issue").alias("source_type"),
        F.col("html_url").alias("url"),
        meta.cast(schemas.META).alias("metadata"),
        "seq",
    )


def table_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as source documents."""
    d = table(spark, sf_dir, "documents")
    id_ = F.col("doc_id").cast("string")
    return d.select(F.concat(F.lit("doc-"), id_).alias("id"), F.concat(F.lit("Document "), id_).alias("title"), "text", F.lit("document").alias("source_type"), F.lit(None).cast("string").alias("url"), F.lit(None).cast(schemas.META).alias("metadata"), F.col("doc_id").alias("seq"))


def table_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers supply brands (one row a line item), sit in nations, and those in regions."""
    line, part, sup = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    nation, region = (table(spark, sf_dir, t) for t in ("nation", "region"))
    one = lambda s, t, r, ids, seq: (s.alias("source"), t.alias("target"), F.lit(r).alias("relation"), F.lit("").alias("description"), F.lit(1.0).alias("weight"), ids.alias("source_ids"), seq.cast("bigint").alias("seq"))
    sold = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
    sold = sold.select(*one(F.col("s_name"), F.col("p_brand"), "supplies", F.array(F.col("l_orderkey").cast("string")), F.lit(10_000) + F.col("l_orderkey") * 10 + F.col("l_linenumber")))
    sits = sup.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(*one(F.col("s_name"), F.col("n_name"), "located_in", F.array(F.col("s_suppkey").cast("string")), F.col("s_suppkey") - 9_000_000))
    lies = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(*one(F.col("n_name"), F.col("r_name"), "located_in", F.array(F.col("n_nationkey").cast("string")), F.col("n_nationkey") - 9_500_000))
    return sold.unionByName(sits).unionByName(lies)


def table_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers, nations and regions as entities; brands come in through their relations alone."""
    sup, nation, region = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    one = lambda n, t, k, base: (n.alias("name"), F.lit(t).alias("type"), F.concat(F.lit(f"{t.lower()} "), k.cast("string")).alias("description"), F.array(F.concat(F.lit(f"{t.lower()}-"), k.cast("string"))).alias("source_ids"), (F.lit(base) + k).cast("bigint").alias("seq"))
    out = region.select(*one(F.col("r_name"), "REGION", F.col("r_regionkey"), 0))
    out = out.unionByName(nation.select(*one(F.col("n_name"), "NATION", F.col("n_nationkey"), 100)))
    return out.unionByName(sup.select(*one(F.col("s_name"), "SUPPLIER", F.col("s_suppkey"), 1000)))
