import re
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import misc, names, text
from tessera.operators import chunk
from tessera.plans import sql


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def plain_chunks(t, size, overlap):
    t, out, i = t.strip(), [], 0
    while t:
        part = t[i : i + size]
        if part.strip():
            out.append(part.strip())
        if i + size >= len(t):
            break
        i += size - overlap
    return out


def test_chunks(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    assert one(spark, chunk.chunk_array(F.lit("hello world"), 100, 10)) == ["hello world"]
    assert one(spark, chunk.chunk_array(F.lit(letters), 10, 2)) == ["abcdefghij", "ijklmnopqr", "qrstuvwxyz"]
    assert one(spark, chunk.chunk_array(F.lit("  \n"), 10, 2)) == []
    with pytest.raises(ValueError):
        chunk.chunk_array(F.lit("x"), 10, 10)


@settings(max_examples=1, deadline=None)
@given(st.lists(st.text("ab \n é", max_size=60), min_size=20, max_size=20))
def test_chunks_like_plain_python(spark, texts):
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", chunk.chunk_array(F.col("t"), 9, 3).alias("c")).collect()
    assert {r["i"]: r["c"] for r in got} == {i: plain_chunks(t, 9, 3) for i, t in enumerate(texts)}


def test_text_units_have_ids_and_order(spark):
    d = spark.createDataFrame([("d1", "T", "abcdefghij" * 3, 0), ("d2", "U", None, 1)], "id string, title string, text string, seq bigint")
    rows = chunk.text_units(d, 12, 2).orderBy("seq").collect()
    assert [r["order"] for r in rows] == [0, 1, 2] and {r["document_id"] for r in rows} == {"d1"} and len({r["id"] for r in rows}) == 3


def test_tokens(spark):
    assert one(spark, text.bm25_tokens(F.lit("Kafka the. kafka_backend.py"))) == ["kafka", "kafka", "the.", "kafka_backend.py", "kafka", "backend", "py"]
    assert set(one(spark, text.local_tokens(F.lit("slow kafka issue")))) == {"slow", "latency", "round-trip", "roundtrips", "pulsar", "memgraph", "kafka", "consumer", "producer", "unsubscribe", "offset", "pubsub"}
    assert one(spark, text.local_tokens(F.lit(None).cast("string"))) == []


def test_text_score(spark):
    q, t = F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))
    assert one(spark, text.overlap_score(q, t)) == pytest.approx(1 / 2**0.5)


@pytest.mark.parametrize(("name", "kind", "want"), sql.DIRTY)
def test_canonical_names(spark, name, kind, want):
    assert one(spark, names.canonical_entity(F.lit(name), F.lit(kind))) == want


@pytest.mark.parametrize(("label", "want"), sql.LABELS)
def test_canonical_relations(spark, label, want):
    assert one(spark, names.canonical_relation(F.lit(label))) == want


@pytest.mark.parametrize(("question", "want"), sql.ROUTES)
def test_routes(spark, question, want):
    assert one(spark, misc.route(F.lit(question))) == want


def test_route_modes(spark):
    assert one(spark, misc.route(F.lit("x"), "naive")) == "naive"
    with pytest.raises(ValueError):
        misc.route(F.lit("x"), "vector")


def test_terms(spark):
    has = lambda a, b: one(spark, text.contains_term(F.lit(a), F.lit(b)))
    assert has("About GRAPH_RAG", "graph-rag") and has("Issue #944", "issue 944") and not has("x", "--")


def test_shorten_and_collapse(spark):
    assert one(spark, text.collapse(F.lit(" a \x1f b "))) == "a b"
    assert one(spark, text.shorten(F.lit("x" * 20), 10)) == "x" * 7 + "..."


@pytest.mark.parametrize("source", ["unit-1", "ünit 2"])
def test_point_ids(spark, source):
    assert one(spark, misc.point_id(F.lit("entity"), F.lit(source))) == str(uuid.uuid5(uuid.NAMESPACE_URL, f"entity:{source}"))


def test_point_id_needs_parts(spark):
    with pytest.raises(Exception, match="must not be empty"):
        one(spark, misc.point_id(F.lit("entity"), F.lit("")))


@pytest.mark.parametrize(
    ("raw", "ok"),
    [('{"entities": [], "relationships": []}', True), ('```json\n{"entities": [{"name": "Graph RAG"}]}\n```', True), ('Sure: {"a": {"b": 1}} done', True), ("no structured json here", False), ("```json\n\n```", False), (None, False)],
)
def test_json(spark, raw, ok):
    got = one(spark, misc.json_object(F.lit(raw).cast("string")))
    assert (got is not None) == ok
    if ok:
        assert got == re.search(r"\{.*\}", raw, re.DOTALL)[0]


def test_sections(spark):
    ctx = F.lit("-----Reports-----\n\n[1] a\n\n-----Entities-----\n\n-----Sources-----\n\n[u1] x\n[u2] y")
    assert one(spark, text.bracketed_ids(text.section(ctx, "-----Sources-----"))) == ["u1", "u2"]
    assert one(spark, text.bracketed_ids(text.section(ctx, "-----Reports-----", "-----Entities-----"))) == ["1"]
    assert one(spark, text.section(ctx, "-----None-----")) == ""
    assert one(spark, text.unique(F.array(F.lit("b"), F.lit(""), F.lit("a"), F.lit("b")))) == ["b", "a"]


def test_white_space_is_pythons():
    from tessera.functions.text import WHITE

    assert set(WHITE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}
