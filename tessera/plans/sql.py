"""Literal inputs of the queries, and their SQL twins for DuckDB."""

from __future__ import annotations

from tessera.functions.misc import GLOBAL_HINTS
from tessera.functions.text import EXPANSIONS, STOP_COMMON, STOP_LOCAL

#: (name, type, canonical name)
DIRTY = [
    ("TG", "CONCEPT", "TrustGraph"),
    (" Trust  Graph", "PROJECT", "TrustGraph"),
    ("graph_rag", "CONCEPT", "Graph RAG"),
    ("Graph-RAG", "METHOD", "Graph RAG"),
    ("Reciprocal Rank Fusion", "CONCEPT", "RRF"),
    ("rrf", "METHOD", "RRF"),
    ("#944", "ISSUE", "Issue #944"),
    ("issue 875", "ISSUE", "Issue #875"),
    ("944", "CONCEPT", "Issue #944"),
    ("graph_rag.Processor", "CLASS", "graph_rag.Processor"),
    ("TF-IDF", "METHOD", "TF-IDF"),
    ("Cross-Encoder  Reranking", "METHOD", "Cross-encoder Reranking"),
    ("a/b/kafka_backend.py", "FILE", "kafka_backend.py"),
    ("c/kafka_backend.py", "script", "kafka_backend.py"),
    ("a/b/kafka_backend.py", "CONCEPT", "a/b/kafka_backend.py"),
    ("a/b/Makefile", "FILE", "a/b/Makefile"),
]
LABELS = [("depends on", "depends_on"), ("Depends-On", "depends_on"), ("requires", "depends_on"), ("related_to", "mentions"), ("fixes", "fixes"), (" Used  by ", "used_by"), ("impacts", "affects")]
LOCAL_QUESTIONS = [("a", "Which supplier of region ASIA is in JAPAN or China?"), ("b", "FRANCE and GERMANY suppliers"), ("c", "nation 7 graph retrieval")]
ROUTES = [("这个 repo 主要有哪些值得贡献的方向？", "global"), ("RRF 会影响哪些 retrieval 相关组件？", "local"), ("domain model", "global"), ("What does issue #875 propose?", "local"), ("Give me an OVERVIEW", "global"), ("kafka latency", "local")]
CATEGORIES = [("single_lookup", "local,naive"), ("local_relationship", "local,naive"), ("global_theme", "global,local,naive"), ("other", "local,naive")]


def _s(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _values(rows, names: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(_s(v) for v in r) + ')' for r in rows)}) AS v({names})"


def _list(words) -> str:
    return "[" + ", ".join(map(_s, words)) + "]"


WS = r"[\t\n\r\f\v \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
STRIP = lambda c: f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"
COLLAPSE = lambda c: f"trim(regexp_replace(coalesce({c}, ''), '{WS}+', ' ', 'g'), ' ')"
NORMAL = lambda c: f"array_to_string(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+'), ' ')"

UNITS = f"""docs AS (SELECT doc_id, 'doc-' || doc_id AS document_id, 'Document ' || doc_id AS title, {STRIP("coalesce(text, '')")} AS t FROM documents),
wins AS (SELECT doc_id, document_id, title, t, unnest(range(0, greatest(1, CAST(ceil((length(t) - 250) / 2250.0) AS BIGINT)))) AS i FROM docs WHERE length(t) > 0),
parts AS (SELECT doc_id, document_id, title, i, {STRIP('substr(t, i * 2250 + 1, 2500)')} AS text FROM wins),
units AS (SELECT *, md5(document_id || '::' || ord || '::' || substr(text, 1, 80)) AS id, doc_id * 1000000 + ord AS seq FROM
  (SELECT doc_id, document_id, title, text, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ord FROM parts WHERE text <> ''))"""

RAW = lambda c: f"regexp_extract_all(lower({c}), '[a-z0-9][a-z0-9_\\-.]*')"
BM25 = lambda c: f"list_filter(flatten(list_transform({RAW(c)}, lambda k: list_prepend(k, regexp_split_to_array(k, '[_\\-.]+')))), lambda w: w <> '' AND NOT list_contains({_list(STOP_COMMON)}, w))"

INDEX = f"""{UNITS},
terms AS (SELECT id, seq, unnest({BM25("title || chr(10) || text")}) AS term FROM units),
tf AS (SELECT id, seq, term, count(*) AS tf FROM terms GROUP BY ALL),
dl AS (SELECT id, sum(tf) AS dl FROM tf GROUP BY id),
st AS (SELECT count(*) AS n, avg(dl) AS mean FROM dl),
plain AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), st),
idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM plain) ELSE idf END AS idf FROM plain),
asked AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({BM25('text')}) AS term FROM benchmark) GROUP BY ALL),
scored AS (SELECT query_id, tf.id, seq, round(sum(qtf * idf * (tf.tf * 2.5) / (tf.tf + 1.5 * (0.25 + 0.75 * dl / mean))), 9) AS score
  FROM tf JOIN asked USING (term) JOIN idf USING (term) JOIN dl ON dl.id = tf.id, st GROUP BY query_id, tf.id, seq),"""


def ranked(k: int) -> str:
    return f"hits AS (SELECT query_id, rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq) AS rank FROM scored) WHERE rank <= {k} AND score > 0)"


NEAR = """e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, label FROM embeddings),
near AS (SELECT q.vec_id AS query_id, e.vec_id AS id, e.label, round(list_cosine_similarity(q.v, e.v), 9) AS score FROM e JOIN e q ON q.vec_id % 20 = 0)"""
RRF = """, f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id,
  coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0) AS s, least(coalesce(a.rank, 1000), coalesce(b.rank, 1000)) AS best
  FROM a FULL JOIN b ON a.query_id = b.query_id AND a.id = b.id)
SELECT query_id, rank, id, round(s, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, best, id) AS rank FROM f) WHERE rank <= 8"""

GRAPH = """rel AS (
  SELECT s_name AS source, p_brand AS target, 'supplies' AS relation, [CAST(l_orderkey AS VARCHAR)] AS ids, 10000 + l_orderkey * 10 + l_linenumber AS seq
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  UNION ALL SELECT s_name, n_name, 'located_in', [CAST(s_suppkey AS VARCHAR)], s_suppkey - 9000000 FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT n_name, r_name, 'located_in', [CAST(n_nationkey AS VARCHAR)], n_nationkey - 9500000 FROM nation JOIN region ON n_regionkey = r_regionkey),
ent AS (
  SELECT r_name AS name, 'REGION' AS type, 'region ' || r_regionkey AS description, 'region-' || r_regionkey AS source_ids, r_regionkey AS seq FROM region
  UNION ALL SELECT n_name, 'NATION', 'nation ' || n_nationkey, 'nation-' || n_nationkey, 100 + n_nationkey FROM nation
  UNION ALL SELECT s_name, 'SUPPLIER', 'supplier ' || s_suppkey, 'supplier-' || s_suppkey, 1000 + s_suppkey FROM supplier),
nodes AS (SELECT * FROM ent UNION ALL SELECT p_brand, 'CONCEPT', '', '', 1099511627776 + 2 * min(seq) + 1 FROM (SELECT target AS p_brand, seq FROM rel WHERE relation = 'supplies') GROUP BY 1),
edges AS (SELECT least(source, target) AS u, greatest(source, target) AS v, list_sort(list(DISTINCT relation)) AS relations, CAST(count(*) AS DOUBLE) AS weight,
  list_sort(list_distinct(flatten(list(ids)))) AS ids, min(seq) AS seq FROM rel GROUP BY 1, 2)"""
BOTH = "both_ways AS (SELECT u AS name FROM edges UNION ALL SELECT v FROM edges)"
REGIONS = """reports AS (SELECT CAST(r_regionkey AS VARCHAR) AS id, r_name AS title, 'Suppliers of region ' || r_name AS summary, list_sort(list(n_name)) AS names, CAST(r_regionkey % 3 AS DOUBLE) AS rating, r_regionkey AS seq
  FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name)"""
COMPONENTS = f"""{GRAPH},
links AS (SELECT u AS a, v AS b FROM edges UNION ALL SELECT v, u FROM edges),
reach AS (SELECT name, name AS other FROM nodes UNION SELECT r.name, l.b FROM reach r JOIN links l ON l.a = r.other)"""

LOCAL = lambda c: (
    f"(SELECT list_distinct(list_concat(p, flatten(list_transform(p, lambda w: CASE w {' '.join(f'WHEN {_s(k)} THEN {_list(v)}' for k, v in EXPANSIONS.items())} ELSE [] END)))) FROM "
    f"(SELECT list_distinct(list_filter(flatten(list_transform(list_filter({RAW(c)}, lambda t: NOT list_contains({_list(STOP_LOCAL)}, t)), lambda k: list_prepend(k, regexp_split_to_array(k, '[_\\-.]+')))), lambda w: w <> '' AND NOT list_contains({_list(STOP_LOCAL)}, w))) AS p))"
)
SCORE = lambda q, t: f"len(list_intersect({q}, {t})) / sqrt(len({q}))"
LOCAL_GRAPH = f"""{GRAPH}, {BOTH}, {REGIONS},
deg AS (SELECT n.*, count(b.name) AS degree FROM nodes n LEFT JOIN both_ways b ON b.name = n.name GROUP BY ALL),
q AS (SELECT query_id, {LOCAL('question')} AS q FROM {_values(LOCAL_QUESTIONS, 'query_id, question')}),
ntok AS (SELECT *, {LOCAL("concat_ws(' ', name, type, description)")} AS tok FROM deg),
rn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq) AS rank FROM (
  SELECT query_id, name, seq, degree, source_ids, {SCORE('q', 'tok')} * CASE WHEN degree > 12 AND NOT list_contains(q, lower(name)) THEN 0.65 ELSE 1 END AS score FROM ntok JOIN q ON {SCORE('q', 'tok')} > 0))"""
EDGE_SCORES = f"""seeds AS (SELECT query_id, name FROM rn WHERE rank <= 8),
etok AS (SELECT u, v, seq, {LOCAL("concat_ws(' ', u, v, array_to_string(relations, ' '), CASE WHEN weight > 1 THEN '' END)")} AS tok FROM edges),
sce AS (SELECT q.query_id, u, v, seq, round({SCORE('q', 'tok')} + 0.8 * CAST(a.name IS NOT NULL AS INT) + 0.8 * CAST(b.name IS NOT NULL AS INT), 12) AS score
  FROM etok JOIN q ON true LEFT JOIN seeds a ON a.query_id = q.query_id AND a.name = u LEFT JOIN seeds b ON b.query_id = q.query_id AND b.name = v)"""

ORACLE = {
    "chunk_documents": f"WITH {UNITS} SELECT id, document_id, ord, length(text) AS n_chars, md5(text) AS text_md5 FROM units",
    "stable_ids": "SELECT o_orderkey, md5('order::' || o_orderkey || '::' || o_custkey) AS stable_id FROM orders",
    "shorten_text": f"""SELECT doc_id, md5(CASE WHEN length(t) <= 900 THEN t ELSE substr(t, 1, 897) || '...' END) AS short_md5, CASE WHEN length(t) <= 220 THEN length(t) ELSE 220 END AS n
FROM (SELECT doc_id, {COLLAPSE('text')} AS t FROM documents)""",
    "bm25_terms": f"WITH {UNITS} SELECT term, count(*) AS n FROM (SELECT unnest({BM25('text')}) AS term FROM units) GROUP BY term",
    "bm25_idf": f"WITH {INDEX} {ranked(1)} SELECT term, round(idf, 6) AS idf FROM idf",
    "bm25_search": f"WITH {INDEX} {ranked(8)} SELECT query_id, rank, id, round(score, 6) AS score FROM hits",
    "local_token_sets": f"SELECT item_id, array_to_string(list_sort({LOCAL('text')}), ' ') AS tokens FROM benchmark",
    "text_score": f"""WITH q AS (SELECT {LOCAL("'that reed hein the graph of the'")} AS q), t AS (SELECT doc_id, {LOCAL("coalesce(text, '')")} AS tok FROM documents)
SELECT doc_id, round({SCORE('q', 'tok')}, 6) AS score FROM t, q WHERE len(list_intersect(q, tok)) > 0""",
    "cosine_topk": f"WITH {NEAR} SELECT query_id, rank, id AS source_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM near) WHERE rank <= 8",
    "kind_filter_count": "SELECT 'kind-' || label AS kind, count(*) AS n FROM embeddings GROUP BY 1",
    "kind_filter_topk": f"WITH {NEAR} SELECT query_id, rank, id AS source_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM near WHERE label = 1) WHERE rank <= 3",
    "rrf_fusion": f"""WITH {NEAR},
a AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM near) WHERE rank <= 20),
b AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM near WHERE label % 2 = 0) WHERE rank <= 20){RRF}""",
    "hybrid_search": f"""WITH {INDEX} {ranked(20)},
a AS (SELECT query_id, document_id AS id, min(rank) AS rank FROM hits JOIN units USING (id) GROUP BY 1, 2),
e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
near AS (SELECT q.vec_id AS query_id, 'doc-' || e.vec_id AS id, round(list_cosine_similarity(q.v, e.v), 9) AS score FROM e JOIN e q ON q.vec_id IN (SELECT item_id FROM benchmark)),
b AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM near) WHERE rank <= 20){RRF}""",
    "canonical_names": f"""WITH v AS (SELECT *, row_number() OVER () AS i FROM {_values(DIRTY, 'name, type, canonical')})
SELECT p_partkey AS seq, CASE p_partkey % 3 WHEN 1 THEN replace(p_name, ' ', '_') || '.py' WHEN 2 THEN p_name ELSE canonical END AS canonical FROM part JOIN v ON i = p_partkey % {len(DIRTY)} + 1""",
    "canonical_relations": f"""WITH v AS (SELECT *, row_number() OVER () AS i FROM {_values(LABELS, 'label, canonical')})
SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN replace(replace(lower(o_orderpriority), '-', '_'), ' ', '_') ELSE canonical END AS canonical FROM orders JOIN v ON i = o_orderkey % {len(LABELS)} + 1""",
    "entity_merge": f"""WITH v AS (SELECT *, row_number() OVER () AS i FROM {_values(DIRTY, 'name, type, canonical')}),
d AS (SELECT canonical AS name, type, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS description, p_brand, p_partkey AS seq FROM part JOIN v ON i = p_partkey % {len(DIRTY)} + 1)
SELECT name, coalesce(arg_min(type, seq) FILTER (WHERE type <> 'CONCEPT'), 'CONCEPT') AS type, coalesce(arg_min(description, seq) FILTER (WHERE description <> ''), '') AS description,
  array_to_string(list_sort(list(DISTINCT p_brand)), '|') AS source_ids, min(seq) AS seq FROM d GROUP BY name""",
    "relation_dedupe": f"""WITH {GRAPH} SELECT source, target, CASE WHEN relation = 'Use' THEN 'uses' ELSE relation END AS relation, 1.0 AS weight, min(seq) AS seq
FROM (SELECT source, target, CASE WHEN seq % 2 = 0 THEN 'Use' ELSE relation END AS relation, seq FROM rel) GROUP BY 1, 2, 3""",
    "graph_nodes": f"WITH {GRAPH} SELECT name, type, description, source_ids FROM nodes",
    "graph_edges": f"WITH {GRAPH} SELECT u, v, array_to_string(relations, '|') AS relations, weight, len(ids) AS n_sources, md5(array_to_string(ids, '|')) AS sources_md5, CASE WHEN weight > 1 THEN 1 ELSE 0 END AS n_descriptions FROM edges",
    "graph_renormalize": f"""WITH {GRAPH}, m AS (SELECT CASE WHEN u IN ('ASIA', 'EUROPE') THEN 'TrustGraph' ELSE u END AS a, CASE WHEN v IN ('ASIA', 'EUROPE') THEN 'TrustGraph' ELSE v END AS b, * FROM edges)
SELECT least(a, b) AS u, greatest(a, b) AS v, array_to_string(list_sort(list_distinct(flatten(list(relations)))), '|') AS relations, sum(weight) AS weight, len(list_distinct(flatten(list(ids)))) AS n_sources FROM m WHERE a <> b GROUP BY 1, 2""",
    "graph_renormalize_nodes": f"""WITH {GRAPH}, m AS (SELECT CASE WHEN name IN ('ASIA', 'EUROPE') THEN 'TrustGraph' ELSE name END AS a, * FROM nodes)
SELECT a AS name, coalesce(arg_min(type, seq) FILTER (WHERE type <> 'CONCEPT'), 'CONCEPT') AS type, coalesce(arg_min(description, seq) FILTER (WHERE description <> ''), '') AS description,
  coalesce(array_to_string(list_sort(list(DISTINCT source_ids) FILTER (WHERE source_ids <> '')), '|'), '') AS source_ids FROM m GROUP BY a""",
    "degree_topn": f"WITH {GRAPH}, {BOTH} SELECT n.name, count(b.name) AS degree FROM nodes n LEFT JOIN both_ways b ON b.name = n.name GROUP BY n.name, n.seq ORDER BY degree DESC, n.seq, n.name LIMIT 25",
    "type_counts": f"WITH {GRAPH} SELECT type, count(*) AS n FROM nodes GROUP BY type",
    "relation_counts": f"WITH {GRAPH} SELECT relation, count(*) AS n FROM (SELECT unnest(relations) AS relation FROM edges) GROUP BY relation",
    "connected_components": f"WITH RECURSIVE {COMPONENTS} SELECT name, min(other) AS component FROM reach GROUP BY name",
    "graph_stats": f"""WITH RECURSIVE {COMPONENTS} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges,
  (SELECT count(DISTINCT c) FROM (SELECT min(other) AS c FROM reach GROUP BY name)) AS connected_components""",
    "community_invariants": f"WITH {GRAPH} SELECT count(*) AS members, 0 AS repeated, true AS numbered, true AS not_below_single_nodes FROM nodes",
    "community_listing": f"""WITH {GRAPH}, c AS (SELECT s_name AS name, n_regionkey AS cid FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION SELECT n_name, n_regionkey FROM nation),
x AS (SELECT nodes.name, coalesce(CAST(cid AS VARCHAR), 'NA') AS community FROM nodes LEFT JOIN c USING (name))
SELECT community, count(*) AS size, array_to_string(list_sort(list(name))[1:8], '|') AS sample FROM x GROUP BY community""",
    "report_sources": f"""WITH {GRAPH}, c AS (SELECT n_name AS name, n_regionkey AS cid FROM nation UNION SELECT r_name, r_regionkey FROM region),
s AS (SELECT cid, source_ids AS s FROM c JOIN nodes USING (name) UNION ALL SELECT a.cid, unnest(ids) FROM edges JOIN c a ON a.name = u JOIN c b ON b.name = v AND a.cid = b.cid)
SELECT CAST(cid AS BIGINT) AS community_id, array_to_string(list_sort(list(DISTINCT s)), '|') AS source_ids FROM s GROUP BY cid""",
    "community_reports": """SELECT CAST(n_regionkey AS VARCHAR) AS id, 'Community ' || n_regionkey AS title, '' AS summary, array_to_string(list(n_name ORDER BY n_nationkey), '|') AS entity_names,
  array_to_string(list_sort(list('nation-' || n_nationkey)), '|') AS source_ids, 1.0 AS rating, n_regionkey AS seq FROM nation GROUP BY n_regionkey""",
    "global_topk": f"WITH {REGIONS} SELECT id, title, rating FROM reports ORDER BY rating DESC, seq LIMIT 3",
    "global_context": f"""WITH {REGIONS}, t AS (SELECT * FROM reports ORDER BY rating DESC, seq LIMIT 3)
SELECT 'global_context' AS id, 1.0 AS score, string_agg('[' || id || '] ' || title || chr(10) || 'Entities: ' || array_to_string(names[1:20], ', ') || chr(10) || 'Rating: ' || CAST(rating AS VARCHAR) || chr(10) || summary, chr(10) || chr(10) ORDER BY rating DESC, seq) AS text FROM t""",
    "rank_nodes": f"WITH {LOCAL_GRAPH} SELECT query_id, name, degree, round(score, 6) AS score, rank FROM rn WHERE rank <= 24",
    "rank_edges": f"""WITH {LOCAL_GRAPH}, {EDGE_SCORES}
SELECT query_id, u, v, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq, u, v) AS rank FROM sce WHERE score > 0) WHERE rank <= 32""",
    "rank_reports": f"""WITH {LOCAL_GRAPH}, rtok AS (SELECT *, {LOCAL("concat_ws(' ', title, array_to_string(names, ' '), summary)")} AS tok FROM reports),
sc AS (SELECT q.query_id, id, seq, round({SCORE('q', 'tok')} + 0.4 * least(5, (SELECT count(*) FROM rn WHERE rn.query_id = q.query_id AND rank <= 24 AND list_contains(names, rn.name))), 12) AS score FROM rtok JOIN q ON true)
SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq) AS rank FROM sc WHERE score > 0""",
    "rank_sources": f"""WITH {LOCAL_GRAPH}, {EDGE_SCORES}, u AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id AS seq, {LOCAL("coalesce(text, '')")} AS tok, {LOCAL("'Document ' || doc_id")} AS ttok FROM documents),
re AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq, u, v) AS rank FROM sce WHERE score > 0) WHERE rank <= 32),
ch AS (SELECT query_id, name FROM seeds UNION SELECT query_id, u FROM re UNION SELECT query_id, v FROM re),
g AS (SELECT query_id, id, sum(s) AS s FROM (SELECT query_id, unnest(ids) AS id, score AS s FROM re JOIN edges USING (u, v) UNION ALL SELECT query_id, source_ids, 0.5 FROM ch JOIN nodes USING (name) WHERE source_ids <> '') GROUP BY 1, 2),
sc AS (SELECT q.query_id, u.id, seq, round({SCORE('q', 'tok')} + 1.5 * {SCORE('q', 'ttok')} + coalesce(s, 0), 12) AS score FROM u JOIN q ON true LEFT JOIN g ON g.query_id = q.query_id AND g.id = u.id)
SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq) AS rank FROM sc WHERE score > 0""",
    "route_queries": f"""SELECT item_id AS query_id, CASE WHEN item_id % 3 = 0 OR len(list_filter({_list(GLOBAL_HINTS)}, lambda h: contains(lower(text), h))) > 0 THEN 'global' ELSE 'local' END AS mode,
'naive' AS requested FROM benchmark""",
    "json_extract": "SELECT doc_id, 'n' || doc_id AS name FROM documents",
    "extraction": """SELECT n_name AS name, 'NATION' AS type, '' AS target, 'u' || n_nationkey AS source_ids, 0.0 AS weight FROM nation
UNION ALL SELECT n_name, 'located_in', r_name, 'u' || n_nationkey, 1.0 FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "eval_modes": f"""WITH v AS (SELECT *, row_number() OVER () AS i FROM {_values(CATEGORIES, 'category, modes')})
SELECT item_id AS query_id, category, modes FROM benchmark JOIN v ON i = item_id % {len(CATEGORIES)} + 1""",
    "noise_entities": f"""WITH own AS (SELECT item_id, string_split(text, ' ')[3] || '_' || string_split(text, ' ')[4] AS name FROM benchmark),
n AS (SELECT DISTINCT {NORMAL('name')} AS norm FROM (SELECT name FROM own UNION ALL SELECT n_name FROM nation)),
t AS (SELECT doc_id, {NORMAL("coalesce(text, '')")} AS c, {NORMAL("coalesce(name, 'France')")} AS want FROM documents LEFT JOIN own ON item_id = doc_id)
SELECT doc_id AS query_id, count(*) FILTER (WHERE contains(c, norm) AND length(norm) >= 3 AND norm <> want) AS noise_entities FROM t, n GROUP BY doc_id""",
    "eval_summary": """SELECT o_orderstatus AS mode, count(*) AS queries,
  round(avg(CASE WHEN o_orderkey % 2 <> 0 THEN (o_orderkey % 11) / 10.0 END), 6) AS entity_recall, round(avg(CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 11) / 10.0 END), 6) AS source_recall_at_k,
  round(avg(CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 11) / 10.0 END), 6) AS source_mrr, CAST(NULL AS DOUBLE) AS community_recall, CAST(NULL AS DOUBLE) AS community_mrr,
  round(median(o_totalprice), 6) AS median_latency_ms, round(avg(o_custkey % 7), 6) AS avg_noise_entities FROM orders GROUP BY 1""",
    "vector_upsert": "SELECT 'text_unit' AS kind, CASE WHEN vec_id % 3 = 0 THEN 'new' ELSE 'old' END AS text, count(*) AS n FROM embeddings GROUP BY 2",
    "vector_delete": "SELECT 'text_unit' AS kind, CAST(vec_id AS VARCHAR) AS source_id FROM embeddings WHERE vec_id % 4 <> 0",
    "vector_history": """SELECT CASE WHEN vec_id % 50 = 1 THEN 'entity' ELSE 'text_unit' END AS kind, CAST(vec_id AS VARCHAR) AS source_id,
CASE vec_id % 50 WHEN 0 THEN 'change 0' WHEN 3 THEN 'change 3' WHEN 4 THEN 'change 4' WHEN 5 THEN 'change 5' WHEN 7 THEN 'again' ELSE 'old' END AS text
FROM embeddings WHERE vec_id % 50 <> 2""",
    "vector_counts": "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN vec_id % 3 = 0 THEN 'entity' ELSE 'text_unit' END AS kind, vec_id FROM embeddings) WHERE kind = 'entity' OR vec_id % 5 <> 0 GROUP BY kind",
    "vector_get": "SELECT 'text_unit' AS kind, CAST(vec_id AS VARCHAR) AS source_id, len(embedding) AS n FROM embeddings WHERE vec_id % 18 = 0",
    "vector_documents": f"""WITH {UNITS}, {GRAPH}, {REGIONS}
SELECT 'text_unit' AS kind, id AS source_id, md5({STRIP("title || chr(10) || text")}) AS text_md5 FROM units
UNION ALL SELECT 'entity', name, md5(name || chr(10) || 'Type: ' || type || chr(10) || description) FROM ent
UNION ALL SELECT 'community_report', id, md5(title || chr(10) || 'Entities: ' || array_to_string(names, ', ') || chr(10) || summary) FROM reports""",
    "windowed_events": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2",
}
_TRACES = f"""WITH {INDEX} {ranked(8)},
want AS (SELECT item_id AS query_id, list_sort(list(DISTINCT 'doc-' || doc_id)) AS expected FROM (SELECT doc_id, {NORMAL('text')} AS norm FROM documents), (SELECT item_id, {NORMAL('text')} AS term FROM benchmark) WHERE term <> '' AND contains(' ' || norm || ' ', ' ' || term) GROUP BY 1),
firsts AS (SELECT query_id, document_id, min(rank) AS rank FROM hits JOIN units USING (id) GROUP BY 1, 2),
got AS (SELECT query_id, list(document_id ORDER BY rank) AS docs FROM firsts GROUP BY 1), t AS (SELECT * FROM got JOIN want USING (query_id))"""
ORACLE["recall_mrr"] = f"""{_TRACES} SELECT query_id, round(len(list_intersect(expected, docs[1:8])) / len(expected), 6) AS recall,
  round(coalesce(1.0 / list_min(list_filter(list_transform(expected, lambda e: list_position(docs, e)), lambda i: i > 0)), 0), 6) AS mrr FROM t"""
ORACLE["missing_sources"] = f"{_TRACES} SELECT query_id, unnest(list_filter(list_append(expected, 'doc-' || query_id), lambda e: NOT list_contains(docs, e))) AS document_id FROM t"
#: UUID version 5: the namespace's bytes, then the name; version and variant bits set in the first 16 bytes of SHA-1.
ORACLE["vector_ids"] = """WITH h AS (SELECT vec_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('text_unit:' || vec_id)) AS h FROM embeddings)
SELECT vec_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', 1 + (instr('0123456789abcdef', h[17]) - 1) % 4, 1) || h[18:20] || '-' || h[21:32] AS point_id FROM h"""
ORACLE["trace_ids"] = f"""WITH m AS (SELECT item_id, unnest({_list(['naive', 'local', 'global', 'vector', 'hybrid'])}) AS mode FROM benchmark),
k AS (SELECT *, 'r' || item_id || ',r' || (item_id + 2) AS r, 'u' || item_id || ',u' || (item_id + 1) || ',u' || item_id AS u FROM m)
SELECT item_id, mode, CASE WHEN mode IN ('naive', 'vector', 'hybrid') THEN 'a,b' WHEN mode = 'local' THEN u ELSE '' END AS unit_ids,
  CASE mode WHEN 'local' THEN r WHEN 'global' THEN r || ',' || u ELSE '' END AS community_ids FROM k"""
ORACLE["entity_hits"] = """SELECT n_name, 0.5 AS entity_recall, 'no such|--' AS missing, true AS holds FROM nation"""
ORACLE["community_metrics"] = f"""WITH {REGIONS}, m AS (SELECT *, unnest(['global', 'local', 'naive']) AS mode FROM reports),
x AS (SELECT m.id, m.mode, lower(m.names[1]) AS want, lower(n.title || ' ' || array_to_string(n.names, ' ') || ' ' || n.summary) AS next, lower(m.title || ' ' || array_to_string(m.names, ' ') || ' ' || m.summary) AS own
  FROM m JOIN reports n ON n.seq = (m.seq + 1) % 5)
SELECT id AS query_id, mode, CASE WHEN mode <> 'naive' THEN (CAST(contains(next, want) OR contains(own, want) AS INT) + CAST(contains(next || ' ' || own, 'nowhere') AS INT)) / 2 END AS community_recall,
  CASE WHEN mode <> 'naive' THEN CASE WHEN contains(next, want) THEN 1.0 WHEN contains(own, want) THEN 0.5 ELSE 0.0 END END AS community_mrr FROM x"""
ORACLE["report_documents"] = """WITH s AS (SELECT n_regionkey, 'd' || n_nationkey % 4 AS d, row_number() OVER (PARTITION BY n_regionkey ORDER BY 'nation-' || n_nationkey) AS i FROM nation),
f AS (SELECT n_regionkey, d, min(i) AS i FROM s GROUP BY 1, 2)
SELECT CAST(n_regionkey AS VARCHAR) AS query_id, string_agg(d, ',' ORDER BY i) AS documents FROM f GROUP BY n_regionkey"""
ORACLE["bm25_blocks"] = ORACLE["bm25_search"]
ORACLE["community_planted"] = """WITH m AS (SELECT c_name AS name, c_nationkey AS k FROM customer UNION ALL SELECT n_name, n_nationkey FROM nation)
SELECT name, min(name) OVER (PARTITION BY k) AS head FROM m"""
ORACLE["cosine_pruned"] = ORACLE["cosine_topk"]
ORACLE["local_search"] = f"""WITH {LOCAL_GRAPH}, {EDGE_SCORES}, u AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id AS seq, {LOCAL("coalesce(text, '')")} AS tok, {LOCAL("'Document ' || doc_id")} AS ttok FROM documents),
re AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq, u, v) AS rank FROM sce WHERE score > 0) WHERE rank <= 32),
ch AS (SELECT query_id, name FROM seeds UNION SELECT query_id, u FROM re UNION SELECT query_id, v FROM re),
g AS (SELECT query_id, id, sum(s) AS s FROM (SELECT query_id, unnest(ids) AS id, score AS s FROM re JOIN edges USING (u, v) UNION ALL SELECT query_id, source_ids, 0.5 FROM ch JOIN nodes USING (name) WHERE source_ids <> '') GROUP BY 1, 2),
sc AS (SELECT q.query_id, u.id, seq, round({SCORE('q', 'tok')} + 1.5 * {SCORE('q', 'ttok')} + coalesce(s, 0), 12) AS score FROM u JOIN q ON true LEFT JOIN g ON g.query_id = q.query_id AND g.id = u.id),
rtok AS (SELECT *, {LOCAL("concat_ws(' ', title, array_to_string(names, ' '), summary)")} AS tok FROM reports),
scr AS (SELECT q.query_id, id, seq, round({SCORE('q', 'tok')} + 0.4 * least(5, (SELECT count(*) FROM ch WHERE ch.query_id = q.query_id AND list_contains(names, ch.name))), 12) AS score FROM rtok JOIN q ON true),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq) AS rank, max(score) OVER (PARTITION BY query_id) AS top FROM scr WHERE score > 0),
rs AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq) AS rank, max(score) OVER (PARTITION BY query_id) AS top FROM sc WHERE score > 0)
SELECT query_id, part, id, rank, round(score, 6) AS score FROM (
  SELECT rn.query_id, 'node' AS part, rn.name AS id, rank, score FROM rn JOIN ch ON ch.query_id = rn.query_id AND ch.name = rn.name WHERE rank <= 24 AND score >= 0.75
  UNION ALL SELECT query_id, 'edge', u || ' -- ' || v, rank, score FROM re WHERE score >= 1.0
  UNION ALL SELECT query_id, 'report', id, rank, score FROM rr WHERE rank <= 5 AND score >= greatest(1.5, top * 0.55)
  UNION ALL SELECT query_id, 'source', id, rank, score FROM rs WHERE rank <= 6 AND score >= greatest(2.0, top * 0.20))"""
ORACLE["rrf_duplicates"] = ORACLE["rrf_fusion"]
ORACLE["edge_directions"] = f"WITH {GRAPH} SELECT least(source, target) AS u, greatest(source, target) AS v, arg_min(source, seq) AS first_source, arg_min(target, seq) AS first_target, min(seq) AS seq FROM rel GROUP BY 1, 2"
