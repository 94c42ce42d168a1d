"""Line dedup: repeated long lines stay only in the largest document that holds them.

Native: DataFrame functions alone. A line's key is the line without ASCII white
space at its ends, A-Z lower-cased; two independent 64-bit hashes stand for it.

1. Documents are read once: occurrences (hash, document, 64-line word, bits) are
   written, so that the bounds of the ranges are sampled from numbers, not from text.
2. They are range-partitioned by hash and document and sorted by hash, document
   (largest first) and position. A hash that fills a third of all rows is spread over
   several ranges, as the document is part of the range key. Each sorted range streams
   its rows once: the first occurrence of a line in a document is flagged, on the
   partitioning and order that are there, with no further shuffle.
3. First occurrences alone are counted; their partial counts combine within a range,
   so a very frequent line leaves one row a range. Lines in enough documents keep
   their first document in that order, the largest.
4. What comes back to the documents is a sparse bitmap of the lines to drop, 64 lines
   a word, never text.

Defined results: null or empty text is one empty line. Rows that share a doc_id
count as one document for the frequency and keep or lose lines alike; rows that
share it with other text are told apart by a hash of the text. A null doc_id is a
document of its own for each different text, below every number; rows of null doc_id
and equal text count once. Extra columns pass through; columns named like the outputs
are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.runtime import partitions, settle, small, table

SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased and nothing else; all-ASCII strings take the faster way."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def _identified(docs: DataFrame, text: str) -> DataFrame:
    """docs plus __lines, __tid (hash of the text) and what tells documents apart, largest first: __none, then __back."""
    t = F.col(f"`{text}`")
    lines = F.split(F.coalesce(t, F.lit("")), "\n", -1)
    back = F.bitwise_not(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(t)))  # falls as doc_id rises, without overflow
    return docs.withColumn("__lines", lines).withColumn("__tid", F.xxhash64(t)).withColumn("__none", F.col("doc_id").isNull().cast("int")).withColumn("__back", back)


def occurrences(docs: DataFrame, min_chars: int = 40, text: str = "text") -> DataFrame:
    """(h1, h2, none, back, tid, pos) of each line with a key of min_chars code points or more."""
    at = _identified(docs, text).select("__none", "__back", "__tid", F.posexplode("__lines").alias("pos", "line"))
    at = at.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
    return at.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.col("key")).alias("h2"), F.col("__none").alias("none"), F.col("__back").alias("back"), F.col("__tid").alias("tid"), "pos")


def streamed(seen: DataFrame) -> DataFrame:
    """seen in sorted ranges of hash and document, plus first: whether the line is met in this document for the first time."""
    ranges = seen.repartitionByRange(partitions(seen.sparkSession), "h1", "h2", "none", "back")
    in_document = Window.partitionBy("h1", "h2", "none", "back").orderBy("tid", "pos")
    return ranges.withColumn("first", F.row_number().over(in_document) == 1)


def drop_bitmaps(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, text: str = "text") -> DataFrame:
    """(none, back, tid, drops): 64-line word number -> bits of the lines to drop, where any are."""
    seen = settle(streamed(settle(occurrences(docs, min_chars, text), "line-hashes")), "line-occurrences")
    least = lambda none: F.min(F.when(F.col("none") == none, F.col("back")))
    first = seen.where("first").groupBy("h1", "h2").agg(F.count("*").alias("n"), least(0).alias("numbered"), least(1).alias("nameless"))
    first = first.where(F.col("n") >= min_docs).select("h1", "h2", F.col("numbered").isNull().cast("int").alias("kn"), F.coalesce("numbered", "nameless").alias("kb"))
    # written, so that beyond the broadcast's bound both sides are plain exchanges, whose hot keys AQE can split
    first = small(settle(first, "line-keepers"))
    lost = seen.join(first, ["h1", "h2"]).where("none <> kn OR back <> kb")
    words = lost.groupBy("none", "back", "tid", F.expr("pos div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    return words.groupBy("none", "back", "tid").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("drops"))


def dedup_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, text: str = "text") -> DataFrame:
    """docs with text reduced to its kept lines, plus n_lines, n_dropped and keep_bitmap.

    keep_bitmap: hexadecimal 64-bit words joined by dots, one for each 64 lines, bit i
    of word w for line 64 w + i; empty where every line stays.
    """
    drops = drop_bitmaps(docs, min_docs, min_chars, text).toDF("__n", "__b", "__t", "__drops")
    new = ("n_lines", "n_dropped", "keep_bitmap")
    kept = [c for c in docs.columns if c not in new]
    d = _identified(docs.select(*(F.col(f"`{c}`") for c in kept)), text)
    d = d.join(drops, (d["__none"] == drops["__n"]) & (d["__back"] == drops["__b"]) & (d["__tid"] == drops["__t"]), "left")
    n = F.size("__lines").cast("long")
    dense = F.expr("transform(sequence(0, (size(__lines) - 1) div 64), w -> coalesce(try_element_at(__drops, int(w)), 0L))")
    d = d.withColumn("__words", F.when(F.col("__drops").isNotNull(), dense))
    out = F.when(F.col("__words").isNull(), F.coalesce(F.col(f"`{text}`"), F.lit(""))).otherwise(F.expr("array_join(filter(__lines, (x, i) -> getbit(element_at(__words, int(i div 64 + 1)), i % 64) = 0), '\n')"))
    lost = F.coalesce(F.expr("aggregate(__words, 0L, (a, w) -> a + bit_count(w))"), F.lit(0).cast("long"))
    words = F.coalesce(F.expr("array_join(transform(__words, (w, i) -> lower(hex(~w & if(i < (size(__lines) - 1) div 64 or size(__lines) % 64 = 0, -1L, shiftleft(1L, size(__lines) % 64) - 1L)))), '.')"), F.lit(""))
    return d.select(*(out.alias(text) if c == text else F.col(f"`{c}`") for c in kept), n.alias("n_lines"), lost.alias("n_dropped"), words.alias("keep_bitmap"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = """
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
hot AS (SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT l.doc_id, l.i, l.line, h.key IS NOT NULL AND l.doc_id <> h.keeper AS lost FROM lines l LEFT JOIN hot h ON l.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
