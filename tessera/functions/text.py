"""Text functions as Column builders."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words of the two tokenizers, and the query expansions.
STOP_COMMON = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "to", "of", "for", "in", "on", "with", "and", "or", "by", "from",
    "how", "what", "why", "which", "who", "where", "when", "can", "could", "should", "would", "about",
)
STOP_LOCAL = (*STOP_COMMON, "main", "repo", "repository", "issue", "issues", "technical", "contribution", "opportunities")
EXPANSIONS = {
    "graph": ["graph", "graph-rag", "graph_rag", "graphrag"],
    "rag": ["rag", "graph-rag", "document-rag", "graph_rag", "document_rag"],
    "graph-rag": ["graph-rag", "graph_rag", "graph", "rag"],
    "document-rag": ["document-rag", "document_rag", "document", "rag"],
    "hybrid": ["hybrid", "bm25", "tfidf", "tf-idf", "rrf", "vector"],
    "retrieval": ["retrieval", "rag", "search", "ranking", "reranking"],
    "kafka": ["kafka", "consumer", "producer", "unsubscribe", "offset", "pubsub"],
    "slow": ["slow", "latency", "round-trip", "roundtrips", "pulsar", "memgraph"],
}
#: All characters that count as white space in Unicode, as a character class.
SPACE = r"[\s\x1c-\x1f\x85\xa0  -     　]"
#: The same characters one by one.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# What a token is, and what separates its parts.
TOKEN, SEPARATORS = r"[a-z0-9][a-z0-9_\-.]*", r"[_\-.]+"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def words_array(words) -> Column:
    return F.array(*map(F.lit, words))


def strip(c: Column) -> Column:
    """Without white space at the ends."""
    return F.btrim(_text(c), F.lit(WHITE))


def strip_ends(c: Column) -> Column:
    """As strip, of a column or an array's element: btrim walks through the whole text, so only texts with white space at an end get to it."""
    return F.when(reduce(or_, (f(c, F.lit(w)) for w in WHITE for f in (F.startswith, F.endswith))), strip(c)).otherwise(_text(c))


def collapse(c: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.btrim(F.regexp_replace(_text(c), f"{SPACE}+", " "))


def shorten(c: Column, limit: int = 900) -> Column:
    t = collapse(c)
    return F.when(F.char_length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, limit - 3), F.lit("...")))


def stable_id(*parts: Column) -> Column:
    return F.md5(F.concat_ws("::", *(_text(p.cast("string")) for p in parts)))


def raw_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(_text(c)), F.lit(TOKEN), F.lit(0))


def _whole(token: Column) -> Column:
    """Whether a token has no separator, so that no pattern has to split it."""
    return F.translate(token, "_-.", "") == token


def bm25_tokens(c: Column) -> Column:
    """Tokens and their parts, with repeats: a token without separators stands twice."""
    both = F.flatten(F.transform(raw_tokens(c), lambda t: F.when(_whole(t), F.array(t, t)).otherwise(F.concat(F.array(t), F.split(t, SEPARATORS)))))
    return F.filter(both, lambda w: (w != "") & ~w.isin(*STOP_COMMON))


def local_tokens(c: Column) -> Column:
    """Distinct tokens, their parts and one level of expansions; a stop word's parts are left out with it."""
    kept = F.filter(raw_tokens(c), lambda t: ~t.isin(*STOP_LOCAL))
    both = F.flatten(F.transform(kept, lambda t: F.when(_whole(t), F.array(t)).otherwise(F.concat(F.array(t), F.split(t, SEPARATORS)))))
    words = F.array_distinct(F.filter(both, lambda w: (w != "") & ~w.isin(*STOP_LOCAL)))
    more = F.create_map(*(x for k, v in EXPANSIONS.items() for x in (F.lit(k), words_array(v))))
    grow = lambda p: F.array_union(p, F.flatten(F.transform(F.filter(p, lambda w: w.isin(*EXPANSIONS)), lambda w: F.try_element_at(more, w))))
    return F.element_at(F.transform(F.array(words), grow), 1)  # bound, so that the words are worked out once


def overlap_score(query: Column, tokens: Column) -> Column:
    """Shared tokens over the root of the query's; 0 if either has none."""
    shared = F.size(F.array_intersect(query, tokens)).cast("double")
    return F.when(F.size(query) > 0, shared / F.sqrt(F.size(query).cast("double"))).otherwise(0.0)


def normalize(c: Column) -> Column:
    """Lower-case letters and digits (ASCII) in runs, joined by one space."""
    return F.array_join(F.regexp_extract_all(F.lower(_text(c)), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def contains_term(text: Column, term: Column) -> Column:
    n = normalize(term)
    return (F.char_length(n) > 0) & F.contains(normalize(text), n)


def section(context: Column, start: str, end: str | None = None) -> Column:
    """What stands between the first start and the next end; empty without a start."""
    at = F.instr(context, start)
    rest = context.substr(at + F.lit(len(start)), F.char_length(context))
    if end is not None:
        to = F.instr(rest, end)
        rest = F.when(to > 0, rest.substr(F.lit(1), to - 1)).otherwise(rest)
    return F.when(at > 0, rest).otherwise(F.lit(""))


def bracketed_ids(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?m)^\[([^\]]+)\]"), F.lit(1))


def unique(values: Column) -> Column:
    """Distinct values in order of first appearance, without null and empty ones."""
    return F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "")))
