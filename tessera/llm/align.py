"""Alignment of two tokenizers' tokens by the bytes that they cover.

Every text is encoded by A (byte-level BPE, with a blank in front) and by B (pieces, which puts one there itself). A
label string with one character for each byte says whether no token, one of A, one of B or one of both ends there;
a regular expression scans it for spans up to each both-label, and the labels of a span count the tokens of a group.
Within a group the tokens of A and B that overlap are linked.

Both tokenizers start anew where blanks or line ends follow other characters, so a text is cut there into
segments, which are encoded alike wherever they stand; each worker remembers the ids of a bounded number of
segments. Texts in which other white space or the mark of a blank stands before such a place are taken in one segment.

Corpus-wide counts of linked id pairs: a document's pairs are counted in its own row first, then added up over all
documents. The pairs that make up more than 1 / HOT of all links are fewer than HOT, whatever the corpus, so they are
broadcast and meet the documents' pairs without a shuffle; only links of rarer pairs, none of which is frequent
enough to fill a task, are shuffled to their counts.

Defined results: texts that are null or empty, or whose tokens do not spell the blank and the text (a literal mark
of a blank, for B), have no tokens: zeros, an empty group text and digest, and no part in the counts. Rows that share
a doc_id, or have none, are rows of their own; repeated rows count each time. Extra columns pass through, unless
named like an output. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.bpe import COMMON
from tessera.llm.workers import kept, resting, slices
from tessera.runtime import settle, ship, table

#: Segments, and label spans, that a worker remembers before it starts afresh; the longest span in bytes.
REMEMBERED, LONGEST = 150_000, 48
#: Pairs that are broadcast are fewer than this.
HOT = 200_000
#: Text of a step in bytes.
STEP = 1 << 20

NONE, A_END, B_END, BOTH = b".", b"a", b"b", b"|"
GROUP = re.compile(rb"[^|]*\|")
#: Where both tokenizers start anew: at white space of these kinds after anything but what UNSURE has before it.
SEGMENT = re.compile(r"[ \n\t]+[^ \n\t]*")
UNSURE = re.compile("[\x00-\x08\x0b-\x1f\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u2581\u3000\ufeff][ \n\t]")

#: Segments that are encoded by themselves: their ends are no such places, or they hold characters on whose kind Unicode versions may differ.
ODD = re.compile("[ \n\t\x00-\x1f\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u2581\u3000\ufeff]\\Z|[^\x00-\u024f]")


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers, from their files' contents, with the bytes of every token."""

    def __init__(self, a: bytes, b: bytes):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        self.a = Tokenizer.from_str(a.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        bytes_of = byte_of_char()
        special = {x["id"]: x["content"].encode() for x in json.loads(a).get("added_tokens", [])}
        vocabulary = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [special[i] if i in special else bytes(bytes_of[c] for c in vocabulary.get(i, "")) for i in range(max(vocabulary) + 1)]
        pieces = [(self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if one else p.replace("\u2581", " ").encode() for p, one in pieces]
        self.blank = self.b.piece_to_id("\u2581")
        # pieces that hold a blank after, or a line end beside, anything else would cross segments
        self.cuts = not any(re.search("[^\u2581]\u2581|.[\n\t]|[\n\t].", p, re.DOTALL) for p, one in pieces if not one)

        # the same merges for the faster of two libraries: a token's id is its rank
        by_rank = {x: i for i, x in enumerate(self.a_bytes) if i not in special and x}
        pattern, merges = str(COMMON), json.loads(a)["model"]["merges"]
        ranked = all(self.a.token_to_id("".join(m.split(" ") if isinstance(m, str) else m)) == i for i, m in enumerate(merges, len(bytes_of)))
        plain = json.loads(a)["pre_tokenizer"] | {"trim_offsets": True} == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.quick = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=by_rank, special_tokens={}) if ranked and plain else None

    def encode_joined(self, segments: list[str], step: int = 256) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """For A and B, all ids and their number for each segment, encoded as texts of `step` segments; None if they do not end where the segments do."""
        texts = [" x" + "".join(segments[i : i + step]) for i in range(0, len(segments), step)]  # the first segment begins with the blank
        size = np.array([len(s) if s.isascii() else len(s.encode()) for s in segments])
        starts = np.arange(0, len(segments), step)
        till = np.cumsum(np.insert(size, starts, 2))
        first = starts + np.arange(len(starts))  # the places of the texts' own starts among the segments
        a = map(self.quick.encode_ordinary, texts) if self.quick else (e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False))
        out, raw = [], "".join(texts).encode()
        for lists, by in ((a, self.a_bytes), (self.b.encode([t[1:] for t in texts], num_threads=1), self.b_bytes)):
            ids = list(chain.from_iterable(lists))
            spelled = list(map(by.__getitem__, ids))
            ends = np.cumsum(list(map(len, spelled)))
            at = np.searchsorted(ends, till)
            if b"".join(spelled) != raw or (ends[at] != till).any():
                return None
            n = np.diff(at + 1, prepend=0)
            keep = np.repeat(~np.isin(np.arange(len(n)), first), n)
            out.append((np.array(ids, np.int32)[keep], np.delete(n, first)))
        return out

    def encode(self, segments: list[str]) -> list[tuple[list[int], list[int]]]:
        """(A's ids, B's ids) of each segment; a text's first segment begins with a blank."""
        a = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        b = self.b.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        for i, s in enumerate(segments):
            if s == " ":
                b[i] = [self.blank]
            elif s[0] != " ":  # B has put its blank before a line end, where none stands
                b[i] = b[i][1:] if b[i][:1] == [self.blank] else []
        return list(zip(a, b, strict=True))


def labels(a_sizes: np.ndarray, b_sizes: np.ndarray) -> np.ndarray:
    """A label for each byte of what both lists of token sizes cover."""
    out = np.full(int(a_sizes.sum()), NONE[0], np.uint8)
    out[np.cumsum(a_sizes) - 1] = A_END[0]
    at = np.cumsum(b_sizes) - 1
    out[at] = np.where(out[at] == A_END[0], BOTH[0], B_END[0])
    return out


class _Spans(dict):
    """The label counts of the spans met so far: tokens of A and, in the lower half, of B."""

    def __missing__(self, span: bytes) -> int:
        n = (span.count(A_END) + 1 << 32) + span.count(B_END) + 1
        if len(span) <= LONGEST and len(self) < REMEMBERED:
            self[span] = n
        return n


def groups(label: np.ndarray, known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of A and of B in each group: the spans up to a both-label."""
    n = np.fromiter(map(known.__getitem__, GROUP.findall(label.tobytes())), np.int64)
    return n >> 32, n & 0xFFFFFFFF


def links(label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(end, place in A, place in B) of overlapping tokens: a pair's common bytes end where one of them ends, and no other pair's there."""
    at = np.flatnonzero(label != NONE[0])
    kind = label[at]
    a, b = kind != B_END[0], kind != A_END[0]
    return at, np.cumsum(a) - a, np.cumsum(b) - b


class _Ids:
    """Token ids of many segments in one array."""

    def __init__(self):
        self.ids, self.used, self.start, self.n = np.zeros(1 << 16, np.int32), 0, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, n: np.ndarray) -> None:
        """ids of further segments, n of each."""
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(len(self.ids), len(ids)), np.int32)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.start = np.concatenate([self.start, self.used + np.cumsum(n) - n])
        self.n = np.concatenate([self.n, n])
        self.used += len(ids)

    def of(self, slots: np.ndarray) -> np.ndarray:
        """The ids of these segments, one after the other."""
        n = self.n[slots]
        return self.ids[np.repeat(self.start[slots] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]


class Aligner:
    """Aligns texts slice by slice; the ids of segments met before are at hand, by a number for each."""

    def __init__(self, t: Tokenizers):
        self.t, self.width, self.spans = t, len(t.b_bytes), _Spans()
        self.sizes = [np.array([len(x) for x in by], np.int64) for by in (t.a_bytes, t.b_bytes)]
        strings = lambda n, end: np.array([f"{i}{end}" for i in range(n)], object)
        self.inner, self.last = [strings(len(x), ",") for x in self.sizes], [strings(len(x), end) for x, end in zip(self.sizes, "|;", strict=True)]
        self._forget()

    def _forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.ids, self.fit = [_Ids(), _Ids()], np.zeros(0, bool)

    def _learn(self, new: list[str]) -> None:
        """Encode segments: those that may stand in any text as one text, the others each by itself."""
        plain = [s for s in new if not ODD.search(s)]
        told = self.t.encode_joined(plain) if plain else None
        if told is None:
            plain = []
        else:
            for own, (ids, n) in zip(self.ids, told, strict=True):
                own.add(ids, n)
        known = set(plain)
        single = [s for s in new if s not in known]
        fit = np.ones(len(new), bool)
        for i, (s, pair) in enumerate(zip(single, self.t.encode(single) if single else [], strict=True), len(plain)):
            raw = s.encode()
            fit[i] = all(b"".join(map(by.__getitem__, ids)) == raw for by, ids in zip((self.t.a_bytes, self.t.b_bytes), pair, strict=True))
            for own, ids in zip(self.ids, pair, strict=True):
                own.add(np.array(ids, np.int32), np.array([len(ids)]))
        self.fit = np.concatenate([self.fit, fit])
        self.slot |= zip(plain + single, range(len(self.slot), len(self.slot) + len(new)), strict=True)

    def segments(self, text: str) -> list[str]:
        """The segments of a text with its blank in front."""
        spaced = " " + text
        return SEGMENT.findall(spaced) if self.t.cuts and not UNSURE.search(spaced) else [spaced]

    def _slots(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, slot) of all segments of texts whose tokens spell them."""
        if len(self.slot) > REMEMBERED:
            self._forget()
        cut = [self.segments(t) if t else [] for t in texts]
        if new := list({s: None for segments in cut for s in segments if s not in self.slot}):
            self._learn(new)
        slots = np.fromiter(map(self.slot.__getitem__, chain.from_iterable(cut)), np.int64)
        text = np.repeat(np.arange(len(texts)), list(map(len, cut)))
        wrong = np.bincount(text, ~self.fit[slots], len(texts)) > 0
        return text[~wrong[text]], slots[~wrong[text]]

    def columns(self, texts: list[str], digest=lambda g: g) -> list[pa.Array]:
        """n_a, n_b, n_groups, n_links, digest of the groups' text, sorted pair codes, their counts."""
        count, (text, slots) = len(texts), self._slots(texts)
        a, b = (own.of(slots) for own in self.ids)
        n_a, n_b = (np.bincount(text, own.n[slots], count).astype(np.int64) for own in self.ids)
        label = labels(self.sizes[0][a], self.sizes[1][b])
        ends = np.concatenate([[0], np.cumsum(self.sizes[0][a])])[np.cumsum(n_a)]  # in bytes, of each text
        of_a, of_b = groups(label, self.spans)
        n_groups = np.diff(np.searchsorted(np.flatnonzero(label == BOTH[0]), ends), prepend=0)
        # the groups' texts: each token with what follows it, A's of a group before B's
        out = np.empty(len(a) + len(b), object)
        told = self.inner[0][a]
        last = np.cumsum(of_a) - 1
        told[last] = self.last[0][a[last]]
        out[np.arange(len(a)) + np.repeat(np.cumsum(of_b) - of_b, of_a)] = told
        told = self.inner[1][b]
        last = np.cumsum(of_b) - 1
        told[last] = self.last[1][b[last]]
        out[np.arange(len(b)) + np.repeat(np.cumsum(of_a), of_b)] = told
        till = np.cumsum(n_a + n_b).tolist()
        told = [digest("".join(out[lo:hi].tolist())[:-1]) if hi > lo else "" for lo, hi in zip([0, *till], till)]
        # linked pairs, counted for each text
        at, i, j = links(label)
        whose = np.searchsorted(ends, at, "right")
        n_links = np.bincount(whose, minlength=count)
        key, times = np.unique((whose << 40) | (a[i].astype(np.int64) * self.width + b[j]), return_counts=True)
        offsets = pa.array(np.searchsorted(key >> 40, np.arange(count + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int64))) for x in (key & (1 << 40) - 1, times)]
        return [*(pa.array(x.astype(np.int64)) for x in (n_a, n_b, n_groups, n_links)), pa.array(told, pa.string()), *lists]


def aligner(a: bytes, b: bytes) -> Aligner:
    """One for each pair of vocabularies and Python process, as long as no other operator works there."""
    key, held = (hash(a), hash(b)), kept("align")
    if key not in held:
        held[key] = Aligner(Tokenizers(a, b))
    return held[key]


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def tokens(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, text: str = "text", groups_as: str = "text") -> DataFrame:
    """docs without text plus n_a, n_b, n_groups, n_links, groups, codes and counts (linked id pairs as a * width + b).

    groups_as: "text" (ids of A, a bar, ids of B; groups apart by semicolons) or "sha256" (its digest, '' without
    tokens). The driver reads the vocabulary files, of bounded size, and sends their bytes to the workers.
    """
    spark, default = docs.sparkSession, default_vocabularies()
    files = []
    for path in (a_path or default[0], b_path or default[1]):
        with open(path, "rb") as f:
            files.append(f.read())
    sent_files = spark.sparkContext.broadcast(tuple(files))
    new = {"n_a": T.LongType(), "n_b": T.LongType(), "n_groups": T.LongType(), "n_links": T.LongType(), "groups": T.StringType(), "codes": T.ArrayType(T.LongType()), "counts": T.ArrayType(T.LongType())}
    sent = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in new and c != text), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    schema = T.StructType([f for f in sent.schema if f.name != "__text"] + [T.StructField(k, v) for k, v in new.items()])

    digest = (lambda g: hashlib.sha256(g.encode()).hexdigest()) if groups_as == "sha256" else (lambda g: g)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligned = aligner(*sent_files.value)
        for batch in batches:
            at = batch.schema.get_field_index("__text")
            texts = batch.column(at)
            rest = [batch.column(i) for i in range(batch.num_columns) if i != at]
            for lo, hi in slices(texts, STEP):
                found = aligned.columns(texts.slice(lo, hi - lo).to_pylist(), digest)
                yield pa.RecordBatch.from_arrays([*(r.slice(lo, hi - lo) for r in rest), *found], names=schema.names)
            del batch, texts, rest

    ship(spark)
    return sent.mapInArrow(resting(run), schema)


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """(code, count, best): links that hold each id pair, and whether no pair with the same id of B has more."""
    pairs = aligned.select(F.explode(F.arrays_zip("codes", "counts")).alias("p")).groupBy(F.col("p.codes").alias("code")).agg(F.sum("p.counts").alias("count"))
    pairs = settle(pairs, "pairs")
    most = pairs.groupBy((F.col("code") % width).alias("b")).agg(F.max("count").alias("most"))
    return settle(pairs.join(most, F.col("code") % width == F.col("b")).select("code", "count", (F.col("count") == F.col("most")).alias("best")), "pair-counts")


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, text: str = "text", groups_as: str = "text") -> DataFrame:
    """docs without text plus n_a, n_b, n_groups, n_links, n_best, count_sum and groups.

    n_best: links whose pair has the highest count of all pairs with its id of B; count_sum: the counts of all
    links' pairs, added up.
    """
    import sentencepiece

    width = sentencepiece.SentencePieceProcessor(model_file=b_path or default_vocabularies()[1]).get_piece_size()
    own = docs.drop("n_best", "count_sum")
    held = settle(tokens(own, a_path, b_path, text, groups_as).withColumn("__row", F.monotonically_increasing_id()), "aligned")
    counts = pair_counts(held, width)
    total = counts.agg(F.sum("count")).first()[0] or 0
    # more than total / HOT links each: fewer than HOT pairs, by arithmetic
    hot, rare = F.broadcast(counts.where(F.col("count") * HOT > total)), counts.where(F.col("count") * HOT <= total)
    links_ = held.select("__row", F.explode(F.arrays_zip("codes", "counts")).alias("p")).select("__row", F.col("p.codes").alias("code"), F.col("p.counts").alias("k"))
    sums = [F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("n_best"), F.sum(F.col("k") * F.col("count")).alias("count_sum")]
    common = links_.join(hot, "code").groupBy("__row").agg(*sums)
    others = links_.join(hot, "code", "left_anti").join(rare, "code").groupBy("__row").agg(*sums)
    added = common.unionByName(others).groupBy("__row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = held.drop("codes", "counts").join(added, "__row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(*(F.col(f"`{c}`") for c in held.columns if c not in ("codes", "counts", "__row", "groups")), zero("n_best"), zero("count_sum"), "groups")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = align(table(spark, sf_dir, "documents").select("doc_id", "text"), groups_as="sha256")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
