"""Byte-level BPE: encoding and decoding with a given vocabulary, exactly.

Method: the vocabulary's byte strings are mapped to Latin-1 and put into a
pyahocorasick automaton, one pass of which gives the longest token that starts at
each byte of a piece. Encoding takes longest matches from left to right and steps
back to a shorter token, or past the last token, whenever two neighbours could not
stand side by side in the result of the merges. That compatibility of two adjacent
tokens is a property of the pair alone and is memoised; a byte from which the rest
of the way back has failed is not entered again, so a piece takes linear time.

Null text counts as empty and gives no ids. Texts of any length are taken whole.
Other columns pass through; an input column named as an output is replaced.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.workers import kept, resting, slices, uncollected
from tessera.runtime import ship, table

#: Distinct pieces and token pairs that a worker remembers before it starts afresh.
PIECE_CACHE, PAIR_CACHE = 100_000, 150_000
#: Hashes by which a worker knows a piece that came before.
SEEN = 1 << 21


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """token -> rank, from lines of base64 and a decimal rank."""
    return {base64.b64decode(tok): int(rank) for tok, rank in (line.split() for line in raw.splitlines() if line)}


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.split = _splitter(regex.compile(pattern).findall, pattern)
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.decimal = {r: str(r) for r in self.bytes_of}
        self.size = {r: len(t) for r, t in self.bytes_of.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces = _Pieces(self)
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if len(token) > 1:
                halves = self._halves(token, rank)
                if halves is None:
                    continue  # no merges lead to it: only a whole piece can be this token
                self.parts[rank] = halves
                self.merged[halves] = rank
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token) - 1))
        self.automaton.make_automaton()
        self.prefix = {r: self._shorter(t) for t, r in ranks.items()}  # the next shorter token that it begins with, or -1

    def _halves(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one, by the merges of lower rank."""
        ranks, parts = self.ranks, [token[i : i + 1] for i in range(len(token))]
        if any(p not in ranks for p in parts):
            return None
        while len(parts) > 2:
            best, at = rank, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1], rank)
                if r < best:
                    best, at = r, i
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return ranks[parts[0]], ranks[parts[1]]

    def _shorter(self, token: bytes) -> int:
        for n in range(len(token) - 1, 0, -1):
            r = self.ranks.get(token[:n])
            if r is not None and (n == 1 or r in self.parts):
                return r
        return -1

    def _fit(self, left: int, right: int) -> bool:
        """Whether the merges can leave left and right side by side.

        Undoing the younger of the two innermost merges in turn gives every pair of
        tokens that met at this border; none may have a merge that comes before the
        one which took either of them away.
        """
        known = self.pairs.get((left, right))
        if known is not None:
            return known
        a, b, until, fits = left, right, 1 << 40, True
        while True:
            if self.merged.get((a, b), until) < until:
                fits = False
                break
            if a > b:  # a is younger: look inside it
                if a not in self.parts:
                    nxt = self.parts.get(b)
                    if nxt is None:
                        break
                    until, b = b + 1, nxt[0]
                else:
                    until, a = a, self.parts[a][1]
            else:
                if b not in self.parts:
                    nxt = self.parts.get(a)
                    if nxt is None:
                        break
                    until, a = a, nxt[1]
                else:
                    until, b = b + 1, self.parts[b][0]
        if len(self.pairs) >= PAIR_CACHE:
            self.pairs.clear()
        self.pairs[(left, right)] = fits
        return fits

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        n = len(piece)
        longest = [-1] * n
        for end, (rank, back) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - back] = rank  # ends only grow, so the last is the longest
        out, pos, last, pairs, size, prefix = [], 0, -1, self.pairs, self.size, self.prefix
        while pos < n:
            token = longest[pos]
            while last >= 0 and token >= 0:
                fits = pairs.get((last, token))
                if fits is None:
                    fits = self._fit(last, token)
                if fits:
                    break
                token = prefix[token]
            if token < 0:
                return self._step_back(n, longest, out, pos)
            out.append(token)
            last = token
            pos += size[token]
        return tuple(out)

    def _step_back(self, n: int, longest: list[int], out: list[int], pos: int) -> tuple[int, ...]:
        """Go on from a dead end at pos: shorten or drop the last token, and try again."""
        size, prefix, open_at, token = self.size, self.prefix, bytearray(b"\1") * (n + 1), -1
        while pos < n:
            last = out[-1] if out else -1
            while token >= 0 and not (open_at[pos + size[token]] and (last < 0 or self._fit(last, token))):
                token = prefix[token]
            if token >= 0:
                out.append(token)
                pos += size[token]
                token = longest[pos] if pos < n else -1
                continue
            open_at[pos] = 0
            if not out:
                raise ValueError("the vocabulary lacks a byte")
            out.pop()
            pos -= size[last]
            token = prefix[last]
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.split(text))))

    def ids_text(self, ids: list[int]) -> str:
        return ",".join(map(self.decimal.__getitem__, ids))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


#: The common pattern, and the same for the standard library's matcher (twice as fast). They agree on texts
#: without the characters of UNLIKE: other numerals than digits, controls that only one counts as space, and
#: all beyond Latin Extended.
COMMON = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
FASTER = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
UNLIKE = r"[\u00b2\u00b3\u00b9\u00bc-\u00be\x1c-\x1f]|[^\x00-\u024f]"


def _splitter(findall, pattern: str):
    if pattern != COMMON:
        return findall
    fast, unlike = re.compile(FASTER).findall, re.compile(UNLIKE).search
    return lambda text: findall(text) if unlike(text) else fast(text)


class _Pieces(dict):
    """The ids of pieces met lately: two generations, so that common pieces stay.

    A piece is taken in when its hash comes again, since most pieces come once and would only take up memory.
    """

    def __init__(self, c: Codec):
        self.encode, self.old, self.seen = c.encode_piece, {}, bytearray(SEEN)

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.old.get(piece)
        if ids is None:
            ids, at = self.encode(piece.encode()), hash(piece) % SEEN
            if not self.seen[at]:
                self.seen[at] = 1
                return ids
        if len(piece) <= 64:
            if len(self) >= PIECE_CACHE:
                self.old, self.seen = dict(self), bytearray(SEEN)
                self.clear()
            self[piece] = ids
        return ids


def codec(raw: bytes, pattern: str) -> Codec:
    """One codec for each vocabulary and Python process, as long as no other operator works there."""
    key, codecs = (hash(raw), pattern), kept("bpe")
    if key not in codecs:
        codecs[key] = Codec(parse_ranks(raw), pattern)
    return codecs[key]


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encode_decode(docs: DataFrame, vocab_path: str | None = None, pattern: str | None = None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs plus n_tokens, ids (decimal, joined by commas) and decoded (binary, from the ids).

    The driver reads the vocabulary file (a bounded size) and sends its bytes to the
    workers, so executors need no copy of it. keep: the columns that pass through
    (all, if None). No shuffle: one pass over the rows, a batch of them in memory.
    """
    spark = docs.sparkSession
    default = default_vocabulary()
    raw = spark.sparkContext.broadcast(read_ranks(vocab_path or default[0]))
    pat = pattern or default[1]
    new = {"n_tokens", "ids", "decoded"}
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]
    sent = docs.select(*(F.col(f"`{c}`") for c in kept), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    schema = T.StructType([f for f in sent.schema if f.name != "__text"] + [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.StringType()), T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(raw.value, pat)
        for batch in batches:
            at = batch.schema.get_field_index("__text")
            texts = batch.column(at)
            rest = [batch.column(i) for i in range(batch.num_columns) if i != at]
            names = [n for n in batch.schema.names if n != "__text"]
            for lo, hi in slices(texts):
                rows, counts, ids_text, decoded = hi - lo, [], [], []
                for x in texts.slice(lo, rows):
                    ids = c.encode(x.as_py())
                    counts.append(len(ids))
                    ids_text.append(c.ids_text(ids))
                    decoded.append(c.decode(ids))
                yield pa.RecordBatch.from_arrays([*(r.slice(lo, rows) for r in rest), pa.array(counts, pa.int64()), pa.array(ids_text, pa.string()), pa.array(decoded, pa.binary())], names=[*names, "n_tokens", "ids", "decoded"])
            del batch, texts, rest  # else they stay while the next batch is read

    ship(spark)
    return sent.mapInArrow(resting(uncollected(run)), schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_decode(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", "n_tokens", F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
