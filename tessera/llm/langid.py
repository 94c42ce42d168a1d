"""Language ID by error-correcting output codes.

Each language has a codeword; a binary classifier over character n-grams predicts
each bit. A text's margins are decoded to the codeword with the least loss, each
bit weighing as much as its classifier is right, and the runner-up's loss tells how
ambiguous the answer is. Up to EXHAUSTIVE languages use every split into two parts
as a bit; more languages use a fixed random code with its rows far apart.

Classifiers are linear in n-gram frequencies, so a word's share of every margin is
worked out once and remembered; texts are scored whole in one pass. The sample for
training is bounded: about per_lang rows of each language, by a hash of doc_id.

Defined results: null text, or text without a letter, is "und" with score 0 and not
ambiguous. Without any labelled language all rows are "und"; with one, all texts
with letters are that one with score 1. Rows of null doc_id are told like any other;
they are not held out. Extra columns pass through; columns named
like the outputs are replaced.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.runtime import ship, table

BUCKETS, EXHAUSTIVE, WORD_CACHE = 4096, 5, 300_000
WORDS = re.compile(r"[^\W\d_]+").findall


def codebook(k: int, seed: int = 0) -> np.ndarray:
    """k codewords of +1 and -1."""
    if k <= EXHAUSTIVE:
        bits = [[1.0 if i in side else -1.0 for i in range(k)] for n in range(k - 1) for side in ({0, *c} for c in combinations(range(1, k), n))]
        return np.array(bits, np.float32).T.reshape(k, -1)
    r, length = np.random.default_rng(seed), int(np.ceil(10 * np.log2(k)))
    tries = [r.choice([-1.0, 1.0], (k, length)) for _ in range(200)]
    apart = lambda c: min((c[i] != c[j]).sum() for i, j in combinations(range(min(k, 64)), 2))
    return np.array(max(tries, key=apart), np.float32)


class _Buckets(dict):
    """n-gram -> bucket, remembered; starts afresh when it has grown large."""

    def __missing__(self, gram: str) -> int:
        if len(self) > WORD_CACHE:
            self.clear()
        b = self[gram] = zlib.crc32(gram.encode("utf-8", "surrogatepass")) % BUCKETS
        return b


_BUCKET_OF = _Buckets()


def word_grams(word: str) -> list[int]:
    """Buckets of the 1- to 4-grams of a word with its ends, letters only; none without a letter."""
    if not word.isalpha():
        word = "".join(filter(str.isalpha, word))
        if not word:
            return []
    w, bucket = f" {word} ", _BUCKET_OF
    return [bucket[w[i : i + n]] for n in (1, 2, 3, 4) for i in range(len(w) - n + 1)]


class Identifier:
    def __init__(self, langs: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.langs, self.code, self.weights, self.bias, self.trust = langs, code, weights, bias, trust
        self._fresh()

    def __getstate__(self):
        return self.langs, self.code, self.weights, self.bias, self.trust

    def __setstate__(self, state):
        self.__init__(*state)

    def _fresh(self) -> None:
        """Forget all words: known has a word's row in shares (sums over its n-grams, and their number)."""
        self.known: dict[str, int] = {}
        self.shares = np.zeros((1024, self.weights.shape[1] + 1))

    def _learn(self, words: set[str]) -> None:
        grams = [word_grams(w) for w in words]
        size = np.array([len(g) for g in grams])
        rows = np.zeros((len(grams), self.shares.shape[1]))
        some = np.flatnonzero(size)
        if len(some):
            flat = self.weights[[b for g in grams for b in g]].astype(np.float64)
            rows[some, :-1] = np.add.reduceat(flat, np.r_[0, np.cumsum(size[some])[:-1]], axis=0)
        rows[:, -1] = size
        at = len(self.known)
        while at + len(rows) > len(self.shares):
            self.shares = np.concatenate([self.shares, np.zeros_like(self.shares)])
        self.shares[at : at + len(rows)] = rows
        self.known.update(zip(words, range(at, at + len(rows)), strict=True))

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, score, ambiguous) of each row of margins."""
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]) @ self.trust
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        best, order = loss.argmin(1), np.sort(p, 1)
        unsure = order[:, -1] - order[:, -2] < 0.2 if p.shape[1] > 1 else np.zeros(len(p), bool)
        return best, p[np.arange(len(p)), best], unsure

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        names, scores, unsure = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        sums = np.zeros((len(texts), self.weights.shape[1] + 1))
        if len(self.known) > WORD_CACHE:
            self._fresh()
        for i, t in enumerate(texts):
            words = WORDS((t or "").lower())
            if words:
                if new := {w for w in words if w not in self.known}:
                    self._learn(new)
                sums[i] = self.shares[list(map(self.known.__getitem__, words))].sum(0)
        some = np.flatnonzero(sums[:, -1] > 0)
        if len(some):
            margins = sums[some, :-1] / sums[some, -1:] + self.bias
            best, s, a = self.decode(margins)
            for i, b in zip(some.tolist(), best.tolist(), strict=True):
                names[i] = self.langs[b]
            scores[some], unsure[some] = s, a
        return names, scores, unsure


def fit(texts: list[str], langs: list[str], steps: int = 200) -> Identifier | None:
    names = sorted(set(langs))
    x, y = [], []
    known: dict[str, list[int]] = {}
    for t, lang in zip(texts, langs, strict=True):
        grams: list[int] = []
        for w in WORDS((t or "").lower()):
            if w not in known:
                known[w] = word_grams(w)
            grams += known[w]
        if grams:
            x.append(np.bincount(grams, minlength=BUCKETS).astype(np.float32) / np.float32(len(grams)))
            y.append(names.index(lang))
    if not x:
        return None
    x, y = np.stack(x), np.array(y)
    code = codebook(len(names))
    if len(names) == 1:
        return Identifier(names, np.ones((1, 1), np.float32), np.zeros((BUCKETS, 1), np.float32), np.zeros(1, np.float32), np.ones(1, np.float32))
    target = (code[y] + 1) / 2
    scale = 1 / (x.std(0) + 1e-4)  # columns of one size; the bias is learned
    w, b = np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    xs = x * scale
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    share = np.bincount(y, minlength=len(names))[y]
    each = (1 / share / len(names)).astype(np.float32)[:, None]
    for step in range(1, steps + 1):
        d = (1 / (1 + np.exp(-(xs @ w + b))) - target) * each
        g, gb = xs.T @ d + 1e-4 * w, d.sum(0)
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        mb += 0.1 * (gb - mb)
        vb += 0.01 * (gb * gb - vb)
        r, q = 1 - 0.9**step, np.float32(1 - 0.99**step)
        w -= np.float32(0.003) * (m / r) / (np.sqrt(v / q) + 1e-6)
        b -= np.float32(0.003) * (mb / r) / (np.sqrt(vb / q) + 1e-6)
    right = np.clip((((xs @ w + b) > 0) == (target > 0.5)).mean(0), 0.5, 0.999)
    trust = np.log(right / (1 - right)) / 2
    return Identifier(names, code, w * scale[:, None].astype(np.float32), b, trust.astype(np.float32))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5; false without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, per_lang: int = 500, usable: Column | None = None) -> Identifier | None:
    """Fit on about per_lang rows of each language (at most 4 * per_lang), by hashed doc_id."""
    rows = docs.where("text is not null and lang is not null")
    if usable is not None:
        rows = rows.where(usable)
    rows = rows.select("doc_id", "lang", "text")
    counts = rows.groupBy("lang").count().collect()  # a row for each language
    if not counts:
        return None
    rate = F.create_map(*(x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, 2 * per_lang / r["count"])))))
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003.0
    got = rows.where(unit < F.try_element_at(rate, F.col("lang"))).orderBy(unit, "doc_id", "text").limit(4 * per_lang * len(counts)).collect()
    taken: dict[str, int] = {}
    kept = [r for r in got if (n := taken.get(r["lang"], 0)) < per_lang and not taken.update({r["lang"]: n + 1})]
    return fit([r["text"] for r in kept], [r["lang"] for r in kept])


def identify(docs: DataFrame, model: Identifier | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs plus lang_pred, lang_score and lang_ambiguous. No shuffle."""
    spark, new = docs.sparkSession, ("lang_pred", "lang_score", "lang_ambiguous")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]
    if model is None:
        return docs.select(*(F.col(f"`{c}`") for c in kept), F.lit("und").alias(new[0]), F.lit(0.0).alias(new[1]), F.lit(False).alias(new[2]))
    sent = spark.sparkContext.broadcast(pickle.dumps(model))  # BUCKETS weights for each bit
    rows = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`").alias("__text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(new[0], T.StringType()), T.StructField(new[1], T.DoubleType()), T.StructField(new[2], T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ident = pickle.loads(sent.value)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                names, s, a = ident.predict(part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns - 1)), pa.array(names, pa.string()), pa.array(s, pa.float64()), pa.array(a, pa.bool_())], names=[*kept, *new])

    ship(spark)
    return rows.mapInArrow(run, schema)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs, usable=~held_out(F.col("doc_id")))
    out = identify(docs, model, keep=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))
