"""Toxicity: a bidirectional gated recurrent network with attention pooling.

Inputs are characters and words. A word's letters are read as a sequence by a
bidirectional GRU over learned letter vectors, whose states attention pools into the
word's character input; a word longer than PIECE letters is read in overlapping pieces,
whose inputs are averaged. Beside it stand the log-odds of the word itself and of its
character n-grams (3 to 6, with word ends), learned from document frequencies. A second
bidirectional GRU reads every overlapping window of a text, attention pools its states,
and the document's score is that of its highest window. Both levels are trained as one
in numpy, by multiple-instance learning: in each round the windows that score highest
now stand for their documents. The log-odds that the network sees while it trains come
from the other half of the sample.

The training sample is bounded: at most per_class rows of each label, those with
the smallest hash of doc_id; the intercept is corrected for the classes' true
shares, which are counted over all labelled rows. Scoring covers whole texts.

Defined results: null text and texts without a letter or digit score 0. Labels with
a null, or for documents that are absent, are left out; repeated labels of a
document count as often as they stand. Without both classes every score is 0. Rows of
null doc_id are scored like any other and are not held out.
Extra columns pass through; columns named like the outputs are replaced.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.workers import kept as held
from tessera.llm.workers import release, slices
from tessera.runtime import ship, table

WINDOW, STRIDE, HIDDEN, ODDS, BATCH = 48, 24, 8, 4, 256
LETTERS, EMBED, LETTER_HIDDEN, LETTER_OUT, PIECE = 128, 6, 6, 4, 32
FEATURES = ODDS + LETTER_OUT
WORDS = re.compile(r"[^\W_]+").findall
#: Distinct words that a worker remembers before it starts afresh.
WORD_CACHE = 200_000
#: New words whose inputs are worked out at once.
LEARN = 8192
#: Words of texts that are scored at once. A worker starts afresh after them, so it may have as many words more.
ROOM = 200_000


def grams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + n] for n in (3, 4, 5, 6) for i in range(len(w) - n + 1)]


class LogOdds:
    """Smoothed log-odds of words and of their character n-grams, by document."""

    def __init__(self, docs: list[list[str]], toxic: np.ndarray, keep: int = 200_000):
        w, g = ({0: Counter(), 1: Counter()} for _ in range(2))
        for d, y in zip(docs, toxic, strict=True):
            own = set(d)
            w[int(y)].update(own)
            g[int(y)].update({x for u in own for x in grams(u)})
        n1, n0 = int(toxic.sum()), int((1 - toxic).sum())
        self.words, self.grams = self._table(w, n1, n0, keep), self._table(g, n1, n0, keep)

    @staticmethod
    def _table(c: dict[int, Counter], n1: int, n0: int, keep: int) -> dict[str, float]:
        out = {}
        for x in c[0].keys() | c[1].keys():
            a, b = c[1][x], c[0][x]
            if a + b >= 4:
                s = float(np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1))) * (a + b) / (a + b + 4)
                if abs(s) > 0.3:
                    out[x] = s
        return dict(sorted(out.items(), key=lambda kv: (-abs(kv[1]), kv[0]))[:keep])

    def __getstate__(self):
        return self.words, self.grams

    def __setstate__(self, state):
        self.words, self.grams = state

    @cached_property
    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for x, v in self.grams.items():
            a.add_word(x, v)
        a.make_automaton()
        return a

    def features(self, words: list[str]) -> np.ndarray:
        """(word, ODDS): a word's own log-odds, and the largest, mean and least of its n-grams', unknown ones counting 0.

        One automaton finds the known n-grams of all words, laid end to end: none of them spans two words.
        """
        out = np.zeros((len(words), ODDS))
        out[:, 0] = [self.words.get(w, 0.0) for w in words]
        hits = list(self.automaton.iter("".join(f"^{w}$" for w in words))) if self.grams and words else []
        if hits:
            size = np.array([len(w) for w in words]) + 2
            total = sum(np.maximum(size - n + 1, 0) for n in (3, 4, 5, 6))
            end, v = (np.array(x) for x in zip(*hits, strict=True))
            owner = np.searchsorted(np.cumsum(size), end, "right")
            some = np.bincount(owner, minlength=len(words))
            most, least = np.full(len(words), -np.inf), np.full(len(words), np.inf)
            np.maximum.at(most, owner, v)
            np.minimum.at(least, owner, v)
            part = (some < total) | (total == 0)  # some n-gram is unknown, or there is none
            out[:, 1], out[:, 3] = np.where(part, np.maximum(most, 0), most), np.where(part, np.minimum(least, 0), least)
            out[:, 2] = np.bincount(owner, v, len(words)) / np.maximum(total, 1)
        return out


def windows(n: int) -> list[tuple[int, int]]:
    """Overlapping (from, to) ranges that cover n words."""
    return [(lo, min(lo + WINDOW, n)) for lo in range(0, max(n - STRIDE, 1), STRIDE)] if n else []


def cut(rows: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (windows, WINDOW) into rows, with row 0 as padding, and the mask."""
    at = starts[:, :1] + np.arange(WINDOW)[None, :]
    mask = at < starts[:, 1:]
    return np.where(mask, rows[np.minimum(at, max(len(rows) - 1, 0))], 0), mask


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


def _read(gx: np.ndarray, U: np.ndarray, backward: bool, active: np.ndarray | None = None, mask: np.ndarray | None = None):
    """States (time, row, hidden) of a GRU over input terms gx (time, row, 3 * hidden), and what its gradients need.

    active: the number of leading rows that have a step at each time; mask: 0 where a row has none.
    """
    t_all, n_all, wide = gx.shape
    hidden = wide // 3
    h, states, steps = np.zeros((n_all, hidden), np.float32), np.zeros((t_all, n_all, hidden), np.float32), []
    for t in range(t_all - 1, -1, -1) if backward else range(t_all):
        n = n_all if active is None else int(active[t])
        g, was = gx[t, :n], h[:n]
        gh = was @ U
        zr = _sigmoid(g[:, : 2 * hidden] + gh[:, : 2 * hidden])
        z, r = zr[:, :hidden], zr[:, hidden:]
        cand = np.tanh(g[:, 2 * hidden :] + r * gh[:, 2 * hidden :])
        new = cand + z * (was - cand)
        if mask is not None:
            new *= mask[t][:, None]
        steps.append((t, n, was, z, r, cand, gh[:, 2 * hidden :]))
        h = new if n == n_all else np.concatenate([new, h[n:]])
        states[t, :n] = new
    return states, steps


def _unread(steps: list, ds: np.ndarray, U: np.ndarray, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of a GRU's input terms and of U, from those of its states."""
    t_all, n_all, hidden = ds.shape
    dgx, dU, back = np.zeros((t_all, n_all, 3 * hidden), np.float32), np.zeros_like(U), np.zeros((n_all, hidden), np.float32)
    for t, n, was, z, r, cand, hn in reversed(steps):
        dh = back[:n] + ds[t, :n]
        if mask is not None:
            dh *= mask[t][:, None]
        dc = dh * (1 - z) * (1 - cand * cand)
        dzr = np.concatenate([dh * (was - cand) * z * (1 - z), dc * hn * r * (1 - r)], 1)
        dgx[t, :n, : 2 * hidden], dgx[t, :n, 2 * hidden :] = dzr, dc
        dgh = np.concatenate([dzr, dc * r], 1)
        dU += was.T @ dgh
        back[:n] = dh * z + dgh @ U.T
    return dgx, dU


def _gather(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by their place, of n."""
    return np.stack([np.bincount(at, rows[:, k], n) for k in range(rows.shape[1])], 1).astype(np.float32)


class Network:
    """Two levels of bidirectional GRUs with attention: letters to a word's input, words to one logit a window."""

    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        init = lambda *s: (r.standard_normal(s) * 0.3).astype(np.float32)
        self.p = {f"{d}{k}": v for d in "fb" for k, v in (("W", init(FEATURES, 3 * HIDDEN)), ("U", init(HIDDEN, 3 * HIDDEN)), ("c", np.zeros(3 * HIDDEN, np.float32)), ("a", init(HIDDEN)), ("o", init(HIDDEN)))}
        self.p |= {f"{d}{k}": v for d in "lr" for k, v in (("W", init(EMBED, 3 * LETTER_HIDDEN)), ("U", init(LETTER_HIDDEN, 3 * LETTER_HIDDEN)), ("c", np.zeros(3 * LETTER_HIDDEN, np.float32)))}
        self.p |= {"embed": init(LETTERS, EMBED), "pool": init(2 * LETTER_HIDDEN), "out": init(2 * LETTER_HIDDEN, LETTER_OUT), "bias": np.zeros(1, np.float32)}
        self.shift = 0.0

    def letters(self, words: list[str]):
        """(word, LETTER_OUT) character inputs, and what their gradients need. Pieces of about one length are read together."""
        pieces = [(i, w[lo : lo + PIECE]) for i, w in enumerate(words) for lo in range(0, max(len(w) - PIECE // 2, 1), PIECE // 2) if w]
        found, kept = np.zeros((len(words), LETTER_OUT), np.float32), []
        if not pieces:
            return found, kept
        size = np.array([len(x) for _, x in pieces])
        owner = np.array([i for i, _ in pieces])
        share = (1 / np.bincount(owner, minlength=len(words)).clip(1))[owner].astype(np.float32)[:, None]
        flat = (np.frombuffer("".join(x for _, x in pieces).encode("utf-32-le", "surrogatepass"), np.uint32) % (LETTERS - 1) + 1).astype(np.int64)
        begin = np.cumsum(size) - size
        p = self.p
        for least, most in ((0, 4), (4, 7), (7, 11), (11, PIECE)):
            at = np.flatnonzero((size > least) & (size <= most))
            if not len(at):
                continue
            at = at[np.argsort(-size[at], kind="stable")]  # longest first, so each step works on those that still have a letter
            n = size[at]
            has = np.arange(n[0])[:, None] < n[None, :]
            ids = np.where(has, flat[np.minimum(begin[at][None, :] + np.arange(n[0])[:, None], len(flat) - 1)], 0)
            active, x = has.sum(1), p["embed"][ids]
            table = {d: p["embed"] @ p[d + "W"] + p[d + "c"] for d in "lr"}
            (sl, kl), (sr, kr) = (_read(table[d][ids], p[d + "U"], d == "r", active) for d in "lr")
            states = np.concatenate([sl, sr], 2)
            e = np.where(has, states @ p["pool"], np.float32(-1e9))
            w = np.exp(e - e.max(0)) * has
            w /= w.sum(0)
            pooled = (w[:, :, None] * states).sum(0)
            found += _gather(owner[at], (pooled @ p["out"]) * share[at], len(words))
            kept.append((ids, x, states, w, pooled, owner[at], share[at], kl, kr))
        return found, kept

    def _letters_back(self, kept: list, d: np.ndarray, g: dict[str, np.ndarray]) -> None:
        for ids, x, states, w, pooled, owner, share, kl, kr in kept:
            p, own = self.p, d[owner] * share
            g["out"] += pooled.T @ own
            dp = own @ p["out"].T
            s = np.einsum("tnk,nk->tn", states, dp)
            de = w * (s - (w * s).sum(0))
            g["pool"] += np.einsum("tn,tnk->k", de, states)
            ds = w[:, :, None] * dp[None] + de[:, :, None] * p["pool"]
            dx = np.zeros_like(x)
            for k, steps, part in (("l", kl, ds[:, :, :LETTER_HIDDEN]), ("r", kr, ds[:, :, LETTER_HIDDEN:])):
                dgx, dU = _unread(steps, part, p[k + "U"])
                g[k + "U"] += dU
                g[k + "W"] += x.reshape(-1, EMBED).T @ dgx.reshape(-1, dgx.shape[2])
                g[k + "c"] += dgx.sum((0, 1))
                dx += dgx @ p[k + "W"].T
            g["embed"] += _gather(ids.ravel(), dx.reshape(-1, EMBED), LETTERS)

    def terms(self, odds: np.ndarray, words: list[str]) -> np.ndarray:
        """(2, row, 3 * HIDDEN): the input terms of both word GRUs, worked out once a word."""
        out = np.empty((2, len(words), 3 * HIDDEN), np.float32)
        for lo in range(0, len(words), 8192):
            x = np.concatenate([odds[lo : lo + 8192], self.letters(words[lo : lo + 8192])[0]], 1).astype(np.float32)
            for i, d in enumerate("fb"):
                out[i, lo : lo + 8192] = x @ self.p[d + "W"] + self.p[d + "c"]
        return out

    def logits(self, terms: np.ndarray, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """A logit for each window; ids, mask: (window, WINDOW), ids of rows of terms."""
        it, mt = np.ascontiguousarray(ids.T), np.ascontiguousarray(mask.T).astype(np.float32)
        proj = np.zeros((WINDOW, len(ids), 2), np.float32)
        for i, d in enumerate("fb"):
            U, both, table, h = self.p[d + "U"], np.stack([self.p[d + "a"], self.p[d + "o"]], 1), terms[i], np.zeros((len(ids), HIDDEN), np.float32)
            for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
                g, gh = table[it[t]], h @ U
                zr = _sigmoid(g[:, : 2 * HIDDEN] + gh[:, : 2 * HIDDEN])
                cand = np.tanh(g[:, 2 * HIDDEN :] + zr[:, HIDDEN:] * gh[:, 2 * HIDDEN :])
                h = (cand + zr[:, :HIDDEN] * (h - cand)) * mt[t][:, None]
                proj[t] += h @ both
        e = np.where(mt > 0, proj[:, :, 0], np.float32(-1e9))
        w = np.exp(e - e.max(0)) * mt
        w /= np.maximum(w.sum(0), 1e-9)
        return (w * proj[:, :, 1]).sum(0) + self.p["bias"][0] + self.shift

    def gradients(self, odds: np.ndarray, words: list[str], ids: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss over windows; ids: rows of odds and words."""
        found, kept = self.letters(words)
        p, x = self.p, np.concatenate([odds, found], 1).astype(np.float32)[np.ascontiguousarray(ids.T)]
        mt = np.ascontiguousarray(mask.T).astype(np.float32)
        read = {d: _read(x @ p[d + "W"] + p[d + "c"], p[d + "U"], d == "b", None, mt) for d in "fb"}
        e = np.where(mt > 0, sum(read[d][0] @ p[d + "a"] for d in "fb"), np.float32(-1e9))
        w = np.exp(e - e.max(0)) * mt
        w /= np.maximum(w.sum(0), 1e-9)
        o = sum(read[d][0] @ p[d + "o"] for d in "fb")
        pooled = (w * o).sum(0)
        dz = ((_sigmoid(pooled + p["bias"][0]) - y) / len(y)).astype(np.float32)
        do, de = w * dz, w * (o - pooled) * dz
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["bias"][0] = dz.sum()
        dx = np.zeros_like(x)
        for d in "fb":
            states, steps = read[d]
            g[d + "a"], g[d + "o"] = (de[:, :, None] * states).sum((0, 1)), (do[:, :, None] * states).sum((0, 1))
            dgx, g[d + "U"] = _unread(steps, de[:, :, None] * p[d + "a"] + do[:, :, None] * p[d + "o"], p[d + "U"], mt)
            g[d + "W"] = x.reshape(-1, FEATURES).T @ dgx.reshape(-1, 3 * HIDDEN)
            g[d + "c"] = dgx.sum((0, 1))
            dx += dgx @ p[d + "W"].T
        self._letters_back(kept, _gather(ids.T.ravel(), dx[:, :, ODDS:].reshape(-1, LETTER_OUT), len(words)), g)
        return g


class Scorer:
    """The trained model: texts to scores."""

    def __init__(self, odds: LogOdds, net: Network):
        self.odds, self.net = odds, net
        self._fresh()

    def __getstate__(self):
        return self.odds, self.net

    def __setstate__(self, state):
        self.__init__(*state)

    def _fresh(self) -> None:
        """Forget all words: known has a word's row in terms, new those without terms so far.

        Room for all words is taken at once, since its pages take no memory before they are written; growing would copy it.
        """
        self.known: dict[str, int] = {"": 0}
        self.new, self.terms, self.size = [""], np.empty((2, WORD_CACHE + ROOM, 3 * HIDDEN), np.float32), 0

    def _row(self, word: str) -> int:
        i = self.known.get(word)
        if i is None:
            i = self.known[word] = len(self.known)
            self.new.append(word)
        return i

    def _learn(self) -> None:
        while self.size + len(self.new) > self.terms.shape[1]:
            self.terms = np.concatenate([self.terms, np.empty_like(self.terms)], 1)
        for lo in range(0, len(self.new), LEARN):  # a batch's new words may be very many, with ten n-grams each
            part = self.new[lo : lo + LEARN]
            self.terms[:, self.size : self.size + len(part)] = self.net.terms(self.odds.features(part).astype(np.float32), part)
            self.size += len(part)
        self.new = []

    def score(self, texts: list[str | None]) -> np.ndarray:
        out, held, spans, size = np.zeros(len(texts)), [], [], 0

        def flush() -> None:
            nonlocal held, spans, size
            if not size:
                return
            self._learn()
            words, starts = np.concatenate(held), np.array([s[1:] for s in spans])
            who, best = np.array([s[0] for s in spans]), np.full(len(texts), -np.inf)
            for lo in range(0, len(starts), 2048):
                ids, mask = cut(words, starts[lo : lo + 2048])
                np.maximum.at(best, who[lo : lo + 2048], self.net.logits(self.terms, ids, mask))
            done = np.isfinite(best)
            out[done] = np.maximum(out[done], 1 / (1 + np.exp(-best[done])))
            held, spans, size = [], [], 0
            if self.size > WORD_CACHE:
                self._fresh()

        for i, text in enumerate(texts):
            ids = np.fromiter(map(self._row, WORDS((text or "").lower())), np.int64)
            spans += [(i, size + a, size + b) for a, b in windows(len(ids))]
            held.append(ids)
            size += len(ids)
            if size > ROOM:
                flush()
        flush()
        return out


def fit(texts: list[str], toxic: np.ndarray, share: float | None = None, rounds: int = 10, steps: int = 180, seed: int = 0) -> Scorer | None:
    """Train on labelled texts; share: the true share of toxic ones, if the sample's differs.

    At least `rounds` rounds and about `steps` batches, so that a small sample is learned too.
    """
    toxic = np.asarray(toxic, np.int64)
    docs = [WORDS((t or "").lower()) for t in texts]
    keep = [i for i, d in enumerate(docs) if d]
    docs, toxic = [docs[i] for i in keep], toxic[keep]
    if not 0 < toxic.sum() < len(toxic):
        return None
    half = np.zeros(len(docs), np.int64)
    for y in (0, 1):  # both halves get as many of each class
        half[toxic == y] = np.arange((toxic == y).sum()) % 2
    halves = [LogOdds([d for d, h in zip(docs, half, strict=True) if h != k], toxic[half != k]) for k in (0, 1)]
    cached: list[dict[str, int]] = [{}, {}]
    names, of = [""], [0]  # row 0 stands for no word; of: the half that a row's word is in
    spans, who, words = [], [], []
    size = 0
    for i, d in enumerate(docs):
        k = int(half[i])
        for u in d:
            if (j := cached[k].get(u)) is None:
                j = cached[k][u] = len(names)
                names.append(u)
                of.append(k)
            words.append(j)
        for a, b in windows(len(d)):
            spans.append((size + a, size + b))
            who.append(i)
        size += len(d)
    words, spans, who, of = np.array(words), np.array(spans), np.array(who), np.array(of)
    odds = np.zeros((len(names), ODDS), np.float32)
    for k in (0, 1):
        odds[of == k] = halves[k].features([w for w, h in zip(names, of.tolist(), strict=True) if h == k])
    net, rng = Network(seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    s = {k: np.zeros_like(v) for k, v in net.p.items()}
    step, rounds = 0, max(rounds, steps * BATCH // (2 * len(docs)))
    # before the first round the strongest single word stands for a window
    now = np.concatenate([odds[ids].max(axis=(1, 2)) for ids, _ in (cut(words, spans[lo : lo + 8192]) for lo in range(0, len(spans), 8192))])
    for turn in range(rounds):
        order = np.lexsort((-now, who))
        top = order[np.r_[True, who[order][1:] != who[order][:-1]]]
        others = rng.permutation(np.flatnonzero(toxic[who] == 0))[: len(top)]
        pick = rng.permutation(np.concatenate([top, others]))
        for lo in range(0, len(pick), BATCH):
            at = pick[lo : lo + BATCH]
            ids, mask = cut(words, spans[at])
            rows, ids = np.unique(ids, return_inverse=True)
            g = net.gradients(odds[rows], [names[i] for i in rows], ids.reshape(mask.shape), mask, toxic[who[at]])
            step += 1
            norm = max(1.0, float(np.sqrt(sum((v * v).sum() for v in g.values()))))
            for k, v in g.items():
                v = v / norm
                m[k] += 0.1 * (v - m[k])
                s[k] += 0.01 * (v * v - s[k])
                net.p[k] -= np.float32(0.02) * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-7)
        if turn < rounds - 1:
            terms = net.terms(odds, names)
            now = np.concatenate([net.logits(terms, ids, mask) for ids, mask in (cut(words, spans[lo : lo + 4096]) for lo in range(0, len(spans), 4096))])
    if share and 0 < share < 1:
        p = toxic.mean()
        net.shift = float(np.log(share / (1 - share)) - np.log(p / (1 - p)))
    return Scorer(LogOdds(docs, toxic), net)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; false without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1200, usable: Column | None = None) -> Scorer | None:
    """Fit on at most per_class rows of each label, those of the smallest hashed doc_id."""
    rows = labels.where("toxic in (0, 1)")
    if usable is not None:
        rows = rows.where(usable)
    rows = rows.select("doc_id", "toxic")
    counts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    texts = docs.select("doc_id", "text")
    order = [F.xxhash64("doc_id"), "doc_id"]
    picked = [rows.where(F.col("toxic") == y).orderBy(*order).limit(2 * per_class) for y in (0, 1)]
    ids = F.broadcast(picked[0].union(picked[1]))  # 4 * per_class rows at most
    found = texts.join(ids, "doc_id")
    got: list = []
    for y in (0, 1):
        got += found.where(F.col("toxic") == y).orderBy(*order, "text").limit(per_class).collect()
    got.sort(key=lambda r: (r["doc_id"], r["toxic"]))
    return fit([r["text"] for r in got], np.array([r["toxic"] for r in got]), counts[1] / (counts[0] + counts[1]))


def score(docs: DataFrame, model: Scorer | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs plus toxicity (0 to 1). No shuffle; a batch of rows in memory."""
    spark = docs.sparkSession
    kept = [c for c in (docs.columns if keep is None else keep) if c != "toxicity"]
    if model is None:
        return docs.select(*(F.col(f"`{c}`") for c in kept), F.lit(0.0).alias("toxicity"))
    sent = spark.sparkContext.broadcast(pickle.dumps(model))  # tables of at most 400,000 entries and 1,000 weights
    rows = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`").alias("__text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("toxicity", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held("toxicity")
        own["scorer"] = scorer = pickle.loads(sent.value)
        for b in batches:
            for lo, hi in slices(b.column(b.num_columns - 1)):
                part = b.slice(lo, hi - lo)
                found = scorer.score(part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns - 1)), pa.array(found, pa.float64())], names=[*kept, "toxicity"])
            del b, part  # else they stay while the next batch is read
        own.clear()  # its words and their inputs
        del scorer
        release()

    ship(spark)
    return rows.mapInArrow(run, schema)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), usable=~held_out(F.col("doc_id")))
    out = score(docs, model, keep=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.7).cast("int").alias("predicted"))
