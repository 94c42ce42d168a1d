import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import toxicity
from tessera.llm.workers import slices


def corpus(n=240):
    r = np.random.default_rng(0)
    words = ["lorem", "ipsum", "dolor", "amet", "porta", "vitae", "nulla", "magna"]
    rows = []
    for i in range(n):
        t = [words[j] for j in r.integers(0, len(words), r.integers(5, 150))]
        if i % 4 == 0:
            for _ in range(2):
                t.insert(int(r.integers(0, len(t))), ["nastyword", "nastyones"][int(r.integers(0, 2))])
        rows.append((i, " ".join(t), int(i % 4 == 0)))
    return rows


def test_gradients():
    net, r = toxicity.Network(1), np.random.default_rng(0)
    words = ["", "a", "word", "longer", "x" * 20 + "yz" * 30, "é日本"]
    odds = r.standard_normal((len(words), toxicity.ODDS)).astype(np.float32)
    mask = np.arange(toxicity.WINDOW)[None] < np.array([[7], [toxicity.WINDOW], [1]])
    ids = np.where(mask, r.integers(1, len(words), mask.shape), 0)
    y = np.array([1, 0, 1])
    loss = lambda: float(np.mean(np.logaddexp(0, z := net.logits(net.terms(odds, words), ids, mask).astype(float)) - y * z))
    g = net.gradients(odds, words, ids, mask, y)
    assert set(g) == set(net.p)
    for k in net.p:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        keep = net.p[k][at]
        net.p[k][at] = keep + 1e-2
        up = loss()
        net.p[k][at] = keep - 1e-2
        down = loss()
        net.p[k][at] = keep
        assert g[k][at] and np.isclose((up - down) / 2e-2, g[k][at], rtol=0.05, atol=2e-4), k


def test_new_words_are_worked_out_in_parts(monkeypatch):
    rows = corpus()
    model, sizes, whole = toxicity.fit([t for _, t, _ in rows], np.array([y for *_, y in rows])), [], toxicity.LogOdds.features
    monkeypatch.setattr(toxicity.LogOdds, "features", lambda self, words: sizes.append(len(words)) or whole(self, words))
    model.score([" ".join(f"w{i}" for i in range(40_000))])
    assert sum(sizes) > 40_000 and max(sizes) <= 8192


def test_a_worker_gives_up_what_other_operators_kept():
    from tessera.llm import bpe
    from tessera.llm.workers import kept

    path, pattern = bpe.default_vocabulary()
    raw = bpe.read_ranks(path)
    first = bpe.codec(raw, pattern)
    assert bpe.codec(raw, pattern) is first and len(kept("bpe")) == 1
    assert kept("toxicity") == {} and kept("bpe") == {}


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def slow_states(p, d, xs):
    """One GRU step after the other, in double precision."""
    h, out = np.zeros(p[d + "U"].shape[0]), []
    n = len(h)
    for x in xs:
        a, b = x @ p[d + "W"] + p[d + "c"], h @ p[d + "U"]
        z, r = sigmoid(a[:n] + b[:n]), sigmoid(a[n : 2 * n] + b[n : 2 * n])
        c = np.tanh(a[2 * n :] + r * b[2 * n :])
        h = c + z * (h - c)
        out.append(h)
    return np.array(out)


def slow_score(m, text):
    """A text's score in plain loops: every window, letter by letter and word by word."""
    p = {k: v.astype(float) for k, v in m.net.p.items()}

    def word(w):
        parts = []
        for lo in range(0, max(len(w) - toxicity.PIECE // 2, 1), toxicity.PIECE // 2):
            x = np.array([p["embed"][ord(c) % (toxicity.LETTERS - 1) + 1] for c in w[lo : lo + toxicity.PIECE]])
            s = np.concatenate([slow_states(p, "l", x), slow_states(p, "r", x[::-1])[::-1]], 1)
            e = np.exp(s @ p["pool"])
            parts.append((e / e.sum()) @ s @ p["out"])
        grams = [m.odds.grams.get(x, 0.0) for x in toxicity.grams(w)]
        return np.concatenate([[m.odds.words.get(w, 0.0), max(grams), np.mean(grams), min(grams)], np.mean(parts, 0)])

    words = toxicity.WORDS((text or "").lower())
    best = -np.inf
    for a, b in toxicity.windows(len(words)):
        x = np.array([word(w) for w in words[a:b]])
        sf, sb = slow_states(p, "f", x), slow_states(p, "b", x[::-1])[::-1]
        e = np.exp(sf @ p["fa"] + sb @ p["ba"])
        best = max(best, float((e / e.sum()) @ (sf @ p["fo"] + sb @ p["bo"]) + p["bias"][0] + m.net.shift))
    return sigmoid(best) if words else 0.0


def test_scores_like_plain_loops():
    rows = corpus(60)
    m = toxicity.fit([t for _, t, _ in rows], np.array([y for *_, y in rows]), 0.1, rounds=2, steps=10)
    texts = [rows[0][1], rows[1][1], "lorem " * 150 + "nastyword", "x" * 100 + " ipsum", None, "...", "Ünï 日本 1"]
    got = m.score(texts)
    assert np.allclose(got, [slow_score(m, t) for t in texts], atol=1e-5)
    assert np.allclose(m.score(texts[::-1]), got[::-1], atol=1e-6)


def test_learns_and_generalises_to_characters():
    rows = corpus()
    m = toxicity.fit([t for _, t, _ in rows], np.array([y for *_, y in rows]))
    clean = "lorem ipsum dolor amet porta vitae " * 40
    s = m.score([clean, clean + "nastyword " + clean, "lorem nastything ipsum dolor", None, "", "!?"])
    assert s[0] < 0.3 < 0.7 < s[1] and s[2] > s[0] and (s[3:] == 0).all()


def test_windows_cover_all_words():
    for n in (1, 23, 48, 49, 72, 500):
        w = toxicity.windows(n)
        assert {i for a, b in w for i in range(a, b)} == set(range(n)) and all(b - a <= toxicity.WINDOW for a, b in w)
    assert toxicity.windows(0) == []


def test_frames(spark, docs):
    rows = corpus()
    d = docs([(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(9999, 1, 1), (1, None, None)], "doc_id bigint, quality int, toxic int")
    m = toxicity.train(d, labels)
    out = toxicity.score(docs([(1, "nastyword nastyones lorem"), (2, "lorem ipsum"), (3, None), (2, "lorem ipsum")]), m).collect()
    s = {r["doc_id"]: r["toxicity"] for r in out}
    assert len(out) == 4 and s[1] > 0.5 > s[2] and s[3] == 0.0
    assert toxicity.score(docs([]), m).count() == 0
    assert toxicity.train(d, labels.where("toxic = 0")) is None
    assert toxicity.score(docs([(1, "x")]), None).first()["toxicity"] == 0.0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r["doc_id"]: r for r in toxicity.op10(spark, sf).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for d, r in rows.items())
    held = [(r["toxic"], rows[r["doc_id"]]["predicted"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[r["doc_id"]]["held_out"]]
    y, p = np.array(held).T
    assert p[y == 1].mean() > 0.8 and p[y == 0].mean() < 0.04


def test_null_ids_and_very_long_texts(spark, docs):
    rows = corpus()
    m = toxicity.fit([t for _, t, _ in rows], np.array([y for *_, y in rows]))
    long = "lorem ipsum dolor " * 60_000
    d = docs([(None, "lorem"), (None, long + "nastyword nastyones nastyword"), (5, long), (5, "n" * 200_000)])
    out = [(r["doc_id"], r["toxicity"], r["h"]) for r in toxicity.score(d, m).select("doc_id", "toxicity", toxicity.held_out(F.col("doc_id")).alias("h")).collect()]
    assert len(out) == 4 and [h for i, _, h in out if i is None] == [False, False] and max(t for i, t, _ in out if i is None) > 0.5


def test_new_words_do_not_copy_what_is_known_of_others():
    model = toxicity.fit(["bad word here", "fine word there"] * 20, np.array([1, 0] * 20), rounds=1, steps=1)
    taken = model.terms
    scores = model.score([" ".join(f"w{i}x{j}" for j in range(500)) for i in range(10)])
    assert model.terms is taken and model.size > 5000  # growing held the old and the new table at once
    again = toxicity.Scorer(model.odds, model.net)
    parts = [again.score([" ".join(f"w{i}x{j}" for j in range(500))])[0] for i in range(10)]
    assert np.allclose(scores, parts, atol=1e-5)


def test_texts_are_scored_in_slices_of_bounded_bytes():
    texts = pa.array([None, "x" * 700, "", "y" * 700, "z" * 3000, None])
    cuts = list(slices(texts, 1000))
    assert cuts == [(0, 4), (4, 5), (5, 6)]
