import itertools

import pytest

from tessera.llm import decontam


@pytest.fixture
def bench(spark):
    def make(rows):
        return spark.createDataFrame(rows, "item_id bigint, text string")

    return make


def sentence(rng, n):
    return " ".join(f"w{rng.randrange(500)}" for _ in range(n))


def brute(docs, items):
    """Pairs that agree in 4 of 5 tokens of a window on some diagonal, with the best window's figures."""
    import re

    tok = lambda t: [x for x in re.split(r"[^\w]+", (t or "").lower()) if x]
    out = {}
    for d, t in docs:
        a = tok(t)
        for i, p in items:
            b = tok(p)
            w = min(len(b), decontam.WINDOW)
            if len(b) < 5:
                continue
            for at in range(-len(b) + 1, len(a)):
                eq = [0 <= at + x < len(a) and a[at + x] == b[x] for x in range(len(b))]
                most = max(sum(eq[x : x + w]) for x in range(len(b) - w + 1))
                if 5 * most >= 4 * w:
                    out[d, i] = max(out.get((d, i), (0, 0, 0)), (most, w, -at))
    return out


def test_masks_avoid_every_permitted_substitution():
    for n in range(decontam.SHORTEST, 41):
        w = min(n, decontam.WINDOW)
        masks = decontam.FAMILIES[decontam.family_of(n)]
        placed = [sum(1 << (o + x) for x in m) for m in masks for o in range(w - max(m))]
        for gone in itertools.combinations(range(w), w // 5):
            lost = sum(1 << x for x in gone)
            assert any(not p & lost for p in placed), (n, gone)


@pytest.mark.parametrize("tokens", [500_000, 0])
@pytest.mark.parametrize("n", [5, 6, 7, 8, 9, 10, 14, 15, 20, 33])
def test_no_substitution_pattern_is_missed(docs, bench, monkeypatch, n, tokens):
    monkeypatch.setattr(decontam, "SEED_TOKENS", tokens)
    words = [f"b{i}" for i in range(n)]
    w = min(n, 20)
    rows = []
    for k, gone in enumerate(itertools.islice(itertools.combinations(range(w), w // 5), 0, None, 1 if n < 15 else 37)):
        rows.append((k, " ".join(["a a"] * (k % 3) + ["zz" if i in gone else x for i, x in enumerate(words)][: w if k % 2 else n])))
    got = {r["doc_id"]: (r["matched"], r["width"]) for r in decontam.overlaps(docs(rows), bench([(1, " ".join(words))])).collect()}
    want = brute(rows, [(1, " ".join(words))])
    assert len(want) == len(rows) and got == {d: v[:2] for (d, _), v in want.items()}


def test_like_brute_force(docs, bench, rng, monkeypatch):
    items = [(i, sentence(rng, n)) for i, n in enumerate([4, 5, 7, 8, 12, 20, 40, 60])] + [(8, None), (9, "")]
    rows = []
    for d in range(60):
        p = rng.choice(items[:8])[1].split()
        kind = d % 6
        if kind == 1:
            p = [w if rng.random() > 0.12 else "zz" for w in p]
        elif kind == 2:
            p = [w if rng.random() > 0.35 else "zz" for w in p]
        elif kind == 3:
            p = p[len(p) // 2 :]
        elif kind == 4:
            p = []
        text = " ".join([sentence(rng, rng.randint(0, 30)), "...".join(p).upper() if kind == 5 else " ".join(p), sentence(rng, rng.randint(0, 30))])
        rows.append((d, text))
    rows += [(60, None), (61, ""), (62, sentence(rng, 3))]
    rows.append((63, " ".join([sentence(rng, 20_000), items[5][1], sentence(rng, 20_000)])))  # very long
    want = brute(rows, items)
    assert len(want) > 15
    for tokens in (decontam.SEED_TOKENS, 0):
        monkeypatch.setattr(decontam, "SEED_TOKENS", tokens)
        got = {(r["doc_id"], r["item_id"]): (r["matched"], r["width"], -r["at"]) for r in decontam.overlaps(docs(rows), bench(items)).collect()}
        assert got == want


def test_decontaminate(docs, bench, rng):
    p = sentence(rng, 30)
    d = docs([(1, "x " + p + " y"), (2, sentence(rng, 40)), (1, "clean text of the same id"), (None, p), (3, None), (2, sentence(rng, 10))])
    kept = decontam.decontaminate(d, bench([(1, p), (1, p)]))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "2", "3"] and kept.columns == d.columns
    assert decontam.decontaminate(d, bench([])).count() == 6 and decontam.decontaminate(docs([]), bench([(1, p)])).count() == 0


def test_ties_repeats_and_nulls(docs, bench, rng, monkeypatch):
    p = sentence(rng, 30)
    d = docs([(1, f"x {p} y {p}"), (1, f"x {p} y {p}"), (1, "other " + " ".join(p.split()[:18])), (None, p), (None, sentence(rng, 9))])
    for tokens in (decontam.SEED_TOKENS, 0):
        monkeypatch.setattr(decontam, "SEED_TOKENS", tokens)
        rows = decontam.overlaps(d, bench([(5, p), (5, p), (None, p)])).select("doc_id", "item_id", "at", "matched", "width").collect()
        assert sorted(map(str, map(tuple, rows))) == sorted(map(str, [(i, b, at, m, 20) for i, at, m in ((1, 1, 20), (1, 1, 18), (None, 0, 20)) for b in (5, None)]))


def test_pairs_of_one_window(spark, tmp_path):
    a, b = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(8))
    spark.createDataFrame([(1, a), (1, a.replace("w3 ", "zz "))], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(9, " ".join(a.split()[:20])), (9, b)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [tuple(r) for r in decontam.op7(spark, str(tmp_path)).collect()] == [(1, 9, 20, 20)]


def test_query_finds_every_whole_passage(spark):
    sf = "/root/testdata/sf0.01"
    import re

    norm = lambda t: " ".join(x for x in re.split(r"[^\w]+|_", (t or "").lower()) if x)
    items = [(r["item_id"], norm(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {(r["doc_id"], i) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for i, p in items if p in norm(r["text"])}
    got = {(r["doc_id"], r["item_id"]) for r in decontam.op7(spark, sf).collect()}
    assert want <= got and len(got) <= 1.2 * len(want) + 5
