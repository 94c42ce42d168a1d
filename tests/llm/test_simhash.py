import itertools

import pytest
import xxhash

from tessera.llm import simhash


def plain_fp(text):
    w = (text or "").encode().lower().split()
    parts = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(rows, radius=2):
    fps = sorted({f for _, f in rows})
    up = {f: f for f in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= radius:
            up[find(a)] = find(b)
    least = {}
    for d, f in rows:
        least[find(f)] = min(d, least.get(find(f), d))
    return {(d, f): least[find(f)] for d, f in rows}


def test_covering():
    for radius in (1, 2, 3):
        masks = simhash.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for bits in itertools.combinations(range(0, 64, 3 if radius == 3 else 1), radius):
            diff = sum(1 << b for b in bits)
            assert any(not m & diff for m in masks)


def test_fingerprints(rng):
    for t in [None, "", "one", "One two", "a b c", "É é x\u00a0y z", " ".join(rng.choice("abcdef") for _ in range(500))]:
        assert simhash.fingerprint(t) == plain_fp(t)
    assert simhash.fingerprint("x " * 70_000) == plain_fp("x " * 70_000)


@pytest.mark.parametrize(("small", "giant"), [(48, 32_768), (1, 32_768), (1, 2)])
def test_groups_like_brute_force(spark, rng, monkeypatch, small, giant):
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "GIANT", giant)
    base = [rng.getrandbits(64) for _ in range(6)] + [0]
    fps = []
    for b in base:
        x = b
        for _ in range(25):  # chains of one to three bits
            for bit in rng.sample(range(64), rng.choice([0, 1, 2, 3])):
                x ^= 1 << bit
            fps.append(x)
    rows = [(i * 37 % len(fps), f) for i, f in enumerate(fps)]
    signed = spark.createDataFrame([(simhash._signed(f),) for f in sorted(set(fps))], "fp bigint")
    pairs = [(r["u"], r["v"]) for r in simhash.links(signed).collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 or small for a, b in pairs)
    up = {simhash._signed(f): simhash._signed(f) for f in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[find(a)] = find(b)
    want = plain_groups(rows)
    for (d1, f1), (d2, f2) in itertools.combinations(rows, 2):
        assert (find(simhash._signed(f1)) == find(simhash._signed(f2))) == (want[d1, f1] == want[d2, f2])


def test_query_like_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], plain_fp(r["text"])) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = plain_groups(rows)
    got = simhash.op6(spark, sf).collect()
    assert {(r["doc_id"], int(r["fingerprint"], 16)): r["component_id"] for r in got} == want and len(got) == len(rows)
    assert all(len(r["fingerprint"]) == 16 for r in got)


def test_edges(docs):
    t = "some words that make a text of a few shingles"
    d = docs([(3, t), (1, t), (1, t), (2, None), (4, ""), (None, "lonely words of no one")])
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_groups(d).collect()), key=str)
    assert got == sorted([(3, 1), (1, 1), (1, 1), (2, 2), (4, 2), (None, None)], key=str)
    assert sorted(str(r["doc_id"]) for r in simhash.keep_one(d).collect()) == ["1", "2", "None"]
    assert simhash.near_groups(docs([])).count() == 0


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("grams", [500_000, 900])
def test_keep_one_reaches_a_similarity_of_four_fifths(docs, rng, monkeypatch, grams):
    monkeypatch.setattr(simhash, "BLOCK_GRAMS", grams)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(100, 300))]
        texts.append(base)
        for changes in (1, 2, 3, 4, 5, 6, 8, 10, 12):
            copy = list(base)
            for i in rng.sample(range(len(copy)), changes):
                copy[i] = f"x{rng.randrange(5000)}"
            texts.append(copy)
    texts = [" ".join(x) for x in texts]
    up = list(range(len(texts)))

    def find(x):
        return x if up[x] == x else find(up[x])

    for a, b in itertools.combinations(range(len(texts)), 2):
        if a // 10 == b // 10 and jaccard(texts[a], texts[b]) >= 0.8:
            up[max(find(a), find(b))] = min(find(a), find(b))
    want = sorted({find(x) for x in range(len(texts))})
    got = sorted(r["doc_id"] for r in simhash.keep_one(docs(list(enumerate(texts)))).collect())
    assert got == want and 12 < len(want) < len(texts) - 12
    roots = simhash.similar_roots([simhash.shingle_set(t) for t in texts], 0.8)
    assert roots.tolist() == [find(x) for x in range(len(texts))]


def test_roots_with_labels_and_blocks(rng):
    import numpy as np

    sets = [np.unique(np.array([rng.randrange(40) + 100 * (i % 3) for _ in range(30)], np.int64)) for i in range(60)]
    like = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.4
    up = list(range(60))

    def find(x):
        return x if up[x] == x else find(up[x])

    for a, b in itertools.combinations(range(60), 2):
        if like(sets[a], sets[b]):
            up[max(find(a), find(b))] = min(find(a), find(b))
    want = [find(x) for x in range(60)]
    assert 1 < len(set(want)) < 60 and simhash.similar_roots(sets, 0.4).tolist() == want
    half = np.array([w if i % 2 else 1000 + i for i, w in enumerate(want)])  # some links are known
    assert simhash.similar_roots(sets, 0.4, half).tolist() == want
    block, links = np.array([rng.randrange(3) for _ in range(60)]), set()
    for i, j in itertools.combinations_with_replacement(range(3), 2):
        at = np.flatnonzero((block == i) | (block == j))
        roots = simhash.similar_roots([sets[x] for x in at], 0.4, None, block[at] if i != j else None)
        links |= {(int(at[k]), int(at[r])) for k, r in enumerate(roots) if r != k}
    up = list(range(60))
    for a, b in links:
        up[max(find(a), find(b))] = min(find(a), find(b))
    assert [find(x) for x in range(60)] == want


def test_bands_that_span_ranges(spark, monkeypatch):
    monkeypatch.setattr(simhash, "partitions", lambda s: 7)
    rows = [(f, [1, 100 + f // 2]) for f in range(40)] + [(3, [1]), (77, [5])]
    held = simhash.met(spark.createDataFrame(rows, "fp bigint, keys array<bigint>")).collect()
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for r in held:
        assert r["fp"] != r["pivot"]
        a, b = find((r["key"], r["fp"])), find((r["key"], r["pivot"]))
        up[max(a, b)] = min(a, b)
    assert {find((1, f)) for f in range(40)} == {(1, 0)}
    assert all(find((100 + f // 2, f)) == (100 + f // 2, f // 2 * 2) for f in range(40)) and not any(r["key"] == 5 for r in held)


def test_a_large_group_and_its_chain(docs, rng):
    base = [f"w{i}" for i in range(120)]
    texts = []
    for k in range(60):  # copies with two words changed each: 0.69 to 0.85 alike among themselves
        copy = list(base)
        for i in rng.sample(range(120), 2):
            copy[i] = f"x{k}{i}"
        texts.append(" ".join(copy))
    for k in range(0, 40, 4):  # a chain: each end is like its neighbours only
        texts.append(" ".join([f"c{i}" for i in range(k, k + 100)]))
    up = list(range(len(texts)))

    def find(x):
        return x if up[x] == x else find(up[x])

    for a, b in itertools.combinations(range(len(texts)), 2):
        if jaccard(texts[a], texts[b]) >= 0.8:
            up[max(find(a), find(b))] = min(find(a), find(b))
    want = sorted({find(x) for x in range(len(texts))})
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs(list(enumerate(texts)))).collect()) == want


def test_keep_one_tells_rows_of_one_id_apart(docs):
    a, b, c = ("first of the clean texts that nobody copied", "second text, of other words than those before it", "third one, about nothing that the others say")
    kept = lambda rows: sorted(((r["doc_id"], r["text"]) for r in simhash.keep_one(docs(rows)).collect()), key=str)
    assert kept([(None, a), (None, b), (None, c)]) == sorted([(None, a), (None, b), (None, c)], key=str)
    assert kept([(7, a), (7, b)]) == sorted([(7, a), (7, b)], key=str)
    assert kept([(7, a), (7, c), (3, c)]) == [(3, c), (7, a)]
    assert kept([(7, a), (7, a), (8, b)]) == [(7, a), (8, b)]
    assert kept([(None, a), (None, b), (None, c), (7, a + " and more words"), (7, b + " of it")]) == sorted([(None, a), (None, b), (None, c), (7, a + " and more words"), (7, b + " of it")], key=str)
    assert kept([(9, c), (9, a), (3, c), (None, c), (None, "")]) == sorted([(3, c), (9, a), (None, "")], key=str)
    assert simhash.keep_one(docs([])).count() == 0


def test_keep_one_takes_candidates_from_the_covering_code(docs, rng, monkeypatch):
    bands = simhash.met
    monkeypatch.setattr(simhash, "met", lambda marked: bands(marked).where("false"))
    say = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    texts = []
    for i in range(12):
        w = say(400)
        texts += [" ".join(w), " ".join([*w, *say(1 + i // 4)])]
    codes = [simhash.majority(simhash.shingle_set(t)) for t in texts]
    near = [i for i in range(0, 24, 2) if (codes[i] ^ codes[i + 1]).bit_count() <= 2]
    kept = lambda **o: sorted(r["doc_id"] for r in simhash.keep_one(docs(list(enumerate(texts))), **o).collect())
    assert len(near) >= 3 and kept() == [i for i in range(24) if i - 1 not in near or i % 2 == 0]
    assert kept(similarity=0.999) == list(range(24))  # candidates alone link nothing
