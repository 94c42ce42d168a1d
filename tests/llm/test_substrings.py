import hashlib
import random

import pytest

from tessera.llm import substrings


def plain(rows):
    seen, out, done = set(), {}, {}
    for d, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0])):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w in seen:
                gone[i : i + 100] = b"\1" * 100
            else:
                seen.add(w)
        spans = [i for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1])]
        done[d, t] = (len(b), sum(gone), len(spans), bytes(x for x, g in zip(b, gone, strict=True) if not g))
    for d, t in rows:
        out.setdefault(d, []).append(done[d, t])
    return {d: sorted(v) for d, v in out.items()}


def run(df, **options):
    out = {}
    for r in substrings.dedup_substrings(df, **options).collect():
        assert r["n_removed"] == sum(s["length"] for s in r["spans"])
        out.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])))
    return {d: sorted(v) for d, v in out.items()}


def corpus(seed, n=50):
    r = random.Random(seed)
    letters = ["abcdé ", "xy", "thenandr of"][seed % 3]
    rnd = lambda k: "".join(r.choice(letters) for _ in range(k))
    pool = [rnd(r.randint(60, 400)) for _ in range(8)] + ["a" * 300, "b" * 99]
    rows = [(d * 7 % n, "".join(r.choice([rnd(r.randint(0, 150)), r.choice(pool), r.choice(pool)[r.randint(0, 50) :]]) for _ in range(r.randint(0, 6)))) for d in range(n)]
    rows += [(n + i, rows[i][1]) for i in range(8)] + [(n + 20 + i, rows[i + 9][1][::1].replace("a", "Z", 1)) for i in range(6)]
    return rows + [(n + 40, None), (n + 41, "")]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_like_brute_force(docs, seed):
    rows = corpus(seed)
    assert run(docs(rows).repartition(3)) == plain(rows)


def test_hot_grams_are_dealt_by_context(docs, monkeypatch):
    rows = corpus(4)
    monkeypatch.setattr(substrings, "_hot_grams", lambda d, total, hot: _all_grams(rows))
    assert run(docs(rows)) == plain(rows)


def _all_grams(rows):
    import numpy as np

    out = set()
    for _, t in rows:
        b = np.frombuffer((t or "").encode(), np.uint8)
        out |= set(substrings.anchors(b, np.array([0]), np.array([len(b)]))[1][::2].tolist())
    return out


def contexts(seed, n):
    """(h, doc, tid, pos, left, right, context) of n one-context texts around three K-grams, many of them alike in part."""
    import numpy as np

    r, out = random.Random(seed), []
    grams = [bytes(r.choices(b"ab", k=substrings.K)) for _ in range(3)]
    sides = [(bytes(r.choices(b"ab", k=80)), bytes(r.choices(b"ab", k=80))) for _ in range(4)]
    for d in range(n):
        g, (a, z) = r.randrange(3), r.choice(sides)
        a, z = a[r.choice([0, 0, 50]) :], z[: r.choice([80, 80, 30])]
        x = bytearray(a + grams[g] + z)
        if r.random() < 0.7:
            x[r.choice([i for i in range(len(x)) if not len(a) <= i < len(a) + substrings.K])] = 99
        left, right = min(len(a), substrings.BEFORE), len(x) - len(a)
        m = np.zeros(substrings.CONTEXT, np.uint8)
        m[substrings.BEFORE - left : substrings.BEFORE + right] = np.frombuffer(bytes(x), np.uint8)
        out.append((np.array([g], np.uint64), np.array([d]), np.array([7]), np.array([left], np.int32), np.array([left], np.uint8), np.array([right], np.uint8), m[None]))
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_suffix_order_finds_the_windows_that_occur_before(seed):
    import numpy as np

    h, doc, _, _, left, right, m = (np.concatenate(x) for x in zip(*sorted(contexts(seed, 150), key=lambda c: (int(c[0][0]), int(c[1][0]))), strict=True))
    seen, want = set(), np.zeros((len(h), substrings.BEFORE + 1), bool)
    for i in range(len(h)):
        for o in range(substrings.BEFORE + 1):
            if left[i] >= o and right[i] >= substrings.LENGTH - o:
                w = (o, m[i, substrings.BEFORE - o :][: substrings.LENGTH].tobytes())
                want[i, o] = w in seen
                seen.add(w)
    assert want.any() and (substrings.suffix_repeats(h, m, left, right) == want).all()


def test_contexts_of_hot_grams_are_rows_of_a_block_not_of_a_text():
    import numpy as np

    got, out = contexts(3, 300), substrings._Out()
    substrings.deal_hot(out, got, 4)
    assert len(out.rows) <= 4  # one by one, texts and alignments made thousands
    seen = []
    for _, _, n, blob in out.rows:
        *cols, _ = substrings.unpack(blob, n, (substrings.U8, substrings.I8, substrings.I8, substrings.I4, substrings.U1, substrings.U1))
        seen += [(int(d), o) for d, left, right in zip(cols[1], cols[4], cols[5], strict=True) for o in range(substrings.LENGTH - int(right), int(left) + 1)]
    want = [(int(c[1][0]), o) for c in got for o in range(substrings.BEFORE + 1) if c[4][0] >= o and c[5][0] >= np.int64(substrings.LENGTH) - o]
    assert sorted(seen) == sorted(want)  # each window once


def test_contexts_without_a_common_core_are_not_sorted(monkeypatch):
    import numpy as np

    r, n = np.random.default_rng(0), 400  # one K-gram, unlike surroundings but for two contexts
    m = r.integers(0, 256, (n, substrings.CONTEXT), np.uint8)
    m[:, substrings.BEFORE : substrings.BEFORE + substrings.K] = 65
    m[1, 40:] = m[0, 40:]
    sizes, whole = [], substrings._sorted_repeats
    monkeypatch.setattr(substrings, "_sorted_repeats", lambda text, ok: sizes.append(len(text)) or whole(text, ok))
    got = substrings.suffix_repeats(np.zeros(n, np.uint64), m, np.full(n, substrings.BEFORE, np.uint8), np.full(n, substrings.LENGTH, np.uint8))
    assert sizes == [2] and np.flatnonzero(got.any(1)).tolist() == [1] and np.flatnonzero(got[1]).tolist() == list(range(41))


def test_long_documents_and_chunks(docs, monkeypatch):
    r = random.Random(1)
    monkeypatch.setattr(substrings, "CHUNK", 3)
    monkeypatch.setattr(substrings, "BLOCK", 2000)
    monkeypatch.setattr(substrings, "BUCKET", 2000)
    text = "".join(r.choice("abc") for _ in range(9000))
    rows = [(1, text), (0, text[4000:7000]), (2, "x" + text[100:1600] * 2), (3, text[:1500]), (4, text[:1501])]
    assert run(docs(rows)) == plain(rows)


@pytest.mark.parametrize("size", [1499, 1500, 1501, 1860, 9000])
def test_parts_of_a_long_document_give_the_same_anchors(monkeypatch, size):
    import numpy as np
    import pyarrow as pa

    b = "".join(random.Random(size).choice("abc") for _ in range(size)).encode()
    at, h, c, _ = substrings.anchors(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]))
    monkeypatch.setattr(substrings, "PIECE", 1500)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([7]), pa.array([b], pa.binary())], names=["doc", "tid", "text"])
    got = [x for piece in substrings._pieces(iter([batch])) for x in zip(*(y.tolist() for y in substrings._found(piece)), strict=True)]
    assert sorted((p, a, k) for a, k, _, _, p in got) == sorted(zip(at.tolist(), h.tolist(), c.tolist(), strict=True))


def test_repeated_rows(docs):
    t = "".join(random.Random(2).choice("abcdef") for _ in range(400))
    rows = [(1, t), (1, t), (2, t), (None, t)]
    assert run(docs(rows)) == plain(rows)
    assert run(docs([])) == {}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {d: v[0] for d, v in plain(rows).items()}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.op1(spark, sf).collect()}
    assert got == {d: (*v[:3], hashlib.sha256(v[3]).hexdigest()) for d, v in want.items()}
