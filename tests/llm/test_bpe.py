import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe

TEXTS = [None, "", " ", "hello world's  end", "naïve café 中文 😀\n\n\t x", "a" * 3000, "ab" * 2000, "x²½ \x1c\x1f 12", "trailing  ", "<|endoftext|>", "e\u0301"]


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = bpe.default_vocabulary()
    return tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=bpe.parse_ranks(bpe.read_ranks(path)), special_tokens={})


def test_like_tiktoken(reference, rng):
    path, pattern = bpe.default_vocabulary()
    c = bpe.codec(bpe.read_ranks(path), pattern)
    alphabets = ["ab", "etaoin ", "abc  \n\t", "éüñ中文😀a", "".join(map(chr, range(32, 127))), "\x1c²½a1 "]
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(a) for _ in range(rng.randint(0, 300))) for a in alphabets for _ in range(60)]
    for t in texts:
        ids = c.encode(t)
        assert ids == reference.encode_ordinary(t)
        assert c.decode(ids) == t.encode()


def test_small_caches_change_nothing(reference, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE_CACHE", 3)
    monkeypatch.setattr(bpe, "PAIR_CACHE", 3)
    path, pattern = bpe.default_vocabulary()
    c = bpe.Codec(bpe.parse_ranks(bpe.read_ranks(path)), pattern)
    t = " ".join(f"word{i % 7} thereof{i}" for i in range(200))
    assert c.encode(t) == reference.encode_ordinary(t)


def test_pieces_that_come_once_are_not_held(reference):
    path, pattern = bpe.default_vocabulary()
    c = bpe.Codec(bpe.parse_ranks(bpe.read_ranks(path)), pattern)
    once, twice = "".join(f" qzx{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}vw{'uvwxyz'[i // 100]}" for i in range(600)), " jkqzv" * 2
    assert c.encode(once + twice) == reference.encode_ordinary(once + twice)
    assert len(c.pieces) < 20 and " jkqzv" in c.pieces
    assert c.encode(once) == reference.encode_ordinary(once) and len(c.pieces) > 580
    assert c.encode(once) == reference.encode_ordinary(once)


def test_a_process_gives_memory_back_after_its_task(monkeypatch):
    from tessera.llm import workers

    done = []
    monkeypatch.setattr(workers, "release", lambda: done.append("released"))
    out = workers.resting(lambda batches: (b + 1 for b in batches))(iter([1, 2]))
    assert [next(out), next(out), list(done), list(out), done] == [2, 3, [], [], ["released"]]


def test_frame(spark, docs, reference):
    d = docs(list(enumerate(TEXTS)) + [(3, TEXTS[3])]).withColumn("ids", F.lit(1))
    out = bpe.encode_decode(d)
    assert out.columns == ["doc_id", "text", "n_lines", "toxicity", "n_tokens", "ids", "decoded"]
    for r in out.collect():
        t = TEXTS[r["doc_id"]] or ""
        want = reference.encode_ordinary(t)
        assert (r["n_tokens"], r["ids"], bytes(r["decoded"])) == (len(want), ",".join(map(str, want)), t.encode())
    assert bpe.encode_decode(d.limit(0)).count() == 0


def test_query(spark, reference):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = bpe.op4(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = reference.encode_ordinary(texts[r["doc_id"]])
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_null_ids_and_a_very_long_text(docs):
    long = "the quick brown fox, 12345 times; naïve café! " * 4500
    rows = {(r["doc_id"], r["decoded"].decode()): r["n_tokens"] for r in bpe.encode_decode(docs([(None, "a b"), (None, None), (7, long)])).collect()}
    assert set(rows) == {(None, "a b"), (None, ""), (7, long)} and len(long) > 200_000 and rows[None, ""] == 0


def test_the_collector_is_as_before_after_a_task():
    import gc

    from tessera.llm.workers import uncollected

    seen = []
    assert list(uncollected(lambda batches: (seen.append(gc.isenabled()) or b for b in batches))(iter([1, 2]))) == [1, 2]
    assert seen == [False, False] and gc.isenabled()
