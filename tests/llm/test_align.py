import hashlib
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessera.llm import align

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    """Both libraries on whole texts, and every step in plain loops."""
    a_path, b_path = align.default_vocabularies()
    a = Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=b_path)
    char = align.byte_of_char()

    def tokens(text):
        if not text:
            return [], []
        of_a = [(i, bytes(char[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        of_b = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        want = (" " + text).encode()
        return (of_a, of_b) if b"".join(x for _, x in of_a) == want == b"".join(x for _, x in of_b) else ([], [])

    def spans(found):
        at, out = 0, []
        for i, x in found:
            out.append((i, at, at + len(x)))
            at += len(x)
        return out

    def corpus(texts):
        told, count = [], Counter()
        for t in texts:
            x, y = map(spans, tokens(t))
            cuts = sorted({e for _, _, e in x} & {e for _, _, e in y})
            groups = [(",".join(str(i) for i, s, e in x if lo < e <= hi), ",".join(str(i) for i, s, e in y if lo < e <= hi)) for lo, hi in zip([0, *cuts], cuts)]
            pairs, first = [], 0
            for i, s, e in x:
                while first < len(y) and y[first][2] <= s:
                    first += 1
                k = first
                while k < len(y) and y[k][1] < e:
                    pairs.append((i, y[k][0]))
                    k += 1
            count.update(pairs)
            told.append((len(x), len(y), groups, pairs))
        most = defaultdict(int)
        for (_, j), n in count.items():
            most[j] = max(most[j], n)
        return [(n_a, n_b, len(g), len(p), sum(count[q] == most[q[1]] for q in p), sum(count[q] for q in p), ";".join("|".join(q) for q in g)) for n_a, n_b, g, p in told]

    return corpus


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
HARD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a\n\n b", "\n\na\n", "a\tb \t c", "x\r\ny", "x  y", "it's  don't", "▁", "a ▁ b", "a▁ b", "<s> </s> <unk> <0x41>", "<|endoftext|> and <|endoftext|>",
    "naïve café — “quoted”", "日本語のテキスト です", "😀😀 emoji‍ x", "ΑΒΓ αβγ", "1 234 567", "\u0085 x", "\x1c y", "é combining", "﻿bom", "x　 y", "trailing  ", "a" * 300, ("word " * 6000).strip(), "x" * 4000,
]


def test_tables_and_hard_texts_equal_plain_loops(spark, docs, plain):
    texts = HARD + ["the same text twice, the same text"] * 3
    assert any(t and "▁" in t for t in texts)
    d = docs(list(enumerate(texts)))
    got = {r["doc_id"]: tuple(r[c] for c in NAMES) for r in align.align(d).collect()}
    for i, want in enumerate(plain(texts)):
        assert got[i] == want, texts[i]
    table = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    want = plain([r["text"] for r in table])
    op = {r["doc_id"]: r for r in align.op12(spark, SF).collect()}
    for r, w in zip(table, want, strict=True):
        x = op[r["doc_id"]]
        assert tuple(x[c] for c in NAMES[:-1]) == w[:-1]
        assert x["groups_sha256"] == (hashlib.sha256(w[-1].encode()).hexdigest() if w[0] else "")


def test_random_texts(docs, plain):
    rng = random.Random(3)
    parts = ["a", "The", "zebra", " ", "  ", "\n", "\t", "\r", ".", "'s", "ß", "é", "1", "22", "▁", " ", "中", "😀", "_", "--", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(600)]
    got = {r["doc_id"]: tuple(r[c] for c in NAMES) for r in align.align(docs(list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == plain(texts)


def test_rare_pairs_meet_their_counts_by_a_shuffle(docs, monkeypatch):
    d = docs([(i, f"some words {i} of the common text {i % 3}") for i in range(40)])
    want = sorted(align.align(d).collect())
    monkeypatch.setattr(align, "HOT", 30)
    assert sorted(align.align(d).collect()) == want
    monkeypatch.setattr(align, "HOT", 0)
    assert sorted(align.align(d).collect()) == want


def test_memory_is_given_up_and_long_segments_pass(monkeypatch, plain):
    monkeypatch.setattr(align, "REMEMBERED", 20)
    a = align.Aligner(align.Tokenizers(*(open(p, "rb").read() for p in align.default_vocabularies())))
    texts = [f"w{i} x{i * 7} common y" for i in range(60)]
    got = []
    for t in texts:
        got += zip(*(c.to_pylist() for c in a.columns([t])), strict=True)
    assert [x[:5] for x in got] == [(w[0], w[1], w[2], w[3], w[6]) for w in plain(texts)]


def test_null_ids_repeated_rows_empty_table_and_clashing_columns(docs, spark):
    out = align.align(docs([(None, "a b"), (None, "a b"), (1, None), (1, "c")])).collect()
    assert len(out) == 4 and sorted(r["n_a"] for r in out) == [0, 1, 2, 2]
    assert align.align(docs([])).collect() == []
    d = spark.createDataFrame([(1, "a b", "x", 5, "y")], "doc_id bigint, text string, n_best string, codes int, own string")
    (r,) = align.align(d).collect()
    assert (r["n_best"], r["own"]) == (2, "y")


def test_labels_scan_into_groups():
    import numpy as np

    label = align.labels(np.array([1, 2, 3]), np.array([2, 1, 3]))
    assert bytes(label) == b"ab|..|"
    assert [x.tolist() for x in align.groups(label, align._Spans())] == [[2, 1], [2, 1]]
    assert [x.tolist() for x in align.links(label)] == [[0, 1, 2, 5], [0, 1, 1, 2], [0, 0, 1, 2]]
