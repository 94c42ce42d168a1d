import itertools
import zlib

import numpy as np

import corpus_pipeline
from tessera.llm import bpe, lines, registry, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "byte_bpe"]
    sizes, cols = [docs.count()], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        sizes.append(docs.count())
        if name != "byte_bpe":
            assert docs.columns == cols
    assert sizes == sorted(sizes, reverse=True) and sizes[1] == sizes[2] and sizes[4] == sizes[5] > 0.5 * sizes[0]
    assert all(r["round_trip"] for r in docs.collect())


def test_run_gives_the_ids_of_kept_texts(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    path, pattern = bpe.default_vocabulary()
    c = bpe.codec(bpe.read_ranks(path), pattern)
    for r in rows:
        assert len(c.decode(map(int, filter(None, r["ids"].split(",")))).decode()) == r["n_chars"]


def test_registry_has_one_query_an_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in registry.QUERIES) == list(range(1, 14))


LONG = "This line is well over forty characters long and stands in many texts"


def write(spark, path, docs, labels=(), bench=((1, "one two three four five six seven eight nine ten"),)):
    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in CLASH)
    spark.createDataFrame([(i, t, None, "s", len(t or ""), *CLASH) for i, t in docs], columns).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(bench), "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


CLASH = ("toxicity", "n_lines", "n_dropped", "keep_bitmap", "n_tokens", "ids", "round_trip", "decoded", "keep_id", "tid", "fp", "h")


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set() for w in (a.split(), b.split()))
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_run(docs, labels, bench, codec):
    """The stages in plain Python: (doc_id, ids) of what stays; the toxicity model alone is the operator's."""
    text = dict(docs)
    train = sorted((i, y) for i, _, y in labels if y in (0, 1) and i in text and zlib.crc32(str(i).encode()) % 3 != 1)
    y = np.array([y for _, y in train])
    if len(set(y.tolist())) == 2:
        m = toxicity.fit([text[i] for i, _ in train], y, float(y.mean()))
        docs = [d for d, s in zip(docs, m.score([t for _, t in docs]), strict=True) if s < corpus_pipeline.TOXIC]
    key = lambda x: x.strip(lines.SPACE).translate({i: i + 32 for i in range(65, 91)})
    where = {}
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                where.setdefault(key(x), set()).add(i)
    last = {k: max(v) for k, v in where.items() if len(v) >= 5}
    docs = [(i, "\n".join(x for x in (t or "").split("\n") if last.get(key(x), i) == i)) for i, t in docs]
    up = list(range(len(docs)))

    def find(x):
        return x if up[x] == x else find(up[x])

    for a, b in itertools.combinations(range(len(docs)), 2):
        if jaccard(docs[a][1], docs[b][1]) >= 0.8:
            up[max(find(a), find(b))] = min(find(a), find(b))
    docs = [d for x, d in enumerate(docs) if find(x) == x]
    import re

    tok = lambda t: re.findall(r"[^\W_]+", t.lower())

    def leaks(t, p):
        a, b = tok(t), tok(p or "")
        w = min(len(b), 20)
        if len(b) < 5:
            return False
        for at in range(1 - len(b), len(a)):
            eq = [0 <= at + x < len(a) and a[at + x] == b[x] for x in range(len(b))]
            if any(5 * sum(eq[x : x + w]) >= 4 * w for x in range(len(b) - w + 1)):
                return True
        return False

    return sorted((i, ",".join(map(str, codec.encode(t)))) for i, t in docs if not any(leaks(t, p) for _, p in bench))


def test_like_plain_python(spark, tmp_path, rng):
    words = [f"w{i}" for i in range(300)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    bench = [(1, say(30)), (2, say(12)), (3, None)]
    docs, labels = [], []
    for i in range(120):
        kind, t = i % 8, say(rng.randint(20, 60))
        if kind == 1:
            t += " nastyword nastyones"
        elif kind == 2:
            t += "\n" + LONG + "\n" + say(3)
        elif kind == 3 and docs:
            t = (docs[-1][1] or "x") + (" tail" if i % 16 == 3 else "")
        elif kind == 4:
            t += " " + bench[i % 3 and 1][1] + " end"
        docs.append((i, t))
        labels.append((i, 1, int("nasty" in t)))
    docs += [(120, None), (121, ""), (122, say(20_000)), (123, "\n" + LONG + "\n")]
    sf = write(spark, tmp_path / "t", docs, labels, bench)
    path, pattern = bpe.default_vocabulary()
    codec = bpe.codec(bpe.read_ranks(path), pattern)
    got = sorted((r["doc_id"], r["ids"]) for r in corpus_pipeline.run(spark, sf).collect())
    want = plain_run(docs, labels, bench, codec)
    assert got == want and 50 < len(got) < 110


def test_nulls_repeats_ties_and_clashing_columns(spark, tmp_path):
    a, b = "first of the clean texts that nobody copied at all", "second text, of other words than those before it"
    docs = [(None, a), (None, b), (7, a + " and then some more words to differ"), (7, "third, about nothing that others say"), (8, b), (8, b), (9, None), (None, ""), (None, LONG)]
    sf = write(spark, tmp_path / "t", docs)
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, sf)
        assert frame.columns[-len(CLASH) :] == list(CLASH)
    kept = frame.collect()
    assert all(tuple(r[c] for c in CLASH) == CLASH for r in kept)
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == sorted([("None", a), ("7", docs[2][1]), ("7", docs[3][1]), ("8", b), ("9", ""), ("None", LONG)])
    last = corpus_pipeline.encode(spark, frame, sf)
    assert last.columns.count("n_tokens") == last.columns.count("ids") == 1 and {r["decoded"] for r in last.collect()} == {"decoded"}


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, write(spark, tmp_path / "t", [], [], [])).count() == 0
