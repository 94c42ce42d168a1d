import zlib

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import langid


def test_codebook():
    for k in (2, 3, 4, 5, 9):
        c = langid.codebook(k)
        assert c.shape[0] == k and set(np.unique(c)) <= {-1.0, 1.0}
        assert min((c[i] != c[j]).sum() for i in range(k) for j in range(i)) >= 1 + (k > 3)


def slow_predict(m, text):
    """A text's language and score in plain loops, n-gram by n-gram."""
    grams = []
    for w in langid.WORDS((text or "").lower()):
        w = "".join(c for c in w if c.isalpha())
        if w:
            w = f" {w} "
            grams += [zlib.crc32(w[i : i + n].encode("utf-8", "surrogatepass")) % langid.BUCKETS for n in (1, 2, 3, 4) for i in range(len(w) - n + 1)]
    if not grams:
        return "und", 0.0
    margins = sum(m.weights[g].astype(float) for g in grams) / len(grams) + m.bias
    loss = [sum(t * np.log1p(np.exp(-x * c)) for x, c, t in zip(margins, code, m.trust, strict=True)) for code in m.code]
    p = np.exp(-np.array(loss) + min(loss))
    return m.langs[int(np.argmin(loss))], float(p.max() / p.sum())


def test_predicts_like_plain_loops(rng):
    words = {"en": "the of and hello that with", "de": "der die und nicht ein mit", "fr": "le la les des avec pas", "ru": "это не что как для они", "es": "el los una por con para", "it": "il che di per una gli"}
    for langs in (list(words)[:4], list(words)):  # every split as a bit, and a code of fixed length
        rows = [(" ".join(rng.choices(words[x].split(), k=12)), x) for x in langs for _ in range(15)]
        m = langid.fit([t for t, _ in rows], [x for _, x in rows])
        texts = [t for t, _ in rows[::7]] + [None, "", "1 2", "ǅ ²x", "the der les", "x" * 5000, "und " * 3000 + "the"]
        names, scores, _ = m.predict(texts)
        for t, n, s in zip(texts, names, scores, strict=True):
            want = slow_predict(m, t)
            assert n == want[0] and abs(s - want[1]) < 1e-4


def test_null_ids(docs):
    m = langid.fit(["the hello of", "der die und"] * 4, ["en", "de"] * 4)
    d = docs([(None, "the"), (None, "der"), (3, "the")])
    out = langid.identify(d, m).select("doc_id", "lang_pred", langid.held_out(F.col("doc_id")).alias("h")).collect()
    assert sorted(r["lang_pred"] for r in out) == ["de", "en", "en"] and {r["h"] for r in out if r["doc_id"] is None} == {False}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = langid.op3(spark, sf).collect()
    assert len(rows) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and lang[r["doc_id"]]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97


def test_edges(spark, docs):
    m = langid.fit(["the hello of", "der die und", "le la les"] * 4, ["en", "de", "fr"] * 4)
    d = docs([(1, None), (2, ""), (3, "12 ²! "), (4, "Hello the"), (5, "der " * 50_000), (4, "Hello the")]).withColumnRenamed("n_lines", "lang_pred")
    rows = langid.identify(d, m).collect()
    assert {(r["doc_id"], r["lang_pred"]) for r in rows} == {(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "de")} and len(rows) == 6
    assert all(r["lang_score"] == 0 and not r["lang_ambiguous"] for r in rows if r["lang_pred"] == "und")
    assert langid.identify(docs([]), m).count() == 0
    assert langid.identify(docs([(1, "x")]), None).first()["lang_pred"] == "und"
    one = langid.fit(["some words"], ["xx"])
    assert one.predict(["words", ""])[0] == ["xx", "und"] and one.predict(["words"])[1][0] == 1.0
    assert langid.fit([], []) is None
    none = spark.createDataFrame([(1, None, "en"), (2, "a", None)], "doc_id bigint, text string, lang string")
    assert langid.train(none) is None
