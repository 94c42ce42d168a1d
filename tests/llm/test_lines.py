from pyspark.sql import functions as F

from tessera.llm import lines

WS = " \t\n\x0b\f\r"
LONG = "This line is well over forty characters long, é too"


def plain(rows):
    key = lambda x: x.strip(WS).translate({i: i + 32 for i in range(65, 91)})
    where = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                where.setdefault(key(x), set()).add(d)
    hot = {k: max(v) for k, v in where.items() if len(v) >= 5}
    out = []
    for d, t in rows:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if hot.get(key(x), d) == d]
        out.append((d, len(all_), len(all_) - len(kept), "\n".join(kept)))
    return sorted(out)


def run(df):
    return sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in lines.dedup_lines(df).collect())


def test_like_plain_python(docs, rng):
    pool = [LONG, "  " + LONG.upper().replace("É", "é") + "\t", LONG.replace("é", "É"), "short", "", "another long line that repeats across many documents here"]
    rows = [(i, "\n".join(rng.choice([*pool, f"line of its own, number {i}-{j}, that is long enough"]) for j in range(rng.choice([0, 1, 5, 200])))) for i in range(40)]
    rows += [(40, None), (41, ""), (42, "\n\n"), (43, LONG + "\n" + LONG)]
    assert run(docs(rows)) == plain(rows)


def test_repeated_rows_and_ids(docs):
    rows = [(i, LONG) for i in range(5)] + [(4, LONG), (4, "other\n" + LONG)]
    got = run(docs(rows))
    assert got[:4] == [(i, 1, 1, "") for i in range(4)]
    assert sorted(got[4:]) == sorted([(4, 1, 0, LONG), (4, 1, 0, LONG), (4, 2, 0, "other\n" + LONG)])


def test_bitmap_and_columns(docs):
    out = lines.dedup_lines(docs([(i, "\n".join([LONG, f"own {i}"])) for i in range(6)])).orderBy("doc_id").collect()
    assert [r["keep_bitmap"] for r in out] == ["2"] * 5 + [""] and "toxicity" in out[0]
    assert lines.dedup_lines(docs([])).count() == 0


def test_clashing_columns_pass_through(docs):
    own = {c: F.lit(c) for c in ("tid", "drops", "none", "back", "h1", "pos", "line", "key")}
    out = lines.dedup_lines(docs([(i, LONG) for i in range(6)]).withColumns(own))
    assert {tuple(r[c] for c in own) for r in out.collect()} == {tuple(own)} and out.where("n_dropped = 1").count() == 5


def test_null_ids_are_documents_of_their_own(docs):
    rows = [(None, f"{LONG}\nown {i}") for i in range(6)] + [(None, f"{LONG}\nown 0")]
    got = sorted((r["n_dropped"], r["text"]) for r in lines.dedup_lines(docs(rows)).collect())
    assert sum(n for n, _ in got) in (5, 6) and len({t for n, t in got if n == 0}) == 1  # one text keeps the line
    low = -(2**63)
    got = run(docs([(low, LONG), (1, LONG), (2, LONG), (3, LONG), (2**63 - 1, LONG)]))
    assert got == [(low, 1, 1, ""), (1, 1, 1, ""), (2, 1, 1, ""), (3, 1, 1, ""), (2**63 - 1, 1, 0, LONG)]
    mixed = {(r["doc_id"], r["n_dropped"]) for r in lines.dedup_lines(docs([(low, LONG), (None, LONG), (None, LONG + "\nx"), (None, LONG + "\ny"), (None, LONG + "\nz")])).collect()}
    assert mixed == {(low, 0), (None, 1)}  # null ids stand below every number
    few = docs([(None, LONG)] * 6 + [(1, LONG), (2, LONG), (3, LONG)])
    assert sum(r["n_dropped"] for r in lines.dedup_lines(few).collect()) == 0  # equal texts without an id count once


def test_ranges_are_shuffled_once(spark, docs, rng):
    rows = [(i, "\n".join([LONG, f"a line of its own that is long enough, {i}"])) for i in range(50)]
    plan = lines.streamed(lines.occurrences(docs(rows)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "rangepartitioning" in plan


def test_very_long_text(docs):
    text = "\n".join([f"{LONG} {i % 3000}" for i in range(20_000)])
    rows = [(i, text) for i in range(5)]
    got = run(docs(rows))
    assert [(d, n, k) for d, n, k, _ in got] == [(i, 20_000, 20_000) for i in range(4)] + [(4, 20_000, 0)]
