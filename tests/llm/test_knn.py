import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import knn


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score string")


def brute(rows, query, k):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in ok:
        if query(q):
            s = sorted((-(a @ b) / (np.sqrt(a @ a) * np.sqrt(b @ b)), i) for i, b in ok if i != q)[:k]
            out[q] = [(i, pytest.approx(-x, abs=1e-12)) for x, i in s]
    return out


def test_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    got = knn.op2(spark, sf).collect()
    e = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    want = brute([(r["vec_id"], r["embedding"], "") for r in e], lambda i: i % 50 == 0, 5)
    hit = sum(r["vec_id"] in [i for i, _ in want[r["query_id"]]] for r in got)
    assert hit >= 0.9 * sum(map(len, want.values())) and len(got) == sum(map(len, want.values()))
    ranks = {}
    for r in got:
        ranks.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    for v in ranks.values():
        v.sort()
        assert [x[0] for x in v] == list(range(1, len(v) + 1)) and all(a[1] > b[1] or (a[1] == b[1] and a[2] < b[2]) for a, b in zip(v, v[1:], strict=False))


def collect(df):
    got = {}
    for r in df.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: [(i, s) for _, i, s in sorted(v)] for q, v in got.items()}


def test_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(knn, "GROUP_ROWS", 4)
    inf, nan = float("inf"), float("nan")
    rows = [(i, [1.0, 0.0], "x") for i in range(0, 30)] + [(50, [0.0, 2.0], "x"), (51, None, ""), (100, [0.0, 0.0], ""), (53, [inf, 1.0], ""), (54, [nan, 1.0], ""), (55, [None, 1.0], ""), (56, [], ""), (57, [1.0, 2.0, 3.0], ""), (50, [0.0, 1.0], "twice"), (3, [1.0, 0.0], "again")]
    got = collect(knn.search(frame(spark, rows), F.col("vec_id") % 50 == 0))
    assert sorted(got) == [0, 50]
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5] and all(s == 1.0 for _, s in got[0])
    assert all(i != 50 for i, _ in got[50])


def test_copies_hold_most_rows_and_queries(spark, monkeypatch):
    monkeypatch.setattr(knn, "GROUP_ROWS", 64)
    monkeypatch.setattr(knn, "CELL_ROWS", 16)
    r = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in r.standard_normal(6)], "") for i in range(300)] + [(1000 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], "") for i in range(400)]
    got = collect(knn.search(frame(spark, rows), F.col("vec_id") % 10 == 0, target=1.0))
    want = brute(rows, lambda i: i % 10 == 0, 5)
    assert {q: v for q, v in got.items() if q >= 1000} == {q: v for q, v in want.items() if q >= 1000}
    hit = sum(i in [j for j, _ in want[q]] for q, v in got.items() for i, _ in v)
    assert set(got) == set(want) and hit >= 0.97 * sum(map(len, want.values()))


@pytest.mark.parametrize("width", [8, 24])
def test_two_trees_and_parts(spark, monkeypatch, width):
    for name, n in (("SAMPLE", 300), ("CELL_ROWS", 8), ("GROUP_ROWS", 100), ("CALIBRATION", 100)):
        monkeypatch.setattr(knn, name, n)
    r = np.random.default_rng(width)
    base = r.standard_normal((12, width))
    rows = [(i, [float(x) for x in base[i % 12] + 0.4 * r.standard_normal(width)], "") for i in range(2400)]
    cells = knn.Cells(knn._unit(np.array([v for _, v, _ in rows[:300]])), 2400)
    assert cells.fine is not None and cells.coarse.leaves * cells.fine.leaves >= 200
    x = knn._unit(np.array([v for _, v, _ in rows]))
    order = list(cells.visit(x[5]))
    assert sorted(order) == list(range(cells.coarse.leaves * cells.fine.leaves)) and cells.assign(x[5:6])[0] in order[:40]
    got, want = collect(knn.search(frame(spark, rows), F.col("vec_id") % 50 == 0)), brute(rows, lambda i: i % 50 == 0, 5)
    hit = sum(i in [j for j, _ in want[q]] for q, v in got.items() for i, _ in v)
    assert set(got) == set(want) and hit >= 0.9 * sum(map(len, want.values()))
    for q, v in got.items():
        exact = {i: s for i, s in brute(rows, lambda i, q=q: i == q, 2400)[q]}
        assert all(exact[i] == s for i, s in v)


def test_few_and_none(spark):
    assert knn.search(frame(spark, []), F.col("vec_id") == 0).count() == 0
    assert knn.search(frame(spark, [(0, [1.0], "")]), F.col("vec_id") == 0).count() == 0
    assert [tuple(r) for r in knn.search(frame(spark, [(0, [1.0, 1.0], ""), (7, [1.0, -1.0], "")]), F.col("vec_id") == 0).collect()] == [(0, 1, 7, 0.0)]
    ints = spark.createDataFrame([(0, [1, 1], 5), (7, [1, 0], 5), (None, [1, 1], 5)], "vec_id bigint, embedding array<int>, h1 int")
    assert [(r["query_id"], r["vec_id"]) for r in knn.search(ints, F.col("vec_id") == 0).collect()] == [(0, 7)]


def test_visits_every_leaf_in_the_end():
    x = np.random.default_rng(0).standard_normal((900, 8))
    c = knn.Cells(x, 900 * 12)
    assert c.coarse.leaves > 20
    order = list(c.visit(x[0]))
    assert len(order) == len(set(order)) == c.coarse.leaves * (c.fine.leaves if c.fine else 1) and order[0] == c.assign(x[:1])[0]
