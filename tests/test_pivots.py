import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import pivots
from tessera.operators.nearest import nearest


def frame(spark, x, name="source_id"):
    rows = [(f"s{i:05}" if name == "source_id" else i, None if v is None else [float(a) for a in v]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, f"{name} {'string' if name == 'source_id' else 'int'}, vector array<double>").withColumn("kind", F.lit("text_unit"))


def clustered(rng, n, dim=16, groups=40, width=0.05):
    centre = rng.standard_normal((groups, dim))
    return centre[rng.integers(groups, size=n)] + width * rng.standard_normal((n, dim))


def rows(df):
    return sorted((r["query_id"], r["rank"], r["source_id"], r["score"]) for r in df.collect())


def test_same_rows_and_few_met_on_clustered_data(spark):
    rng = np.random.default_rng(1)
    x = clustered(rng, 6000)
    v, q = frame(spark, x), frame(spark, x[rng.integers(len(x), size=25)] + 0.02 * rng.standard_normal((25, 16)), "query_id")
    found = pivots.search(pivots.build(v, 16), q)
    assert rows(found.hits) == rows(nearest(v, q))
    met = {r["query_id"]: r["vectors"] for r in found.met.collect()}
    assert len(met) == 25 and np.mean(list(met.values())) < 0.5 * len(x)


@pytest.mark.parametrize("top_k", [1, 5, 700])
def test_same_rows_without_clusters_with_copies_and_odd_vectors(spark, monkeypatch, top_k):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(pivots, "ROWS", 20)
    monkeypatch.setattr(pivots, "PIVOTS", 7)
    monkeypatch.setattr(pivots, "AT_ONCE", 3)
    x = [*rng.standard_normal((300, 8)), *([[1.0] * 8] * 200), None, [], [0.0] * 8, [1.0] * 7, [float("nan")] * 8, *(-np.eye(8))]
    v = frame(spark, x)
    q = frame(spark, [*rng.standard_normal((5, 8)), [2.0] * 8, np.eye(8)[0], None, [0.0] * 8, [1.0] * 7], "query_id")
    assert rows(pivots.search(pivots.build(v, 8), q, top_k).hits) == [r for r in rows(nearest(v, q, top_k)) if r[0] != 9]


def test_empty_index_and_kinds(spark):
    q = frame(spark, [[1.0, 0.0]], "query_id")
    assert pivots.search(pivots.build(frame(spark, [None]), 2), q).hits.collect() == []
    v = frame(spark, [[1.0, 0.0], [0.0, 1.0]]).withColumn("kind", F.when(F.col("source_id") == "s00001", "entity").otherwise("text_unit"))
    assert rows(pivots.search(pivots.build(v, 2, "entity"), q).hits) == [(0, 1, "s00001", 0.0)]
    with pytest.raises(ValueError):
        pivots.search(pivots.build(v, 2), q, 0)
