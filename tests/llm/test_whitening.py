import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import whitening

SF = "/root/testdata/sf0.001"


def frame(spark, vectors, **more):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")


def plain(vectors, components=32):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    value, vector = np.linalg.eigh(c.T @ c / n)
    value, vector = value[::-1][:components], vector[:, ::-1][:, :components]
    return n, ((n * x - s) ** 2).sum(axis=1), c @ vector / np.sqrt(value), value / np.trace(c.T @ c / n)


def check(out, ids, vectors, components=32):
    n, deviation, z, explained = plain(vectors, components)
    k = z.shape[1]
    got = {(r["vec_id"], r["component"]): r for r in out}
    assert len(out) == len(got) == len(ids) * k
    white = np.array([[got[i, c + 1]["whitened"] for c in range(k)] for i in ids])
    white = white * np.sign((white * z).sum(axis=0))
    assert np.abs(white - z).max() < 1e-8
    for i, d in zip(ids, deviation.tolist(), strict=True):
        assert got[i, 1]["deviation"] == d
    assert {r["n"] for r in out} == {n}
    assert np.allclose([got[ids[0], c + 1]["explained"] for c in range(k)], explained, rtol=1e-10)
    assert {r["identity_error"] for r in out} == {out[0]["identity_error"]} and out[0]["identity_error"] < 1e-9


def test_table_equals_the_dense_decomposition(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    check(whitening.op13(spark, SF).collect(), [r["vec_id"] for r in rows], [r["embedding"] for r in rows])


def test_what_takes_no_part(spark):
    rng = np.random.default_rng(1)
    good = (rng.standard_normal((40, 3)) * [3, 2, 1]).tolist()
    bad = [None, [], [1, None, 2], [1, float("nan"), 2], [float("inf"), 0, 0], [1, 2], [1e300, 0, 0]]
    d = frame(spark, good + bad).withColumn("component", F.lit("own")).withColumn("n", F.lit(None))
    check(whitening.whiten(d).collect(), list(range(40)), good)
    repeated = frame(spark, good[:20] * 2).withColumn("vec_id", F.when(F.col("vec_id") % 20 > 0, F.col("vec_id") % 20))
    out = whitening.whiten(repeated, 2).collect()
    assert len(out) == 80 and sum(r["vec_id"] is None for r in out) == 4


@pytest.mark.parametrize("vectors", [[], [None], [[1, 2]], [[1, 2]] * 5, [[]]])
def test_no_variance_gives_no_rows(spark, vectors):
    assert whitening.whiten(frame(spark, vectors)).collect() == []


def test_fewer_components_where_variance_ends(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(-9, 9, 50)
    out = whitening.whiten(frame(spark, np.stack([a, 2 * a, 0 * a], 1).tolist())).collect()
    assert {r["component"] for r in out} == {1} and out[0]["explained"] == pytest.approx(1)


def test_lobpcg_walks_where_blocks_do_not_fill_the_space():
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.standard_normal((400, 400)))
    value = 1 / np.arange(1, 401) ** 1.5
    v = (q * value) @ q.T
    asked = []

    def multiply(block):
        asked.append(block.shape[1])
        return v @ block

    got, vectors, residuals, steps = whitening.lobpcg(multiply, 400, 10)
    assert np.allclose(got, value[:10], rtol=1e-11) and residuals.max() <= whitening.TOLERANCE
    assert np.abs(np.abs((vectors * q[:, :10]).sum(axis=0)) - 1).max() < 1e-10
    assert 3 < steps < 100 and max(asked) <= 2 * 18
    with pytest.raises(RuntimeError):
        whitening.lobpcg(multiply, 400, 10, steps=2)


def test_products_are_exact_enough_far_from_zero(spark):
    rng = np.random.default_rng(4)
    vectors = (rng.standard_normal((300, 8)) + 2.0**30).tolist()
    check(whitening.whiten(frame(spark, vectors), 4).collect(), list(range(300)), vectors, 4)


def test_squares_beyond_64_bits_are_exact():
    x = np.array([[1 << 45, 3], [5, -(1 << 45)]])
    d = whitening._deviations(x, 1 << 20, [7, 8])
    assert d.dtype == object and d[0, 0] == (1 << 65) - 7
    assert whitening._squares(d)[0] == ((1 << 65) - 7) ** 2 + (3 * (1 << 20) - 8) ** 2
    assert whitening._squares(np.array([[3, 4]])) == [25]
