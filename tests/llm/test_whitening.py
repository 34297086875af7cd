import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import types as T

from spanloom.llm import whitening
from spanloom.llm.queries import QUERIES

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("x", T.StringType()), T.StructField("n", T.StringType())])


def steps(vectors):
    return [tuple(math.floor(256 * c) for c in v) for v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]


def plain(vectors, many):
    """Exact mean and covariance in fractions, then numpy's eigenvectors."""
    kept = sorted(set(steps(vectors)))
    n, width = len(kept), len(kept[0])
    sums = [sum(x[i] for x in kept) for i in range(width)]
    centred = [[Fraction(x[i]) - Fraction(sums[i], n) for i in range(width)] for x in kept]
    v = np.array([[float(sum(y[i] * y[j] for y in centred) / n) for j in range(width)] for i in range(width)])
    e, axes = np.linalg.eigh(v)
    order = np.argsort(-e)[:many]
    return n, sums, e[order], axes[:, order], np.trace(v)


def check(spark, vectors, many=4):
    rows = spark.createDataFrame([(i, v, "other", "column") for i, v in enumerate(vectors)], SCHEMA).repartition(3)
    got = {(r.vec_id, r.component): r for r in whitening.whiten(rows, components=many).collect()}
    n, sums, e, axes, trace = plain(vectors, many)
    signs = {}
    good = [i for i, v in enumerate(vectors) if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    assert sorted(got) == [(i, k + 1) for i in good for k in range(len(e))]
    for i in good:
        x = steps([vectors[i]])[0]
        for k in range(len(e)):
            r = got[i, k + 1]
            assert (r.n, r.deviation) == (n, sum((n * a - s) ** 2 for a, s in zip(x, sums)))
            assert r.explained == pytest.approx(e[k] / trace, rel=1e-9)
            want = float(sum((a - s / n) * b for a, s, b in zip(x, sums, axes[:, k]))) / math.sqrt(e[k])
            if abs(want) > 1e-6:
                sign = signs.setdefault(k, np.sign(want * r.whitened))
                assert sign * r.whitened == pytest.approx(want, rel=1e-7, abs=1e-9)
            assert r.identity_error < 1e-9
    return got


def test_against_fractions(spark):
    random = np.random.default_rng(5)
    vectors = (random.normal(size=(200, 6)) * [1, 2, 3, 4, 5, 6] + 3).tolist()
    vectors += vectors[:40] * 3 + [None, [1.0, None, 2.0, 0.0, 0.0, 1.0], [float("nan")] * 6, [float("inf")] + [0.0] * 5]
    check(spark, vectors)


def test_large_mean_and_all_components(spark):
    random = np.random.default_rng(6)
    vectors = (random.normal(size=(60, 3)) + 1e5).tolist()
    check(spark, vectors, many=9)


def test_degenerate(spark):
    def rows(*vectors):
        return whitening.whiten(spark.createDataFrame([(i, v, None, None) for i, v in enumerate(vectors)], SCHEMA)).collect()

    assert rows() == []
    assert rows(None, []) == []
    one = rows([1.0, 2.0], [1.0, 2.0], [1.0, 2.0, 3.0])  # the less common width is left out
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(one)] == [(i, k, 1, 0, None, None, None) for i in (0, 1) for k in (1, 2)]
    line = {(r.vec_id, r.component): r for r in rows([0.0, 0.0], [1.0, 0.0], [2.0, 0.0])}
    assert line[0, 2].whitened is None and line[0, 2].explained == 0 and abs(line[0, 1].whitened) == pytest.approx(math.sqrt(1.5))
    huge = rows([1e300, 0.0], [0.0, 0.0])
    assert all(r.deviation is None and r.n == 2 for r in huge)


def test_query(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    vectors = duckdb.sql(f"SELECT vec_id, embedding FROM '{folder}/embeddings.parquet'").fetchall()
    got = {(r.vec_id, r.component): r for r in QUERIES["op11_embedding_whitening"](spark, folder).collect()}
    n, sums, e, axes, trace = plain_numpy([v for _, v in vectors])
    assert len(got) == 4 * len(vectors)
    for i, v in vectors[:50]:
        x = [math.floor(256 * c) for c in v]
        assert got[i, 1].deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums)) and got[i, 1].n == n
        for k in range(4):
            want = sum((a - s / n) * b for a, s, b in zip(x, sums, axes[:, k])) / math.sqrt(e[k])
            assert abs(got[i, k + 1].whitened) == pytest.approx(abs(want), rel=1e-6, abs=1e-9)
            assert got[i, k + 1].explained == pytest.approx(e[k] / trace)
            assert got[i, k + 1].identity_error < 1e-9


def plain_numpy(vectors):
    kept = np.array(sorted(set(steps(vectors))))
    y = kept - kept.sum(axis=0) / len(kept)
    e, axes = np.linalg.eigh(y.T @ y / len(kept))
    return len(kept), kept.sum(axis=0).tolist(), e[::-1], axes[:, ::-1], e.sum()
