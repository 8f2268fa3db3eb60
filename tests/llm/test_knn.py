import math
import random

from pyspark.sql import functions as F

from cohortlens.llm import knn


def brute(rows, k, scale=256.0):
    code = [(n, i, [math.floor(scale * x) for x in v]) for n, (i, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, q, a in code:
        if q is not None and q % 5 == 0:
            scores = [(-sum(x * y for x, y in zip(a, b)), i is None, i or 0, m) for m, i, b in code if m != n]
            out += [(q, r + 1, None if s[1] else s[2], -s[0]) for r, s in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def result(df):
    return sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect()), key=str)


def check(spark, rows, k=5):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert result(knn.top_k(df, F.col("id") % 5 == 0, k)) == brute(rows, k)


def test_random(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", 16)
    random.seed(1)
    rows = [(i, [random.gauss(0, 0.3) for _ in range(12)]) for i in range(500)]
    check(spark, rows)


def test_ties_and_odd_vectors(spark):
    rows = [(i, [0.5, -0.25, 0.125]) for i in range(40)] + [(5, [0.5, -0.25, 0.125]), (None, [0.5, 0.5, 0.5])]
    rows += [(41, None), (42, []), (43, [0.1, None]), (44, [float("nan"), 1.0]), (45, [float("inf"), 1.0]), (50, [1.0]), (55, [0.1, 0.2, 0.3, 0.4])]
    check(spark, rows)


def test_fewer_than_k(spark):
    check(spark, [(0, [1.0, 2.0]), (1, [0.5, 0.5])])
    check(spark, [(0, [1.0, 2.0])])
    check(spark, [])


def test_blocks_are_skipped():
    import numpy as np

    rng = np.random.default_rng(0)
    c = np.sort(rng.integers(0, 1000, (4000, 1)), axis=0).astype(float)
    c = np.hstack([c, np.ones_like(c)])
    seen = []
    real = knn._dots
    knn._dots = lambda q, part, exact: seen.append(len(part)) or real(q, part, exact)
    try:
        n = np.arange(len(c))
        i, cid, _, score = knn.search(c[-1:], np.array([3999]), np.array([-knn._LONG]), c, n, n, 5, block=100)
    finally:
        knn._dots = real
    assert sum(seen) <= 300 and sorted(score.tolist(), reverse=True) == sorted((c[:-1] @ c[-1]).astype(int).tolist())[-5:][::-1]


def test_large_components(spark):
    rows = [(i, [1e30 * (i + 1), -1.0, 3e7]) for i in range(6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = knn.top_k(df, F.col("id") == 0, 5).collect()
    assert [r.vec_id for r in got] == [1, 2, 3, 4, 5] and {r.score for r in got} == {(1 << 63) - 1}
