import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import mixing


def fill(sizes, weights=(1, 2, 3), cap=3):
    """Targets by taking the excess away again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in capped)
        open_ = sum(w[s] for s in names if s not in capped)
        share = {s: cap * sizes[s] if s in capped else rest * w[s] / open_ for s in names}
        more = {s for s in names if s not in capped and share[s] > cap * sizes[s]}
        if not more:
            return share
        capped |= more


def frame(spark, counts):
    rows = [(i * 7919 % 100003, " ".join(["w"] * (1 + i * i % 23)), s) for i, s in enumerate(s for s, n in counts for _ in range(n))]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.mark.parametrize("counts", [[("a", 300), ("b", 40), ("Z", 60), ("é", 5), (None, 90)], [("a", 5)], [("b", 200), ("c", 2), ("d", 2), ("e", 2)]])
def test_targets_and_copies(spark, counts):
    df = frame(spark, counts)
    rows = mixing.mix(df).select("row.doc_id", "row.source", "size", "source_size", "target", "copies").collect()
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    want = fill(sizes)
    for s, size in sizes.items():
        own = [r for r in rows if r.source == s]
        assert {r.source_size for r in own} == {size}
        assert own[0].target == pytest.approx(want[s])
        taken = sum(r["size"] * r.copies for r in own)
        assert abs(taken - want[s]) <= max(23, 0.02 * want[s])
        assert max(r.copies for r in own) <= 3
    again = mixing.mix(df.repartition(5)).select("row.doc_id", "copies").collect()
    assert sorted((r.doc_id, r.copies) for r in again) == sorted((r.doc_id, r.copies) for r in rows)


def test_sql_twin(spark):
    df = frame(spark, [("a", 120), ("b", 30), ("Z", 60), ("é", 5), (None, 40)])
    documents = pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns)  # noqa: F841
    want = duckdb.sql(mixing.sql()).fetchall()
    got = mixing.mix(df).select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")), "copies").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_hard_cases(hard, empty):
    rows = mixing.mix(hard).collect()
    assert len(rows) == hard.count()
    assert all(r.copies == 0 or r["size"] > 0 or r.target > 0 for r in rows)
    assert mixing.emit(mixing.mix(hard)).columns == hard.columns
    assert mixing.mix(empty).count() == 0


def test_numbered(spark):
    df = spark.range(5000).withColumn("k", F.col("id") * 7919 % 5003).repartition(7)
    rows = mixing.numbered(df, [F.col("k").asc()], "n").orderBy("k").collect()
    assert [r.n for r in rows] == list(range(5000))
