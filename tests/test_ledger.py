"""The bucketed ledger against a dictionary, batch by batch."""

import random

from pyspark.sql import functions as F

from cohortlens.session import scratch_path
from cohortlens.sources.ledger import Ledger

SCHEMA = "k long, name string, at long, id long, v double, bad boolean"


def put(book, batch):
    for k, name, at, i, v, bad in batch:
        old = book.setdefault((k, name), [None, 0])
        old[1] += 1
        if not bad and (old[0] is None or (at, i) > (old[0][0], old[0][1])):
            old[0] = (at, i, v)


def rows_of(book):
    return sorted(str((k, n, row, tries)) for (k, n), (row, tries) in book.items() if row)


def read(spark, ledger):
    return sorted(str((r.k, r["name"], (r.at, r.id, r.v), r.attempts)) for r in ledger.rows(spark).collect())


def stored(spark, ledger):
    """Files of each bucket."""
    out = {}
    for r in spark.read.parquet(ledger.path).select("bucket", F.input_file_name().alias("f")).distinct().collect():
        out.setdefault(r.bucket, set()).add(r.f)
    return out


def test_batches_replays_and_untouched_buckets(spark):
    random.seed(10)
    ledger = Ledger(scratch_path(spark, "ledger"), ("k", "name"), (F.col("at").desc(), F.col("id").desc()), 8)
    book, files = {}, {}
    for b in range(4):
        keys = list(range(40)) + [None] if b < 2 else [3, 4]
        batch = [(random.choice(keys), random.choice(["a", None]), random.randrange(9), 1000 * b + i, random.random(), random.random() < 0.4) for i in range(60 if b < 2 else 5)]
        df = spark.createDataFrame(batch, SCHEMA)
        touched = ledger.apply(df.withColumnRenamed("bad", "flag"), F.col("flag"), b)
        put(book, batch)
        assert read(spark, ledger) == rows_of(book)
        if b >= 2:
            now = stored(spark, ledger)
            assert len(touched) <= 4 and all(now[x] == files[x] for x in now if x not in touched)
        again = ledger.apply(df.withColumnRenamed("bad", "flag"), F.col("flag"), b)
        assert again == touched and read(spark, ledger) == rows_of(book)
        files = stored(spark, ledger)
    left = {(r.k, r["name"]): r.attempts for r in ledger.open_keys(spark, 3).collect()}
    assert left == {key: n for key, (row, n) in book.items() if row is None and n < 3}


def test_an_empty_batch_writes_nothing(spark):
    ledger = Ledger(scratch_path(spark, "ledger"), ("k",), (F.col("at").desc(),), 4)
    assert ledger.apply(spark.createDataFrame([], "k long, at long"), F.lit(False), 0) == []
    assert ledger.apply(spark.createDataFrame([(1, 2)], "k long, at long"), F.lit(None).cast("boolean"), 1) != []
    assert ledger.apply(spark.createDataFrame([], "k long, at long"), F.lit(False), 2) == []
    assert ledger.rows(spark).count() == 1
