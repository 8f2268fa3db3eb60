"""What the operators shuffle, and when it goes."""

import os

from pyspark.sql import functions as F

from cohortlens.llm import common


def test_only_marked_texts_are_packed(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(4000)] + [(None, None)], "doc_id long, text string")
    base = common.keyed(docs)
    wanted = base.where("doc % 40 = 0").select(F.col("th").alias("t2"))
    got = {r.doc for r in common.zipped(base, common.marked(wanted, "t2")).select("doc").collect()}
    assert set(range(0, 4000, 40)) <= got and len(got) < 800
    assert common.zipped(base, common.marked(wanted.limit(0), "t2")).count() == 0


def test_shuffle_files_go_with_their_step(spark):
    common.tuned(spark)
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {f for d in manager.localDirsString() for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_") and f.endswith(".data")}

    before = shuffles()
    common.settle(spark.range(20000).groupBy((F.col("id") % 999).alias("k")).count())
    assert not shuffles() - before
