"""A ledger of the latest row of each key, kept in buckets of its keys.

A batch rewrites only the buckets that it touches, by dynamic partition overwrite, so the
cost of a batch follows the batch and not the ledger. Applying a batch again changes
nothing: rows are told apart by the ledger's order, and attempts by the number of the
batch that counted them last."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, discard, exists

#: Columns that the ledger adds to its rows.
OWN = ("durable", "attempts", "last_batch", "bucket")


@dataclass(frozen=True)
class Ledger:
    """Rows at ``path`` by ``keys``; of a key's rows the first in ``order`` (falling
    columns, total over different rows) is kept. The number of buckets belongs to the
    path: all batches must name the same. Null keys are keys."""

    path: str
    keys: tuple[str, ...]
    order: tuple[Column, ...]
    buckets: int = 64

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("bucket")

    def apply(self, batch: DataFrame, retryable: Column, batch_id: int) -> list[int]:
        """The batch put into the ledger; the buckets that were written. Retryable rows do
        not replace a row but count as attempts, as all rows do. Batches are numbered in
        the order they are applied; only the last one may come again."""
        spark = batch.sparkSession
        names = batch.columns
        first = Window.partitionBy(*self.keys).orderBy(F.col("durable").desc(), *self.order)
        whole = Window.partitionBy(*self.keys)
        ranked = batch.withColumn("durable", ~F.coalesce(retryable, F.lit(False)))
        ranked = ranked.select("*", F.row_number().over(first).alias("__n"), F.count(F.lit(1)).over(whole).alias("attempts")).where("__n = 1").drop("__n")
        # A key seen in retryable rows only keeps its place, without values.
        blank = [F.when(F.col("durable") | F.lit(n in self.keys), F.col(n)).alias(n) for n in names]
        incoming = cut_lineage(ranked.select(*blank, "durable", "attempts", F.lit(batch_id).cast("long").alias("last_batch"), self._bucket()))
        # At most ``buckets`` numbers.
        touched = sorted(r.bucket for r in incoming.select("bucket").distinct().collect())
        rows = incoming
        if touched and exists(spark, self.path):
            held = self._stored(spark, incoming).where(F.col("bucket").isin(touched))
            seen = held.select(*[F.col(k).alias(f"__{k}") for k in self.keys], F.col("last_batch").alias("__seen"))
            same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in self.keys]
            new = incoming.join(seen.where(F.col("__seen") >= batch_id), same, "left_anti")
            rows = held.select(incoming.columns).unionAll(new)
        merged = rows.withColumn("__n", F.row_number().over(first))
        merged = merged.withColumn("attempts", F.sum("attempts").over(whole)).withColumn("last_batch", F.max("last_batch").over(whole)).where("__n = 1").drop("__n")
        ready = cut_lineage(merged)
        if touched:
            ready.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        discard(incoming, ready)
        return touched

    def _stored(self, spark: SparkSession, like: DataFrame) -> DataFrame:
        return spark.read.schema(like.schema).parquet(self.path)

    def rows(self, spark: SparkSession) -> DataFrame:
        """Current row of each key that has a durable one, with its ``attempts``."""
        return spark.read.parquet(self.path).where("durable").drop("durable", "last_batch", "bucket")

    def open_keys(self, spark: SparkSession, limit: int) -> DataFrame:
        """Keys without a durable row that have had fewer attempts than ``limit``."""
        return spark.read.parquet(self.path).where(~F.col("durable") & (F.col("attempts") < limit)).select(*self.keys, "attempts")
