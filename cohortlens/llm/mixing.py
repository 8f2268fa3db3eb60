"""Mixing sources to target weights by systematic sampling; DataFrame functions only.

Every document of a source has the same expected number of copies, the source's target
over its size. Documents stand in order of size; their expected copies are summed along
that order, one offset is added, and a document is emitted once for each whole number
its sum crosses. The order of a hot source is spread over tasks by range, and a row's
place is its place in the task plus what the tasks before it hold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The offset is taken from this many evenly spaced ones behind a random first: the one
#: whose taken words come nearest to the target (ties: the first).
OFFSETS = 16
_TASK_BITS = 33  # of monotonically_increasing_id: row in the task


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Rows numbered from 0 in ``order``, whatever the size: range partitions, sorted
    and written once, then one offset for each partition."""
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = settle(spread.withColumn("__id", F.monotonically_increasing_id()))
    task = F.shiftright("__id", _TASK_BITS)
    # One row for each partition.
    sizes = rows.groupBy(task.alias("__task")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__task", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    at = F.col("__start") + F.col("__id").bitwiseAND((1 << _TASK_BITS) - 1)
    return rows.withColumn("__task", task).join(starts, "__task").select(*df.columns, at.cast("long").alias(name))


def targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """``source``, ``source_size`` -> the same with ``target``. Sources in code point
    order, null last, weigh ``weights`` in turn; together they share the sum of sizes.
    No target exceeds ``cap`` times its source's size; the excess goes to the others by
    weight until none is above. Whole numbers until the last division."""
    ranked = numbered(sizes, [F.col("source").asc_nulls_last()], "__rank")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("__rank") % len(weights) + 1).cast("int"))
    open_ = settle(ranked.select("source", "source_size", weight.cast("long").alias("w")))
    limit = F.col("source_size") * cap
    total = open_.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    capped = F.lit(False)
    while True:
        # One row: what the capped sources take, and the weight of the others.
        row = open_.agg(
            F.coalesce(F.sum(F.when(capped, limit)), F.lit(0)).alias("taken"),
            F.coalesce(F.sum(F.when(~capped, F.col("w"))), F.lit(0)).alias("weight"),
            F.count(F.when(capped, 1)).alias("n"),
        ).first()
        rest, weigh = int(total - row.taken), int(row.weight)
        # A larger share per weight never frees a capped source.
        now = limit.cast("decimal(38,0)") * weigh < F.col("w").cast("decimal(38,0)") * rest if weigh else F.lit(True)
        if open_.where(now).count() == row.n:
            break
        capped = now
    share = (F.col("w") * F.lit(rest)).cast("double") / F.lit(float(weigh)) if weigh else F.lit(None).cast("double")
    return open_.select("source", "source_size", F.when(capped, limit.cast("double")).otherwise(share).alias("target"))


def mix(
    docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3, seed: str = "mix", text: str = "text", source: str = "source", key: str = "doc_id",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Every row of ``docs`` (its columns ``keep``, or all) as struct ``row`` with ``size`` (words), ``source_size``,
    ``target`` (both of its source) and ``copies``, 0 to ``cap``.

    A null or empty text has size 0; null is a source of its own; a source of size 0 has
    target 0 and no copies. Rows that repeat are sampled each on its own. Reruns agree."""
    columns = docs.columns if keep is None else keep
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(source).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.col(key).cast("long").alias("doc"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("th"),
    )
    order = [F.col("source").asc_nulls_last(), F.col("size").asc(), F.col("doc").asc_nulls_last(), F.col("th").asc()]
    rows = settle(numbered(base, order, "at"))
    per = settle(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("at").alias("first")))
    goal = targets(per.select("source", "source_size"), weights, cap)
    # Digits of a hash of the seed and the source's name.
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    right = per.join(goal.select(F.col("source").alias("s2"), "target"), F.col("source").eqNullSafe(F.col("s2"))).select(
        F.col("source").alias("s3"), "source_size", "first", "target", start.alias("u"),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"),
    )
    right = settle(right)
    placed = rows.join(right, F.col("source").eqNullSafe(F.col("s3"))).withColumn("k", F.col("at") - F.col("first"))

    def crossed(j: Column | int) -> Column:
        offset = (F.col("u") + F.lit(float(j)) / F.lit(float(OFFSETS))) if isinstance(j, int) else j
        return F.least(F.floor(offset + (F.col("k") + 1) * F.col("rate")) - F.floor(offset + F.col("k") * F.col("rate")), F.lit(cap)).cast("long")

    tried = placed.groupBy("s3").agg(
        F.first("u").alias("u"), F.first("target").alias("target"), *[F.sum(crossed(j) * F.col("size")).alias(f"t{j}") for j in range(OFFSETS)]
    )
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"t{j}") - F.col("target")).alias("d"), F.lit(j).alias("j")) for j in range(OFFSETS)]))["j"]
    chosen = settle(tried.select(F.col("s3").alias("s4"), (F.col("u") + best.cast("double") / F.lit(float(OFFSETS))).alias("offset")))
    return placed.join(chosen, F.col("s3").eqNullSafe(F.col("s4"))).select("row", "size", "source_size", "target", crossed(F.col("offset")).alias("copies"))


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as its copies say."""
    return mixed.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def sql(table: str = "documents", weights: Sequence[int] = (1, 2, 3), cap: int = 3, seed: str = "mix", columns: str = "doc_id, size, source_size, target, taken, copies") -> str:
    """The same in DuckDB. There the share of an open source follows from the order in
    which sources reach their caps: ``cap * size / weight``, least first."""
    return f"""
WITH s AS (SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM {table}),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS LAST) - 1 AS k FROM s),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
w AS (SELECT *, CAST(list_extract([{', '.join(map(str, weights))}], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} + 1 AS BIGINT)) AS BIGINT) AS w,
  sum(source_size) OVER () AS total FROM p),
c AS (SELECT *, {cap} * source_size AS lim,
  coalesce(sum({cap} * source_size) OVER q, 0) AS taken, sum(w) OVER () - coalesce(sum(w) OVER q, 0) AS rest FROM w
  WINDOW q AS (ORDER BY CAST(source_size AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT coalesce(sum(CASE WHEN lim * rest < w * (total - taken) THEN lim END), 0) AS t, coalesce(sum(CASE WHEN lim * rest < w * (total - taken) THEN w END), 0) AS v FROM c),
g AS (SELECT c.source, c.source_size, CASE WHEN lim * rest < w * (total - taken) THEN CAST(lim AS DOUBLE)
  ELSE CAST(w * (total - b.t) AS DOUBLE) / CAST((SELECT sum(w) FROM w) - b.v AS DOUBLE) END AS target FROM c, b),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0e0 END AS rate,
  CAST(CAST('0x' || substr(md5('{seed}:' || coalesce(source, '')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296e0 AS u FROM g),
t AS (SELECT r.source, j.j, abs(sum(size * least({cap}, floor(u + j.j / {OFFSETS}e0 + (k + 1) * rate) - floor(u + j.j / {OFFSETS}e0 + k * rate))) - any_value(target)) AS d
  FROM o JOIN r ON o.source IS NOT DISTINCT FROM r.source, (SELECT CAST(unnest(range({OFFSETS})) AS DOUBLE) AS j) j GROUP BY r.source, j.j),
h AS (SELECT source, arg_min(j, (d, j)) AS j FROM t GROUP BY source),
m AS (SELECT o.*, r.source_size, r.target, CAST(least({cap}, floor(u + h.j / {OFFSETS}e0 + (k + 1) * rate) - floor(u + h.j / {OFFSETS}e0 + k * rate)) AS BIGINT) AS copies
  FROM o JOIN r ON o.source IS NOT DISTINCT FROM r.source JOIN h ON h.source IS NOT DISTINCT FROM o.source)
SELECT {columns.replace('taken', 'size * copies AS taken')} FROM m"""
