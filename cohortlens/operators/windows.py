"""Window operators. Top-n and first/last use ``row_number() <= n``, which Spark cuts
down before the shuffle (WindowGroupLimit); anything that must order a whole group goes
through :mod:`.ordered`; windows per unit stay plain, as a unit has a bounded line-up."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clip, logistic_unit
from . import ordered
from .ordered import attach_totals, join_on


def latest_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in ``order`` (which must be total)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")


def top_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n)
    return out.withColumnRenamed("__rn", rank) if rank else out.drop("__rn")


def order_rank(df: DataFrame, keys: Sequence[str], order: ordered.Order, name: str) -> DataFrame:
    return ordered.row_index(df, keys, order, name)


def shrink_to_cohort(
    df: DataFrame, keys: Sequence[str], value: str, exposure: str, prior: float, name: str
) -> DataFrame:
    """mu + r (x - mu) with r = m / (m + prior) and mu the unweighted cohort mean."""
    out = ordered.with_stats(df, keys, {"__mu": F.avg(value)})
    r = F.col(exposure) / (F.col(exposure) + F.lit(prior))
    return out.withColumn(name, F.col("__mu") + r * (F.col(value) - F.col("__mu"))).drop("__mu")


def winsorised_z(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Null as 0; from five rows on clipped to the 5 % and 95 % points; z with the
    population sd, 0 where the sd is 0. Points, mean and sd are all read off the counts
    of distinct values, so the rows are read once for the counts and once for the result."""
    filled = df.withColumn("__v", F.coalesce(F.col(value), F.lit(0.0)))
    pos = ordered.value_positions(filled, keys, "__v")
    points = ordered.quantiles_at(pos, keys, "__v", {"lo": 0.05, "hi": 0.95})
    lo, hi, n = F.col("__v_lo"), F.col("__v_hi"), F.col("n")
    cut = lambda v: F.when(F.col("n_total") >= 5, clip(v, lo, hi)).otherwise(F.col(v))
    # Sums of what lies above the low point keep their digits.
    above = cut("__v") - lo
    sums = join_on(pos, points, keys, nulls=True).groupBy(*keys).agg(
        F.max("n_total").alias("n_total"), F.max(lo).alias("__v_lo"), F.max(hi).alias("__v_hi"),
        (F.sum(above * n) / F.sum(n)).alias("__m1"), (F.sum(above * above * n) / F.sum(n)).alias("__m2"),
    )
    out = join_on(filled, sums, keys, "left", nulls=True)
    sd = F.sqrt(F.greatest(F.col("__m2") - F.col("__m1") * F.col("__m1"), F.lit(0.0)))
    z = F.when(sd > 1e-12, (cut("__v") - lo - F.col("__m1")) / sd).otherwise(0.0)
    return out.select(*df.columns, z.alias(name))


def robust_unit(df: DataFrame, keys: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """(x - median) / max(IQR, 1e-9) through the bounded logistic; null gives 0.5.
    ``columns`` maps new name -> raw column; all share one quantile pass."""
    out = ordered.with_quantiles(
        df, keys, list(columns.values()), {"__q1": 0.25, "__q2": 0.5, "__q3": 0.75}
    )
    new = {}
    for name, raw in columns.items():
        scale = F.greatest(F.col(f"{raw}___q3") - F.col(f"{raw}___q1"), F.lit(1e-9))
        new[name] = F.coalesce(logistic_unit((F.col(raw) - F.col(f"{raw}___q2")) / scale), F.lit(0.5))
    return out.select(*df.columns, *[v.alias(n) for n, v in new.items()])


def group_extent(df: DataFrame, row: str = "row", col: str = "col", unit: Sequence[str] = ("unit", "side")) -> DataFrame:
    """Width of the grid row, and depth (row-2)/max(max row - 2, 1) clipped to 0-1,
    inside one line-up (at most a team's players)."""
    w_row = Window.partitionBy(*unit, row)
    w_all = Window.partitionBy(*unit)
    out = df.select("*", F.max(col).over(w_row).alias("row_width"), F.max(row).over(w_all).alias("max_row"))
    depth = (F.col(row) - 2) / F.greatest(F.col("max_row") - 2, F.lit(1))
    return out.withColumn("depth", clip(depth, F.lit(0.0), F.lit(1.0)))


def first_last_sample(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First and last unit per group (a single row once): two aggregates, no sort."""
    payload = F.struct(*[F.col(x) for x in order], *[F.col(x) for x in df.columns if x not in order])
    ends = df.groupBy(*keys).agg(F.min(payload).alias("a"), F.max(payload).alias("b"))
    picked = ends.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("s"))
    return picked.select(*[F.col(f"s.{x}").alias(x) for x in df.columns])


def sequence_in_group(df: DataFrame, keys: Sequence[str], order: ordered.Order) -> DataFrame:
    """0-based position, group size, and whether the row is the latest."""
    placed = ordered.row_index(df, keys, order, "seq", start=0)
    out = attach_totals(placed, keys, [F.count(F.lit(1)).alias("group_size")], source=df)
    return out.withColumn("is_latest", F.col("seq") == F.col("group_size") - 1)


def kth_threshold(df: DataFrame, keys: Sequence[str], value: str, k: int, tie: str, short: float | None = None) -> DataFrame:
    """k' = min(k, n): the k'-th largest value and the largest one. With ``short``, a
    pool of fewer than k rows gets that constant as threshold."""
    top = top_n_per_group(df.where(F.col(value).isNotNull()), keys, [F.col(value).desc(), F.col(tie)], k)
    kth = F.min(value)
    if short is not None:
        kth = F.when(F.count(F.lit(1)) < k, F.lit(short)).otherwise(kth)
    return top.groupBy(*keys).agg(kth.alias("kth_value"), F.max(value).alias("best_value"))


def ecdf_position(pool: DataFrame, points: DataFrame, keys: Sequence[str], value: str, point: str) -> DataFrame:
    """100 x share of the pool at or below the point of its group."""
    joined = join_on(pool.select(*keys, value), points, keys)
    return joined.groupBy(*keys).agg(
        (100.0 * F.avg((F.col(value) <= F.col(point)).cast("double"))).alias("percentile")
    )


def line_index(df: DataFrame, unit: Sequence[str], row: str = "row", col: str = "col") -> DataFrame:
    """Dense index of the grid row among outfield rows (row 1 is the keeper), size of
    the line, and place in it; inside one line-up."""
    outfield = df.where(F.col(row) != 1)
    w = Window.partitionBy(*unit).orderBy(row)
    line = Window.partitionBy(*unit, row)
    return outfield.select(
        "*",
        F.dense_rank().over(w).alias("line"),
        F.count(F.lit(1)).over(line).cast("int").alias("line_size"),
        F.row_number().over(line.orderBy(col, "entity")).alias("place"),
    )


def best_of_others(df: DataFrame, keys: Sequence[str], entity: str, upper: str, lower: str) -> DataFrame:
    """The largest upper bound among all other members, and whether the member's lower
    bound beats it. Only the top two uppers of a group are needed."""
    two = top_n_per_group(df.select(*keys, entity, upper), keys, [F.col(upper).desc(), F.col(entity)], 2, rank="__r")
    tops = two.groupBy(*keys).agg(
        F.max(F.when(F.col("__r") == 1, F.col(entity))).alias("__top"),
        F.max(F.when(F.col("__r") == 1, F.col(upper))).alias("__u1"),
        F.max(F.when(F.col("__r") == 2, F.col(upper))).alias("__u2"),
    )
    out = join_on(df, tops, keys)
    rival = F.when(F.col(entity) == F.col("__top"), F.col("__u2")).otherwise(F.col("__u1"))
    return out.select(*df.columns, rival.alias("best_other_upper")).withColumn(
        "identified", F.col("best_other_upper").isNull() | (F.col(lower) > F.col("best_other_upper"))
    )


def slot_fill_ordinal(ranked: DataFrame, slots: DataFrame, cohort: str, order: Sequence[Column], max_ordinal: int) -> DataFrame:
    """The k-th best of a cohort fills its k-th slot; unfilled slots stay listed."""
    top = top_n_per_group(ranked, [cohort], order, max_ordinal, rank="ordinal")
    out = join_on(slots, top, [cohort, "ordinal"], "left")
    return out


def slot_fill_greedy(candidates: DataFrame, slots: DataFrame, cohort: str, entity: str, order: Sequence[Column], n_slots: int) -> DataFrame:
    """Slots in fixed order, each taking the best unused candidate of its cohort; a
    used one only if none is left. Only the best ``n_slots`` of a cohort can ever be
    chosen, so the ordered part sees at most slots x n_slots rows."""
    top = top_n_per_group(candidates, [cohort], order, n_slots, rank="__r")
    pool = join_on(slots, top.select(cohort, entity, "__r"), [cohort], "left")
    schema = f"slot_no int, slot string, {cohort} string, {entity} long, reused boolean"

    def pick(_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        used: set = set()
        rows = []
        for (no, slot, role), block in pdf.sort_values(["slot_no", "__r"]).groupby(
            ["slot_no", "slot", cohort], sort=True
        ):
            ids = [int(x) for x in block[entity].dropna()]
            free = [x for x in ids if x not in used]
            chosen = free[0] if free else (ids[0] if ids else None)
            rows.append((no, slot, role, chosen, bool(ids) and not free))
            if chosen is not None:
                used.add(chosen)
        return pd.DataFrame(rows, columns=["slot_no", "slot", cohort, entity, "reused"])

    return pool.withColumn("__g", F.lit(0)).groupBy("__g").applyInPandas(pick, schema)


def ordered_pick_list(members: DataFrame, keys: Sequence[str], entity: str, order: Sequence[Column]) -> DataFrame:
    """Members of a picked team (a bounded line-up) in order, numbered and as text."""
    w = Window.partitionBy(*keys).orderBy(*order)
    numbered = members.withColumn("place", F.row_number().over(w))
    return numbered.groupBy(*keys).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("place", F.col(entity).alias("e")))), lambda s: s["e"].cast("string")),
            ",",
        ).alias("pick_order"),
        F.count(F.lit(1)).alias("members"),
    )


def sequence_flag(df: DataFrame, keys: Sequence[str], order: ordered.Order, after: int) -> DataFrame:
    """Number by date inside a competition and whether it lies beyond ``after``."""
    out = ordered.row_index(df, keys, order, "match_number")
    return out.withColumn("knockout", (F.col("match_number") > after).cast("int"))
