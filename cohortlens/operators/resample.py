"""Seeded resampling. A draw is whole-number arithmetic on (seed, replicate, position):
a rerun, a lost executor or another engine yields the same draws; ``rand()`` would not."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from ..session import cut_lineage
from .ordered import Order, join_on, row_index

#: All steps are taken modulo this prime, so that products stay within a long.
PRIME = (1 << 31) - 1


def scatter(seed: int, replicate: Column, position: Column) -> Column:
    """A whole number below 2^62 from the three."""
    a, b = F.pmod(replicate.cast("long"), F.lit(PRIME)), F.pmod(position.cast("long"), F.lit(PRIME))
    x0 = (F.lit(seed % PRIME * 48271) + a) % PRIME
    x1 = (x0 * x0 + b) % PRIME
    x2 = (x1 * 69621 + x0) % PRIME
    x3 = (x2 * x2 + x1 + 12345) % PRIME
    x4 = (x3 * x3 + x2 * 7 + 1) % PRIME
    return x3 * F.lit(1 << 31) + x4


def draw(seed: int, replicate: Column, position: Column, n: Column) -> Column:
    """0-based index in [0, n)."""
    return scatter(seed, replicate, position) % n


def drawer(seed: int):
    """:func:`draw` on an array of positions. Made here, so that it travels to the workers
    by value."""
    prime = PRIME

    def draws(replicate: int, position: np.ndarray, n: int) -> np.ndarray:
        x0 = (seed % prime * 48271 + replicate % prime) % prime
        x1 = (x0 * x0 % prime + position % prime) % prime
        x2 = (x1 * 69621 + x0) % prime
        x3 = (x2 * x2 + x1 + 12345) % prime
        x4 = (x3 * x3 + x2 * 7 + 1) % prime
        return (x3 * (1 << 31) + x4) % n

    return draws


#: Rows of a group whose draws meet in one task; a place in a block fits two bytes.
BLOCK = 1 << 16


def drawn_totals(rows: DataFrame, group: str, index: str, values: Sequence[str], worlds: int, seed: int, stride: int = 65537) -> DataFrame:
    """``world``, ``group``, ``n`` and the sum of each of ``values``, as doubles, over as
    many rows as the group has, drawn with replacement in worlds 1 to ``worlds``.

    ``rows`` number a group's rows from 0 in ``index``; the group is a whole number. Draws
    travel as places in blocks of the group, two bytes each, to the block that they hit;
    a block holds the same number of rows and, but for chance, of draws at every size."""
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    numbered = join_on(rows.select(group, index), sizes, [group]).select(F.col(group).cast("long").alias("g"), F.col(index).cast("long").alias("i"), "n")

    draws = drawer(seed)

    def throw(batches):
        def out(g, n, held):
            positions = np.concatenate(held)
            for world in range(1, worlds + 1):
                hit = np.sort(draws(world * stride + g, positions, n))
                blocks, starts = np.unique(hit // BLOCK, return_index=True)
                parts = np.split((hit % BLOCK).astype(np.uint16), starts[1:])
                size = len(blocks)
                yield pa.record_batch([pa.array([g] * size, pa.int64()), pa.array(blocks, pa.int64()), pa.array([world] * size, pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["g", "b", "world", "places"])

        waiting: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            g, i, n = (batch.column(c).to_numpy() for c in ("g", "i", "n"))
            for key in np.unique(g):
                own = g == key
                name = int(key), int(n[own][0])
                waiting.setdefault(name, []).append(i[own])
                if sum(map(len, waiting[name])) >= BLOCK:
                    yield from out(*name, waiting.pop(name))
        for (key, size), held in waiting.items():
            yield from out(key, size, held)

    def catch(hits: pa.Table, held: pa.Table) -> pa.Table:
        at = held.column("i").to_numpy() % BLOCK
        known, value = [], []
        for name in values:
            column = held.column(name).to_numpy(zero_copy_only=False)
            have, what = np.zeros(BLOCK, bool), np.zeros(BLOCK)
            have[at] = held.column(name).is_valid().to_numpy()
            what[at] = np.where(have[at], column, 0.0)
            known.append(have)
            value.append(what)
        n, count, total = np.zeros(worlds + 1, np.int64), np.zeros((len(values), worlds + 1), np.int64), np.zeros((len(values), worlds + 1))
        for world, places in zip(hits.column("world").to_pylist(), hits.column("places")):
            place = np.frombuffer(places.as_buffer(), np.uint16)
            n[world] += len(place)
            for k in range(len(values)):
                count[k, world] += known[k][place].sum()
                total[k, world] += value[k][place].sum()
        seen = np.flatnonzero(n)
        g = hits.column("g")[0].as_py() if hits.num_rows else 0
        sums = [pa.array(total[k][seen], pa.float64(), mask=count[k][seen] == 0) for k in range(len(values))]
        return pa.table([pa.array(seen, pa.int32()), pa.array([g] * len(seen), pa.int64()), pa.array(n[seen]), *sums], names=["world", "g", "n", *values])

    thrown = numbered.mapInArrow(throw, "g long, b long, world int, places binary")
    block = F.floor(F.col(index) / BLOCK).cast("long")
    held = rows.select(F.col(group).cast("long").alias("g"), block.alias("b"), F.col(index).cast("long").alias("i"), *[F.col(v).cast("double").alias(v) for v in values])
    kinds = ", ".join(f"{v} double" for v in values)
    sums = thrown.groupBy("g", "b").cogroup(held.groupBy("g", "b")).applyInArrow(catch, f"world int, g long, n long, {kinds}")
    out = sums.groupBy("world", "g").agg(F.sum("n").alias("n"), *[F.sum(v).alias(v) for v in values])
    return out.select("world", F.col("g").cast(rows.schema[group].dataType).alias(group), "n", *values)


def scatter_sql(rows: str, seed: int, replicate: str, position: str, name: str = "d") -> str:
    """The rows of a SELECT with :func:`scatter` as ``name``, for SQL twins."""
    steps = (
        ("x0", f"({seed % PRIME * 48271} + CAST({replicate} AS BIGINT) % {PRIME}) % {PRIME}"),
        ("x1", f"(x0 * x0 + CAST({position} AS BIGINT) % {PRIME}) % {PRIME}"),
        ("x2", f"(x1 * 69621 + x0) % {PRIME}"),
        ("x3", f"(x2 * x2 + x1 + 12345) % {PRIME}"),
        ("x4", f"(x3 * x3 + x2 * 7 + 1) % {PRIME}"),
    )
    for column, value in steps:
        rows = f"SELECT *, {value} AS {column} FROM ({rows})"
    return f"SELECT * EXCLUDE (x0, x1, x2, x3, x4), x3 * {1 << 31} + x4 AS {name} FROM ({rows})"


def bootstrap_ci(
    members: DataFrame,
    keys: Sequence[str],
    value: str,
    seed: int,
    resamples: int = 2000,
    fraction: float = 0.10,
) -> DataFrame:
    """Interval of a trimmed mean over bounded member sets (the caller's top-n): one row
    per (group, replicate), the resampled array trimmed in place. No value gives (0, 0),
    a single value gives itself."""
    sets = members.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("__v"))
    size = F.size("__v")
    cut0 = F.floor(size * F.lit(fraction)).cast("int")
    cut = F.when(size - 2 * cut0 >= 2, cut0).otherwise(0)
    reps = sets.withColumn("__b", F.explode(F.sequence(F.lit(1), F.lit(resamples))))
    drawn = F.array_sort(
        F.transform(
            F.sequence(F.lit(1), size),
            lambda i: F.element_at("__v", (draw(seed, F.col("__b"), i, size) + 1).cast("int")),
        )
    )
    kept = F.slice(drawn, cut + 1, size - 2 * cut)
    mean = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.size(kept)
    est = reps.select(*keys, mean.alias("__e"))
    return est.groupBy(*keys).agg(
        F.percentile("__e", F.lit(0.025)).alias("ci95_low"), F.percentile("__e", F.lit(0.975)).alias("ci95_high")
    )


#: Worlds whose draws of a block are counted together.
WORLDS = 64


def bootstrap_worlds(rows: DataFrame, order: Order, worlds: int, seed: int, keep: Sequence[str] | None = None) -> DataFrame:
    """World 0 holds the rows as observed; each further world draws as many rows with
    replacement: ``world``, ``weight`` and the columns of ``keep`` (all, if not given).
    A world's rows that are equal in these may come as one, with their weights added.

    A draw travels as its place in a block of ``BLOCK`` rows, two bytes each, to the block
    that it hits, and is counted there for each distinct row of the block."""
    keep = list(keep or rows.columns)
    placed = cut_lineage(row_index(rows, [], order, "__i", start=0).select("__i", *keep))
    observed = placed.select(F.lit(0).alias("world"), F.lit(1).cast("long").alias("weight"), *keep)
    if worlds < 2:
        return observed
    block, slice_, draws = BLOCK, WORLDS, drawer(seed)
    plain = not any(isinstance(placed.schema[c].dataType, (ArrayType, MapType, StructType)) for c in keep)

    def throw(batches):
        for batch in batches:
            for b, n, world in zip(*(batch.column(c).to_pylist() for c in ("__b", "__n", "world"))):
                hit = np.sort(draws(world, np.arange(b * block, min(n, (b + 1) * block)), n))
                to, starts = np.unique(hit // block, return_index=True)
                parts = np.split((hit % block).astype(np.uint16), starts[1:])
                size = len(to)
                yield pa.record_batch([pa.array(to, pa.int64()), pa.array([world // slice_] * size, pa.int32()), pa.array([world] * size, pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["__b", "__s", "world", "places"])

    def catch(hits: pa.Table, held: pa.Table) -> pa.Table:
        code = np.zeros(held.num_rows, np.int64)
        for name in keep if plain else ():
            known = held.column(name).combine_chunks().dictionary_encode(null_encoding="encode")
            code = np.unique(code * max(len(known.dictionary), 1) + known.indices.to_numpy(), return_inverse=True)[1]
        kinds, first, code = np.unique(code if plain else np.arange(held.num_rows), return_index=True, return_inverse=True)
        at = np.zeros(block, np.int64)
        at[held.column("__i").to_numpy() % block] = code
        count = np.zeros((slice_, len(kinds)), np.int32)
        for world, places in zip(hits.column("world").to_pylist(), hits.column("places")):
            count[world % slice_] += np.bincount(at[np.frombuffer(places.as_buffer(), np.uint16)], minlength=len(kinds)).astype(np.int32)
        world, kind = np.nonzero(count)
        start = hits.column("world")[0].as_py() // slice_ * slice_ if hits.num_rows else 0
        taken = held.select(keep).take(first[kind])
        return pa.table([pa.array((start + world).astype(np.int32)), pa.array(count[world, kind].astype(np.int64)), *taken.columns], names=["world", "weight", *keep])

    # A unit of work is a block of positions in a world; their number is known to no plan
    # before the rows are counted, so they are spread over all partitions by hand.
    total = placed.agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 0)
    units = total.select("__n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / block))).alias("__b"))
    units = units.select("*", F.explode(F.sequence(F.lit(1), F.lit(worlds - 1))).alias("world"))
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    thrown = units.repartition(spread, "__b", "world").mapInArrow(throw, "__b long, __s int, world int, places binary")
    slices = F.explode(F.sequence(F.lit(0), F.lit((worlds - 1) // slice_))).alias("__s")
    held = placed.select(F.floor(F.col("__i") / block).cast("long").alias("__b"), slices, "__i", *keep)
    schema = StructType([*observed.schema.fields[:2], *[placed.schema[c] for c in keep]])
    drawn = thrown.groupBy("__b", "__s").cogroup(held.groupBy("__b", "__s")).applyInArrow(catch, schema)
    return observed.unionByName(drawn)
