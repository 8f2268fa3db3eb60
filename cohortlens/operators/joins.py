"""Joins. Two rewrites stand in for what no join operator offers: an OR over two sides
becomes an explode of the sides, and a range join becomes an equi-join on a time bucket.
Sides are never assumed small; the optimizer broadcasts what it can prove small."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import normalise_text
from .ordered import By, Order, chunked, columns_of, join_on, row_index


def _unique(df: DataFrame, keys: Sequence[str], side: str) -> DataFrame:
    """``df`` with one row per key, or a failing job when a key repeats. One aggregation
    both checks and places the rows for the join."""
    rest = [x for x in df.columns if x not in keys]
    one = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.first(F.struct(F.lit(0).alias("__z"), *rest)).alias("__r"))
    row = F.when(F.col("__n") > 1, F.raise_error(F.lit(f"repeated key on the {side} side"))).otherwise(F.col("__r"))
    return one.select(*keys, row.alias("__r")).select(*keys, *[F.col(f"__r.{x}").alias(x) for x in rest])


def validated_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", one_to_one: bool = False) -> DataFrame:
    """Join that fails when a key is repeated on the right (m:1) or on either side (1:1)."""
    lhs = _unique(left, keys, "left") if one_to_one else left
    return lhs.join(_unique(right, keys, "right"), list(keys), how)


def side_rows(units: DataFrame, columns: Sequence[str], home: str = "home_id", away: str = "away_id", side: str = "side") -> DataFrame:
    """(unit, side) rows from home and away, one scan."""
    return units.select(*columns, F.explode(F.array(home, away)).alias(side))


def expected_units(units: DataFrame, associations: DataFrame, windows: Mapping[str, str]) -> DataFrame:
    """Official units each entity is expected in, per window: the entity's side plays at
    home or away in the same league and season. Distinct (entity, window, unit)."""
    from .filters import window_membership

    official = units.where(F.col("official"))
    sides = side_rows(official, ["unit", "league", "season", *windows.values()])
    joined = associations.join(sides, ["league", "season", "side"])
    return window_membership(joined, windows).select("entity", "window", "unit").distinct()


def set_coverage(expected: DataFrame, processed: DataFrame, keys: Sequence[str], unit: str = "unit") -> DataFrame:
    """Expected, processed and missing units per key with the ratio."""
    done = processed.select(unit).distinct().withColumn("__done", F.lit(1))
    marked = join_on(expected, done, [unit], "left")
    return marked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("expected"),
        F.count("__done").alias("processed"),
        (F.count(F.lit(1)) - F.count("__done")).alias("missing"),
        (F.count("__done") / F.count(F.lit(1))).alias("coverage"),
    )


def side_target_union(units: DataFrame, associations: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Distinct entities attached to either side of a unit, and benchmark entities among
    them."""
    sides = side_rows(units, ["unit", "league", "season"])
    marked = join_on(associations, benchmark.select("entity").distinct().withColumn("__b", F.lit(1)), ["entity"], "left")
    pairs = sides.join(marked, ["league", "season", "side"]).select("unit", "entity", "__b").distinct()
    return pairs.groupBy("unit").agg(
        F.count(F.lit(1)).alias("targets"), F.count("__b").alias("benchmark_targets")
    )


def target_filter(rows: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the target keys; targets may repeat, null keys are no targets."""
    return rows.join(targets.select(*keys), list(keys), "left_semi")


def exclude_done(rows: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are not done yet; a null key is never done."""
    return rows.join(done.select(*keys), list(keys), "left_anti")


#: Least length of a cell, 2^20 microseconds: shorter intervals share a level.
_LEAST_LEVEL = 20


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str], start: Column, end: Column, ts: str) -> DataFrame:
    """Rows of ``right`` whose time lies in [start, end] of the left row, on equal keys.

    Time is cut into aligned cells of every power of two. An interval lies in the one or
    two cells of the first level whose cells are as long as it is, so a left row is copied
    twice at most, whatever its length; a right row has a key on each level that intervals
    use, which are as many as the logarithm of the longest over the shortest. A pair meets
    once, candidates are at most some four times the pairs, and large cells of a hot key
    are split by the join. Intervals that end before they start meet nothing."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    timed = left.withColumn("__s", micros(start)).withColumn("__e", micros(end)).where(F.col("__e") >= F.col("__s"))
    level = F.greatest(F.length(F.bin(F.col("__e") - F.col("__s"))), F.lit(_LEAST_LEVEL))
    timed = timed.withColumn("__level", level)
    cell = lambda c: F.expr(f"shiftright({c}, __level)")
    lhs = timed.withColumn("__cell", F.explode(F.array_distinct(F.array(cell("__s"), cell("__e")))))
    # A single row of some forty values at most.
    used = timed.agg(F.collect_set("__level").alias("__levels"))
    rhs = join_on(right.withColumn("__t", micros(F.col(ts))), used, []).withColumn("__level", F.explode("__levels")).drop("__levels")
    joined = lhs.join(rhs.withColumn("__cell", cell("__t")), [*keys, "__level", "__cell"])
    kept = joined.where((F.col("__t") >= F.col("__s")) & (F.col("__t") <= F.col("__e")))
    return kept.drop("__s", "__e", "__t", "__level", "__cell")


def asof_nearest(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ts: str,
    right_ts: str,
    left_id: str,
    right_id: str,
    values: Sequence[str],
) -> DataFrame:
    """For each left row the right row of the same key nearest in time; the earlier one,
    then the smaller id, on ties. One union ordered by time: the last right row before
    and the first one after are carried along by two running windows, so no pairs are
    formed."""
    lt, rt = F.col(left_ts), F.col(right_ts)
    probe = left.select(*keys, lt.alias("__t"), F.col(left_id).alias("__lid"))
    hit = F.struct(rt.alias("t"), F.col(right_id).alias("id"), *[F.col(v) for v in values])
    cand = right.select(*keys, rt.alias("__t"), hit.alias("__hit"))
    both = probe.unionByName(cand, allowMissingColumns=True)
    order = [By("__t"), By("__hit.id", nulls_first=False), By("__lid")]
    return _asof_chunked(both, keys, order, left_id, values)


def _last_hit() -> Column:
    """Latest candidate, the smallest id at equal times."""
    present = F.struct(F.col("__hit.t").alias("t"), (-F.col("__hit.id")).alias("m"), F.col("__hit").alias("h"))
    return F.max(F.when(F.col("__hit").isNotNull(), present))


def _asof_carry(both: DataFrame, keys: Sequence[str], order: Order) -> DataFrame:
    # At equal times candidates sort before probes, so "before" includes equality. The
    # search ahead runs over the reversed order: a growing frame costs one update a row.
    grow = (Window.unboundedPreceding, 0)
    back = Window.partitionBy(*keys).orderBy(*columns_of(order)).rowsBetween(*grow)
    ahead = Window.partitionBy(*keys).orderBy(F.col("__t").desc(), F.col("__lid").desc()).rowsBetween(*grow)
    return both.select(
        "*", _last_hit().over(back)["h"].alias("__before"), F.min("__hit").over(ahead).alias("__after")
    )


def _asof_chunked(both: DataFrame, keys: Sequence[str], order: Order, left_id: str, values: Sequence[str]) -> DataFrame:
    """Chunks of time, each with the best candidate of the chunks before and after it."""
    rows = chunked(both, keys, order)
    per = rows.groupBy("__key", "__chunk").agg(_last_hit().alias("__l"), F.min("__hit").alias("__f"))
    w = Window.partitionBy("__key").orderBy("__chunk")
    ends = per.select(
        "__key",
        "__chunk",
        F.max("__l").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("__pl"),
        F.min("__f").over(w.rowsBetween(1, Window.unboundedFollowing)).alias("__nf"),
    )
    carried = _asof_carry(rows, ["__key", "__chunk"], order)
    joined = carried.join(ends, ["__key", "__chunk"])
    filled = joined.withColumn("__before", F.coalesce("__before", F.col("__pl.h"))).withColumn(
        "__after", F.coalesce("__after", "__nf")
    )
    return _asof_pick(filled, keys, left_id, values)


def _asof_pick(carried: DataFrame, keys: Sequence[str], left_id: str, values: Sequence[str]) -> DataFrame:
    micros = lambda x: F.unix_micros(x.cast("timestamp"))
    t = micros(F.col("__t"))
    back, ahead = t - micros(F.col("__before.t")), micros(F.col("__after.t")) - t
    use_back = F.col("__after").isNull() | (back <= ahead)
    hit = F.when(F.col("__before").isNotNull() & use_back, F.col("__before")).otherwise(F.col("__after"))
    out = carried.where(F.col("__lid").isNotNull()).withColumn("__h", hit)
    return out.select(
        *keys,
        F.col("__lid").alias(left_id),
        F.col("__t").alias("left_ts"),
        F.col("__h.t").alias("right_ts"),
        F.col("__h.id").alias("right_id"),
        *[F.col(f"__h.{v}").alias(v) for v in values],
    )


#: Letters of a text whose windows are made in one row.
_STRETCH = 2048


def longest_alias_match(texts: DataFrame, text: str, key: str, registry: DataFrame, alias: str = "alias", label: str = "label") -> DataFrame:
    """``key``, ``text``, ``match``: the label of the longest alias of ``registry`` that
    occurs in the text in any case; among the longest the smaller alias, then the smaller
    label; null if none does or the text is null.

    The windows of a text, one for each place and each length that an alias has, meet the
    aliases in an equi-join, so the work does not grow with the number of aliases. Equal
    texts are looked up once; long ones are cut into stretches that overlap by the longest
    alias less one letter. Empty and null aliases match nothing."""
    known = registry.select(F.lower(alias).alias("__w"), F.col(label).alias("__label")).where(F.length("__w") > 0)
    known = known.groupBy("__w").agg(F.min("__label").alias("__label"))
    # A single row: the lengths of aliases.
    lengths = known.agg(F.collect_set(F.length("__w")).alias("__lens"), F.max(F.length("__w")).alias("__most"))
    hay = join_on(texts.select(F.lower(text).alias("__text")).where(F.length("__text") > 0).distinct(), lengths, []).where(F.col("__most").isNotNull())
    begins = F.sequence(F.lit(1), F.length("__text"), F.lit(_STRETCH))
    part = hay.withColumn("__at", F.explode(begins)).withColumn("__part", F.expr(f"substring(__text, __at, {_STRETCH} + __most - 1)"))
    size = F.length("__part")
    places = lambda n: F.transform(F.sequence(F.lit(1), F.least(F.lit(_STRETCH), size - n + 1)), lambda p: F.substring(F.col("__part"), p, n))
    words = F.flatten(F.transform("__lens", lambda n: F.when(n <= size, places(n)).otherwise(F.array().cast("array<string>"))))
    windows = part.select(F.xxhash64("__text").alias("__h"), "__text", F.explode(F.array_distinct(words)).alias("__w"))
    best = F.min_by("__label", F.struct((-F.length("__w")).alias("n"), F.col("__w"))).alias("match")
    found = windows.select("__h", "__w").join(known, "__w").groupBy("__h").agg(best)
    return texts.withColumn("__h", F.xxhash64(F.lower(text))).join(found, "__h", "left").select(key, text, "match")


def best_candidate(rows: DataFrame, keys: Sequence[str], score: Sequence[Column], tie: str) -> DataFrame:
    """Candidate with the largest score tuple; the smallest tie value on equality. A
    max over structs, combined map-side."""
    ranked = F.struct(*[s.alias(f"s{i}") for i, s in enumerate(score)], (-F.col(tie)).alias("t"))
    payload = F.struct(*[F.col(x) for x in rows.columns if x not in keys])
    best = rows.groupBy(*keys).agg(F.max_by(payload, ranked).alias("b"))
    return best.select(*keys, "b.*")


def alias_join(rows: DataFrame, text: str, registry: DataFrame, alias: str, label: str, priority: str) -> DataFrame:
    """Pipe-separated aliases to rows, joined on normalised text; the entry with the
    largest priority wins an alias."""
    exploded = registry.select(F.explode(F.split(F.col(alias), r"\|")).alias("a"), label, priority).select(
        normalise_text("a").alias("__k"), label, priority
    )
    one = exploded.groupBy("__k").agg(F.max_by(label, F.struct(priority, label)).alias(label))
    return rows.withColumn("__k", normalise_text(text)).join(one, "__k", "left").drop("__k")


#: Runs into which the numbers of all combinations are cut.
_RUNS = 1024


def combinations(spark, candidates: DataFrame, role: str, entity: str) -> DataFrame:
    """Every choice of one candidate per role, numbered lexicographically by (role,
    entity), long form (combination, role, entity). The combination number is decoded as
    mixed-radix digits, so the choices are generated in parallel and each digit finds its
    candidate by an equi-join; nothing is multiplied by a cross join and planning runs no
    job. The number of combinations is the operator's own result size. No candidates: no
    combinations."""
    numbered = row_index(candidates.select(role, entity).distinct(), [role], [entity], "__d", start=0)
    sizes = numbered.groupBy(role).agg(F.count(F.lit(1)).alias("n"))
    # A single row: (role, n) of every role, in order.
    one = sizes.agg(F.array_sort(F.collect_list(F.struct(F.col(role).alias("role"), "n"))).alias("__s"))
    times = lambda xs: F.aggregate(xs, F.lit(1).cast("long"), lambda acc, x: acc * x["n"])
    runs = join_on(spark.range(0, _RUNS, 1, 64), one, []).where(F.size("__s") > 0).withColumn("__total", times(F.col("__s")))
    each, more = F.expr(f"__total div {_RUNS}"), F.col("__total") % _RUNS
    first = each * F.col("id") + F.least(F.col("id"), more)
    length = each + (F.col("id") < more).cast("long")
    ids = runs.withColumn("__first", first).withColumn("__n", length).where(F.col("__n") > 0).select("__s", F.explode(F.sequence(F.col("__first"), F.col("__first") + F.col("__n") - 1)).alias("__id"))
    digit = lambda x, k: F.floor(F.col("__id") / times(F.slice("__s", k + 2, F.size("__s")))) % x["n"]
    digits = F.transform("__s", lambda x, k: F.struct(x["role"].alias(role), digit(x, k).cast("long").alias("__d")))
    long = ids.select((F.col("__id") + 1).alias("combination"), F.explode(digits).alias("x"))
    return long.select("combination", f"x.{role}", "x.__d").join(numbered, [role, "__d"]).select("combination", role, entity)


def full_outer_reconcile(a: DataFrame, b: DataFrame, keys: Sequence[str], measure: str, tolerance: float) -> DataFrame:
    """Both ledgers side by side with the difference; unresolved when a side is missing
    or the difference exceeds the tolerance."""
    left = a.select(*keys, F.col(measure).alias(f"{measure}_a"))
    right = b.select(*keys, F.col(measure).alias(f"{measure}_b"))
    out = left.join(right, list(keys), "full_outer")
    diff = F.coalesce(f"{measure}_a", F.lit(0.0)) - F.coalesce(f"{measure}_b", F.lit(0.0))
    one_sided = F.col(f"{measure}_a").isNull() | F.col(f"{measure}_b").isNull()
    return out.select("*", diff.alias("difference"), (one_sided | (F.abs(diff) > tolerance)).alias("unresolved"))


def coalesced_lookup(base: DataFrame, sources: Sequence[DataFrame], keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """First source that has a value wins, column by column."""
    out = base
    for i, s in enumerate(sources):
        renamed = s.select(*keys, *[F.col(x).alias(f"__{i}_{x}") for x in columns])
        out = join_on(out, renamed, keys, "left")
    picked = [F.coalesce(*[F.col(f"__{i}_{x}") for i in range(len(sources))]).alias(x) for x in columns]
    return out.select(*base.columns, *picked)


def frozen_delta(before: DataFrame, after: DataFrame, keys: Sequence[str], columns: Sequence[str], tolerance: float) -> DataFrame:
    """Largest absolute change per column between two snapshots, and whether it stays
    within the tolerance; long form."""
    b = before.select(*keys, *[F.col(x).alias(f"__b_{x}") for x in columns])
    joined = join_on(after, b, keys)
    wide = joined.agg(*[F.max(F.abs(F.col(x) - F.col(f"__b_{x}"))).alias(x) for x in columns])
    long = wide.unpivot([], list(columns), "check", "max_delta")
    return long.withColumn("passed", F.coalesce(F.col("max_delta") <= tolerance, F.lit(False)))


def repair_missing_only(table: DataFrame, repair: DataFrame, keys: Sequence[str], values: Sequence[str], missing: Column) -> DataFrame:
    """Fill only rows marked missing, leaving all others as they are."""
    r = repair.select(*keys, *[F.col(v).alias(f"__r_{v}") for v in values])
    joined = join_on(table.withColumn("__m", missing), r, keys, "left")
    fixed = {v: F.when(F.col("__m"), F.coalesce(f"__r_{v}", v)).otherwise(F.col(v)) for v in values}
    return joined.select(
        *[fixed[x].alias(x) if x in fixed else F.col(x) for x in table.columns],
        (F.col("__m") & F.col(f"__r_{values[0]}").isNotNull()).alias("repaired"),
    )
