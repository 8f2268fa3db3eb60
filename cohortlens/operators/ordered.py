"""Ordered computations that survive a hot group.

A window per group hands one whole group to one task. Here a large group is cut into
chunks that follow each other in its order. Where to cut is read off a sample: one row in
1,024 by a hash of key and order values, so the number of chunks follows the size of the
group, whatever the type of the values and however they crowd. Rows are compared with the
cuts by all leading order columns, so ties in the first do not keep a chunk together.
Totals of the chunks before come from one short window (a row for each chunk), and only
the inside of a chunk is sorted.

There is one plan for every size, planning runs no job, and null keys form a group like
any other. A small group has no cuts and is one chunk. The sample is cut short, by strata
of the hash, only where it would give a group more than ``MAX_CHUNKS`` chunks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: One row in 2^SAMPLE_BITS is sampled; sampled rows of a chunk; so 65,536 rows a chunk.
SAMPLE_BITS, PER_CHUNK = 10, 64
#: Most chunks of a group (a power of two); strata that bound its sample.
MAX_CHUNKS, STRATA = 4096, 1024
#: Rows of a block in :func:`last_k`.
BLOCK = 65_536
_KEY, _CHUNK, _MARK = "__key", "__chunk", "__mark"


@dataclass(frozen=True)
class By:
    """A column of an order. Nulls stand where Spark puts them, first in a rising order
    and last in a falling one, unless ``nulls_first`` says otherwise."""

    name: str
    falling: bool = False
    nulls_first: bool | None = None

    @property
    def column(self) -> Column:
        c = F.col(self.name)
        first = not self.falling if self.nulls_first is None else self.nulls_first
        if self.falling:
            return c.desc_nulls_first() if first else c.desc_nulls_last()
        return c.asc_nulls_first() if first else c.asc_nulls_last()

    @property
    def mark(self) -> list[Column]:
        """Values whose rising order, or for a falling one its reverse, is this one's."""
        c = F.col(self.name)
        usual = self.nulls_first is None or self.nulls_first != self.falling
        return [c] if usual else [c.isNull(), c]


#: Names rise. A plain Column orders rows inside a chunk but does not tell where to cut.
Order = Sequence["str | By | Column"]


def _by(order: Order) -> list[By | Column]:
    return [By(x) if isinstance(x, str) else x for x in order]


def columns_of(order: Order) -> list[Column]:
    return [x.column if isinstance(x, By) else x for x in _by(order)]


def _key(keys: Sequence[str]) -> Column:
    """The keys as one value that equals itself where parts are null."""
    return F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0)


def join_on(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", nulls: bool = False
) -> DataFrame:
    """Equi-join on equally named keys; the key columns of ``left`` are kept. ``nulls``
    lets null keys meet. Without keys the right side must be a single row, which is
    checked where the join runs."""
    if not keys:
        one = right.agg(F.count(F.lit(1)).alias("__single"), *[F.first(F.col(c)).alias(c) for c in right.columns])
        checked = one.select(F.assert_true(F.col("__single") <= 1, F.lit("a join without keys takes a single row")).alias("__ok"), *right.columns)
        return left.join(F.broadcast(checked), F.col("__ok").isNull(), how).drop("__ok")
    rest = [x for x in right.columns if x not in keys]
    if not nulls:
        return left.join(right, list(keys), how).select(*left.columns, *rest)
    met = right.select(_key(keys).alias(_KEY), *rest)
    return left.withColumn(_KEY, _key(keys)).join(met, _KEY, how).select(*left.columns, *rest)


def attach_totals(
    df: DataFrame, keys: Sequence[str], aggs: Sequence[Column], source: DataFrame | None = None
) -> DataFrame:
    """Group totals added to every row: aggregate, then join back. The aggregate is
    combined map-side, so a hot group never meets in one task."""
    rows = source if source is not None else df
    if not keys:
        return join_on(df, rows.agg(*aggs), [])
    totals = rows.groupBy(_key(keys).alias(_KEY)).agg(*aggs)
    out = df.withColumn(_KEY, _key(keys)).join(totals, _KEY, "left")
    return out.drop(_KEY)


def with_stats(df: DataFrame, keys: Sequence[str], stats: Mapping[str, Column]) -> DataFrame:
    """Group aggregates beside every row."""
    return attach_totals(df, keys, [a.alias(n) for n, a in stats.items()])


def with_quantiles(df: DataFrame, keys: Sequence[str], columns: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """Group quantiles beside every row, columns ``<column>_<name>``."""
    return join_on(df, quantiles(df, keys, columns, probs), keys, "left" if keys else "inner", nulls=True)


def _mark(order: Order) -> tuple[Column | None, bool]:
    """The leading columns of one direction as one value, and whether they fall."""
    lead: list[By] = []
    for x in _by(order):
        if not isinstance(x, By) or lead and x.falling != lead[0].falling:
            break
        lead.append(x)
    if not lead:
        return None, False
    parts = [c.alias(f"m{i}") for i, c in enumerate(c for x in lead for c in x.mark)]
    return F.struct(*parts), lead[0].falling


def _cuts(named: DataFrame, unique: bool) -> DataFrame:
    """``__key``, ``__cuts``: rising first values of the chunks but the first, for groups
    of at least two chunks. Rows that repeat (not ``unique``) count once."""
    h = F.xxhash64(_KEY, _MARK)
    drawn = named.select(_KEY, _MARK, h.alias("__h")).where(F.col("__h").bitwiseAND((1 << SAMPLE_BITS) - 1) == 0)
    if not unique:
        drawn = drawn.distinct()
    drawn = drawn.withColumn("__h", F.shiftright("__h", SAMPLE_BITS)).withColumn("__stratum", F.pmod("__h", F.lit(STRATA)))
    few = Window.partitionBy(_KEY, "__stratum").orderBy("__h")
    most = -(-MAX_CHUNKS * PER_CHUNK // STRATA)
    kept = drawn.withColumn("__n", F.row_number().over(few)).where(F.col("__n") <= most)
    # At most MAX_CHUNKS * PER_CHUNK values for each group.
    sorted_ = kept.groupBy(_KEY).agg(F.sort_array(F.collect_list(_MARK)).alias("__s"))
    chunks = F.least(F.floor(F.size("__s") / PER_CHUNK), F.lit(MAX_CHUNKS)).cast("int")
    at = F.transform(F.sequence(F.lit(1), F.col("__c") - 1), lambda i: F.element_at("__s", (F.floor(i * F.size("__s") / F.col("__c")) + 1).cast("int")))
    return sorted_.withColumn("__c", chunks).where(F.col("__c") >= 2).select(_KEY, at.alias("__cuts"))


def chunked(df: DataFrame, keys: Sequence[str], order: Order, source: DataFrame | None = None) -> DataFrame:
    """``df`` with its group (``__key``) and the chunk of the group (``__chunk``); chunks
    follow each other in ``order``. ``source`` holds the rows of ``df`` before equal ones
    were merged: the sample is then drawn there, which spares merging them twice."""
    mark, falling = _mark(order)
    named = df.withColumn(_KEY, _key(keys))
    if mark is None:
        return named.withColumn(_CHUNK, F.lit(0))
    named = named.withColumn(_MARK, mark)
    steps = []
    while not steps or steps[-1] > 1:
        steps.append(steps[-1] // 2 if steps else MAX_CHUNKS // 2)
    # Cuts that a row has reached, found by halving.
    reached = F.aggregate(
        F.array(*[F.lit(x) for x in steps]), F.lit(0), lambda n, x: F.when(F.get("__cuts", n + x - 1) <= F.col(_MARK), n + x).otherwise(n)
    )
    place = F.when(F.col("__cuts").isNull(), 0).otherwise(-reached if falling else reached)
    drawn_from = named if source is None else source.select(_key(keys).alias(_KEY), mark.alias(_MARK))
    return named.join(_cuts(drawn_from, source is None), _KEY, "left").select(*df.columns, _KEY, place.alias(_CHUNK))


def prefix(
    df: DataFrame,
    keys: Sequence[str],
    order: Order,
    sums: Mapping[str, Column | str] | None = None,
    index: str | None = None,
    totals: Mapping[str, str] | None = None,
    source: DataFrame | None = None,
) -> DataFrame:
    """Exclusive prefix sums (``sums``: new name -> summed column) and a 0-based row
    ``index`` per group. ``order`` must be total. ``totals`` (new name -> name of a sum)
    adds whole group sums. ``source``: see :func:`chunked`."""
    terms = {n: (F.col(v) if isinstance(v, str) else v) for n, v in (sums or {}).items()}
    if index:
        terms = {**terms, index: F.lit(1).cast("long")}
    named = df.select("*", *[t.alias(f"__t_{n}") for n, t in terms.items()])
    rows = chunked(named, keys, order, source)
    per = rows.groupBy(_KEY, _CHUNK).agg(*[F.sum(f"__t_{n}").alias(f"__s_{n}") for n in terms])
    # At most MAX_CHUNKS rows for each group.
    group = Window.partitionBy(_KEY)
    before = group.orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(
        _KEY, _CHUNK,
        *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in terms],
        *[F.sum(f"__s_{n}").over(group).alias(new) for new, n in (totals or {}).items()],
    )
    inner = Window.partitionBy(_KEY, _CHUNK).orderBy(*columns_of(order)).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(offsets, [_KEY, _CHUNK])
    return joined.select(
        *df.columns,
        *[(F.col(f"__o_{n}") + F.coalesce(F.sum(f"__t_{n}").over(inner), F.lit(0))).alias(n) for n in terms],
        *(totals or {}),
    )


def row_index(df: DataFrame, keys: Sequence[str], order: Order, name: str, start: int = 1) -> DataFrame:
    """``row_number`` for groups of any size."""
    out = prefix(df, keys, order, index=name)
    return out.withColumn(name, (F.col(name) + F.lit(start)).cast("long"))


def last_k(
    df: DataFrame, keys: Sequence[str], order: Order, k: int, aggs: Mapping[str, Column], current: bool = False
) -> DataFrame:
    """Aggregates over the ``k`` rows before the current one, or over the last ``k``
    with it (``current``). Rows are cut into blocks by position and each block gets the
    last ``k`` rows of the block before it, so every frame is complete inside its block."""
    keys = list(keys)
    frame = (-k + 1, 0) if current else (-k, -1)
    size = max(BLOCK, k + 1)
    placed = prefix(df, keys, order, index="__i").withColumn("__b", F.floor(F.col("__i") / size))
    halo = F.col("__i") % size >= size - k
    copies = F.when(halo, F.array(F.col("__b"), F.col("__b") + 1)).otherwise(F.array(F.col("__b")))
    spread = placed.withColumn("__block", F.explode(copies))
    w = Window.partitionBy(*keys, "__block").orderBy("__i").rowsBetween(*frame)
    out = spread.select("*", *[a.over(w).alias(n) for n, a in aggs.items()])
    return out.where(F.col("__b") == F.col("__block")).drop("__i", "__b", "__block")


def value_positions(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per distinct non-null value of a group with ``n`` (rows holding it),
    ``n_before`` (rows with a smaller value) and ``n_total``. Ranks, shares, quantiles
    and trimmed means all read off these positions."""
    known = df.where(F.col(value).isNotNull())
    counts = known.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return prefix(counts, keys, [value], sums={"n_before": "n"}, totals={"n_total": "n_before"}, source=known)


def quantiles_at(pos: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Quantiles ``<value>_<name>`` by group from :func:`value_positions`."""
    aggs = []
    for n, p in probs.items():
        h = (F.col("n_total") - 1) * F.lit(p)
        for tag, k in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            inside = (F.col("n_before") <= k) & (k < F.col("n_before") + F.col("n"))
            aggs.append(F.max(F.when(inside, F.col(value))).alias(f"__{tag}_{n}"))
        aggs.append(F.max(h - F.floor(h)).alias(f"__f_{n}"))
    lo, hi, part = (lambda n: F.col(f"__lo_{n}")), (lambda n: F.col(f"__hi_{n}")), (lambda n: F.col(f"__f_{n}"))
    return pos.groupBy(*keys).agg(*aggs).select(*keys, *[(lo(n) + part(n) * (hi(n) - lo(n))).alias(f"{value}_{n}") for n in probs])


def quantiles(df: DataFrame, keys: Sequence[str], columns: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """Exact linear-interpolation quantiles: one row per group, columns
    ``<column>_<name>``; the two neighbouring order statistics are found by position.
    All columns go through one pass."""
    keys = list(keys)
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("__c"), F.col(c).cast("double").alias("__v")) for i, c in enumerate(columns)]))
    long = df.select(*keys, pairs.alias("__p")).select(*keys, "__p.*")
    each = quantiles_at(value_positions(long, [*keys, "__c"], "__v"), [*keys, "__c"], "__v", probs)
    wide = [F.max(F.when(F.col("__c") == i, F.col(f"__v_{n}"))).alias(f"{c}_{n}") for i, c in enumerate(columns) for n in probs]
    if not keys:
        return each.agg(*wide)
    # Groups that hold nulls only keep a row.
    return join_on(df.select(*keys).distinct(), each.groupBy(*keys).agg(*wide), keys, "left", nulls=True)


def competition_rank(df: DataFrame, keys: Sequence[str], value: str, name: str, descending: bool = True) -> DataFrame:
    """rank with ties sharing the lowest place; nulls are not ranked."""
    pos = value_positions(df, keys, value)
    ahead = F.col("n_total") - F.col("n_before") - F.col("n") if descending else F.col("n_before")
    ranks = pos.select(*keys, value, (ahead + 1).cast("long").alias(name))
    return join_on(df, ranks, [*keys, value], "left", nulls=True)


def pct_rank_avg(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Average rank of ties divided by the group's count of non-null values."""
    pos = value_positions(df, keys, value)
    share = (F.col("n_before") + (F.col("n") + 1) / F.lit(2.0)) / F.col("n_total")
    return join_on(df, pos.select(*keys, value, share.alias(name)), [*keys, value], "left", nulls=True)


def trimmed_mean(
    df: DataFrame, keys: Sequence[str], value: str, fraction: float = 0.10, guard: str = "a", name: str = "trimmed_mean"
) -> DataFrame:
    """Mean without floor(n*fraction) values on each side. Guard ``a`` cuts when at
    least two values remain; guard ``b`` when n exceeds both cuts together."""
    pos = value_positions(df, keys, value)
    n = F.col("n_total")
    cut0 = F.floor(n * F.lit(fraction))
    ok = (n - 2 * cut0 >= 2) if guard == "a" else (n > 2 * cut0)
    cut = F.when(ok, cut0).otherwise(F.lit(0))
    kept = F.greatest(
        F.lit(0),
        F.least(F.col("n_before") + F.col("n"), n - cut) - F.greatest(F.col("n_before"), cut),
    )
    return pos.groupBy(*keys).agg(
        (F.sum(F.col(value) * kept) / F.sum(kept)).alias(name), F.max("n_total").alias("n")
    )


def ecdf(df: DataFrame, keys: Sequence[str], value: str, order: Order, name: str = "cum_share") -> DataFrame:
    """Every row with its cumulative share i/n in value order."""
    kept = df.where(F.col(value).isNotNull())
    placed = prefix(kept, keys, order, index="__i", totals={"__n": "__i"})
    return placed.withColumn(name, (F.col("__i") + 1) / F.col("__n")).drop("__i", "__n")
