"""Ridge Poisson regression of goals on attacker, defender and knockout flag.

No design matrix: rows collapse to one cell for each (attacker, defender, flag), and the
score equations of one block of effects need only sums of a group. Attack effects are
updated together, each by its own Newton steps on the sums of its cells; then defence
effects; the intercept and the flag's slope follow from the same sums. Several models,
one for each (penalty, half-life), are fitted side by side, the model as a key of the sums.

A model minimises  sum w (mu - y eta) / sum w  +  alpha / 2 * (squares of all effects but
the intercept). At its minimum the effects of a block sum to zero, so a block is centred
after each update and its mean goes to the intercept, which leaves every mu as it was.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import join_on
from ..operators.sets import two_side_rows
from ..session import cut_lineage, discard

#: Newton steps inside one group, each of at most 1; all on sums already made.
_STEPS = 40
BLOCKS = ("attack", "defence")


@dataclass(frozen=True)
class Model:
    """A fitted grid point; its effects of sides are rows of :attr:`Fit.effects`."""

    point: int
    alpha: float
    half_life: float | None
    intercept: float
    slope: float


@dataclass(frozen=True)
class Fit:
    """``effects``: point, block, side, effect. Sides that were not seen have none."""

    effects: DataFrame
    models: tuple[Model, ...]


def decay_weight(ts: Column, reference: Column, half_life: float | None) -> Column:
    """0.5^(age in days / half-life), or 1."""
    if half_life is None:
        return F.lit(1.0)
    age = (F.unix_micros(reference.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 86_400_000_000.0
    return F.pow(F.lit(0.5), age / F.lit(half_life))


def attack_rows(matches: DataFrame) -> DataFrame:
    """Two rows per match: who attacks, who defends, the flag, and the goals."""
    sides = two_side_rows(matches, ["unit", "ts", "knockout"])
    return sides.select("ts", F.col("side").cast("string").alias("attack"), F.col("opponent").cast("string").alias("defence"), F.col("knockout").cast("double").alias("x"), F.col("goals_for").cast("double").alias("goals"))


def cells(matches: DataFrame, points: Sequence[tuple[float, float | None]]) -> DataFrame:
    """``point``, ``attack``, ``defence``, ``x``, ``w`` (weight), ``y`` (weighted goals):
    all that the fit needs of the matches. Weights age from the last match."""
    rows = join_on(attack_rows(matches), matches.agg(F.max("ts").alias("__last")), [])
    ages = list(dict.fromkeys(h for _, h in points))
    weights = [decay_weight(F.col("ts"), F.col("__last"), h) for h in ages]
    sums = [F.sum(e).alias(f"__{n}{i}") for i, w in enumerate(weights) for n, e in (("w", w), ("y", w * F.col("goals")))]
    one = rows.dropna(subset=["attack", "defence", "x", "goals"]).groupBy("attack", "defence", "x").agg(*sums)
    each = F.array(*[F.struct(F.lit(p).alias("point"), F.col(f"__w{ages.index(h)}").alias("w"), F.col(f"__y{ages.index(h)}").alias("y")) for p, (_, h) in enumerate(points)])
    return one.select("attack", "defence", "x", F.inline(each)).where(F.col("w") > 0)


def _of_point(values: Sequence[float]) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("point") + 1)


class _State:
    """Numbers of each grid point on the driver, effects of sides in written tables."""

    def __init__(self, data: DataFrame, points: Sequence[tuple[float, float | None]]):
        self.data, self.n = data, len(points)
        self.alpha = [a for a, _ in points]
        totals = {r.point: r for r in data.groupBy("point").agg(F.sum("w").alias("w"), F.sum("y").alias("y"), F.sum(F.col("y") * F.col("x")).alias("yx")).collect()}
        if len(totals) < self.n or any(t.y <= 0 for t in totals.values()):
            raise ValueError("no goals to fit")
        self.w, self.y, self.yx = ([totals[p][k] for p in range(self.n)] for k in ("w", "y", "yx"))
        self.b, self.k = [math.log(y / w) for y, w in zip(self.y, self.w)], [0.0] * self.n
        self.table: dict[str, DataFrame | None] = dict.fromkeys(BLOCKS)
        self.centre = {block: [0.0] * self.n for block in BLOCKS}

    def effect(self, block: str) -> DataFrame | None:
        """point, the block's column, effect; centred."""
        table = self.table[block]
        return table and table.select("point", F.col("side").alias(block), (F.col("value") - _of_point(self.centre[block])).alias(f"__{block}"))

    def rows(self) -> DataFrame:
        """The cells with both effects and the mean goals of a unit of weight."""
        out = self.data
        for block in BLOCKS:
            effect = self.effect(block)
            out = out.withColumn(f"__{block}", F.lit(0.0)) if effect is None else join_on(out, effect, ["point", block], "left").fillna(0.0, [f"__{block}"])
        eta = _of_point(self.b) + _of_point(self.k) * F.col("x") + F.col("__attack") + F.col("__defence")
        return out.withColumn("__mu", F.col("w") * F.exp(eta))

    def update(self, block: str) -> float:
        """One block to its minimum, then one step of intercept and slope; the largest
        change."""
        mu, x = F.col("__mu"), F.col("x")
        sums = self.rows().groupBy("point", F.col(block).alias("side")).agg(
            F.sum(mu).alias("m"), F.sum(mu * x).alias("mx"), F.sum(mu * x * x).alias("mxx"), F.sum("y").alias("y"), F.max(f"__{block}").alias("old")
        )
        ridge = _of_point([a * w for a, w in zip(self.alpha, self.w)])

        def newton(d: Column, _: Column) -> Column:
            m = F.col("m") * F.exp(d)
            step = (F.col("y") - m - ridge * (F.col("old") + d)) / (m + ridge)
            return d + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), step))

        moved = F.aggregate(F.sequence(F.lit(1), F.lit(_STEPS)), F.lit(0.0), newton)
        grown = sums.withColumn("moved", moved).select("point", "side", "moved", (F.col("old") + F.col("moved")).alias("value"), *[(F.col(c) * F.exp("moved")).alias(c) for c in ("m", "mx", "mxx")])
        before, self.table[block] = self.table[block], cut_lineage(grown)
        discard(before)
        largest = 0.0
        for r in self.table[block].groupBy("point").agg(F.avg("value").alias("mean"), F.max(F.abs("moved")).alias("moved"), *[F.sum(c).alias(c) for c in ("m", "mx", "mxx")]).collect():
            p, w, a = r.point, self.w[r.point], self.alpha[r.point]
            self.centre[block][p] = r.mean
            self.b[p] += r.mean
            # Two equations: intercept, slope.
            g0, g1 = (r.m - self.y[p]) / w, (r.mx - self.yx[p]) / w + a * self.k[p]
            h00, h01, h11 = r.m / w, r.mx / w, r.mxx / w + a
            det = h00 * h11 - h01 * h01
            steps = (h01 * g1 - h11 * g0) / det, (h01 * g0 - h00 * g1) / det
            db, dk = (max(-1.0, min(1.0, s)) for s in steps)
            self.b[p], self.k[p] = self.b[p] + db, self.k[p] + dk
            largest = max(largest, r.moved, abs(db), abs(dk))
        return largest


def poisson_fit(matches: DataFrame, points: Sequence[tuple[float, float | None]], tol: float = 1e-9, sweeps: int = 200) -> Fit:
    """All ``points`` (penalty, half-life in days or None) fitted to ``matches`` (unit,
    ts, knockout, home, away, home_goals, away_goals) in one iteration.

    Each sweep reads the cells twice, whatever the number of points. Matches without
    a side, goals or flag are left out. A sweep's tables are
    written in the shared folder and deleted when the next are. No matches, or none with
    a goal, is an error, and so is a fit that has not settled after ``sweeps``."""
    if not points or any(a <= 0 for a, _ in points):
        raise ValueError("a penalty above 0 is needed")
    state = _State(cut_lineage(cells(matches, points)), points)
    for _ in range(sweeps):
        if max(state.update(block) for block in BLOCKS) < tol:
            break
    else:
        raise ValueError(f"not settled after {sweeps} sweeps")
    both = [state.effect(b).select("point", F.lit(b).alias("block"), F.col(b).alias("side"), F.col(f"__{b}").alias("effect")) for b in BLOCKS]
    effects = cut_lineage(both[0].unionAll(both[1]))
    discard(state.data, *state.table.values())
    models = [Model(p, a, h, state.b[p], state.k[p]) for p, (a, h) in enumerate(points)]
    return Fit(effects, tuple(models))


def _model_column(fit: Fit, value: str) -> Column:
    return _of_point([getattr(m, value) for m in fit.models])


def rates(fit: Fit, matches: DataFrame) -> DataFrame:
    """``matches`` with point, lambda_home and lambda_away, a row for each grid point."""
    out = matches.withColumn("point", F.explode(F.array(*[F.lit(m.point) for m in fit.models])))
    for side in ("home", "away"):
        for block in BLOCKS:
            key = f"__key_{side}"
            own = fit.effects.where(F.col("block") == block).select("point", F.col("side").alias(key), F.col("effect").alias(f"__{side}_{block}"))
            out = join_on(out.withColumn(key, F.col(side).cast("string")), own, ["point", key], "left").fillna(0.0, [f"__{side}_{block}"])
    base = _model_column(fit, "intercept") + _model_column(fit, "slope") * F.col("knockout")
    rate = lambda s, o: F.exp(base + F.col(f"__{s}_attack") + F.col(f"__{o}_defence"))
    return out.select(*matches.columns, "point", rate("home", "away").alias("lambda_home"), rate("away", "home").alias("lambda_away"))


def score_equations(fit: Fit, matches: DataFrame) -> DataFrame:
    """What each equation of the fit is off by: ``point``, ``block`` (attack, defence,
    intercept, slope), ``side``, ``residual``. All are 0 where the fit is exact."""
    points = [(m.alpha, m.half_life) for m in fit.models]
    rows = cut_lineage(cells(matches, points))
    total = rows.groupBy("point").agg(F.sum("w").alias("total"))
    for block in BLOCKS:
        own = fit.effects.where(F.col("block") == block).select("point", F.col("side").alias(block), F.col("effect").alias(f"__{block}"))
        rows = join_on(rows, own, ["point", block], "left").fillna(0.0, [f"__{block}"])
    eta = _model_column(fit, "intercept") + _model_column(fit, "slope") * F.col("x") + F.col("__attack") + F.col("__defence")
    rows = join_on(rows, total, ["point"]).withColumn("off", (F.col("w") * F.exp(eta) - F.col("y")) / F.col("total"))
    alpha = _model_column(fit, "alpha")
    per_side = lambda b: rows.groupBy("point", F.lit(b).alias("block"), F.col(b).alias("side")).agg((F.sum("off") + F.max(alpha * F.col(f"__{b}"))).alias("residual"))
    none = F.lit(None).cast("string").alias("side")
    whole = rows.groupBy("point", F.lit("intercept").alias("block"), none).agg(F.sum("off").alias("residual"))
    slope = rows.groupBy("point", F.lit("slope").alias("block"), none).agg((F.sum(F.col("off") * F.col("x")) + F.max(alpha * _model_column(fit, "slope"))).alias("residual"))
    return per_side("attack").unionAll(per_side("defence")).unionAll(whole).unionAll(slope)
