"""Outcome forecasts and their rolling back-test.

A match table has: comp, unit, ts, home, away, home_goals, away_goals. Everything but
the Elo fold is a prefix aggregate in (ts, unit) order."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clip, outcome_label
from ..operators import ordered
from ..operators.components import components
from ..operators.ordered import join_on
from ..operators.sets import two_side_rows
from ..session import cut_lineage
from . import goals_glm

MAX_GOALS = 10
EPS = 1e-12
WARM_UP = 12
# Prior games, default rate and bounds of a goal rate.
PRIOR_GAMES = 4.0
DEFAULT_RATE = 1.35
RATE_BOUNDS = (0.2, 4.5)
RHO_GRID = 81
RHO_LIMIT = 0.2
ORDER = ("ts", "unit")


# --- score matrices ------------------------------------------------------------------


def pmf(rate: Column) -> Column:
    """Array of P(0..10)."""
    r = F.greatest(rate, F.lit(1e-6))
    return F.transform(
        F.sequence(F.lit(0), F.lit(MAX_GOALS)), lambda k: F.exp(k * F.log(r) - r) / F.factorial(k).cast("double")
    )


def _tau(lh: Column, la: Column, rho: Column) -> list[Column]:
    """Low-score factors of the cells 0-0, 0-1, 1-0 and 1-1."""
    floor = F.lit(0.05)
    return [
        F.greatest(floor, 1 - lh * la * rho),
        F.greatest(floor, 1 + lh * rho),
        F.greatest(floor, 1 + la * rho),
        F.greatest(floor, 1 - rho),
    ]


def poisson_matrix(df: DataFrame, keys: Sequence[str], lh: str, la: str, rho: str | None = None) -> DataFrame:
    """121 rows (i, j, p) per input row, normalised."""
    r = F.col(rho) if rho else F.lit(0.0)
    rows = df.select(*keys, lh, la, r.alias("__rho"), pmf(F.col(lh)).alias("__h"), pmf(F.col(la)).alias("__a"))
    wide = rows.withColumn("__s", _totals(F.col("__h"), F.col("__a")))
    wide = wide.withColumn("__z", _mass(F.col("__s"), F.col("__h"), F.col("__a"), F.col(lh), F.col(la), F.col("__rho")))
    cells = wide.select("*", F.posexplode("__h").alias("i", "__ph")).select("*", F.posexplode("__a").alias("j", "__pa"))
    factor = F.lit(1.0)
    for (i, j), t in zip(((0, 0), (0, 1), (1, 0), (1, 1)), _tau(F.col(lh), F.col(la), F.col("__rho"))):
        factor = F.when((F.col("i") == i) & (F.col("j") == j), t).otherwise(factor)
    return cells.select(*keys, "i", "j", (F.col("__ph") * F.col("__pa") * factor / F.col("__z")).alias("p"))


def _totals(h: Column, a: Column) -> Column:
    """One walk over both arrays: mass of home wins, draws and away wins."""
    zero = F.struct(*[F.lit(0.0).alias(n) for n in ("ch", "ca", "home", "draw", "away")])
    step = lambda s, z: F.struct(
        (s["ch"] + z["h"]).alias("ch"),
        (s["ca"] + z["a"]).alias("ca"),
        (s["home"] + z["h"] * s["ca"]).alias("home"),
        (s["draw"] + z["h"] * z["a"]).alias("draw"),
        (s["away"] + z["a"] * s["ch"]).alias("away"),
    )
    return F.aggregate(F.arrays_zip(h.alias("h"), a.alias("a")), zero, step)


def _mass(s: Column, h: Column, a: Column, lh: Column, la: Column, rho: Column) -> Column:
    t00, t01, t10, t11 = _tau(lh, la, rho)
    base = s["home"] + s["draw"] + s["away"]
    return base + h[0] * a[0] * (t00 - 1) + h[0] * a[1] * (t01 - 1) + h[1] * a[0] * (t10 - 1) + h[1] * a[1] * (t11 - 1)


def outcome_probs(df: DataFrame, lh: str, la: str, rho: str | None = None, prefix: str = "p") -> DataFrame:
    """Adds <prefix>_home, _draw, _away; a row expression, no rows are multiplied."""
    r = F.col(rho) if rho else F.lit(0.0)
    t00, t01, t10, t11 = _tau(F.col(lh), F.col(la), r)
    rows = df.withColumn("__h", pmf(F.col(lh))).withColumn("__a", pmf(F.col(la)))
    rows = rows.withColumn("__s", _totals(F.col("__h"), F.col("__a")))
    h, a, s = F.col("__h"), F.col("__a"), F.col("__s")
    home = s["home"] + h[1] * a[0] * (t10 - 1)
    draw = s["draw"] + h[0] * a[0] * (t00 - 1) + h[1] * a[1] * (t11 - 1)
    away = s["away"] + h[0] * a[1] * (t01 - 1)
    z = _mass(s, h, a, F.col(lh), F.col(la), r)
    return rows.select(
        *df.columns, (home / z).alias(f"{prefix}_home"), (draw / z).alias(f"{prefix}_draw"), (away / z).alias(f"{prefix}_away")
    )


def proper_scores(df: DataFrame, actual: str = "actual") -> DataFrame:
    """Brier, log loss, ranked probability score, top-1 hit from p_home, p_draw, p_away.
    Probabilities equal to 12 digits tie, and the first outcome wins."""
    ph, pd_, pa = F.col("p_home"), F.col("p_draw"), F.col("p_away")
    eh, ed, ea = (F.round(x, 12) for x in (ph, pd_, pa))
    y = [F.when(F.col(actual) == x, 1.0).otherwise(0.0) for x in "HDA"]
    hit = F.when(F.col(actual) == "H", ph).when(F.col(actual) == "D", pd_).otherwise(pa)
    brier = (ph - y[0]) * (ph - y[0]) + (pd_ - y[1]) * (pd_ - y[1]) + (pa - y[2]) * (pa - y[2])
    c1, c2 = ph - y[0], ph + pd_ - y[0] - y[1]
    best = F.when((eh >= ed) & (eh >= ea), "H").when(ed >= ea, "D").otherwise("A")
    return df.select(
        "*",
        brier.alias("brier"),
        (-F.log(F.greatest(hit, F.lit(EPS)))).alias("log_loss"),
        ((c1 * c1 + c2 * c2) / 2.0).alias("rps"),
        best.alias("predicted"),
        (best == F.col(actual)).alias("accuracy"),
    )


# --- prefix state --------------------------------------------------------------------


def expanding_prior(matches: DataFrame) -> DataFrame:
    """State strictly before each match: matches, goals and outcome counts of the
    competition; games and goals for and against of both sides."""
    y = outcome_label("home_goals", "away_goals")
    m = matches.withColumn("actual", y)
    m = ordered.prefix(
        m,
        ["comp"],
        ORDER,
        sums={
            "prior_goals": (F.col("home_goals") + F.col("away_goals")).cast("long"),
            "prior_h": (F.col("actual") == "H").cast("long"),
            "prior_d": (F.col("actual") == "D").cast("long"),
            "prior_a": (F.col("actual") == "A").cast("long"),
        },
        index="prior_matches",
    )
    sides = two_side_rows(matches, ["comp", "unit", "ts"])
    sides = ordered.prefix(
        sides,
        ["comp", "side"],
        ORDER,
        sums={"gf": F.col("goals_for").cast("long"), "ga": F.col("goals_against").cast("long")},
        index="games",
    )
    per_unit = sides.groupBy("comp", "unit").agg(
        *[
            F.max(F.when(F.col("venue") == v, F.col(x))).alias(f"{v}_{n}")
            for v in ("home", "away")
            for x, n in (("gf", "gf"), ("ga", "ga"), ("games", "games"))
        ]
    )
    return join_on(m, per_unit, ["comp", "unit"])


def base_rate(df: DataFrame) -> DataFrame:
    """(1 + prior count) / sum per outcome."""
    total = F.col("prior_matches") + 3
    return df.select("*", *[((F.col(f"prior_{x}") + 1) / total).alias(f"base_{n}") for x, n in (("h", "home"), ("d", "draw"), ("a", "away"))])


def shrunk_rates(df: DataFrame) -> DataFrame:
    """Goal rates of both sides with four prior games at the global rate."""
    gr = F.when(F.col("prior_matches") > 0, F.col("prior_goals") / (2 * F.col("prior_matches"))).otherwise(DEFAULT_RATE)
    rate = lambda s, x: (F.col(f"{s}_{x}") + PRIOR_GAMES * F.col("global_rate")) / (F.col(f"{s}_games") + PRIOR_GAMES)
    raw = lambda s, o: F.when(F.col("global_rate") > 0, rate(s, "gf") * rate(o, "ga") / F.col("global_rate")).otherwise(0.0)
    out = df.withColumn("global_rate", gr)
    return out.withColumn("lambda_home", clip(raw("home", "away"), *RATE_BOUNDS)).withColumn(
        "lambda_away", clip(raw("away", "home"), *RATE_BOUNDS)
    )


def rho_grid_fit(df: DataFrame, minimum: int = 10) -> DataFrame:
    """Low-score correction per match: the grid value with the largest log-likelihood
    over all earlier forecast matches (0 before ``minimum`` of them; the lowest value on
    ties). ``df`` holds the forecast matches with their rates. A running sum per
    (competition, grid value) replaces the repeated sums over the history, and the grid
    values run side by side."""
    step = 2 * RHO_LIMIT / (RHO_GRID - 1)
    gh, ga = F.least(F.col("home_goals"), F.lit(MAX_GOALS)), F.least(F.col("away_goals"), F.lit(MAX_GOALS))
    rates = ["lambda_home", "lambda_away"]
    base = df.select("comp", *ORDER, "home_goals", "away_goals", *rates)
    base = base.withColumn("__h", pmf(F.col("lambda_home"))).withColumn("__a", pmf(F.col("lambda_away")))
    base = base.withColumn("__s", _totals(F.col("__h"), F.col("__a")))
    h, a, s = F.col("__h"), F.col("__a"), F.col("__s")
    cells = [(0, 0), (0, 1), (1, 0), (1, 1)]
    parts = base.select(
        "comp",
        *ORDER,
        *rates,
        (s["home"] + s["draw"] + s["away"]).alias("__z"),
        (h[gh] * a[ga]).alias("__p"),
        F.when((gh < 2) & (ga < 2), gh * 2 + ga).otherwise(4).alias("__cell"),
        *[(h[i] * a[j]).alias(f"__c{n}") for n, (i, j) in enumerate(cells)],
    )

    width, eps, most = RHO_GRID, EPS, ordered.MAX_CHUNKS
    rho = np.arange(width) * step - RHO_LIMIT

    def likelihoods(table: pa.Table | pa.RecordBatch) -> np.ndarray:
        """A row for each match, a column for each grid value."""
        names = ["lambda_home", "lambda_away", "__z", "__p", *[f"__c{n}" for n in range(4)]]
        value = {n: table.column(n).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(n).to_numpy() for n in names}
        cell, out = np.asarray(table.column("__cell")), np.empty((table.num_rows, width))
        known = {n: np.asarray(table.column(n).is_valid()) for n in ("lambda_home", "lambda_away", "__p")}
        for i in range(0, table.num_rows, 4096):
            at = slice(i, i + 4096)
            lh, la, z, p = (value[n][at, None] for n in names[:4])
            has_h, has_a, has_p = (known[n][at, None] for n in known)
            # As `_tau`: nulls leave the floor.
            taus = [
                np.where(ok, np.maximum(0.05, tau), 0.05)
                for ok, tau in ((has_h & has_a, 1 - lh * la * rho), (has_h, 1 + lh * rho), (has_a, 1 + la * rho), (True, 1 - rho[None, :]))
            ]
            factor, mass = np.ones((len(p), width)), z
            for n, tau in enumerate(taus):
                factor = np.where(cell[at, None] == n, tau, factor)
                mass = mass + value[f"__c{n}"][at, None] * (tau - 1)
            out[at] = np.log(np.where(has_p, np.maximum(eps, p * factor / mass), eps))
        return out

    # The log-likelihoods of all grid values are made where they are added: first for the
    # total of each chunk of a competition, then, from the totals of the chunks before, in
    # order inside it. Only what they are made of is written and shuffled.
    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def out() -> pa.RecordBatch:
            sums = pa.array([x[1] for x in held.values()], pa.list_(pa.float64()))
            columns = [pa.array([c for c, _ in held], batch.schema.field("comp").type), pa.array([c for _, c in held], pa.int32()), pa.array([x[0] for x in held.values()], pa.int64()), sums]
            return pa.record_batch(columns, names=["comp", "__chunk", "__n", "__ll"])

        for batch in batches:
            if not batch.num_rows:
                continue
            comps = batch.column("comp").dictionary_encode(null_encoding="encode")
            code = comps.indices.to_numpy().astype(np.int64) * most + batch.column("__chunk").to_numpy()
            order = np.argsort(code, kind="stable")
            each, first, n = np.unique(code[order], return_index=True, return_counts=True)
            names = comps.dictionary.to_pylist()
            for c, k, s in zip(each.tolist(), n.tolist(), np.add.reduceat(likelihoods(batch)[order], first, axis=0)):
                key = names[c // most], c % most
                old = held.get(key)
                held[key] = (k, s) if old is None else (old[0] + k, old[1] + s)
            if len(held) >= most:
                yield out()
                held = {}
        if held:
            yield out()

    grid, inside, kinds = range(RHO_GRID), ["__key", "__chunk"], dict(df.dtypes)
    rows = ordered.chunked(cut_lineage(parts), ["comp"], ORDER)
    parted = rows.drop("__key", *ORDER).mapInArrow(total, f"comp {kinds['comp']}, __chunk int, __n long, __ll array<double>")
    sums = parted.groupBy(F.struct("comp").alias("__key"), "__chunk").agg(F.sum("__n").alias("__n"), *[F.sum(F.col("__ll")[k]).alias(f"__s{k}") for k in grid])
    before = Window.partitionBy("__key").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    starts = sums.select(*inside, so_far("__n").alias("__from"), F.array(*[so_far(f"__s{k}").cast("double") for k in grid]).alias("__start"))

    def fold(table: pa.Table, start: pa.Table) -> pa.Table:
        table = table.sort_by([(x, "ascending") for x in ORDER])
        run = likelihoods(table)
        run[1:] = run[:-1]
        run[:1] = np.asarray(start.column("__start").combine_chunks().flatten())
        np.cumsum(run, axis=0, out=run)
        best = np.argmax(np.round(run, 9, out=run), axis=1)  # the lowest value on ties
        seen = start.column("__from")[0].as_py() + np.arange(table.num_rows)
        return pa.table([table.column("comp"), table.column("unit"), pa.array(best), pa.array(seen)], names=["comp", "unit", "__k", "__seen"])

    best = rows.groupBy(*inside).cogroup(starts.groupBy(*inside)).applyInArrow(fold, f"comp {kinds['comp']}, unit {kinds['unit']}, __k long, __seen long")
    rho = F.when(F.col("__seen") >= minimum, F.col("__k") * F.lit(step) - F.lit(RHO_LIMIT)).otherwise(0.0)
    return join_on(df, best.select("comp", "unit", F.round(rho, 6).alias("rho")), ["comp", "unit"])


# Elo start, scale and step.
ELO_START, ELO_SCALE, ELO_STEP = 1500.0, 400.0, 24.0


def elo_folder():
    """Function (ratings, rows) -> pre-match ratings of (home, away, home_goals,
    away_goals) rows in order; the ratings are updated in place. Made here, so that it
    travels to the workers by value and they need not have this package."""
    import math

    start, scale, size = ELO_START, ELO_SCALE, ELO_STEP

    def fold(state: dict, rows) -> list[tuple[float, float]]:
        out = []
        for home, away, gh, ga in rows:
            rh, ra = state.get(home, start), state.get(away, start)
            out.append((rh, ra))
            expected = 1.0 / (1.0 + 10.0 ** ((ra - rh) / scale))
            got = 1.0 if gh > ga else 0.5 if gh == ga else 0.0
            step = size * (math.log(abs(gh - ga) + 1) + 1) * (got - expected)
            state[home] = rh + step
            state[away] = state.get(away, start) - step
        return out

    return fold


def elo_parts(matches: DataFrame) -> DataFrame:
    """``comp``, ``side``, ``part``: sides of a competition that are tied by matches share
    a part. Ratings never pass from one part to another."""
    sides = matches.select("comp", "home", "away").distinct()
    return components(sides, ["comp"], "home", "away").withColumnsRenamed({"node": "side", "root": "part"})


def elo_ratings(matches: DataFrame) -> DataFrame:
    """Pre-match Elo of both sides. Each rating feeds the next, so the matches of sides
    that are tied to each other are folded in order by one task, those of other parts of
    the competition by others; the rows stream through in Arrow batches and only the
    ratings of one part are held, never its matches. A null side belongs to the part of
    its opponent."""
    rate = elo_folder()
    parts = elo_parts(matches)
    at = lambda side, name: parts.select("comp", F.col("side").alias(side), F.col("part").alias(name))
    rows = join_on(matches.select("comp", "unit", "ts", "home", "away", "home_goals", "away_goals"), at("home", "__p"), ["comp", "home"], "left", nulls=True)
    lone = join_on(rows.where(F.col("home").isNull()).drop("__p"), at("away", "__p"), ["comp", "away"], "left", nulls=True)
    rows = rows.where(F.col("home").isNotNull()).unionByName(lone)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, state = None, {}
        for pdf in batches:
            first, second = [], []
            for c, p, home, away, gh, ga in zip(*(pdf[x] for x in ("comp", "__p", "home", "away", "home_goals", "away_goals"))):
                if (c, p) != part:
                    part, state = (c, p), {}
                ((rh, ra),) = rate(state, [(home, away, gh, ga)])
                first.append(rh)
                second.append(ra)
            yield pd.DataFrame({"comp": pdf["comp"], "unit": pdf["unit"], "elo_home": first, "elo_away": second})

    kinds = dict(matches.dtypes)
    placed = rows.repartition("comp", "__p").sortWithinPartitions("comp", "__p", *ORDER)
    slim = placed.select("comp", "__p", "unit", "home", "away", "home_goals", "away_goals")
    return slim.mapInPandas(fold, f"comp {kinds['comp']}, unit {kinds['unit']}, elo_home double, elo_away double")


# Defaults of the form features, and their weights in the edge.
FORM = {"rating": 6.5, "shots": 10.0, "pass_accuracy": 0.75}
EDGE = {"rating": 0.45, "shots": 0.035, "pass_accuracy": 1.2}
EDGE_ELO = 0.0042


def last_form(matches: DataFrame, features: DataFrame, k: int = 5) -> DataFrame:
    """Mean of the last ``k`` feature rows of both sides before each match, defaults
    where there are none. A match without features adds nothing, so rows are tied to the
    number of feature rows seen before, not to positions among all matches.
    ``features``: unit, side, and the form columns."""
    sides = two_side_rows(matches, ["comp", "unit", "ts"]).select("comp", "unit", "ts", "venue", "side")
    marked = join_on(sides, features.select("unit", "side", *FORM), ["unit", "side"], "left")
    marked = cut_lineage(marked.withColumn("__has", F.col("rating").isNotNull().cast("long")))
    counted = ordered.prefix(marked, ["comp", "side"], ORDER, sums={"__seen": "__has"})
    have = marked.where(F.col("__has") == 1)
    means = ordered.last_k(have, ["comp", "side"], ORDER, k, {f"form_{n}": F.avg(n) for n in FORM}, current=True)
    placed = ordered.row_index(means, ["comp", "side"], ORDER, "__seen")
    state = placed.select("comp", "side", "__seen", *[f"form_{n}" for n in FORM])
    joined = join_on(counted.select("comp", "unit", "venue", "side", "__seen"), state, ["comp", "side", "__seen"], "left")
    return joined.groupBy("comp", "unit").agg(
        *[
            F.coalesce(F.max(F.when(F.col("venue") == v, F.col(f"form_{n}"))), F.lit(d)).alias(f"{v}_{n}")
            for v in ("home", "away")
            for n, d in FORM.items()
        ]
    )


def form_logit(df: DataFrame) -> DataFrame:
    """Win, draw, loss from the Elo and form edge, the draw share tied to the base rate."""
    edge = F.lit(EDGE_ELO) * (F.col("elo_home") - F.col("elo_away"))
    for n, w in EDGE.items():
        edge = edge + F.lit(w) * (F.col(f"home_{n}") - F.col(f"away_{n}"))
    out = df.withColumn("edge", edge)
    win = 1.0 / (1.0 + F.exp(-F.col("edge")))
    draw = clip(F.col("base_draw") * (0.72 + 0.55 * F.exp(-F.abs("edge"))), 0.12, 0.38)
    parts = [F.greatest(p, F.lit(1e-8)) for p in ((1 - draw) * win, draw, (1 - draw) * (1 - win))]
    total = parts[0] + parts[1] + parts[2]
    return out.select("*", *[(p / total).alias(f"form_{n}") for p, n in zip(parts, ("home", "draw", "away"))])


MODELS = {"naive_base_rate": "base", "poisson_shrunk": "poi", "dixon_coles_shrunk": "dc", "transparent_form": "form"}


def rolling_backtest(matches: DataFrame, features: DataFrame | None = None, warm_up: int = WARM_UP) -> DataFrame:
    """Long scored forecasts, one row per match and model, each using earlier matches
    only. Without ``features`` the fourth model is left out."""
    matches = cut_lineage(matches)
    state = cut_lineage(shrunk_rates(base_rate(expanding_prior(matches))).where(F.col("prior_matches") >= warm_up))
    rows = outcome_probs(rho_grid_fit(state), "lambda_home", "lambda_away", prefix="poi")
    rows = outcome_probs(rows, "lambda_home", "lambda_away", "rho", prefix="dc")
    models = dict(MODELS)
    if features is None:
        models.pop("transparent_form")
    else:
        rows = join_on(join_on(rows, elo_ratings(matches), ["comp", "unit"]), last_form(matches, features), ["comp", "unit"])
        rows = form_logit(rows)
    long = F.array(
        *[
            F.struct(F.lit(m).alias("model"), *[F.col(f"{p}_{o}").alias(f"p_{o}") for o in ("home", "draw", "away")])
            for m, p in models.items()
        ]
    )
    keep = ["comp", "unit", "ts", "home", "away", "home_goals", "away_goals", "actual", "lambda_home", "lambda_away", "rho"]
    return proper_scores(rows.select(*keep, F.inline(long)))


def frozen_holdout(matches: DataFrame, strengths: DataFrame) -> DataFrame:
    """Forecasts from strengths fixed before the holdout, scored against the uniform
    prior. ``strengths``: side, z, attack, defence; one row per side."""
    side = lambda v: strengths.select(F.col("side").alias(v), *[F.col(x).alias(f"{v}_{x}") for x in ("z", "attack", "defence")])
    rows = matches.join(side("home"), "home").join(side("away"), "away")
    edge = F.col("home_z") - F.col("away_z")
    rate = lambda s, h, a: 1.30 * F.exp(0.22 * s * edge + 0.18 * (F.col(f"{h}_attack") - F.col(f"{a}_defence")))
    rows = rows.withColumn("lambda_home", rate(1.0, "home", "away")).withColumn("lambda_away", rate(-1.0, "away", "home"))
    out = outcome_probs(rows, "lambda_home", "lambda_away").withColumn("actual", outcome_label("home_goals", "away_goals"))
    return proper_scores(out).withColumn("naive_log_loss", F.lit(-1.0) * F.log(F.lit(1.0 / 3.0)))


def holdout_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count(F.lit(1)).alias("matches"),
        F.avg("brier").alias("brier_score"),
        F.avg("log_loss").alias("log_loss"),
        F.avg("rps").alias("ranked_probability_score"),
        F.avg(F.col("accuracy").cast("double")).alias("top1_accuracy"),
        F.avg("naive_log_loss").alias("naive_log_loss"),
    ).withColumn("skill", 1 - F.col("log_loss") / F.col("naive_log_loss"))


# --- fitted models -------------------------------------------------------------------

decay_weight = goals_glm.decay_weight


def poisson_glm(train: DataFrame, alpha: float, half_life: float | None) -> goals_glm.Fit:
    """Poisson regression of goals on attacker, defender and knockout flag, ridge-penalised
    and time-weighted."""
    return goals_glm.poisson_fit(train, [(alpha, half_life)])


def glm_rates(fit: goals_glm.Fit, matches: DataFrame) -> DataFrame:
    """lambda_home and lambda_away of each match under the fitted model."""
    return goals_glm.rates(fit, matches).drop("point")


ALPHAS, HALF_LIVES = (0.03, 0.1, 0.3, 1.0), (21.0, None)


def grid_points(alphas: Sequence[float] = ALPHAS, half_lives: Sequence[float | None] = HALF_LIVES) -> list[tuple[float, float | None]]:
    return [(a, h) for a in alphas for h in half_lives]


def split_last(matches: DataFrame, hold_out: int) -> tuple[DataFrame, DataFrame]:
    """(all but the last matches, the last ``hold_out``), both written."""
    matches = cut_lineage(matches)
    test = cut_lineage(matches.orderBy(F.col("ts").desc(), F.col("unit").desc()).limit(hold_out))
    return matches.join(test.select("unit"), "unit", "left_anti"), test


def grid_tune(matches: DataFrame, hold_out: int = 18, points: Sequence[tuple[float, float | None]] = tuple(grid_points())) -> DataFrame:
    """Log loss of each (alpha, half-life) on the last ``hold_out`` matches; all points
    are fitted together."""
    train, test = split_last(matches, hold_out)
    fit = goals_glm.poisson_fit(train, points)
    probs = outcome_probs(goals_glm.rates(fit, test), "lambda_home", "lambda_away").withColumn("actual", outcome_label("home_goals", "away_goals"))
    losses = proper_scores(probs).groupBy("point").agg(F.avg("log_loss").alias("log_loss"), F.count(F.lit(1)).alias("matches"))
    named = F.inline(F.array(*[F.struct(F.lit(m.point).alias("point"), F.lit(m.alpha).alias("alpha"), F.lit(m.half_life).cast("double").alias("half_life")) for m in fit.models]))
    return losses.join(matches.sparkSession.range(1).select(named), "point").select("alpha", "half_life", "log_loss", "matches")


def pair_rates(fit: goals_glm.Fit, pair: tuple, knockout: int = 1) -> dict:
    """Goal rate of each side of the pair against the other."""
    rows = fit.effects.where(F.col("point") == 0).where(F.col("side").isin(*map(str, pair))).collect()  # four rows
    effect = {(r.block, r.side): r.effect for r in rows}
    m = fit.models[0]
    rate = lambda a, b: math.exp(m.intercept + m.slope * knockout + effect.get(("attack", str(a)), 0.0) + effect.get(("defence", str(b)), 0.0))
    return {pair[0]: rate(*pair), pair[1]: rate(*reversed(pair))}


def final_rates(matches: DataFrame, pair: tuple, hold_out: int = 18) -> dict:
    """Rates of the pair under the grid point with the least hold-out loss, fitted anew to
    all matches."""
    best = grid_tune(matches, hold_out).orderBy("log_loss", "alpha", F.col("half_life").asc_nulls_last()).first()
    return pair_rates(poisson_glm(matches, best.alpha, best.half_life), pair)


def bootstrap_rates(matches: DataFrame, pair: tuple, glm: Mapping, worlds: int, seed: int, weight: float = 0.72) -> DataFrame:
    """Per world and side of the pair: its games and the opponent's resampled, the shrunk
    rate times the knockout factor, blended geometrically with the fitted rate."""
    from ..operators.resample import drawn_totals

    sides = two_side_rows(matches, ["unit", "ts", "knockout"])
    games = sides.where(F.col("side").isin(*pair)).select("side", "unit", "ts", "goals_for", "goals_against")
    placed = cut_lineage(ordered.row_index(games, ["side"], ORDER, "__i", start=0))
    totals = drawn_totals(placed, "side", "__i", ["goals_for", "goals_against"], worlds, seed).withColumnsRenamed({"goals_for": "gf", "goals_against": "ga"})
    g = F.col("home_goals") + F.col("away_goals")
    rate = lambda test: F.sum(F.when(test, g)) / (2 * F.count_if(test))
    glob = matches.agg(
        (F.sum(g) / (2 * F.count(F.lit(1)))).alias("gr"), (rate(F.col("knockout") == 1) / rate(F.col("knockout") == 0)).alias("ko")
    )
    rows = join_on(totals, glob, [])
    shrunk = lambda x: (F.col(x) + PRIOR_GAMES * F.col("gr")) / (F.col("n") + PRIOR_GAMES)
    rates = rows.select("world", "side", "gr", "ko", shrunk("gf").alias("attack"), shrunk("ga").alias("defence"))
    other = rates.select("world", F.when(F.col("side") == pair[0], pair[1]).otherwise(pair[0]).alias("side"), F.col("defence").alias("against"))
    both = rates.join(other, ["world", "side"])
    form = F.col("attack") * F.col("against") / F.col("gr") * F.col("ko")
    fitted = F.when(F.col("side") == pair[0], F.lit(float(glm[pair[0]]))).otherwise(F.lit(float(glm[pair[1]])))
    return both.select("world", "side", F.exp(weight * F.log(fitted) + (1 - weight) * F.log(form)).alias("rate"))
