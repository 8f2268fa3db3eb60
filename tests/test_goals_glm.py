"""The fitted goal model against a Newton fit in numpy over the plain design."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.catalog import forecast_q
from cohortlens.plans import forecast as M
from cohortlens.plans import goals_glm as G


def numpy_fit(rows, alpha, half_life):
    """Intercept, slope, attack and defence effects of (days, home, away, gh, ga, x)."""
    last = max(r[0] for r in rows)
    data = [(r[1], r[2], r[5], r[3], r[0]) for r in rows] + [(r[2], r[1], r[5], r[4], r[0]) for r in rows]
    names = sorted({d[0] for d in data})
    at = {n: i for i, n in enumerate(names)}
    a, d = (np.array([at[r[i]] for r in data]) for i in (0, 1))
    x, y = np.array([float(r[2]) for r in data]), np.array([float(r[3]) for r in data])
    w = np.array([1.0 if half_life is None else 0.5 ** ((last - r[4]) / half_life) for r in data])
    w /= w.sum()
    n = len(names)
    ridge = np.r_[0.0, np.full(1 + 2 * n, alpha)]
    apply = lambda v: v[0] + v[1] * x + v[2 : 2 + n][a] + v[2 + n :][d]
    turn = lambda e: np.r_[e.sum(), (e * x).sum(), np.bincount(a, e, n), np.bincount(d, e, n)]
    beta = np.zeros(2 + 2 * n)
    beta[0] = math.log((w * y).sum())
    for _ in range(60):
        mu = w * np.exp(apply(beta))
        g = turn(mu - w * y) + ridge * beta
        if np.abs(g).max() < 1e-15:
            break
        diag = np.r_[mu.sum(), (mu * x * x).sum() + alpha, np.bincount(a, mu, n) + alpha, np.bincount(d, mu, n) + alpha]
        s, r = np.zeros_like(g), -g
        z = r / diag
        p, rz = z.copy(), r @ z
        for _ in range(4 * n + 50):
            hp = turn(mu * apply(p)) + ridge * p
            step = rz / (p @ hp)
            s, r = s + step * p, r - step * hp
            z = r / diag
            old, rz = rz, r @ z
            if abs(rz) < 1e-32:
                break
            p = z + rz / old * p
        beta = beta + s
    return names, beta


def played(n_sides, n_matches, seed):
    rng = np.random.default_rng(seed)
    skill = rng.normal(0, 0.4, n_sides)
    rows = []
    for i in range(n_matches):
        h, a = rng.choice(n_sides, 2, replace=False)
        x = int(i > 0.8 * n_matches)
        rows.append((i // 10, int(h), int(a), int(rng.poisson(math.exp(0.3 + skill[h] - skill[a] - 0.2 * x))), int(rng.poisson(math.exp(0.1 + skill[a] - skill[h]))), x))
    return rows


def frame(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "unit long, day int, home long, away long, home_goals int, away_goals int, knockout int")
    return df.withColumn("ts", F.timestamp_micros(F.col("day").cast("long") * 86_400_000_000))


def compare(fit, rows):
    effects = defaultdict(dict)
    for r in fit.effects.collect():
        effects[r.point, r.block][r.side] = r.effect
    for m in fit.models:
        names, beta = numpy_fit(rows, m.alpha, m.half_life)
        n = len(names)
        assert m.intercept == pytest.approx(beta[0], abs=1e-6) and m.slope == pytest.approx(beta[1], abs=1e-6)
        for block, part in (("attack", beta[2 : 2 + n]), ("defence", beta[2 + n :])):
            got = effects[m.point, block]
            assert len(got) == n and max(abs(got[str(s)] - v) for s, v in zip(names, part)) < 1e-6


def test_all_points_equal_numpy_fits(spark):
    rows = played(9, 120, 1)
    fit = G.poisson_fit(frame(spark, rows), M.grid_points())
    assert len(fit.models) == 8
    compare(fit, rows)
    off = G.score_equations(fit, frame(spark, rows))
    assert off.count() == 8 * (9 + 9 + 2) and off.agg(F.max(F.abs("residual"))).first()[0] < 1e-8


def test_ten_thousand_sides(spark):
    rows = played(10_000, 20_000, 2)
    fit = M.poisson_glm(frame(spark, rows), 0.0001, None)
    compare(fit, rows)


def test_losses_of_the_grid(spark):
    rows = played(9, 120, 3)
    points = [(0.03, None), (1.0, 21.0)]
    got = {r.alpha: r for r in M.grid_tune(frame(spark, rows), 18, points).collect()}
    for alpha, half_life in points:
        names, beta = numpy_fit(rows[:-18], alpha, half_life)
        at, n, losses = {s: i for i, s in enumerate(names)}, len(names), []
        for _, h, a, gh, ga, x in rows[-18:]:
            rate = lambda s, o: math.exp(beta[0] + beta[1] * x + beta[2 + at[s]] + beta[2 + n + at[o]])  # noqa: B023, E731
            p, q = ([math.exp(-r) * r**k / math.factorial(k) for k in range(11)] for r in (rate(h, a), rate(a, h)))
            cells = {s: sum(p[i] * q[j] for i in range(11) for j in range(11) if (i > j) - (i < j) == s) for s in (1, 0, -1)}
            losses.append(-math.log(cells[(gh > ga) - (gh < ga)] / sum(cells.values())))
        assert got[alpha].matches == 18 and got[alpha].half_life == half_life
        assert got[alpha].log_loss == pytest.approx(sum(losses) / 18, abs=1e-7)


def test_nulls_new_sides_and_errors(spark):
    rows = played(5, 40, 4)
    m = frame(spark, rows)
    odd = m.limit(4).withColumn("home", F.lit(None).cast("long")).unionByName(m.limit(3).withColumn("home_goals", F.lit(None).cast("int")))
    fit = M.poisson_glm(m.unionByName(odd), 0.1, 21.0)
    assert G.score_equations(fit, m.unionByName(odd)).agg(F.max(F.abs("residual"))).first()[0] < 1e-8
    new = m.limit(1).withColumn("away", F.lit(99).cast("long"))
    r = M.glm_rates(fit, new).first()
    side = fit.effects.where((F.col("block") == "attack") & (F.col("side") == str(r.home))).first().effect
    assert r.lambda_home == pytest.approx(math.exp(fit.models[0].intercept + fit.models[0].slope * r.knockout + side))
    with pytest.raises(ValueError):
        M.poisson_glm(m.limit(0), 0.1, None)
    with pytest.raises(ValueError):
        M.poisson_glm(m, 0.0, None)


def test_the_fit_keeps_the_mean_rate(spark, tables):
    m = forecast_q.flagged(tables)
    r = M.glm_rates(M.poisson_glm(m, 0.1, None), m).agg(F.avg("lambda_home"), F.avg("lambda_away"), F.avg("home_goals"), F.avg("away_goals")).first()
    assert r[0] + r[1] == pytest.approx(r[2] + r[3], rel=1e-6)
