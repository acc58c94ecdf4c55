"""Models and statistics of the research layer against plain versions."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebook.operators import regimes as rg


def plain_regimes(x, half, k, rounds):
    """The same fit and filter by one loop over all rows."""
    mu, sd = x[:half].mean(axis=0), x[:half].std(axis=0)
    x = (x - mu) / np.where(sd > 0, sd, 1)
    z = x[:half]
    order = np.sort(z[:, 0])
    part = sum((z[:, 0] > order[math.ceil(i / k * half) - 1]).astype(int) for i in range(1, k))
    mean, var = (np.stack([f(z[part == s]) for s in range(k)]) for f in (lambda v: v.mean(axis=0), lambda v: v.var(axis=0) + 1e-6))
    start, move = np.full(k, 1 / k), np.full((k, k), 0.1 / k) + 0.9 * np.eye(k)

    def forward(z):
        e = rg.log_density(z, mean, var)
        a = [np.log(start) + e[0]]
        for t in range(1, len(z)):
            a.append(np.logaddexp.reduce(a[-1][:, None] + np.log(move), axis=0) + e[t])
        return e, np.stack(a)

    for _ in range(rounds):
        e, a = forward(z)
        b = np.zeros_like(a)
        for t in range(len(z) - 2, -1, -1):
            b[t] = np.logaddexp.reduce(np.log(move) + (e[t + 1] + b[t + 1])[None], axis=1)
        p = np.exp(a + b - np.logaddexp.reduce(a[-1]))
        pair = np.exp(a[:-1, :, None] + np.log(move)[None] + (e[1:] + b[1:])[:, None] - np.logaddexp.reduce(a[-1])).sum(axis=0) + 1e-6
        w = p.sum(axis=0)[:, None] + 1e-9
        mean, start, move = p.T @ z / w, p[0] + 1e-9, pair / pair.sum(axis=1, keepdims=True)
        var = np.maximum(p.T @ (z * z) / w - mean * mean, 0) + 1e-6
        by = np.argsort(mean[:, 0], kind="stable")
        start, move, mean, var = start[by] / start.sum(), move[np.ix_(by, by)], mean[by], var[by]
    return forward(x)[1].argmax(axis=1)


def test_regimes_by_blocks(spark, monkeypatch):
    """Any size of blocks and of scans gives the states of one loop over the series; short series and nulls are left out."""
    r = np.random.default_rng(5)
    series = {}
    for g, n in (("a", 240), ("b", 151)):
        state = np.cumsum(r.random(n) < 0.05) % 4
        series[g] = np.stack([r.normal(state * 2.0, 0.6), r.normal(-(state % 2), 0.5)], axis=1)
    rows = [(g, t, *map(float, v)) for g, x in series.items() for t, v in enumerate(x)]
    rows += [("a", 1000, None, 1.0), (None, 3, 1.0, 1.0), *[("short", t, float(t), 0.0) for t in range(9)]]
    df = spark.createDataFrame(rows, "g string, t long, u double, v double").repartition(4)
    want = sorted((g, t, s) for g, x in series.items() for t, s in enumerate(plain_regimes(x, (len(x) - 1) // 2 + 1, 4, 2)))
    for block, fan in ((1000, 1024), (7, 3)):
        monkeypatch.setattr(rg, "FAN", fan)
        got = sorted((x.g, x.t, x.state) for x in rg.regimes(df, "g", "t", ["u", "v"], 4, rounds=2, block=block).collect())
        assert got == want
    assert len({s for *_, s in want}) == 4 and rg.regimes(df.limit(0), "g", "t", ["u", "v"], rounds=1).count() == 0


@pytest.mark.parametrize("partitions", [1, 16])
def test_ranks_in_ranges(spark, partitions):
    """Average ranks inside keys and without any, with ties, nulls, NaN-free; the same for any number of ranges."""
    from tidebook.operators.ranking import average_ranks, in_ranges, running

    r = random.Random(3)
    rows = [(k, r.choice(["a", "b", None]), r.choice([None, *map(float, range(7)), r.random()])) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, g string, v double").repartition(5)
    for by in ([], ["g"]):
        got = {x.id: x.rk for x in average_ranks(df, "v", "rk", by, partitions).collect()}
        pdf = pd.DataFrame(rows, columns=["id", "g", "v"])
        pdf["g"], pdf["v"] = pdf["g"].fillna("none") if by else "all", pdf["v"].fillna(-1.0)  # nulls come first and are ties
        want = pdf.groupby("g")["v"].rank(method="average")
        assert len(got) == 300 and all(abs(got[k] - want[k]) < 1e-9 for k in range(300))
    ranged = in_ranges(df, ["g"], ["id"], partitions)
    back = running(ranged, ["g"], ["id"], "low", F.coalesce("v", F.lit(9.0)), F.min, F.least, backwards=True)
    low = {x.id: x.low for x in back.collect()}
    for k, g, _ in rows:
        assert low[k] == min(9.0 if v is None else v for j, h, v in rows if h == g and j >= k)


@pytest.mark.parametrize("partitions", [1, 16])
def test_step_up_in_ranges(spark, partitions):
    from tidebook.operators.ranking import step_up

    r = random.Random(8)
    p = [(k, round(r.random() ** 3, 3)) for k in range(200)]
    got = {x.id: x for x in step_up(spark.createDataFrame(p, "id long, p double").repartition(3), 0.1, partitions).collect()}
    order, least, least_y = sorted(p, key=lambda x: (x[1], x[0])), 1.0, 1.0
    h = sum(1 / i for i in range(1, 201))
    for rank in range(200, 0, -1):
        k, v = order[rank - 1]
        least, least_y = min(least, v * 200 / rank), min(least_y, v * 200 / rank * h)
        x = got[k]
        assert x["rank"] == rank and abs(x.q_bh - least) < 1e-9 and abs(x.q_bhy - least_y) < 1e-9 and (x.bh, x.bhy) == (least <= 0.1, least_y <= 0.1)
    assert step_up(spark.createDataFrame([], "id long, p double"), 0.1, partitions).count() == 0


def test_no_window_without_a_key(spark):
    """The plan of ranks and adjusted p-values has no window over all rows."""
    from tidebook.operators.ranking import average_ranks, step_up

    df = spark.createDataFrame([(1, 0.2), (2, 0.1)], "id long, p double")
    for out in (average_ranks(df, "p", "rk"), step_up(df)):
        plan = out._jdf.queryExecution().toString()
        assert "Window" in plan and all("_part" in line for line in plan.splitlines() if "Window " in line and "windowspec" in line.lower())


def test_permutations_by_arithmetic(spark):
    """Every key gives a permutation, different keys different ones, and places are spread evenly."""
    from tidebook.operators.resampling import shuffled

    sizes = [1, 2, 3, 7, 12, 60, 61, 200]
    df = spark.createDataFrame([(n, k, x) for n in sizes for k in range(30) for x in range(n)], "n long, k long, x long")
    found = {}
    for r in df.withColumn("at", shuffled("x", "n", "k")).collect():
        found.setdefault((r.n, r.k), {})[r.x] = r.at
    assert all(sorted(p.values()) == list(range(n)) for (n, _), p in found.items())
    assert len({tuple(sorted(found[60, k].items())) for k in range(30)}) == 30
    assert abs(np.mean([found[200, k][0] for k in range(30)]) - 99.5) < 40


def test_effects_equal_dummies(spark):
    """Slopes and clustered errors with two sets of effects against least squares with dummies; a null level counts as one."""
    from tidebook.operators.effects import clustered_fit, demeaned

    r = np.random.default_rng(4)
    n = 400
    a, b, g = r.integers(0, 5, n), r.integers(0, 7, n), r.integers(0, 20, n)
    x1, x2 = r.normal(size=n) + a, r.normal(size=n) - b + 0.3 * a
    y = 2 * x1 - 0.7 * x2 + 3.0 * a - b * b + r.normal(size=n)
    names = [None, "p", "q", "r", "s"]
    df = spark.createDataFrame([(names[i], int(j), int(k), float(u), float(v), float(w)) for i, j, k, u, v, w in zip(a, b, g, x1, x2, y)] + [("p", 1, 1, None, 0.0, 0.0)],
                               "a string, b int, g int, x1 double, x2 double, y double").repartition(4)
    d = np.column_stack([np.eye(5)[a], np.eye(7)[b][:, 1:]])
    z = np.column_stack([x1, x2, y])
    z = z - d @ np.linalg.lstsq(d, z, rcond=None)[0]
    x, e = z[:, :2], z[:, 2]
    beta = np.linalg.solve(x.T @ x, x.T @ e)
    scores = np.stack([(x[g == k] * (e - x @ beta)[g == k, None]).sum(axis=0) for k in range(20)])
    inverse = np.linalg.inv(x.T @ x)
    se = np.sqrt(np.diag(inverse @ scores.T @ scores @ inverse))
    got = {t.term: t for t in clustered_fit(df, "y", ["x1", "x2"], ["a", "b"], "g").collect()}
    assert np.allclose([got[t].beta for t in ("x1", "x2")], beta, rtol=1e-7) and np.allclose([got[t].se for t in ("x1", "x2")], se, rtol=1e-6) and got["x1"].n == n and got["x1"].clusters == 20
    with pytest.raises(RuntimeError, match="still move"):
        demeaned(df, ["a", "b"], ["x1"], tolerance=0.0, max_rounds=2)
    with pytest.raises(ValueError, match="not independent"):
        clustered_fit(df.withColumn("same", F.col("b") * 1.0), "y", ["same"], ["a", "b"], "g")


def test_least_squares_from_sums(spark):
    """Coefficients from sums of products against least squares over rows; a column that others explain gets 0."""
    from tidebook.operators.linear import products, solve

    r = np.random.default_rng(6)
    rows, want = [], {}
    for w in (0, 1):
        x = np.column_stack([np.ones(50), r.normal(size=(50, 3))])
        x = np.column_stack([x, x[:, 1] * 2.0])
        y = x[:, :4] @ r.normal(size=4) + r.normal(size=50)
        rows += [(w, [float(v) for v in z]) for z in np.column_stack([x, y])]
        want[w] = np.linalg.lstsq(x[:, :4], y, rcond=None)[0]
    sums = products(spark.createDataFrame(rows, "win long, z array<double>").repartition(3), ["win"], "z")
    got = {(x.win, x.model): x.betas for x in solve(sums, "win", 6, {"all": ([0, 1, 2, 3, 4], [5]), "one": ([0], [5])}).collect()}
    for w in (0, 1):
        assert np.allclose(got[w, "all"][:4], want[w]) and got[w, "all"][4] == 0
        assert np.allclose(got[w, "one"], np.mean([z[5] for v, z in rows if v == w]))


def test_one_set_of_draws(spark):
    """Sums of a replicate agree with means from the same seed, and -1 has the rows themselves."""
    from tidebook.operators.resampling import replicate_means, replicate_sums

    df = spark.createDataFrame([(k % 2, k, k * 0.5, None if k % 7 == 0 else 1.0) for k in range(60)], "g long, i long, x double, y double").repartition(4)
    got = {(x.by, x.j): x for x in replicate_sums(df, "g", "i", {"x": F.col("x"), "xx": F.col("x") * F.col("x"), "y": F.col("y")}, draws=30, seed=5).collect()}
    means = {(x.by, x.j): x.m for x in replicate_means(df, "g", "i", "x", draws=30, seed=5).collect()}
    assert all(math.isclose(got[k].x / got[k].copies, m) for k, m in means.items()) and len(means) == 60
    assert got[0, -1].copies == 30 and got[0, -1].x == sum(k * 0.5 for k in range(0, 60, 2)) and got[0, -1].y == 30 - 5


def test_component_fitted_in_sample(spark):
    """Scores by a component of the fitting rows only, against an eigenvector in numpy; a constant column counts nothing."""
    from tidebook.operators.models import integrated

    r = np.random.default_rng(9)
    common = r.normal(size=80)
    x = np.column_stack([common * k + r.normal(size=80) * 0.5 for k in (1.0, 0.8, -0.6)] + [np.full(80, 3.0)])
    x[40:] *= 5  # later rows must not matter
    df = spark.createDataFrame([("a", t, [float(v) for v in row]) for t, row in enumerate(x)], "g string, t long, v array<double>").repartition(3)
    got = [s.score for s in sorted(integrated(df, "g", "v", 4, F.col("t") < 40, ["t"]).collect(), key=lambda s: s.t)]
    z = (x[:, :3] - x[:40, :3].mean(axis=0)) / x[:40, :3].std(axis=0)
    top = np.linalg.eigh(np.corrcoef(x[:40, :3].T))[1][:, -1]
    assert np.allclose(got, z @ (top * np.sign(top[0])))


@pytest.mark.parametrize("partitions", [1, 9])
def test_quantiles_in_ranges(spark, partitions):
    from tidebook.operators.ranking import quantiles

    r = random.Random(2)
    rows = [(r.choice(["a", None]), r.choice([None, 1.0, 2.0, r.random()])) for _ in range(200)] + [("one", 5.0), ("none", None)]
    got = {x.g: x for x in quantiles(spark.createDataFrame(rows, "g string, v double").repartition(4), ["g"], "v", {"low": 0.05, "mid": 0.5, "top": 1.0}, partitions).collect()}
    for g in {g for g, v in rows if v is not None}:
        v = [v for h, v in rows if h == g and v is not None]
        assert got[g].n == len(v) and np.allclose([got[g].low, got[g].mid, got[g].top], np.quantile(v, [0.05, 0.5, 1.0]))
    assert "none" not in got
