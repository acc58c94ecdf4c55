"""Hidden Markov regimes of long series, fitted and filtered over blocks of time.

A row of a series is a K by K matrix in the semiring of log-sum-exp and plus: the chance to go from one state to another and to see
the row there. Matrices are associative, so a block of rows is one matrix, and what comes into a block is a scan over the matrices of those
before it. The scan goes up and down in levels of ``FAN`` blocks, so no task ever holds more than a block's rows or FAN
matrices, however long the series. A round of expectation-maximisation is such a scan in both directions and sums of each block, which Spark adds up.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.sources.storage import stored

#: Blocks that are scanned together.
FAN = 1024
_VARIANCE_FLOOR = 1e-6


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of stacks of matrices of logarithms."""
    return np.logaddexp.reduce(a[..., :, :, None] + b[..., None, :, :], axis=-2)


def product(steps: np.ndarray) -> np.ndarray:
    """Product of a stack, in order."""
    while len(steps) > 1:
        even = len(steps) // 2 * 2
        steps = np.concatenate([times(steps[:even:2], steps[1:even:2]), steps[even:]])
    return steps[0]


def log_density(x: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    d = x[:, None, :] - mean[None]
    return -0.5 * (np.log(2 * np.pi * var)[None] + d * d / var[None]).sum(axis=2)


class Model:
    """Logarithms of the start and the moves, means and variances; one row of a table of models."""

    def __init__(self, row, k: int) -> None:
        self.start, self.move = np.log(np.asarray(row["start"])), np.log(np.asarray(row["move"]).reshape(k, k))
        self.mean, self.var = (np.asarray(row[c]).reshape(k, -1) for c in ("mean", "var"))

    def seen(self, x: np.ndarray) -> np.ndarray:
        return log_density(x, self.mean, self.var)

    def matrix(self, x: np.ndarray, first: bool) -> np.ndarray:
        """A block's matrix; the series' first row is not moved to."""
        e = self.seen(x)
        steps = self.move[None] + e[:, None, :]
        if first:
            steps[0] = np.where(np.eye(len(self.start), dtype=bool), e[0][:, None], -np.inf)
        return product(steps)

    def forward(self, x: np.ndarray, first: bool, into: np.ndarray) -> np.ndarray:
        e = self.seen(x)
        a = np.empty_like(e)
        last = into
        for t in range(len(x)):
            last = (last if first and t == 0 else np.logaddexp.reduce(last[:, None] + self.move, axis=0)) + e[t]
            a[t] = last
        return a

    def sums(self, x: np.ndarray, first: bool, into: np.ndarray, after: np.ndarray) -> np.ndarray:
        """A block's expected weights, sums, squares, moves and start, end to end."""
        k, e, a = len(self.start), self.seen(x), self.forward(x, first, into)
        b = np.empty_like(e)
        b[-1] = after
        for t in range(len(x) - 2, -1, -1):
            b[t] = np.logaddexp.reduce(self.move + (e[t + 1] + b[t + 1])[None], axis=1)
        z = np.logaddexp.reduce(a[-1] + after)
        p = np.exp(a + b - z)
        before = a[:-1] if first else np.concatenate([into[None], a[:-1]])
        to = (e + b)[1:] if first else e + b
        pair = np.exp(before[:, :, None] + self.move[None] + to[:, None, :] - z).sum(axis=0)
        return np.concatenate([p.sum(axis=0), (p.T @ x).ravel(), (p.T @ (x * x)).ravel(), pair.ravel(), p[0] if first else np.zeros(k)])


def maximised(total: np.ndarray, k: int, features: int) -> dict:
    """The model that a round's sums give; states in order of their first mean."""
    w, rest = total[:k] + 1e-9, total[k:]
    mean = rest[: k * features].reshape(k, -1) / w[:, None]
    square = rest[k * features : 2 * k * features].reshape(k, -1) / w[:, None]
    pair = rest[2 * k * features : 2 * k * features + k * k].reshape(k, k) + 1e-6
    start = rest[-k:] + 1e-9
    order = np.argsort(mean[:, 0], kind="stable")
    move = pair / pair.sum(axis=1, keepdims=True)
    return {"start": (start / start.sum())[order], "move": move[np.ix_(order, order)].ravel(), "mean": mean[order].ravel(), "var": (np.maximum(square - mean * mean, 0) + _VARIANCE_FLOOR)[order].ravel()}


_MODEL = "start array<double>, move array<double>, mean array<double>, var array<double>"


def _first_models(rows: DataFrame, k: int, features: int) -> DataFrame:
    """(g, model) from slices of each series by quantiles of its first feature; x is standardised."""
    cuts = rows.groupBy("g").agg(F.percentile_approx(F.col("x")[0], [i / k for i in range(1, k)], 10_000).alias("cuts"))
    part = F.aggregate("cuts", F.lit(0), lambda n, c: n + F.when(F.col("x")[0] > c, 1).otherwise(0))
    x = [F.col("x")[f] for f in range(features)]
    per = rows.join(cuts, "g").groupBy("g", part.alias("s")).agg(F.array(*[F.avg(c) for c in x]).alias("m"), F.array(*[F.var_pop(c) for c in x]).alias("v"))
    near = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.when(i == j, 0.9 + 0.1 / k).otherwise(0.1 / k))))

    def pick(what: str, miss: float, least: float):
        def of(i):
            found = F.filter("slices", lambda s: s["s"] == i)
            return F.when(F.size(found) > 0, F.transform(F.element_at(found, 1)[what], lambda v: v + least)).otherwise(F.array_repeat(F.lit(miss), features))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), of))

    slices = per.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("s", "m", "v"))).alias("slices"))  # k of them
    return slices.select("g", F.array_repeat(F.lit(1.0 / k), k).alias("start"), near.alias("move"), pick("m", 0.0, 0.0).alias("mean"), pick("v", 1.0, _VARIANCE_FLOOR).alias("var"))


def _scan(matrices: DataFrame, models: DataFrame, k: int, kind: str) -> DataFrame:
    """(g, b, into, after): logarithms of what comes into each block, and of what its last row can still expect, from (g, b, m)."""
    levels, fan = [matrices], FAN
    while True:
        top = levels[-1]
        if top.groupBy("g").count().where("count > 1").isEmpty():
            break

        def joined(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("b")
            m = product(np.stack([np.asarray(v).reshape(k, k) for v in pdf["m"]]))
            return pd.DataFrame({"g": pdf["g"].iloc[:1], "b": pdf["b"].iloc[:1] // fan, "m": [m.ravel()]})

        levels.append(stored(top.groupBy("g", F.expr(f"b div {fan}")).applyInPandas(joined, f"g {kind}, b long, m array<double>"), "regime-level"))
    ends = models.select("g", F.transform("start", lambda v: F.log(v)).alias("into"), F.array_repeat(F.lit(0.0), k).alias("after")).join(levels[-1].select("g", "b"), "g")
    for level in levels[-2::-1]:
        def spread(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("b", ignore_index=True)
            m = [np.asarray(v).reshape(k, k) for v in pdf["m"]]
            into, after = [np.asarray(pdf["into"][0])], [np.asarray(pdf["after"][0])]
            for x in m[:-1]:
                into.append(np.logaddexp.reduce(into[-1][:, None] + x, axis=0))
            for x in m[:0:-1]:
                after.append(np.logaddexp.reduce(x + after[-1][None], axis=1))
            return pdf[["g", "b"]].assign(into=into, after=after[::-1])

        above = ends.select("g", F.col("b").alias("up"), "into", "after")
        both = level.withColumn("up", F.expr(f"b div {fan}")).join(above, ["g", "up"])
        ends = both.groupBy("g", "up").applyInPandas(spread, f"g {kind}, b long, into array<double>, after array<double>")
    return ends


def regimes(bars: DataFrame, by: str, order: str, features: list[str], k: int = 4, rounds: int = 6, block: int = 4096) -> DataFrame:
    """(by, order, state): each row's most probable regime from the rows up to it, 0 to k - 1 by the first feature's mean.

    Models are fitted on the first half of each series' range of ``order`` (whole numbers, no two rows of a series alike) by ``rounds`` of
    expectation-maximisation with diagonal Gaussians. Blocks are ranges of order of that length; no result depends on it. Rows with a null feature are left
    out, series without a name or of fewer than 4 k rows in their first half as well.
    """
    kind, n = dict(bars.dtypes)[by], len(features)
    rows = bars.dropna(subset=[*features, order]).select(F.col(by).alias("g"), F.col(order).cast("long").alias("t"), *[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)])
    span = rows.groupBy("g").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    rows = rows.join(span, "g").withColumn("fit", F.expr("2 * (t - t0) <= t1 - t0"))
    scale = rows.where("fit").groupBy("g").agg(F.count("*").alias("rows"), *[f(f"f{i}").alias(f"{s}{i}") for i in range(n) for s, f in (("mu", F.avg), ("sd", F.stddev_pop))]).where(f"rows >= {4 * k}")
    x = F.array(*[F.when(F.col(f"sd{i}") > 0, (F.col(f"f{i}") - F.col(f"mu{i}")) / F.col(f"sd{i}")).otherwise(0.0) for i in range(n)])
    rows = stored(rows.join(scale, "g").select("g", "t", F.expr(f"(t - t0) div {block}").alias("b"), (F.col("t") == F.col("t0")).alias("starts"), "fit", x.alias("x")), "regime-rows")
    training = rows.where("fit")
    models = stored(_first_models(training, k, n), "regime-models")

    def blocks(df: DataFrame, extra: DataFrame):
        return df.join(extra, [c for c in ("g", "b") if c in extra.columns]).groupBy("g", "b")

    def matrix(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        m = Model(pdf.iloc[0], k).matrix(np.stack(pdf["x"]), bool(pdf["starts"].iloc[0]))
        return pd.DataFrame({"g": pdf["g"].iloc[:1], "b": pdf["b"].iloc[:1], "m": [m.ravel()]})

    def matrices(df: DataFrame) -> DataFrame:
        return stored(blocks(df, models).applyInPandas(matrix, f"g {kind}, b long, m array<double>"), "regime-blocks")

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        row = pdf.iloc[0]
        v = Model(row, k).sums(np.stack(pdf["x"]), bool(row["starts"]), np.asarray(row["into"]), np.asarray(row["after"]))
        return pd.DataFrame({"g": pdf["g"].iloc[:1], "v": [v]})

    def maximise(pdfs):
        for pdf in pdfs:
            made = [maximised(np.asarray(v), k, n) for v in pdf["v"]]
            yield pd.DataFrame({"g": pdf["g"]} | {c: [m[c] for m in made] for c in ("start", "move", "mean", "var")})

    size = 2 * k + 2 * k * n + k * k
    for _ in range(rounds):
        ends = _scan(matrices(training), models, k, kind)
        each = blocks(training.join(models, "g"), ends).applyInPandas(sums, f"g {kind}, v array<double>")
        total = each.groupBy("g").agg(F.array(*[F.sum(F.col("v")[i]) for i in range(size)]).alias("v"))
        models = stored(total.mapInPandas(maximise, f"g {kind}, {_MODEL}"), "regime-models")

    def states(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        row = pdf.iloc[0]
        a = Model(row, k).forward(np.stack(pdf["x"]), bool(row["starts"]), np.asarray(row["into"]))
        return pd.DataFrame({"g": pdf["g"], "t": pdf["t"], "state": a.argmax(axis=1)})

    ends = _scan(matrices(rows), models, k, kind)
    out = blocks(rows.join(models, "g"), ends).applyInPandas(states, f"g {kind}, t long, state long")
    return out.select(F.col("g").alias(by), F.col("t").cast(dict(bars.dtypes)[order]).alias(order), "state")
