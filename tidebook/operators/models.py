"""Small models: a first component, a logistic curve."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.functions.stats import corr


def first_component(rows: DataFrame, by: str, values: str, n: int) -> DataFrame:
    """(by, share, loadings): first principal component of standardised arrays of n values.

    Spark adds up the moments; only an n by n matrix a group is decomposed. The first loading is not negative.
    """
    v = F.posexplode(values).alias("i", "x")
    long = rows.select(by, values, v)
    pair = long.select(by, "i", "x", F.posexplode(values).alias("j", "y"))
    moments = pair.groupBy(by, "i", "j").agg(corr("x", "y").alias("r"))
    kind = dict(rows.dtypes)[by]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((n, n))
        m[pdf["i"], pdf["j"]] = pdf["r"].fillna(0.0)
        m[np.arange(n), np.arange(n)] = 1.0
        value, vector = np.linalg.eigh((m + m.T) / 2)
        top = vector[:, -1] * (1 if vector[0, -1] >= 0 else -1)
        return pd.DataFrame({by: [key[0]], "share": [value[-1] / n], "loadings": [top]})

    return moments.groupBy(by).applyInPandas(run, f"{by} {kind}, share double, loadings array<double>")


def integrated(rows: DataFrame, by: str, values: str, n: int, fit: Column, keep: list[str]) -> DataFrame:
    """(by, keep, score): arrays of n values standardised and projected on their first component, both fitted on the rows where fit holds.

    A value that does not vary there counts 0. The component's first loading is not negative.
    """
    training = rows.where(fit)
    scale = training.select(by, F.posexplode(values).alias("i", "x")).groupBy(by, "i").agg(F.avg("x").alias("mu"), F.stddev_pop("x").alias("sd"))
    scale = scale.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "mu", "sd"))), lambda s: F.struct(s["mu"].alias("mu"), s["sd"].alias("sd"))).alias("scale"))  # n of them
    model = first_component(training, by, values, n).select(by, "loadings").join(scale, by)
    parts = F.transform(F.arrays_zip(F.col(values).alias("x"), F.col("scale").alias("s"), F.col("loadings").alias("w")),
                        lambda p: F.when(p["s"]["sd"] > 0, (p["x"] - p["s"]["mu"]) / p["s"]["sd"] * p["w"]).otherwise(F.lit(0.0)))
    return rows.join(model, by).select(by, *keep, F.aggregate(parts, F.lit(0.0), lambda a, x: a + x).alias("score"))


def logistic_curve(x: np.ndarray, hits: np.ndarray, n: np.ndarray, rounds: int = 25) -> tuple[float, float]:
    """Newton steps for the probability of hits out of n as a logistic function of x."""
    beta, design = np.zeros(2), np.column_stack([np.ones(len(x)), x])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-design @ beta))
        w = n * p * (1 - p)
        beta = beta + np.linalg.solve(design.T @ (design * w[:, None]) + 1e-9 * np.eye(2), design.T @ (hits - n * p))
    return float(beta[0]), float(beta[1])
