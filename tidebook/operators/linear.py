"""Least squares from sums of products that Spark adds up: rows never meet in one place, only matrices do."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A column whose part beyond the ones before it is less than this of it is left out, with a coefficient of 0.
SMALL = 1e-9


def products(rows: DataFrame, by: list[str], values: str) -> DataFrame:
    """(by, i, j, v): for i <= j the sums of products of an array's elements; nulls count as 0."""
    pair = rows.select(*by, values, F.posexplode(values).alias("i", "_a")).select(*by, "i", "_a", F.posexplode(values).alias("j", "_b")).where("i <= j")
    return pair.groupBy(*by, "i", "j").agg(F.sum(F.coalesce(F.col("_a") * F.col("_b"), F.lit(0.0))).alias("v"))


def swept(m: np.ndarray, of: list[int]) -> np.ndarray:
    """Coefficients (rows: of) of each column of m on those columns, from stacks of matrices of sums of products."""
    m, held, whole = m.copy(), np.zeros((len(m), len(of)), bool), m[:, of, of]
    for n, k in enumerate(of):
        p = m[:, k, k]
        use = p > SMALL * np.maximum(whole[:, n], 1e-300)
        held[:, n] = use
        d = np.where(use, p, 1.0)
        row, col = m[:, k, :] / d[:, None], m[:, :, k].copy()
        new = m - col[:, :, None] * row[:, None, :]
        new[:, k, :] = row
        new[:, :, k] = -col / d[:, None]
        new[:, k, k] = 1 / d
        m = np.where(use[:, None, None], new, m)
    return np.where(held[:, :, None], m[:, of, :], 0.0)


def solve(sums: DataFrame, by: str, size: int, models: dict[str, tuple[list[int], list[int]]]) -> DataFrame:
    """(by, model, y, betas): least squares of each model's responses on its regressors, by position in the arrays that ``products`` summed.

    by is a whole number; sums has few rows for each, size * size at most.
    """
    cells = F.struct("i", "j", "v")
    per = sums.groupBy(by).agg(F.collect_list(cells).alias("cells"))  # one matrix

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            m = np.zeros((len(pdf), size, size))
            for k, found in enumerate(pdf["cells"]):
                i, j, v = (np.array([c[x] for c in found]) for x in "ijv")
                m[k, i, j] = m[k, j, i] = v
            for name, (of, on) in models.items():
                beta = swept(m, of)
                for y in on:
                    yield pd.DataFrame({"by": pdf["by"], "model": name, "y": y, "betas": list(beta[:, :, y])})

    return per.withColumnRenamed(by, "by").mapInPandas(run, "by long, model string, y int, betas array<double>").withColumnRenamed("by", by)
