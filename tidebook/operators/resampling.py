"""Seeded resampling: random numbers come from counters, so every replicate can be drawn on its own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The splitmix64 step and its two multipliers.
STEP, MUL1, MUL2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Replicates that one task draws at a time.
CHUNK = 100


def splitmix(counter: np.ndarray, seed: int) -> np.ndarray:
    """The splitmix64 output for each position of the stream that starts at seed."""
    z = np.uint64(seed) + (counter.astype(np.uint64) + np.uint64(1)) * np.uint64(STEP)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(MUL1)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(MUL2)
    return z ^ (z >> np.uint64(31))


def _replicates(df: DataFrame, by: str, order: str, value: str, draws: int, one, schema: str) -> DataFrame:
    """Sums over a group's rows of each replicate. Rows are spread over tasks: row i's part in replicate j depends on (i, j) alone.

    i is the row's order, an integer that tells a group's rows apart.
    """
    def partial(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for pdf in pdfs:
            for key, g in pdf.groupby("by"):
                i, x = g["i"].to_numpy(), g["x"].to_numpy(dtype=np.float64)
                acc = total.setdefault(key, np.zeros((draws, 2)))
                for lo in range(0, draws, CHUNK):
                    j = np.arange(lo, min(draws, lo + CHUNK))
                    acc[j] += one(i, x, j)
        for key, acc in total.items():
            yield pd.DataFrame({"by": key, "j": np.arange(draws), "s": acc[:, 0], "w": acc[:, 1]})

    rows = df.where(F.col(value).isNotNull()).select(F.col(by).alias("by"), F.col(order).cast("long").alias("i"), F.col(value).alias("x"))
    sums = rows.mapInPandas(partial, schema)
    return sums.groupBy("by", "j").agg(F.sum("s").alias("s"), F.sum("w").alias("w"))


def sign_flip_null(df: DataFrame, by: str, order: str, value: str, draws: int, seed: int) -> DataFrame:
    """by, n, mean, p: the share of random sign choices whose mean is at least the observed one, the observed one included."""
    def flip(i: np.ndarray, x: np.ndarray, j: np.ndarray) -> np.ndarray:
        up = splitmix(i.astype(np.uint64)[None, :] + j.astype(np.uint64)[:, None] * np.uint64(MUL1), seed) >> np.uint64(63)
        return np.stack([(np.where(up == 1, 1.0, -1.0) * x).sum(axis=1), np.full(len(j), len(x))], axis=1)

    kind = dict(df.dtypes)[by]
    null = _replicates(df, by, order, value, draws, flip, f"by {kind}, j int, s double, w double")
    seen = df.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("b")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    both = null.join(seen, F.col("by") == F.col("b"))
    hits = F.count(F.when(F.col("s") / F.col("w") >= F.col("mean") - 1e-12, 1))
    return both.groupBy(F.col("by").alias(by), "n", "mean").agg(((hits + 1) / (draws + 1)).alias("p"))


#: Shares of a Poisson(1) variable: at most 0, at most 1, and so on.
POISSON = np.cumsum(np.exp(-1.0) / np.array([1, 1, 2, 6, 24, 120, 720, 5040], dtype=np.float64))


def replicate_sums(df: DataFrame, by: str, order: str, values: dict[str, Column], draws: int, seed: int) -> DataFrame:
    """(by, j, copies, each name): sums of several values in each replicate, from the same draws; each row's number of copies in a replicate is Poisson(1).

    One pass: whatever moments a statistic needs, it is made of these sums afterwards. Null values count as 0. j = -1 has the sums of the rows themselves.
    """
    names = list(values)

    def partial(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for pdf in pdfs:
            for key, g in pdf.groupby("by"):
                i, x = g["i"].to_numpy(), np.column_stack([np.ones(len(g)), g[[f"v{k}" for k in range(len(names))]].to_numpy(dtype=np.float64)])
                acc = total.setdefault(key, np.zeros((draws + 1, x.shape[1])))
                acc[0] += x.sum(axis=0)
                for lo in range(0, draws, CHUNK):
                    j = np.arange(lo, min(draws, lo + CHUNK))
                    acc[j + 1] += _copies(i, j, seed) @ x
        for key, acc in total.items():
            yield pd.DataFrame({"by": key, "j": np.arange(-1, draws)} | {f"v{k}": acc[:, k] for k in range(acc.shape[1])})

    rows = df.select(F.col(by).alias("by"), F.col(order).cast("long").alias("i"), *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"v{k}") for k, c in enumerate(values.values())])
    sums = rows.mapInPandas(partial, f"by {dict(df.dtypes)[by]}, j int, " + ", ".join(f"v{k} double" for k in range(len(names) + 1)))
    return sums.groupBy("by", "j").agg(*[F.sum(f"v{k}").alias(n) for k, n in enumerate(["copies", *names])])


def _copies(i: np.ndarray, j: np.ndarray, seed: int) -> np.ndarray:
    """How often rows i are in replicates j: a matrix of replicates by rows."""
    u = splitmix(i.astype(np.uint64)[None, :] + j.astype(np.uint64)[:, None] * np.uint64(MUL2), seed) >> np.uint64(11)
    return np.searchsorted(POISSON, u.astype(np.float64) / 2.0**53).astype(np.float64)


def replicate_means(df: DataFrame, by: str, order: str, value: str, draws: int, seed: int) -> DataFrame:
    """by, j, m: a group's mean in each replicate; each row's number of copies in a replicate is Poisson(1)."""
    def weigh(i: np.ndarray, x: np.ndarray, j: np.ndarray) -> np.ndarray:
        w = _copies(i, j, seed)
        return np.stack([(w * x).sum(axis=1), w.sum(axis=1)], axis=1)

    kind = dict(df.dtypes)[by]
    sums = _replicates(df, by, order, value, draws, weigh, f"by {kind}, j int, s double, w double").where("w > 0")
    return sums.select("by", "j", (F.col("s") / F.col("w")).alias("m"))


def bootstrap_means(df: DataFrame, by: str, order: str, value: str, draws: int, seed: int, alpha: float) -> DataFrame:
    """by, lo, mean, hi: percentile interval of the mean."""
    means = replicate_means(df, by, order, value, draws, seed)
    ci = means.groupBy("by").agg(F.expr(f"percentile(m, {alpha / 2})").alias("lo"), F.expr(f"percentile(m, {1 - alpha / 2})").alias("hi"))
    seen = df.groupBy(F.col(by).alias("b")).agg(F.avg(value).alias("mean"))
    return ci.join(seen, F.col("by") == F.col("b")).select(F.col("by").alias(by), "lo", "mean", "hi")


#: The prime modulus 2**31 - 1, and what a permutation's rounds multiply and add.
PRIME, OF_VALUE, OF_KEY, PLUS = 2_147_483_647, 1_103_515_245, 1_812_433_253, 12_345
ROUNDS = 6


def shuffle_step(x: str, rows: str, columns: str, key: str, div: str = "div") -> str:
    """SQL for one pass of a keyed permutation of 0 to rows * columns - 1, a Feistel network on x's row and column."""
    left, right = f"({x} {div} {columns})", f"({x} % {columns})"
    for k in range(ROUNDS):
        mix = f"(({right if k % 2 == 0 else left} * {OF_VALUE} + ({key} * {ROUNDS} + {k}) * {OF_KEY} + {PLUS}) % {PRIME}) {div} 128"
        if k % 2 == 0:
            left = f"(({left} + ({mix})) % {rows})"
        else:
            right = f"(({right} + ({mix})) % {columns})"
    return f"({left} * {columns} + {right})"


def shuffled(x: str, n: str, key: str) -> Column:
    """x's place (long) in a permutation of 0 to n - 1 that key names: arithmetic on x alone, no sort. x, n, key: SQL of whole numbers; n under 2**31.

    A network permutes a few numbers more, fewer than the root of n; a place beyond n is passed through it again.
    """
    rows = f"cast(ceil(sqrt({n})) as bigint)"
    columns = f"(({n} + {rows} - 1) div {rows})"
    step = shuffle_step("x", "s.r", "s.c", "s.k")
    start = f"named_struct('x', cast({x} as bigint), 'r', {rows}, 'c', {columns}, 'k', cast({key} as bigint), 'n', cast({n} as bigint))"
    once = f"named_struct('x', {step.replace('(x ', '(s.x ')}, 'r', s.r, 'c', s.c, 'k', s.k, 'n', s.n)"
    return F.expr(f"aggregate(sequence(1, {rows} * {columns} - {n} + 1), {start}, (s, i) -> if(i > 1 and s.x < s.n, s, {once}), s -> s.x)")
