"""Least squares with several sets of fixed effects, and errors that go together inside clusters.

Effects are taken out in cells, the combinations of all keys that occur, with counts and means: rows are read once for the cells and once
to take off what a cell's mean has lost. A round takes each key's means out of the cells in turn.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.sources.storage import stored

from .linear import products


def demeaned(df: DataFrame, keys: list[str], columns: list[str], tolerance: float = 1e-10, max_rounds: int = 200) -> DataFrame:
    """df with columns less the effects of all keys: what is left has mean 0 in each level of each key, within tolerance of a column's deviation.

    Nulls in columns leave the row out; a null key is a level like others. Raises if means are not that small after max_rounds.
    """
    df = df.dropna(subset=columns)
    names = {c: f"_m_{c}" for c in columns}
    scale = df.agg(*[F.stddev_pop(c).alias(c) for c in columns]).first()
    start = stored(df.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.avg(c).alias(n) for c, n in names.items()]), "effect-cells")
    cells = start
    for _ in range(max_rounds):
        sizes = []
        for k in keys:
            mean = cells.groupBy(F.col(k).alias("_level")).agg(*[(F.sum(F.col(n) * F.col("_n")) / F.sum("_n")).alias(f"_d{n}") for n in names.values()])
            cells = cells.join(mean, F.col(k).eqNullSafe(F.col("_level"))).withColumns({n: F.col(n) - F.col(f"_d{n}") for n in names.values()})
            size = f"_size_{len(sizes)}"
            cells = cells.withColumn(size, F.greatest(F.lit(0.0), *[F.abs(F.col(f"_d{n}")) / F.lit(float(scale[c]) or 1.0) for c, n in names.items()])).drop("_level", *[f"_d{n}" for n in names.values()])
            sizes.append(size)
        # The last key's means are 0 now; the round was needed for what the others moved.
        cells = stored(cells, "effect-cells")
        moved = cells.agg(F.max(F.greatest(F.lit(0.0), *sizes))).first()[0]
        cells = cells.drop(*sizes)
        if moved is None or moved <= tolerance or len(keys) == 1:
            break
    else:
        raise RuntimeError(f"demeaned: effects of {keys} still move by {moved:.3g} deviations after {max_rounds} rounds")
    off = start.join(cells.drop("_n").withColumnsRenamed({n: f"_r{n}" for n in names.values()} | {k: f"_k_{k}" for k in keys}),
                     reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]))
    off = off.select(*[f"_k_{k}" for k in keys], *[(F.col(n) - F.col(f"_r{n}")).alias(f"_off{n}") for n in names.values()])
    out = df.join(off, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]))
    return out.withColumns({c: F.col(c) - F.col(f"_off{n}") for c, n in names.items()}).drop(*[f"_k_{k}" for k in keys], *[f"_off{n}" for n in names.values()])


def clustered_fit(df: DataFrame, y: str, xs: list[str], effects: list[str], cluster: str) -> DataFrame:
    """(term, beta, se, n, clusters): least squares of y on xs with the effects taken out, errors summed inside clusters before they are squared.

    Only matrices of as many rows and columns as there are terms reach the driver. Terms that the effects or the terms before explain have no defined slope; they raise.
    """
    rows = stored(demeaned(df.where(F.col(cluster).isNotNull()), effects, [*xs, y]).select(cluster, *xs, y), "within-rows")
    k = len(xs)
    m = np.zeros((k + 1, k + 1))
    for r in products(rows.select(F.array(*[F.col(c).cast("double") for c in (*xs, y)]).alias("z")), [], "z").collect():
        m[r.i, r.j] = m[r.j, r.i] = r.v
    a, b = m[:k, :k], m[:k, k]
    raw = df.agg(F.count("*"), *[F.var_pop(x) for x in xs]).first()
    gone = [x for x, left, v in zip(xs, a.diagonal(), raw[1:]) if left <= 1e-12 * raw[0] * (v or 1.0)]
    if gone or not k or np.linalg.cond(a / np.sqrt(np.outer(a.diagonal(), a.diagonal()) + 1e-300)) > 1e12:
        raise ValueError(f"clustered_fit: {xs} are not independent once effects are taken out")
    beta = np.linalg.solve(a, b)
    e = F.col(y) - reduce(lambda s, t: s + t, [F.col(x) * F.lit(float(v)) for x, v in zip(xs, beta)])
    per = rows.groupBy(cluster).agg(F.count("*").alias("_n"), F.array(*[F.sum(F.col(x) * e) for x in xs]).alias("z"))
    per = stored(per, "cluster-scores")
    meat = np.zeros((k, k))
    for r in products(per.select("z"), [], "z").collect():
        meat[r.i, r.j] = meat[r.j, r.i] = r.v
    n, clusters = per.agg(F.sum("_n"), F.count("*")).first()
    inverse = np.linalg.inv(a)
    se = np.sqrt(np.diag(inverse @ meat @ inverse))
    return df.sparkSession.createDataFrame([(x, float(v), float(s), n, clusters) for x, v, s in zip(xs, beta, se)], "term string, beta double, se double, n long, clusters long")
