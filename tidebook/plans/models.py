"""Queries with fitted models and regressions on flow and fills."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.operators.effects import clustered_fit
from tidebook.operators.models import first_component, integrated, logistic_curve
from tidebook.operators.regimes import regimes
from tidebook.operators.timeline import last_known, trailing
from tidebook.sources import market as mk
from tidebook.sources.storage import stored

from .fills import MARK, TOUCHED, marked
from .inference import brier_by_rank
from .registry import query, sql
from .tape import OFI, bar_features, ofi_bins

HOUR = mk.HOUR_NS


def level_flow(spark, sf_dir) -> DataFrame:
    """flow: each level's own order flow against the snapshot before; a level that appears counts whole, one that goes is taken off."""
    s = mk.snapshots(spark, sf_dir).withColumn("book", F.struct("bids", "asks"))
    s = last_known(s, ["sym"], ["ts_ns", "seq"], {"book": "was"}, before=True).where("was is not null")

    def side(now: str, was: str, sign: int):
        def step(a, b):
            better = (a["px"] - b["px"]) * sign
            return F.when(b.isNull(), a["sz"]).when(a.isNull(), -b["sz"]).when(better > 0, a["sz"]).when(better == 0, a["sz"] - b["sz"]).otherwise(-b["sz"])

        return F.zip_with(F.col(now), F.col(was), step)

    return s.withColumn("flow", F.zip_with(side("bids", "was.bids", 1), side("asks", "was.asks", -1), lambda b, a: b - a))


def _term(px, pp, sz, pz, up):
    return f"(CASE WHEN {px} {up} {pp} THEN {sz} WHEN {px} = {pp} THEN {sz} - {pz} ELSE -{pz} END)"


@query(sql("SELECT sym, bin, " + ", ".join(f"sum(f{l}) AS ofi{l}" for l in range(10)) + " FROM (SELECT sym, ts_ns // 3600000000000 AS bin, " + ", ".join(
    f"{_term(f'bids[{l}].px', f'pb[{l}].px', f'bids[{l}].sz', f'pb[{l}].sz', '>')} - {_term(f'asks[{l}].px', f'pa[{l}].px', f'asks[{l}].sz', f'pa[{l}].sz', '<')} AS f{l - 1}" for l in range(1, 11)) + """
  FROM (SELECT *, lag(bids) OVER w AS pb, lag(asks) OVER w AS pa FROM snap WINDOW w AS (PARTITION BY sym ORDER BY ts_ns, seq)) WHERE pb IS NOT NULL) GROUP BY ALL"""))
def cont_ofi_bins(spark, sf_dir):
    """Ten levels' flows by hour."""
    f = level_flow(spark, sf_dir).withColumn("bin", F.expr(f"ts_ns div {HOUR}"))
    return f.groupBy("sym", "bin").agg(*[F.sum(F.get("flow", F.lit(l))).alias(f"ofi{l}") for l in range(10)])


@query(sql("""SELECT sym, count(*) AS n, round(regr_slope(dm, ofi), 8) AS slope, round(regr_intercept(dm, ofi), 8) AS intercept, round(regr_r2(dm, ofi), 8) AS r2 FROM (
  SELECT sym, ofi, lead(mid_close) OVER (PARTITION BY sym ORDER BY bin) - mid_close AS dm FROM
  (SELECT sym, ts_ns // 3600000000000 AS bin, sum(ofi) AS ofi, arg_max(mid, (ts_ns, seq)) AS mid_close FROM ofi GROUP BY ALL)) WHERE dm IS NOT NULL GROUP BY sym""", OFI))
def ofi_regression(spark, sf_dir):
    """The next hour's move on this hour's flow."""
    w = Window.partitionBy("sym").orderBy("bin")  # one row an hour
    b = ofi_bins(spark, sf_dir).withColumn("dm", F.lead("mid_close").over(w) - F.col("mid_close")).where("dm is not null")
    return b.groupBy("sym").agg(F.count("*").alias("n"), F.round(F.regr_slope("dm", "ofi"), 8).alias("slope"), F.round(F.regr_intercept("dm", "ofi"), 8).alias("intercept"),
                                F.round(F.regr_r2("dm", "ofi"), 8).alias("r2"))


def clustered_slope(df: DataFrame, cluster: str, x: str, y: str) -> DataFrame:
    """n, clusters, slope through the means, and its standard error with errors free to move together inside clusters."""
    m = df.agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.count("*").alias("n"), F.regr_slope(y, x).alias("b"), (F.var_pop(x) * F.count("*")).alias("sxx"))
    d = df.join(F.broadcast(m), how="cross")  # one row
    e = (F.col(y) - F.col("my")) - F.col("b") * (F.col(x) - F.col("mx"))
    per = d.groupBy(cluster, "n", "b", "sxx").agg(F.sum((F.col(x) - F.col("mx")) * e).alias("s"))
    return per.groupBy("n", "b", "sxx").agg(F.count("*").alias("clusters"), F.sum(F.col("s") * F.col("s")).alias("v")).select(
        "n", "clusters", F.round("b", 8).alias("slope"), F.round(F.sqrt("v") / F.col("sxx"), 8).alias("se"))


@query("""WITH d AS (SELECT l_suppkey % 50 AS g, l_quantity::DOUBLE AS x, l_extendedprice::DOUBLE / 1000 AS y FROM lineitem),
m AS (SELECT avg(x) AS mx, avg(y) AS my, count(*) AS n, regr_slope(y, x) AS b, var_pop(x) * count(*) AS sxx FROM d)
SELECT n, count(*) AS clusters, round(b, 8) AS slope, round(sqrt(sum(s * s)) / sxx, 8) AS se FROM (SELECT g, n, b, sxx, sum((x - mx) * (y - my - b * (x - mx))) AS s FROM d, m GROUP BY ALL) GROUP BY n, b, sxx""")
def clustered_ols(spark, sf_dir):
    """Price on quantity, errors grouped by supplier."""
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return clustered_slope(l.select(F.expr("l_suppkey % 50").alias("g"), F.col("l_quantity").cast("double").alias("x"), (F.col("l_extendedprice").cast("double") / 1000).alias("y")), "g", "x", "y")


#: Terms of the regression with two sets of effects: dummies of flags and line numbers (the first number is the base), then the two slopes, then the response.
_DUMMIES = [f"(l_returnflag = '{f}')::INT::DOUBLE" for f in "ANR"] + [f"(l_linenumber = {k})::INT::DOUBLE" for k in range(2, 8)]
_TERMS = [*_DUMMIES, "l_quantity::DOUBLE", "l_discount::DOUBLE", "l_extendedprice::DOUBLE / 1000"]
_D = len(_DUMMIES)
TWO_WAY = f"""WITH d AS MATERIALIZED (SELECT l_suppkey % 50 AS g, list_value({', '.join(_TERMS)}) AS z FROM lineitem),
s0 AS MATERIALIZED (SELECT i, j, sum(z[i + 1] * z[j + 1]) AS v FROM d, (SELECT unnest(range({_D + 3})) AS i), (SELECT unnest(range({_D + 3})) AS j) GROUP BY ALL),
""" + ",\n".join(f"""s{n + 1} AS MATERIALIZED (SELECT a.i, a.j, CASE WHEN NOT p.v > 1e-9 * greatest(o.v, 1e-300) THEN a.v WHEN a.i = {n} AND a.j = {n} THEN 1 / p.v WHEN a.i = {n} THEN a.v / p.v WHEN a.j = {n} THEN -a.v / p.v ELSE a.v - c.v * (r.v / p.v) END AS v
  FROM s{n} a JOIN s{n} p ON p.i = {n} AND p.j = {n} JOIN s{n} r ON r.i = {n} AND r.j = a.j JOIN s{n} c ON c.i = a.i AND c.j = {n} JOIN s0 o ON o.i = {n} AND o.j = {n})""" for n in range(_D)) + f""",
held AS ({' UNION ALL '.join(f'SELECT {n} AS i, p.v > 1e-9 * greatest(o.v, 1e-300) AS used FROM s{n} p JOIN s0 o USING (i, j) WHERE i = {n} AND j = {n}' for n in range(_D))}),
off AS (SELECT {', '.join(f'list(CASE WHEN used THEN v ELSE 0 END ORDER BY i) FILTER (j = {_D + t}) AS c{t}' for t in range(3))} FROM s{_D} JOIN held USING (i) WHERE j >= {_D}),
w AS MATERIALIZED (SELECT g, {', '.join(f'z[{_D + t + 1}] - list_dot_product(z[1:{_D}], c{t}) AS {c}' for t, c in enumerate(('x1', 'x2', 'y')))} FROM d, off),
m AS (SELECT count(*) AS n, sum(x1 * x1) AS a, sum(x1 * x2) AS b, sum(x2 * x2) AS c, sum(x1 * y) AS u, sum(x2 * y) AS v FROM w),
f AS (SELECT *, a * c - b * b AS det, (u * c - v * b) / (a * c - b * b) AS b1, (v * a - u * b) / (a * c - b * b) AS b2 FROM m),
k AS (SELECT count(*) AS clusters, sum(p * p) AS pp, sum(p * q) AS pq, sum(q * q) AS qq FROM (SELECT g, sum(x1 * (y - b1 * x1 - b2 * x2)) AS p, sum(x2 * (y - b1 * x1 - b2 * x2)) AS q FROM w, f GROUP BY g))
SELECT 'quantity' AS term, round(b1, 7) AS beta, round(sqrt(c * c * pp - 2 * b * c * pq + b * b * qq) / det, 7) AS se, n::BIGINT AS n, clusters FROM f, k
UNION ALL SELECT 'discount', round(b2, 7), round(sqrt(b * b * pp - 2 * a * b * pq + a * a * qq) / det, 7), n::BIGINT, clusters FROM f, k"""


@query(TWO_WAY)
def fe_two_way(spark, sf_dir):
    """Price on quantity and discount with effects of return flags and of line numbers at once, errors grouped by supplier."""
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.expr("l_suppkey % 50").alias("g"), "l_returnflag", "l_linenumber", F.col("l_quantity").cast("double").alias("quantity"), F.col("l_discount").cast("double").alias("discount"), (F.col("l_extendedprice").cast("double") / 1000).alias("y"))
    return clustered_fit(l, "y", ["quantity", "discount"], ["l_returnflag", "l_linenumber"], "g").withColumns({c: F.round(c, 7) for c in ("beta", "se")})


@query(sql("""SELECT s.seq, s.sym, (SELECT round(greatest(0, -avg(side * (m1h - price) / m0)) * CASE WHEN count(m1h) > 0 THEN 1e4 END, 6) FROM marks m WHERE m.sym = s.sym AND m.ts_ns + 3600000000000 <= s.ts_ns AND m.ts_ns > s.ts_ns - 2 * 3600000000000) AS toxicity FROM snap s""", *TOUCHED, MARK))
def markout_toxicity(spark, sf_dir):
    """Mean loss after an hour of the fills whose hour ended within the last one; nothing later is used."""
    m = marked(spark, sf_dir).select("sym", "seq", (F.col("ts_ns") + HOUR).alias("ts_ns"), F.col("markout_1h").alias("v"), F.lit(1).alias("kind"))
    both = mk.snapshots(spark, sf_dir).select("sym", "seq", "ts_ns", F.lit(0).alias("kind")).unionByName(m, allowMissingColumns=True)
    t = trailing(both, ["sym"], HOUR, {"s": F.col("v"), "n": F.when(F.col("v").isNotNull(), 1)}).where("kind = 0")
    return t.select("seq", "sym", F.round(F.greatest(F.lit(0.0), -F.try_divide("s", "n")) * F.when(F.col("n") > 0, 1e4), 6).alias("toxicity"))


@query()
def hmm_filter(spark, sf_dir):
    """Four volatility regimes of four-hour bars, filtered forward."""
    return regimes(bar_features(spark, sf_dir), "sym", "bar", ["vol", "drift"], 4)


@query()
def ofi_pca(spark, sf_dir):
    """The common part of ten levels' hourly flows."""
    b = cont_ofi_bins(spark, sf_dir).select("sym", F.array(*[f"ofi{l}" for l in range(10)]).alias("v"))
    return first_component(b, "sym", "v", 10)


@query()
def ofi_integrated(spark, sf_dir):
    """Ten levels' hourly flows as one number, by a component fitted on the first half of the hours only."""
    b = cont_ofi_bins(spark, sf_dir).select("sym", "bin", F.array(*[F.col(f"ofi{l}").cast("double") for l in range(10)]).alias("v"))
    b = stored(b, "level-flows")
    half = b.groupBy("sym").agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"))
    return integrated(b.join(half, "sym"), "sym", "v", 10, F.expr("2 * (bin - lo) <= hi - lo"), ["bin"])


@query()
def calibration_by_rank(spark, sf_dir):
    """Fill probability by depth rank against a logistic curve in the rank."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        x, n, p = (pdf[c].to_numpy(dtype=np.float64) for c in ("rank", "n", "p"))
        a, b = logistic_curve(x, p * n, n)
        return pdf.assign(fitted=1 / (1 + np.exp(-(a + b * x))))[["rank", "n", "p", "fitted"]]

    # Five rows, one for each rank, whatever the input's size.
    return brier_by_rank(spark, sf_dir).withColumn("every", F.lit(1)).groupBy("every").applyInPandas(run, "rank int, n long, p double, fitted double")
