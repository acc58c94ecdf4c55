"""Queries that test and compare: ranks, multiple testing, overfitting, slopes, seeded resampling."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions import quotes as q
from tidebook.functions.stats import corr
from tidebook.operators import fills as sim
from tidebook.operators.ranking import average_ranks, step_up
from tidebook.operators.resampling import MUL1, MUL2, POISSON, STEP, bootstrap_means, replicate_means, sign_flip_null
from tidebook.sources import market as mk

from .fills import LEDGER, MARK, TOUCHED, costed, marked
from .registry import query, sql

DAY = 86_400_000_000_000


@query(sql("""SELECT n_bid, n_ask, round(u / (n_bid * n_ask), 9) AS share, abs(u / (n_bid * n_ask) - 0.5) >= 0.05 AS separated FROM (
  SELECT count(*) FILTER (side = 1) AS n_bid, count(*) FILTER (side = -1) AS n_ask, sum(rk) FILTER (side = 1) - count(*) FILTER (side = 1) * (count(*) FILTER (side = 1) + 1) / 2 AS u FROM (
    SELECT side, rank() OVER (ORDER BY size) + (count(*) OVER (PARTITION BY size) - 1) / 2 AS rk FROM fills))""", *TOUCHED))
def rank_separation(spark, sf_dir):
    """How often a bid fill is larger than an ask fill (ties half)."""
    r = average_ranks(marked(spark, sf_dir).select("side", "size"), "size", "rk")
    n = r.agg(F.count(F.when(F.col("side") == 1, 1)).alias("n_bid"), F.count(F.when(F.col("side") == -1, 1)).alias("n_ask"), F.sum(F.when(F.col("side") == 1, F.col("rk"))).alias("s"))
    share = F.try_divide(F.col("s") - F.col("n_bid") * (F.col("n_bid") + 1) / 2, F.col("n_bid") * F.col("n_ask"))
    return n.select("n_bid", "n_ask", F.round(share, 9).alias("share"), (F.abs(share - 0.5) >= 0.05).alias("separated"))


@query(sql("""SELECT count(*) AS n, round(corr(ra, rb), 9) AS rho FROM (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS ra,
  rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2 AS rb FROM lineitem WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL)"""))
def spearman(spark, sf_dir):
    """Rank correlation of quantity and discount."""
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_quantity", "l_discount").dropna()
    x = average_ranks(average_ranks(x, "l_quantity", "ra"), "l_discount", "rb")
    return x.agg(F.count("*").alias("n"), F.round(corr("ra", "rb"), 9).alias("rho"))


P_VALUES = """pv AS (SELECT o_custkey % 97 AS id, round(exp(-abs(avg(o_totalprice) - any_value(g)) / (any_value(s) / sqrt(count(*)))), 9) AS p FROM orders,
  (SELECT avg(o_totalprice) AS g, stddev_samp(o_totalprice) AS s FROM orders) GROUP BY 1)"""


@query(f"""WITH {P_VALUES}, r AS (SELECT *, row_number() OVER (ORDER BY p, id) AS rank, count(*) OVER () AS m FROM pv),
q AS (SELECT *, least(1, min(p * m / rank) OVER (ORDER BY p DESC, id DESC)) AS q, least(1, min(p * m / rank * h) OVER (ORDER BY p DESC, id DESC)) AS qy FROM r, (SELECT sum(1e0 / i) AS h FROM (SELECT unnest(range(1, (SELECT count(*) FROM pv) + 1)) AS i)))
SELECT id, p, rank, round(q, 9) AS q_bh, round(qy, 9) AS q_bhy, q <= 0.1 AS bh, qy <= 0.1 AS bhy FROM q""")
def bh_bhy(spark, sf_dir):
    """Step-up control over groups of customers whose mean order differs from the overall mean."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.expr("o_custkey % 97").alias("id"), F.col("o_totalprice").cast("double").alias("x"))
    every = o.agg(F.avg("x").alias("g"), F.stddev_samp("x").alias("s"))
    per = o.groupBy("id").agg(F.avg("x").alias("a"), F.count("*").alias("n"))  # 97 rows
    p = per.join(F.broadcast(every), how="cross").select("id", F.round(F.exp(-F.abs(F.col("a") - F.col("g")) / (F.col("s") / F.sqrt("n"))), 9).alias("p"))
    return step_up(p)


@query(sql("""SELECT count(*) AS n, coalesce(round(sum(CASE WHEN x > 0 THEN x ELSE 0 END) / nullif(-sum(CASE WHEN x < 0 THEN x ELSE 0 END), 0), 7), 'inf'::DOUBLE) AS rrr,
  coalesce(round(sum(CASE WHEN x > 0 AND (k > 1 OR m = 1) THEN x ELSE 0 END) / nullif(-sum(CASE WHEN x < 0 AND (k > 1 OR m = 1) THEN x ELSE 0 END), 0), 7), 'inf'::DOUBLE) AS rrr_without_best, round(min(x), 7) AS worst,
  round(sum((x - mu) ** 3) / count(*) / (sum((x - mu) ** 2) / count(*)) ** 1.5, 7) AS skew FROM (
  SELECT x, row_number() OVER (ORDER BY x DESC, d) AS k, avg(x) OVER () AS mu, count(*) OVER () AS m FROM (SELECT ts_ns // 86400000000000 AS d, round(sum(edge + carry - fee - funding), 6) AS x FROM costed GROUP BY 1))""", *TOUCHED, LEDGER))
def tail_rrr(spark, sf_dir):
    """Gains over losses of daily profit, with and without the best day; infinite without a losing day."""
    d = costed(spark, sf_dir).groupBy(F.expr(f"ts_ns div {DAY}").alias("d")).agg(F.round(F.sum("net"), 6).alias("x"))
    gain, loss = F.sum(F.when(F.col("x") > 0, F.col("x")).otherwise(0.0)), -F.sum(F.when(F.col("x") < 0, F.col("x")).otherwise(0.0))
    # The best day is a loss only if all are, and it is the only one's own best.
    several, endless = F.count("*") > 1, F.lit(float("inf"))
    top, least = (F.when(several, F.greatest(F.lit(0.0), F.max("x"))).otherwise(F.lit(0.0)), F.when(several, F.least(F.lit(0.0), F.max("x"))).otherwise(F.lit(0.0)))
    return d.agg(F.count("*").alias("n"), F.coalesce(F.round(F.try_divide(gain, loss), 7), endless).alias("rrr"),
                 F.coalesce(F.round(F.try_divide(gain - top, loss + least), 7), endless).alias("rrr_without_best"),
                 F.round(F.min("x"), 7).alias("worst"), F.round(F.skewness("x"), 7).alias("skew"))


DAILY = """daily AS (SELECT g % 8 AS strategy, d, round(avg(x), 6) AS x FROM (SELECT user_id % 8 AS g, ts_ns // 86400000000000 AS d, side * (m1h - price) / m0 * 1e4 AS x FROM marks) GROUP BY 1, 2)"""


def daily(spark, sf_dir) -> DataFrame:
    """Mean markout in bp by strategy (users modulo 8) and day."""
    m = marked(spark, sf_dir).select(F.expr("user_id % 8").alias("strategy"), F.expr(f"ts_ns div {DAY}").alias("d"), (F.col("markout_1h") * 1e4).alias("x"))
    return m.groupBy("strategy", "d").agg(F.round(F.avg("x"), 6).alias("x"))


SPLITS = [c for c in combinations(range(6), 3)]


@query(sql("""SELECT count(*) AS n_splits, round(avg(CASE WHEN rk <= n / 2e0 THEN 1e0 ELSE 0e0 END), 9) AS pbo FROM (
  SELECT split, strategy, arg_is, rank() OVER (PARTITION BY split ORDER BY oos) AS rk, count(*) OVER (PARTITION BY split) AS n FROM (
    SELECT *, first_value(strategy) OVER (PARTITION BY split ORDER BY ins DESC, strategy) AS arg_is FROM (
      SELECT split, strategy, round(sum(CASE WHEN list_contains(blocks, b) THEN x ELSE 0 END), 6) AS ins, round(sum(CASE WHEN list_contains(blocks, b) THEN 0 ELSE x END), 6) AS oos
      FROM (SELECT strategy, d % 6 AS b, x FROM daily), (SELECT unnest(range(""" + str(len(SPLITS)) + """)) AS split, unnest(""" + str([list(c) for c in SPLITS]) + """) AS blocks) GROUP BY 1, 2))) WHERE strategy = arg_is""", *TOUCHED, MARK, DAILY))
def pbo_cscv(spark, sf_dir):
    """How often the strategy that is best on half of the blocks ranks in the lower half on the other."""
    per = daily(spark, sf_dir).groupBy("strategy", F.expr("d % 6").alias("b")).agg(F.sum("x").alias("x"))
    splits = F.array(*[F.struct(F.lit(k).alias("split"), F.array(*[F.lit(b) for b in c]).alias("blocks")) for k, c in enumerate(SPLITS)])
    per = per.select("strategy", "b", "x", F.explode(splits).alias("s")).select("strategy", "x", "s.split", F.array_contains("s.blocks", F.col("b").cast("int")).alias("inside"))
    sums = per.groupBy("split", "strategy").agg(F.round(F.sum(F.when(F.col("inside"), F.col("x")).otherwise(0.0)), 6).alias("ins"),
                                                F.round(F.sum(F.when(F.col("inside"), 0.0).otherwise(F.col("x"))), 6).alias("oos"))
    w = Window.partitionBy("split")
    sums = sums.withColumns({"best": F.row_number().over(w.orderBy(F.desc("ins"), "strategy")), "rk": F.rank().over(w.orderBy("oos")), "n": F.count("*").over(w)})
    return sums.where("best = 1").agg(F.count("*").alias("n_splits"), F.round(F.avg(F.when(F.col("rk") <= F.col("n") / 2, 1.0).otherwise(0.0)), 9).alias("pbo"))


@query(sql("""SELECT strategy, n, round(mu / sd, 7) AS sharpe FROM (SELECT strategy, count(*) AS n, avg(x) AS mu, stddev_samp(x) AS sd FROM daily GROUP BY 1)
  WHERE sd > 0""", *TOUCHED, MARK, DAILY))
def daily_sharpe(spark, sf_dir):
    per = daily(spark, sf_dir).groupBy("strategy").agg(F.count("*").alias("n"), F.avg("x").alias("mu"), F.stddev_samp("x").alias("sd"))
    return per.where("sd > 0").select("strategy", "n", F.round(F.col("mu") / F.col("sd"), 7).alias("sharpe"))


Q_LAGS = 10


@query(sql("""SELECT strategy, n, round(mu / sd, 7) AS sharpe, round(mu / sqrt((g0 + 2 * (""" + " + ".join(f"{1 - k / (Q_LAGS + 1)} * coalesce(g{k}, 0)" for k in range(1, Q_LAGS + 1)) + """)) / n), 6) AS t_hac FROM (
  SELECT strategy, count(*) AS n, avg(x) AS mu, stddev_samp(x) AS sd, var_pop(x) AS g0, """ + ", ".join(f"covar_samp(x, l{k}) AS g{k}" for k in range(1, Q_LAGS + 1)) + """ FROM (
    SELECT *, """ + ", ".join(f"lag(x, {k}) OVER w AS l{k}" for k in range(1, Q_LAGS + 1)) + """ FROM daily WINDOW w AS (PARTITION BY strategy ORDER BY d)) GROUP BY 1)
  WHERE n >= 5 AND sd > 0 AND g0 + 2 * (""" + " + ".join(f"{1 - k / (Q_LAGS + 1)} * coalesce(g{k}, 0)" for k in range(1, Q_LAGS + 1)) + ") > 0", *TOUCHED, MARK, DAILY))
def lo_hac(spark, sf_dir):
    """Sharpe ratio of daily markout, and t-value of its mean with autocovariances up to ten lags."""
    w = Window.partitionBy("strategy").orderBy("d")  # one row a day
    x = daily(spark, sf_dir).withColumns({f"l{k}": F.lag("x", k).over(w) for k in range(1, Q_LAGS + 1)})
    per = x.groupBy("strategy").agg(F.count("*").alias("n"), F.avg("x").alias("mu"), F.stddev_samp("x").alias("sd"), F.var_pop("x").alias("g0"), *[F.covar_samp("x", f"l{k}").alias(f"g{k}") for k in range(1, Q_LAGS + 1)])
    long = F.col("g0") + 2 * sum((F.coalesce(f"g{k}", F.lit(0.0)) * (1 - k / (Q_LAGS + 1)) for k in range(1, Q_LAGS + 1)), F.lit(0.0))
    return per.withColumn("v", long).where("n >= 5 and sd > 0 and v > 0").select("strategy", "n", F.round(F.col("mu") / F.col("sd"), 7).alias("sharpe"), F.round(F.col("mu") / F.sqrt(F.col("v") / F.col("n")), 6).alias("t_hac"))


def within_slope(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """Sums by group of squared and crossed deviations from the group's own means: n, sxx, sxy."""
    n = F.count("*")
    sxx = F.sum(F.col(x) * F.col(x)) - F.sum(x) * F.sum(x) / n
    sxy = F.sum(F.col(x) * F.col(y)) - F.sum(x) * F.sum(y) / n
    return df.groupBy(by).agg(n.alias("n"), sxx.alias("sxx"), sxy.alias("sxy"))


PAIR = "SELECT o_orderpriority AS root, (o_custkey % 1000)::DOUBLE AS x, o_totalprice::DOUBLE / 1000 AS y FROM orders"
SLOPES = f"per AS (SELECT root, count(*) AS n, sum(x * x) - sum(x) * sum(x) / count(*) AS sxx, sum(x * y) - sum(x) * sum(y) / count(*) AS sxy FROM ({PAIR}) GROUP BY root)"


def pairs(spark, sf_dir) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderpriority").alias("root"), F.expr("o_custkey % 1000").cast("double").alias("x"), (F.col("o_totalprice").cast("double") / 1000).alias("y"))


@query(f"WITH {SLOPES} SELECT sum(n)::BIGINT AS n, round(sum(sxy) / sum(sxx), 8) AS slope FROM per")
def fe_slope(spark, sf_dir):
    """Slope within roots, from each root's sufficient statistics."""
    return within_slope(pairs(spark, sf_dir), "root", "x", "y").agg(F.sum("n").alias("n"), F.round(F.sum("sxy") / F.sum("sxx"), 8).alias("slope"))


@query(f"WITH {SLOPES} SELECT root, n, round((t.sxy - per.sxy) / (t.sxx - per.sxx), 8) AS slope_without FROM per, (SELECT sum(sxx) AS sxx, sum(sxy) AS sxy FROM per) t")
def leave_one_root_out(spark, sf_dir):
    """The slope without each root: totals less its own."""
    per = within_slope(pairs(spark, sf_dir), "root", "x", "y")
    w = Window.partitionBy()  # one row a root
    return per.select("root", "n", F.round((F.sum("sxy").over(w) - F.col("sxy")) / (F.sum("sxx").over(w) - F.col("sxx")), 8).alias("slope_without"))


@query(sql("""SELECT rank, n, round(nf / n, 9) AS p, round(nf / n * (1 - nf / n), 9) AS brier FROM (
  SELECT r AS rank, count(*) AS n, count(f.interval)::DOUBLE AS nf FROM (SELECT s.seq, r FROM snap s, (SELECT unnest(range(1, 6))::INT AS r)) a LEFT JOIN (SELECT DISTINCT interval, idx FROM fills) f ON f.interval = a.seq AND f.idx = a.r GROUP BY r)""",
           "quotes AS (SELECT sym, seq, ts_ns, 1 AS side, bids[r].px AS px, 3e0 AS size, r AS idx FROM snap, (SELECT unnest(range(1, 6))::INT AS r))", *TOUCHED[1:]))
def brier_by_rank(spark, sf_dir):
    """Share of bid orders at each depth rank that get a fill, and the Brier score of that share."""
    snaps = mk.snapshots(spark, sf_dir)
    orders = F.array(*[q.at_level(1, F.lit(3.0), r - 1, r) for r in range(1, 6)])
    hit = sim.fills(mk.trades(spark, sf_dir), sim.resting(snaps, orders)).select("interval", F.col("idx").alias("rank")).distinct()
    per = snaps.agg(F.count("*").alias("n")).withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(5))))
    per = per.join(hit.groupBy("rank").agg(F.count("*").alias("nf")), "rank", "left").withColumn("p", F.coalesce("nf", F.lit(0)) / F.col("n"))
    return per.select("rank", "n", F.round("p", 9).alias("p"), F.round(F.col("p") * (1 - F.col("p")), 9).alias("brier"))


def draws_sql(step: int, count: int = 1000, seed: int = 2026, table: str = "daily", also: str = "") -> str:
    """CTEs that end in z(strategy, x, j, z): the counter's random number of each row and replicate, from the table's strategy, d, x and what is named also."""
    wrap = "18446744073709551616::UHUGEINT"
    return f"""c0 AS (SELECT strategy, {also}x, j, (d::UHUGEINT + j::UHUGEINT * {step}::UHUGEINT) % {wrap} AS c FROM {table}, (SELECT unnest(range({count})) AS j) WHERE x IS NOT NULL),
z0 AS (SELECT *, (({seed}::UHUGEINT + (c + 1::UHUGEINT) * {STEP}::UHUGEINT) % {wrap})::UBIGINT AS a FROM c0),
z1 AS (SELECT *, ((xor(a, a >> 30)::UHUGEINT * {MUL1}::UHUGEINT) % {wrap})::UBIGINT AS b FROM z0),
z2 AS (SELECT *, ((xor(b, b >> 27)::UHUGEINT * {MUL2}::UHUGEINT) % {wrap})::UBIGINT AS e FROM z1),
z AS (SELECT strategy, {also}x, j, xor(e, e >> 31) AS z FROM z2)"""


@query(sql("""SELECT strategy, n, round(mean, 9) AS mean, (count(*) FILTER (s / n >= mean - 1e-12) + 1) / 1001e0 AS p FROM
  (SELECT strategy, j, sum(CASE WHEN z >> 63 = 1 THEN x ELSE -x END) AS s FROM z GROUP BY ALL) JOIN (SELECT strategy, count(*) AS n, avg(x) AS mean FROM daily GROUP BY 1) USING (strategy)
  GROUP BY ALL""", *TOUCHED, MARK, DAILY, draws_sql(MUL1)))
def perm_null(spark, sf_dir):
    """For each strategy: mean daily markout, and how often a random choice of signs does as well."""
    return sign_flip_null(daily(spark, sf_dir), "strategy", "d", "x", draws=1000, seed=2026).withColumn("mean", F.round("mean", 9))


#: Copies of a row in a replicate: the number of these shares of a Poisson variable below the random number.
COPIES = "+".join(f"(z >> 11 > {c!r}::DOUBLE * 9007199254740992e0)::INT" for c in POISSON.tolist())
INTERVAL = """SELECT {keys}round(quantile_cont(m, 0.025), 9) AS lo, round(any_value(mean), 9) AS mean, round(quantile_cont(m, 0.975), 9) AS hi FROM
  (SELECT {keys}j, sum(w * x) / sum(w) AS m FROM (SELECT *, {copies} AS w FROM z) GROUP BY ALL HAVING sum(w) > 0) {seen}{group}"""


@query(sql(INTERVAL.format(keys="strategy, ", copies=COPIES, seen="JOIN (SELECT strategy, avg(x) AS mean FROM daily GROUP BY 1) USING (strategy)", group=" GROUP BY strategy"),
           *TOUCHED, MARK, DAILY, draws_sql(MUL2)))
def bootstrap_ci(spark, sf_dir):
    """Percentile intervals of the mean daily markout, days drawn again with replacement."""
    ci = bootstrap_means(daily(spark, sf_dir), "strategy", "d", "x", draws=1000, seed=2026, alpha=0.05)
    return ci.select("strategy", *[F.round(c, 9).alias(c) for c in ("lo", "mean", "hi")])


PAIRED = """pairs AS (SELECT a.strategy // 2 AS strategy, a.d, b.x - a.x AS x FROM daily a JOIN daily b ON a.d = b.d AND b.strategy = a.strategy + 1 WHERE a.strategy % 2 = 0)"""


@query(sql("""SELECT pair, n_pairs, round(any_value(mean), 9) AS delta, round(quantile_cont(m, 0.025), 9) AS lo, round(quantile_cont(m, 0.975), 9) AS hi,
  round(least(1e0, 2 * least(avg((m >= 0)::INT), avg((m <= 0)::INT))), 9) AS p FROM
  (SELECT strategy AS pair, j, sum(w * x) / sum(w) AS m FROM (SELECT *, """ + COPIES + """ AS w FROM z) GROUP BY ALL HAVING sum(w) > 0)
  JOIN (SELECT strategy AS pair, avg(x) AS mean, count(*) AS n_pairs FROM pairs GROUP BY 1) USING (pair) WHERE n_pairs >= 3 GROUP BY pair, n_pairs""",
           *TOUCHED, MARK, DAILY, PAIRED, draws_sql(MUL2, table="pairs")))
def paired_delta(spark, sf_dir):
    """Mean difference of daily markout between two strategies on the days that both have, its interval, and a two-sided p."""
    x = daily(spark, sf_dir).withColumns({"pair": F.expr("strategy div 2"), "second": F.expr("strategy % 2")})
    both = x.groupBy("pair", "d").agg(F.max(F.when(F.col("second") == 0, F.col("x"))).alias("a"), F.max(F.when(F.col("second") == 1, F.col("x"))).alias("b"))
    both = both.select("pair", "d", (F.col("b") - F.col("a")).alias("x")).where("x is not null")
    means = replicate_means(both, "pair", "d", "x", draws=1000, seed=2026)
    per = means.groupBy("by").agg(F.expr("percentile(m, 0.025)").alias("lo"), F.expr("percentile(m, 0.975)").alias("hi"),
                                  F.avg((F.col("m") >= 0).cast("int")).alias("up"), F.avg((F.col("m") <= 0).cast("int")).alias("down"))
    seen = both.groupBy("pair").agg(F.count("*").alias("n_pairs"), F.avg("x").alias("delta")).where("n_pairs >= 3")
    return seen.join(per, F.col("pair") == F.col("by")).select("pair", "n_pairs", *[F.round(c, 9).alias(c) for c in ("delta", "lo", "hi")],
                                                              F.round(F.least(F.lit(1.0), 2 * F.least("up", "down")), 9).alias("p"))


@query(sql("""SELECT round(64e0 / (8 + 2 * coalesce(sum(CASE WHEN isnan(c) THEN 0 ELSE c * c END), 0)), 9) AS n_effective FROM (
  SELECT corr(a.x, b.x) AS c FROM full_days a JOIN full_days b ON a.d = b.d AND a.strategy < b.strategy GROUP BY a.strategy, b.strategy)""", *TOUCHED, MARK, DAILY,
           """full_days AS (SELECT s.strategy, t.d, coalesce(x, 0) AS x FROM (SELECT unnest(range(8)) AS strategy) s CROSS JOIN (SELECT DISTINCT d FROM daily) t LEFT JOIN daily USING (strategy, d))"""))
def effective_trials(spark, sf_dir):
    """Number of independent strategies that the correlations of daily markouts amount to: trace squared over the squared norm."""
    wide = daily(spark, sf_dir).groupBy("d").pivot("strategy", list(range(8))).agg(F.first("x")).fillna(0.0)
    cols = [str(k) for k in range(8)]
    one = wide.agg(*[corr(F.col(a), F.col(b)).alias(f"{a}_{b}") for a, b in combinations(cols, 2)])
    square = sum((F.pow(F.coalesce(F.nanvl(F.col(f"{a}_{b}"), F.lit(0.0)), F.lit(0.0)), 2) for a, b in combinations(cols, 2)), F.lit(0.0))
    return one.select(F.round(F.lit(64.0) / (F.lit(8.0) + 2 * square), 9).alias("n_effective"))
