"""Queries that join the parts: stored tables and feeds, the full ledger, regimes, windows, filters, ladders, cross-symbol models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebook.functions import quotes as q
from tidebook.functions.stats import corr
from tidebook.operators import fills as sim
from tidebook.operators.ranking import quantiles, step_up
from tidebook.operators.resampling import MUL2, replicate_sums
from tidebook.operators.timeline import as_of, last_known, running_sum, trailing
from tidebook.sources import feeds
from tidebook.sources import market as mk
from tidebook.sources.storage import scratch, stored

from .fills import MARK, TOUCHED, marked, quoted, touch_orders, with_mids
from .inference import COPIES, draws_sql
from .registry import query, sql
from .tape import OFI, order_flow, rolling_sigma

HOUR, DAY = mk.HOUR_NS, mk.DAY_NS


def _named(df: DataFrame) -> DataFrame:
    """With the symbol as text, as stored tables have it."""
    return df.withColumn("symbol", F.concat(F.lit("S"), F.col("sym")))


@query(sql("""SELECT 'S' || sym AS symbol, side, count(*) AS n_fills, sum(size) AS qty, sum(size * price) AS notional FROM fills GROUP BY ALL""", *TOUCHED))
def stored_fills(spark, sf_dir):
    """Book and tape stored as Parquet, a folder a symbol, read again, and the touch filled from what was read."""
    path = scratch(spark, "stored")
    feeds.store_snapshots(_named(mk.snapshots(spark, sf_dir)), f"{path}/snapshots", "V")
    feeds.store_trades(_named(mk.trades(spark, sf_dir)), f"{path}/trades", "V")
    # Times are unique here, so they stand for the sequence numbers that stored tables lack.
    snaps = mk.read_snapshots(spark, f"{path}/snapshots").select(F.col("symbol").alias("sym"), F.col("ts_ns").alias("seq"), "ts_ns", "bids", "asks")
    trades = mk.read_trades(spark, f"{path}/trades").select(
        F.col("symbol").alias("sym"), F.col("ts_ns").alias("seq"), "ts_ns", F.lit(0).cast("long").alias("user_id"), F.col("side").cast("int").alias("side"), "price", "size")
    found = sim.fills(trades, sim.resting(snaps, touch_orders()))
    return found.groupBy(F.col("sym").alias("symbol"), "side").agg(F.count("*").alias("n_fills"), F.sum("size").alias("qty"), F.sum(F.col("size") * F.col("price")).alias("notional"))


def _stamp(ns: str) -> str:
    """A day's time as vendor files write it: HHMMSS and nine digits."""
    s = f"({ns} % {DAY} div 1000000000)"
    return f"concat(lpad({s} div 3600, 2, '0'), lpad({s} div 60 % 60, 2, '0'), lpad({s} % 60, 2, '0'), lpad({ns} % 1000000000, 9, '0'))"


@query(sql("""SELECT sym, ts_ns, CASE WHEN nb = 0 THEN NULL ELSE b[1].px END AS bid, CASE WHEN na = 0 THEN NULL ELSE a[1].px END AS ask,
  coalesce(list_sum(list_transform(b, lambda l: l.sz)), 0) AS bid_depth, coalesce(list_sum(list_transform(a, lambda l: l.sz)), 0) AS ask_depth FROM (
  SELECT sym, ts_ns, count(CASE WHEN seq % 2 = 0 THEN 1 END) OVER w AS nb, count(CASE WHEN seq % 2 = 1 THEN 1 END) OVER w AS na,
    last_value(CASE WHEN seq % 2 = 0 THEN bids END IGNORE NULLS) OVER w AS b, last_value(CASE WHEN seq % 2 = 1 THEN asks END IGNORE NULLS) OVER w AS a
  FROM snap WINDOW w AS (PARTITION BY sym, ts_ns // 86400000000000 ORDER BY ts_ns, seq))"""))
def depth_feed_books(spark, sf_dir):
    """A vendor's one-sided depth files, a file a symbol and day, written from the book, and the two-sided books read from them."""
    path = scratch(spark, "depth-feed")
    s = mk.snapshots(spark, sf_dir).withColumns({"day": F.expr(f"ts_ns div {DAY}"), "side": F.when(F.expr("seq % 2 = 0"), "B").otherwise("S")})
    level = F.transform(F.when(F.col("side") == "B", F.col("bids")).otherwise(F.col("asks")), lambda l: F.concat_ws(",", l["px"], l["sz"], F.lit(1)))
    day = F.date_format(F.date_from_unix_date(F.col("day").cast("int")), "yyyyMMdd")
    row = F.concat_ws(",", day, F.expr(_stamp("ts_ns")), day, F.lit(0), F.lit(1), F.lit("P"), F.lit("G"), F.concat(F.lit("S"), "sym"), "side",
                      *[F.lit(0)] * 5, F.lit(10), F.array_join(level, ","))
    rows = s.select("sym", "day", "ts_ns", "seq", row.alias("value"))
    head = rows.select("sym", "day").distinct().select("sym", "day", F.lit(-1).cast("long").alias("ts_ns"), F.lit(-1).cast("long").alias("seq"), F.lit("header").alias("value"))
    # One vendor file holds one symbol's day in order; that is what a task writes.
    whole = rows.unionByName(head).repartition("sym", "day").sortWithinPartitions("sym", "day", "ts_ns", "seq")
    whole.select("sym", "day", "value").write.partitionBy("sym", "day").text(path)
    books = feeds.futures_depth(spark, path)
    best = lambda side: F.get(F.col(side), F.lit(0))["px"]
    depth = lambda side: F.aggregate(side, F.lit(0.0), lambda t, l: t + l["sz"])
    return books.select(F.substring("symbol", 2, 20).cast("long").alias("sym"), "ts_ns", best("bids").alias("bid"), best("asks").alias("ask"),
                        depth("bids").alias("bid_depth"), depth("asks").alias("ask_depth"))


#: Columns of the full ledger, in order.
FULL = ("fill_id ts_ns venue symbol side is_maker price size ref_mid_at_fill queue_pos_at_fill fee slippage funding_accrued gas swap_slippage mid_1s mid_10s mid_60s "
        "markout_1s markout_10s markout_60s realised_spread adverse_selection_cost inv_after gross_pnl net_pnl regime_posterior run_id commit_hash").split()
MARKS = {"1s": 10**9, "10s": 10 * 10**9, "60s": 60 * 10**9}
BOTH_FILLS = """
numbered AS (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY ts_ns, seq) AS n FROM snap),
taken AS (SELECT seq, sym, ts_ns, l - 1 AS idx, 1 AS side, false AS is_maker, price, least(2, c) - least(2, c - sz) AS size, NULL::DOUBLE AS queue FROM (
  SELECT seq, sym, ts_ns, l, asks[l].px AS price, asks[l].sz AS sz, sum(asks[l].sz) OVER (PARTITION BY sym, seq ORDER BY l) AS c FROM numbered, (SELECT unnest(range(1, 11)) AS l) WHERE n % 50 = 0)
  WHERE least(2, c) - least(2, c - sz) > 0),
made AS (SELECT f.seq, f.sym, f.ts_ns, f.idx, f.side, true AS is_maker, f.price, f.size, o.queue FROM fills f JOIN orders o ON o.sym = f.sym AND o.seq = f.interval AND o.side = f.side),
every AS (SELECT * FROM made UNION ALL SELECT * FROM taken),
full_marks AS (SELECT f.*, s.mid AS m0, a.mid AS m1, b.mid AS m10, c.mid AS m60 FROM every f ASOF LEFT JOIN snap s ON f.sym = s.sym AND f.ts_ns >= s.ts_ns
  ASOF LEFT JOIN snap a ON f.sym = a.sym AND f.ts_ns + 1000000000 >= a.ts_ns ASOF LEFT JOIN snap b ON f.sym = b.sym AND f.ts_ns + 10000000000 >= b.ts_ns
  ASOF LEFT JOIN snap c ON f.sym = c.sym AND f.ts_ns + 60000000000 >= c.ts_ns),
full_costs AS (SELECT *, row_number() OVER w - 1 AS fill_id, sum(side * size) OVER w AS inv, sum(side * size) OVER w - side * size AS inv0, lag(m0) OVER w AS p0, lag(ts_ns) OVER w AS pt,
  size * price * CASE WHEN is_maker THEN 0.0002e0 ELSE 0.0005e0 END AS fee, CASE WHEN is_maker THEN 0e0 ELSE size * price * 0.0002e0 END AS slippage
  FROM full_marks WINDOW w AS (PARTITION BY sym ORDER BY ts_ns, seq, idx)),
full_pnl AS (SELECT *, inv0 * coalesce(m0 - p0, 0) + side * size * (m0 - price) AS gross, coalesce(abs(inv0) * abs(p0) * 0.0001e0 * (ts_ns - pt) / 28800000000000e0, 0) AS funding FROM full_costs)"""


def full_ledger(spark: SparkSession, sf_dir: str, run: str = "run") -> DataFrame:
    """One row a fill: makers at the touch, and a buy of two at every fiftieth snapshot of a symbol, with costs, marks and profit."""
    snaps, trades = mk.snapshots(spark, sf_dir), mk.trades(spark, sf_dir)
    cols = ["seq", "sym", "ts_ns", "idx", "side", "is_maker", "price", "size", "queue"]
    made = sim.fills(trades, quoted(spark, sf_dir, touch_orders())).withColumn("is_maker", F.lit(True)).select(cols)
    n = running_sum(snaps.withColumn("one", F.lit(1)), ["sym"], ["ts_ns", "seq"], {"one": "n"})
    taken = sim.taker_fills(n.where("n % 50 = 0"), 2.0, 1).select(
        "seq", "sym", "ts_ns", F.col("level").alias("idx"), "side", F.lit(False).alias("is_maker"), "price", "size", F.lit(None).cast("double").alias("queue"))
    f = with_mids(stored(made.unionByName(taken), "both-fills"), snaps, MARKS)
    order = ["ts_ns", "seq", "idx"]
    f = f.withColumns({"signed": F.col("side") * F.col("size"), "one": F.lit(1).cast("long"), "mark": F.when(F.col("m0").isNotNull(), F.struct("m0", "ts_ns"))})
    f = last_known(running_sum(f, ["sym"], order, {"signed": "inv_after", "one": "number"}), ["sym"], order, {"mark": "prev"}, before=True)
    before, notional = F.col("inv_after") - F.col("signed"), F.col("price") * F.col("size")
    gross = before * F.coalesce(F.col("m0") - F.col("prev.m0"), F.lit(0.0)) + F.coalesce(F.col("signed") * (F.col("m0") - F.col("price")), F.lit(0.0))
    f = f.withColumns({
        "fee": q.fee(notional, F.col("is_maker"), 0.0002, 0.0005), "slippage": q.slippage(notional, F.col("is_maker"), 0.0002), "gross_pnl": gross,
        "funding_accrued": F.coalesce(q.funding(before, F.col("prev.m0"), F.col("ts_ns") - F.col("prev.ts_ns"), 0.0001), F.lit(0.0))})
    marks = {f"markout_{h}": F.try_divide(F.col("side") * (F.col(f"m{h}") - F.col("price")), "m0") for h in MARKS}
    return f.withColumns(marks).select(
        (F.col("number") - 1).alias("fill_id"), "ts_ns", F.lit("V").alias("venue"), F.concat(F.lit("S"), "sym").alias("symbol"), "side", "is_maker", "price", "size",
        F.col("m0").alias("ref_mid_at_fill"), F.col("queue").alias("queue_pos_at_fill"), "fee", "slippage", "funding_accrued", F.lit(0.0).alias("gas"), F.lit(0.0).alias("swap_slippage"),
        *[F.col(f"m{h}").alias(f"mid_{h}") for h in MARKS], *marks, (-F.col("markout_10s")).alias("realised_spread"),
        F.try_divide(F.col("side") * (F.col("m10s") - F.col("m0")), "m0").alias("adverse_selection_cost"), "inv_after", "gross_pnl",
        F.expr("gross_pnl - fee - slippage - funding_accrued").alias("net_pnl"), F.lit(None).cast("double").alias("regime_posterior"), F.lit(run).alias("run_id"), F.lit("").alias("commit_hash"))


@query(sql("""SELECT fill_id, ts_ns, 'V' AS venue, 'S' || sym AS symbol, side, is_maker, price, size, m0 AS ref_mid_at_fill, queue AS queue_pos_at_fill, round(fee, 9) AS fee, round(slippage, 9) AS slippage,
  round(funding, 9) AS funding_accrued, 0e0 AS gas, 0e0 AS swap_slippage, m1 AS mid_1s, m10 AS mid_10s, m60 AS mid_60s, round(side * (m1 - price) / m0, 12) AS markout_1s,
  round(side * (m10 - price) / m0, 12) AS markout_10s, round(side * (m60 - price) / m0, 12) AS markout_60s, round(-side * (m10 - price) / m0, 12) AS realised_spread,
  round(side * (m10 - m0) / m0, 12) AS adverse_selection_cost, inv AS inv_after, round(gross, 8) AS gross_pnl, round(gross - fee - slippage - funding, 8) AS net_pnl,
  NULL::DOUBLE AS regime_posterior, 'run' AS run_id, '' AS commit_hash FROM full_pnl""", *TOUCHED, BOTH_FILLS))
def ledger_full(spark, sf_dir):
    """All columns of the ledger, written to shared storage a folder a symbol and read from there."""
    path = scratch(spark, "ledger")
    full_ledger(spark, sf_dir).withColumn("sym", F.col("symbol")).write.partitionBy("sym").parquet(path)
    digits = {"fee": 9, "slippage": 9, "funding_accrued": 9, "gross_pnl": 8, "net_pnl": 8, "realised_spread": 12, "adverse_selection_cost": 12} | {f"markout_{h}": 12 for h in MARKS}
    return spark.read.parquet(path).select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in FULL])


def surges(spark, sf_dir) -> DataFrame:
    """At each snapshot, with its best levels, over the last four hours' trades: n, deviation of log price changes in bp, imbalance."""
    t = mk.trades(spark, sf_dir).withColumn("d", F.struct("price", "ts_ns"))
    t = last_known(t, ["sym"], ["ts_ns", "seq"], {"d": "p"}, before=True)
    t = t.select("seq", "sym", "ts_ns", F.lit(1).alias("kind"), F.log(F.col("price") / F.col("p.price")).alias("r"), F.coalesce("p.ts_ns", "ts_ns").alias("left"),
                 (F.col("side") * F.col("size")).alias("s"), F.col("size").alias("v"), F.lit(1).alias("one"))
    both = mk.snapshots(spark, sf_dir).select("seq", "sym", "ts_ns", F.lit(0).alias("kind"), F.slice("bids", 1, 1).alias("bids"), F.slice("asks", 1, 1).alias("asks")).unionByName(t, allowMissingColumns=True)
    w = trailing(both, ["sym"], 4 * HOUR, {"n": F.col("one"), "net": F.col("s"), "vol": F.col("v")}, since={"r": F.coalesce("left", "ts_ns")}, moments={"r": F.col("r")})
    surge = F.when(F.col("n") >= 3, F.round(F.sqrt(F.coalesce("r_var", F.lit(0.0))) * 1e4, 4))
    return w.where("kind = 0").withColumns({"surge_bp": surge, "ofi": F.round(F.try_divide(F.abs("net"), "vol"), 9)})


@query(sql("""SELECT seq, sym, surge_bp, surge, micro, flow, (surge OR micro OR flow) AS any_of, (surge AND micro AND flow) AS all_of FROM (
  SELECT seq, sym, CASE WHEN n >= 3 THEN round(1e4 * sqrt(greatest(0, s2 / (n - 1) - (s1 / (n - 1)) ** 2)), 4) END AS surge_bp,
    coalesce(CASE WHEN n >= 3 THEN round(1e4 * sqrt(greatest(0, s2 / (n - 1) - (s1 / (n - 1)) ** 2)), 4) END >= 40.1, false) AS surge,
    round(abs((bsz - asz) / (bsz + asz) * (ask - bid) / 2) / mid * 1e4, 7) >= 20.1 AS micro, coalesce(round(net / vol, 9) >= 0.5, false) AS flow FROM (
    SELECT s.*, count(t.seq) AS n, sum(CASE WHEN t.p_ns > s.ts_ns - 14400000000000 THEN t.r END) AS s1, sum(CASE WHEN t.p_ns > s.ts_ns - 14400000000000 THEN t.r * t.r END) AS s2,
      abs(sum(t.side * t.size)) AS net, sum(t.size) AS vol
    FROM (SELECT seq, sym, ts_ns, bid, ask, bsz, asz, mid FROM snap) s LEFT JOIN (SELECT *, ln(price / lag(price) OVER w) AS r, lag(ts_ns) OVER w AS p_ns FROM trade WINDOW w AS (PARTITION BY sym ORDER BY ts_ns, seq)) t
      ON t.sym = s.sym AND t.ts_ns <= s.ts_ns AND t.ts_ns > s.ts_ns - 14400000000000 GROUP BY ALL))""".replace("sqrt(greatest(0, s2", "sqrt(greatest(0, coalesce(s2, 0)").replace("(s1 / (n", "(coalesce(s1, 0) / (n")))
def adverse_filters(spark, sf_dir):
    """Three filters at each snapshot, a surge of traded volatility, the microprice's distance from the mid, one-sided flow, and any or all of them."""
    bz, az = mk.best("bids", "sz"), mk.best("asks", "sz")
    micro = F.round(F.abs(q.microprice() - q.mid()) / q.mid() * 1e4, 7)
    s = surges(spark, sf_dir).withColumns({
        "surge": F.coalesce(F.col("surge_bp") >= 40.1, F.lit(False)), "micro": F.coalesce((micro >= 20.1) & (bz + az > 0), F.lit(False)), "flow": F.coalesce(F.col("ofi") >= 0.5, F.lit(False))})
    return s.select("seq", "sym", "surge_bp", "surge", "micro", "flow", F.expr("surge or micro or flow").alias("any_of"), F.expr("surge and micro and flow").alias("all_of"))


@query(sql("""SELECT seq, sym, shape, side, k, px, sz FROM snap, (
  SELECT 'single' AS shape, 1 AS side, 0 AS k, 0.5e0 AS off, 1e0 AS sz UNION ALL SELECT 'single', -1, 0, 0.5e0, 1e0
  UNION ALL SELECT 'paired', 1, 0, 0.5e0, 1e0 UNION ALL SELECT 'paired', 1, 1, 1.5e0, 2e0 UNION ALL SELECT 'paired', -1, 0, 1e0, 3e0
  UNION ALL SELECT 'ladder', sd, k, 0.5e0 + 0.25e0 * k, 1e0 FROM (SELECT unnest(range(3))::INT AS k), (SELECT unnest([1, -1]) AS sd)
  UNION ALL SELECT 'geometric', sd, k, 0.5e0 * 2e0 ** k, 1e0 FROM (SELECT unnest(range(3))::INT AS k), (SELECT unnest([1, -1]) AS sd)) o, LATERAL (SELECT mid - o.side * o.off AS px)"""))
def quote_ladders(spark, sf_dir):
    """Every request of four shapes around the mid: one a side, uneven arms, even steps, growing steps."""
    half = F.lit(0.5)

    def rungs(shape: str, side: int, offsets, sizes) -> object:
        return F.transform(offsets, lambda off, k: F.struct(F.lit(shape).alias("shape"), F.lit(side).alias("side"), k.alias("k"), off.alias("off"), F.get(sizes, k).alias("sz")))

    ones, plain = F.array(*[F.lit(1.0)] * 3), lambda *x: F.array(*[F.lit(float(v)) for v in x])
    every = [rungs("single", s, plain(0.5), ones) for s in (1, -1)] + [rungs("paired", 1, plain(0.5, 1.5), plain(1, 2)), rungs("paired", -1, plain(1.0), plain(3))]
    every += [rungs("ladder", s, q.shape_levels(half, 0.25, F.lit(3)), ones) for s in (1, -1)] + [rungs("geometric", s, q.shape_geometric(half, 2.0, F.lit(3)), ones) for s in (1, -1)]
    s = mk.snapshots(spark, sf_dir).select("seq", "sym", q.mid().alias("mid"), F.explode(F.concat(*every)).alias("o"))
    return s.select("seq", "sym", "o.shape", "o.side", "o.k", (F.col("mid") - F.col("o.side") * F.col("o.off")).alias("px"), "o.sz")


REGIME = """vols AS (SELECT seq, sym, ts_ns, CASE WHEN n > 1 THEN round(sqrt(greatest(0, (s2 - r0 * r0) / (n - 1) - ((s1 - r0) / (n - 1)) ** 2)), 7) END AS sigma FROM (
  SELECT seq, sym, ts_ns, count(*) OVER w AS n, sum(r) OVER w AS s1, sum(r * r) OVER w AS s2, first_value(r) OVER w AS r0 FROM
    (SELECT *, coalesce(ln(mid) - ln(lag(mid) OVER (PARTITION BY sym ORDER BY ts_ns, seq)), 0) AS r FROM snap)
  WINDOW w AS (PARTITION BY sym ORDER BY ts_ns RANGE BETWEEN 86399999999999 PRECEDING AND CURRENT ROW))),
labelled AS (SELECT m.*, v.sigma, CASE WHEN v.sigma IS NULL THEN 'none' WHEN v.sigma >= 0.0031 THEN 'hivol' ELSE 'calm' END AS regime,
  CASE WHEN m.ts_ns % 86400000000000 < 21600000000000 THEN 'open' ELSE 'rest' END AS session FROM marks m ASOF LEFT JOIN vols v ON m.sym = v.sym AND m.ts_ns >= v.ts_ns)"""


def regimes_of_fills(spark, sf_dir) -> DataFrame:
    """Marked fills with the volatility regime that was known when they happened, and the session."""
    vols = rolling_sigma(spark, sf_dir).join(mk.snapshots(spark, sf_dir).select("seq", "ts_ns"), "seq").withColumn("known", F.struct("sigma"))
    f = as_of(marked(spark, sf_dir), vols, ["sym"], "known", "known")
    regime = F.when(F.col("known.sigma").isNull(), "none").when(F.col("known.sigma") >= 0.0031, "hivol").otherwise("calm")
    return f.withColumns({"regime": regime, "session": F.when(F.expr(f"ts_ns % {DAY} < {DAY // 4}"), "open").otherwise("rest")})


@query(sql("""SELECT session, regime, count(*) AS n_fills, round(avg(1e4 * (side * (m0 - price) / m0)), 9) AS captured_bp, round(avg(1e4 * side * (m1h - m0) / m0), 9) AS adverse_bp,
  round(avg(1e4 * side * (m1h - price) / m0), 9) AS markout_bp FROM labelled GROUP BY ALL""", *TOUCHED, MARK, REGIME))
def decomp_by_regime(spark, sf_dir):
    """Captured spread, adverse selection and markout, by session and by the regime known at the fill."""
    f = regimes_of_fills(spark, sf_dir)
    return f.groupBy("session", "regime").agg(
        F.count("*").alias("n_fills"), F.round(F.avg(F.col("side") * (F.col("m0") - F.col("price")) / F.col("m0") * 1e4), 9).alias("captured_bp"),
        F.round(F.avg(F.col("adverse_1h") * 1e4), 9).alias("adverse_bp"), F.round(F.avg(F.col("markout_1h") * 1e4), 9).alias("markout_bp"))


N_IN, N_OUT = 5 * DAY, 2 * DAY
WINDOWS = f"""spans AS (SELECT t0 + k * {N_OUT} + {N_IN} AS oos_from, k AS win FROM (SELECT min(ts_ns) AS t0, max(ts_ns) AS t1 FROM snap), (SELECT unnest(range(0, 400)) AS k) WHERE t0 + k * {N_OUT} + {N_IN + N_OUT} <= t1),
cells AS (SELECT user_id % 13 AS root, win, count(*) AS n_fills, round(sum(1e4 * side * (m1h - price) / m0 - 0.015e0), 6) AS net_bp, sum(size * side) AS position
  FROM marks JOIN spans ON ts_ns >= oos_from AND ts_ns < oos_from + {N_OUT} GROUP BY ALL)"""


def window_cells(spark, sf_dir) -> DataFrame:
    """Fills, net after fees in bp and position of each root in each out-of-sample window of a walk forward."""
    lim = mk.snapshots(spark, sf_dir).agg(F.min("ts_ns").alias("t0"), F.max("ts_ns").alias("t1"))
    m = marked(spark, sf_dir).join(F.broadcast(lim), how="cross")  # one row
    m = m.withColumn("win", F.expr(f"(ts_ns - t0 - {N_IN}) div {N_OUT}")).where(f"ts_ns >= t0 + {N_IN} and t0 + win * {N_OUT} + {N_IN + N_OUT} <= t1")
    return m.groupBy(F.expr("user_id % 13").alias("root"), "win").agg(
        F.count("*").alias("n_fills"), F.round(F.sum(F.col("markout_1h") * 1e4 - 0.015), 6).alias("net_bp"), F.sum(F.col("size") * F.col("side")).alias("position"))


@query(sql("SELECT * FROM cells", *TOUCHED, MARK, WINDOWS))
def window_harness(spark, sf_dir):
    """The per-window harness as one plan keyed by root and window."""
    return window_cells(spark, sf_dir)


ASSEMBLED = """tested AS (SELECT root AS id, round(exp(-0.5e0 * (avg(net_bp) / stddev_samp(net_bp)) ** 2 * count(*)), 9) AS p, count(*) AS n FROM cells GROUP BY root HAVING count(*) > 1 AND stddev_samp(net_bp) > 0)"""


@query(sql("""SELECT id, p, rank, round(q, 9) AS q_bh, round(qy, 9) AS q_bhy, q <= 0.1 AS bh, qy <= 0.1 AS bhy FROM (
  SELECT *, least(1, min(p * m / rank) OVER (ORDER BY p DESC, id DESC)) AS q, least(1, min(p * m / rank * h) OVER (ORDER BY p DESC, id DESC)) AS qy FROM
    (SELECT id, p, row_number() OVER (ORDER BY p, id) AS rank, count(*) OVER () AS m FROM tested), (SELECT sum(1e0 / i) AS h FROM (SELECT unnest(range(1, (SELECT count(*) FROM tested) + 1)) AS i)))""",
           *TOUCHED, MARK, WINDOWS, ASSEMBLED))
def assemble_windows(spark, sf_dir):
    """Roots whose windows' net differs from nothing (a bound on the normal tail), after control for their number."""
    per = window_cells(spark, sf_dir).groupBy(F.col("root").alias("id")).agg(F.avg("net_bp").alias("mu"), F.stddev_samp("net_bp").alias("sd"), F.count("*").alias("n")).where("n > 1 and sd > 0")
    return step_up(per.select("id", F.round(F.exp(-0.5 * F.pow(F.col("mu") / F.col("sd"), 2) * F.col("n")), 9).alias("p")))


CROSS = """hours AS (SELECT sym, ts_ns // 3600000000000 AS bin, sum(ofi) AS ofi, arg_max(mid, (ts_ns, seq)) AS c FROM ofi GROUP BY ALL),
moves AS (SELECT *, c - lag(c) OVER (PARTITION BY sym ORDER BY bin) AS dm FROM hours),
wide AS (SELECT a.sym, a.bin, a.dm AS y, a.ofi AS x1, b.ofi AS x2 FROM moves a JOIN moves b ON a.bin = b.bin AND b.sym = 1 - a.sym WHERE a.dm IS NOT NULL),
fit AS (SELECT sym, count(*) AS n, corr(y, x1) AS r1, corr(y, x2) AS r2, corr(x1, x2) AS r12 FROM wide GROUP BY sym)"""


def hourly_moves(spark, sf_dir) -> DataFrame:
    """By symbol and hour: flow, and the mid's move since the hour before."""
    h = order_flow(spark, sf_dir).groupBy("sym", F.expr(f"ts_ns div {HOUR}").alias("bin")).agg(F.sum("ofi").alias("ofi"), F.max_by("mid", F.struct("ts_ns", "seq")).alias("c"))
    return h.withColumn("dm", F.col("c") - F.lag("c").over(Window.partitionBy("sym").orderBy("bin")))  # one row an hour


@query(sql("SELECT sym, n, round(r1 * r1, 8) AS r2_own, round((r1 * r1 + r2 * r2 - 2 * r1 * r2 * r12) / (1 - r12 * r12), 8) AS r2_cross FROM fit WHERE abs(r12) < 1", OFI, CROSS))
def own_cross_ols(spark, sf_dir):
    """Share of a symbol's hourly moves that its own flow explains, and its own with the other symbol's (least squares from correlations)."""
    h = hourly_moves(spark, sf_dir)
    other = h.select((1 - F.col("sym")).alias("sym"), "bin", F.col("ofi").alias("x2"))
    w = h.where("dm is not null").join(other, ["sym", "bin"])
    f = w.groupBy("sym").agg(F.count("*").alias("n"), corr("dm", "ofi").alias("r1"), corr("dm", "x2").alias("r2"), corr("ofi", "x2").alias("r12")).where("abs(r12) < 1")
    return f.select("sym", "n", F.round(F.expr("r1 * r1"), 8).alias("r2_own"), F.round(F.expr("(r1 * r1 + r2 * r2 - 2 * r1 * r2 * r12) / (1 - r12 * r12)"), 8).alias("r2_cross"))


BLOCKS = 12


@query(sql(f"""SELECT s.sym, any_value(s.n) AS n, round(any_value(s.r2), 8) AS observed, (count(*) FILTER (t.r2 >= s.r2 - 1e-12) + 1) / {BLOCKS + 1}e0 AS p FROM (SELECT * FROM shifted WHERE k = 0) s JOIN shifted t ON t.sym = s.sym AND t.k > 0 GROUP BY s.sym""",
           OFI, CROSS, f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY bin) - 1 AS i, count(*) OVER (PARTITION BY sym) AS n FROM wide),
shifted AS (SELECT sym, k, n, (r1 * r1 + r2 * r2 - 2 * r1 * r2 * r12) / (1 - r12 * r12) - r1 * r1 AS r2 FROM (
  SELECT a.sym, k, any_value(a.n) AS n, corr(a.y, a.x1) AS r1, corr(a.y, b.x2) AS r2, corr(a.x1, b.x2) AS r12 FROM (SELECT unnest(range({BLOCKS + 1})) AS k) s, ranked a JOIN ranked b ON b.sym = a.sym AND b.i = (a.i + k * (a.n // {BLOCKS + 1})) % a.n GROUP BY a.sym, k) WHERE abs(r12) < 1)"""))
def block_null(spark, sf_dir):
    """What the other symbol's flow adds, against its flow moved on in blocks of time, which keeps each series and breaks their alignment."""
    h = hourly_moves(spark, sf_dir)
    w = h.where("dm is not null").join(h.select((1 - F.col("sym")).alias("sym"), "bin", F.col("ofi").alias("x2")), ["sym", "bin"])
    by = Window.partitionBy("sym")  # one row an hour
    w = w.withColumns({"i": F.row_number().over(by.orderBy("bin")) - 1, "n": F.count("*").over(by)})
    moved = w.select("sym", "i", "n", "x2", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS))).alias("k"))
    moved = moved.select("sym", "k", F.expr(f"pmod(i - k * (n div {BLOCKS + 1}), n)").cast("int").alias("i"), F.col("x2").alias("z"))
    f = w.join(moved, ["sym", "i"]).groupBy("sym", "k").agg(F.count("*").alias("n"), corr("dm", "ofi").alias("r1"), corr("dm", "z").alias("r2"), corr("ofi", "z").alias("r12"))
    f = f.where("abs(r12) < 1").select("sym", "k", "n", F.expr("(r1 * r1 + r2 * r2 - 2 * r1 * r2 * r12) / (1 - r12 * r12) - r1 * r1").alias("r2"))
    seen = f.where("k = 0").select("sym", "n", F.col("r2").alias("observed"))
    null = f.where("k > 0").join(seen.select("sym", "observed"), "sym").groupBy("sym").agg(F.count(F.when(F.col("r2") >= F.col("observed") - 1e-12, 1)).alias("hits"))
    return seen.join(null, "sym").select("sym", "n", F.round("observed", 8).alias("observed"), ((F.col("hits") + 1) / (BLOCKS + 1)).alias("p"))


@query(sql("""SELECT root, n_low, n_high, round(high - low, 9) AS delta_bp FROM (SELECT root, count(*) FILTER (sigma <= lo) AS n_low, count(*) FILTER (sigma >= hi) AS n_high,
    avg(x) FILTER (sigma <= lo) AS low, avg(x) FILTER (sigma >= hi) AS high FROM
  (SELECT *, user_id % 13 AS root, 1e4 * side * (m1h - price) / m0 AS x FROM labelled WHERE sigma IS NOT NULL) JOIN
  (SELECT user_id % 13 AS root, quantile_cont(sigma, 1 / 3e0) AS lo, quantile_cont(sigma, 2 / 3e0) AS hi FROM labelled WHERE sigma IS NOT NULL GROUP BY 1) USING (root) GROUP BY root) WHERE n_low > 1 AND n_high > 1""",
           *TOUCHED, MARK, REGIME))
def tercile_deltas(spark, sf_dir):
    """By root, the mean markout of fills in its most volatile third less that of its calmest third."""
    f = regimes_of_fills(spark, sf_dir).where("known.sigma is not null").select(F.expr("user_id % 13").alias("root"), F.col("known.sigma").alias("sigma"), (F.col("markout_1h") * 1e4).alias("x"))
    f = stored(f, "fills-in-regimes")
    cut = quantiles(f, ["root"], "sigma", {"lo": 1 / 3, "hi": 2 / 3}).drop("n")
    low, high = F.col("sigma") <= F.col("lo"), F.col("sigma") >= F.col("hi")
    per = f.join(F.broadcast(cut), "root").groupBy("root").agg(  # one row a root
        F.count(F.when(low, 1)).alias("n_low"), F.count(F.when(high, 1)).alias("n_high"), F.avg(F.when(low, F.col("x"))).alias("a"), F.avg(F.when(high, F.col("x"))).alias("b"))
    return per.where("n_low > 1 and n_high > 1").select("root", "n_low", "n_high", F.round(F.col("b") - F.col("a"), 9).alias("delta_bp"))


@query(sql("""SELECT gate, win, n_fills, round(net_bp, 6) AS net_bp FROM (SELECT gate, win, count(*) AS n_fills, round(sum(x), 6) AS net_bp, row_number() OVER (PARTITION BY win ORDER BY round(sum(x), 6) DESC, gate) AS k FROM (
  SELECT g.gate, win, 1e4 * side * (m1h - price) / m0 - 0.015e0 AS x FROM marks m JOIN (SELECT seq, abs(bsz - asz) / (bsz + asz) AS imb FROM snap) s ON s.seq = m.interval
    JOIN spans ON m.ts_ns >= oos_from - 432000000000000 AND m.ts_ns < oos_from, (SELECT unnest([0.21e0, 0.41e0, 0.61e0, 1.01e0]) AS gate) g WHERE imb < g.gate) GROUP BY gate, win) WHERE k = 1""", *TOUCHED, MARK, WINDOWS))
def gate_choice(spark, sf_dir):
    """For each walk-forward window, the gate on uneven touch sizes with the best net in sample."""
    bz, az = mk.best("bids", "sz"), mk.best("asks", "sz")
    imb = mk.snapshots(spark, sf_dir).select(F.col("seq").alias("interval"), (F.abs(bz - az) / (bz + az)).alias("imb"))
    lim = mk.snapshots(spark, sf_dir).agg(F.min("ts_ns").alias("t0"), F.max("ts_ns").alias("t1"))
    m = marked(spark, sf_dir).join(imb, "interval").join(F.broadcast(lim), how="cross")  # one row
    k = F.expr(f"(ts_ns - t0) div {N_OUT}")
    m = m.withColumn("win", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), k - N_IN // N_OUT), k)))
    m = m.where(f"ts_ns >= t0 + win * {N_OUT} and ts_ns < t0 + win * {N_OUT} + {N_IN} and t0 + win * {N_OUT} + {N_IN + N_OUT} <= t1")
    g = m.withColumn("gate", F.explode(F.array(*[F.lit(x) for x in (0.21, 0.41, 0.61, 1.01)]))).where("imb < gate")
    per = g.groupBy("gate", "win").agg(F.count("*").alias("n_fills"), F.round(F.sum(F.col("markout_1h") * 1e4 - 0.015), 6).alias("net_bp"))
    best = Window.partitionBy("win").orderBy(F.desc("net_bp"), "gate")  # four rows
    return per.withColumn("k", F.row_number().over(best)).where("k = 1").select("gate", "win", "n_fills", "net_bp")


ROOT_DAYS = """root_days AS (SELECT 0 AS strategy, root * 100000 + d AS d, round(sum(cap), 6) AS y, round(sum(adv), 6) AS x FROM (
  SELECT user_id % 13 AS root, ts_ns // 86400000000000 AS d, 1e4 * side * (m0 - price) / m0 AS cap, 1e4 * side * (m1h - m0) / m0 AS adv FROM marks) GROUP BY root, d)"""


@query(sql("""SELECT n AS n_rootdays, round(point, 6) AS ratio, round(quantile_cont(r, 0.025), 6) AS lo, round(quantile_cont(r, 0.975), 6) AS hi FROM
  (SELECT j, -100 * sum(w * x) / sum(w * y) AS r FROM (SELECT *, """ + COPIES + """ AS w FROM z) GROUP BY j HAVING sum(w * y) != 0), (SELECT count(*) AS n, -100 * sum(x) / sum(y) AS point FROM root_days) GROUP BY n, point""",
           *TOUCHED, MARK, ROOT_DAYS, draws_sql(MUL2, table="root_days", also="y, ")))
def ratio_ci(spark, sf_dir):
    """Adverse selection in percent of captured spread, pooled over root-days, and its interval with root-days drawn again."""
    m = marked(spark, sf_dir).select(F.expr(f"user_id % 13 * 100000 + ts_ns div {DAY}").alias("i"), (F.col("adverse_1h") * 1e4).alias("adv"),
                                     (F.col("side") * (F.col("m0") - F.col("price")) / F.col("m0") * 1e4).alias("cap"))
    per = m.groupBy("i").agg(F.round(F.sum("cap"), 6).alias("cap"), F.round(F.sum("adv"), 6).alias("adv")).withColumn("every", F.lit(0))
    r = replicate_sums(per, "every", "i", {"cap": F.col("cap"), "adv": F.col("adv")}, draws=1000, seed=2026).where("cap != 0").withColumn("r", -100 * F.col("adv") / F.col("cap"))
    seen, drawn = F.col("j") < 0, F.when(F.col("j") >= 0, F.col("r"))
    out = r.agg(F.max(F.when(seen, F.col("copies"))).cast("long").alias("n_rootdays"), F.max(F.when(seen, F.col("r"))).alias("ratio"),
                F.percentile(drawn, 0.025).alias("lo"), F.percentile(drawn, 0.975).alias("hi"))
    return out.where("n_rootdays is not null").select("n_rootdays", *[F.round(c, 6).alias(c) for c in ("ratio", "lo", "hi")])


def correlations(n: str, moment) -> tuple[Column, Column]:
    """Pearson's correlation of x and y, and their partial one given z, from n and sums of products: moment("xy") and the like."""
    def c(a, b):
        return moment(a + b) * n - moment(a) * moment(b)

    def r(a, b):
        return F.try_divide(c(a, b), F.sqrt(c(a, a) * c(b, b)))

    xy, xz, yz = r("x", "y"), r("x", "z"), r("y", "z")
    return xy, F.try_divide(xy - xz * yz, F.sqrt((1 - xz * xz) * (1 - yz * yz)))


_PAIRS = ["x", "y", "z", "xx", "yy", "zz", "xy", "xz", "yz"]
_R = "(({n} * {ab} - {a} * {b}) / nullif(sqrt(({n} * {a}{a} - {a} * {a}) * ({n} * {b}{b} - {b} * {b})), 0))"
_XY, _XZ, _YZ = (_R.format(n="n", a=p[0], b=p[1], ab=p) for p in ("xy", "xz", "yz"))


@query(sql(f"""SELECT name, any_value(n) FILTER (j < 0)::BIGINT AS n, round(any_value(r) FILTER (j < 0), 6) AS r, round(quantile_cont(r, 0.025) FILTER (j >= 0), 6) AS lo, round(quantile_cont(r, 0.975) FILTER (j >= 0), 6) AS hi FROM (
  SELECT j, n, unnest(['pearson', 'partial']) AS name, unnest([{_XY}, ({_XY} - {_XZ} * {_YZ}) / nullif(sqrt((1 - {_XZ} * {_XZ}) * (1 - {_YZ} * {_YZ})), 0)]) AS r FROM (
    SELECT j, sum(w) AS n, {', '.join(f"sum(w * {' * '.join(p)}) AS {p}" for p in _PAIRS)} FROM (SELECT *, {COPIES} AS w FROM z UNION ALL SELECT 0, y, z, x, -1, 0, 1 FROM root_sums) GROUP BY j)) GROUP BY name"""
           .replace("FROM (SELECT *, ", "FROM (SELECT x, y, zz AS z, j, ").replace("UNION ALL SELECT 0, y, z, x, -1, 0, 1 FROM", "UNION ALL SELECT x, y, zz, -1, 1 FROM"),
           *TOUCHED, MARK, """root_sums AS (SELECT 0 AS strategy, root * 100000 + d AS d, round(sum(cap), 6) AS y, round(sum(adv), 6) AS x, count(*)::DOUBLE AS zz FROM (
  SELECT user_id % 13 AS root, ts_ns // 86400000000000 AS d, 1e4 * side * (m0 - price) / m0 AS cap, 1e4 * side * (m1h - m0) / m0 AS adv FROM marks) GROUP BY root, d)""", draws_sql(MUL2, table="root_sums", also="y, zz, ")))
def correlation_ci(spark, sf_dir):
    """Correlation of a root-day's adverse selection with its captured spread, and the same given its number of fills, each with its interval, all from one set of draws."""
    m = marked(spark, sf_dir).select(F.expr(f"user_id % 13 * 100000 + ts_ns div {DAY}").alias("i"), (F.col("adverse_1h") * 1e4).alias("adv"),
                                     (F.col("side") * (F.col("m0") - F.col("price")) / F.col("m0") * 1e4).alias("cap"))
    per = m.groupBy("i").agg(F.round(F.sum("adv"), 6).alias("x"), F.round(F.sum("cap"), 6).alias("y"), F.count("*").cast("double").alias("z")).withColumn("every", F.lit(0))
    moments = {p: reduce(lambda a, b: a * b, [F.col(c) for c in p]) for p in _PAIRS}
    s = replicate_sums(per, "every", "i", moments, draws=1000, seed=2026)
    pearson, partial = correlations(F.col("copies"), lambda p: F.col(p if p in _PAIRS else p[::-1]))
    s = s.select("j", "copies", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), r.alias("r")) for n, r in (("pearson", pearson), ("partial", partial))])).alias("c"))
    seen, drawn = F.col("j") < 0, F.when(F.col("j") >= 0, F.col("c.r"))
    return s.groupBy("c.name").agg(F.max(F.when(seen, F.col("copies"))).cast("long").alias("n"), F.round(F.max(F.when(seen, F.col("c.r"))), 6).alias("r"),
                                   F.round(F.percentile(drawn, 0.025), 6).alias("lo"), F.round(F.percentile(drawn, 0.975), 6).alias("hi"))


@query("""WITH d AS (SELECT l_returnflag AS root, l_quantity::DOUBLE AS x1, l_discount::DOUBLE AS x2, l_extendedprice::DOUBLE / 1000 AS y FROM lineitem),
s AS (SELECT sum(n) AS n, sum(s11) AS s11, sum(s22) AS s22, sum(s12) AS s12, sum(s1y) AS s1y, sum(s2y) AS s2y FROM (
  SELECT root, count(*) AS n, var_pop(x1) * count(*) AS s11, var_pop(x2) * count(*) AS s22, covar_pop(x1, x2) * count(*) AS s12, covar_pop(x1, y) * count(*) AS s1y, covar_pop(x2, y) * count(*) AS s2y FROM d GROUP BY root))
SELECT n::BIGINT AS n, round((s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12), 7) AS slope1, round((s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12), 7) AS slope2 FROM s""")
def fe_two_slopes(spark, sf_dir):
    """Two slopes within return flags at once: price on quantity and discount, from each flag's sums."""
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_returnflag").alias("root"), F.col("l_quantity").cast("double").alias("x1"), F.col("l_discount").cast("double").alias("x2"), (F.col("l_extendedprice").cast("double") / 1000).alias("y"))
    n = F.count("*")
    per = d.groupBy("root").agg(n.alias("n"), *[(F.covar_pop(a, b) * n).alias(name) for name, a, b in (
        ("s11", "x1", "x1"), ("s22", "x2", "x2"), ("s12", "x1", "x2"), ("s1y", "x1", "y"), ("s2y", "x2", "y"))])
    s = per.agg(*[F.sum(c).alias(c) for c in ("n", "s11", "s22", "s12", "s1y", "s2y")])
    return s.select("n", F.round(F.expr("(s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12)"), 7).alias("slope1"), F.round(F.expr("(s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12)"), 7).alias("slope2"))


def sign_test(up: Column, n: Column) -> Column:
    """Two-sided p of up successes out of n at even odds."""
    few = F.least(up, n - up)
    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), few), F.lit(0.0), lambda s, k: s + F.aggregate(
        F.filter(F.sequence(F.lit(0).cast("long"), k), lambda i: i > 0), F.lit(1.0), lambda c, i: c * (n - k + i) / i))
    return F.when(n > 0, F.least(F.lit(1.0), 2 * tail / F.pow(F.lit(2.0), n)))


@query(sql("""SELECT n, up, round(least(1, 2 * tail / 2 ** n), 9) AS p, round(leverage, 9) AS leverage, round(total, 6) AS total, round(total - top, 6) AS total_without_top FROM (
  SELECT n, up, leverage, total, top, list_sum(list_transform(range(least(up, n - up) + 1), lambda k: factorial(n::INT)::DOUBLE / factorial(k::INT)::DOUBLE / factorial((n - k)::INT)::DOUBLE)) AS tail FROM (
    SELECT count(*) FILTER (s != 0) AS n, count(*) FILTER (s > 0) AS up, max(abs(s)) / sum(abs(s)) AS leverage, sum(s) AS total, arg_max(s, (abs(s), root)) AS top FROM (SELECT root, round(sum(net_bp), 6) AS s FROM cells GROUP BY root)))""", *TOUCHED, MARK, WINDOWS))
def root_robustness(spark, sf_dir):
    """How far the roots agree on the net of the walk forward: those above nothing and the sign test of it, the largest root's share of all, and the total without it."""
    per = window_cells(spark, sf_dir).groupBy("root").agg(F.round(F.sum("net_bp"), 6).alias("s"))
    one = per.agg(F.count(F.when(F.col("s") != 0, 1)).alias("n"), F.count(F.when(F.col("s") > 0, 1)).alias("up"), F.try_divide(F.max(F.abs("s")), F.sum(F.abs("s"))).alias("leverage"),
                  F.sum("s").alias("total"), F.max_by("s", F.struct(F.abs("s"), "root")).alias("top"))
    return one.select("n", "up", F.round(sign_test(F.col("up"), F.col("n")), 9).alias("p"), F.round("leverage", 9).alias("leverage"), F.round("total", 6).alias("total"), F.round(F.col("total") - F.col("top"), 6).alias("total_without_top"))


def nan_mean(c: str) -> Column:
    """Mean of a column's values that are numbers; null if none is."""
    return F.avg(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")))


@query(sql("""SELECT count(*) AS n_roots, count(sharpe) FILTER (NOT isnan(sharpe)) AS n_trials, round(avg(sharpe) FILTER (NOT isnan(sharpe)), 9) AS sharpe, round(avg(n_fills), 9) AS n_fills, round(avg(net_bp), 9) AS net_bp, round(avg(position), 9) AS position FROM (
  SELECT root, avg(n_fills) AS n_fills, avg(net_bp) AS net_bp, avg(position) AS position, CASE WHEN root % 5 = 0 THEN 'nan'::DOUBLE WHEN count(*) > 1 AND stddev_samp(net_bp) > 0 THEN avg(net_bp) / stddev_samp(net_bp) END AS sharpe FROM cells GROUP BY root)""", *TOUCHED, MARK, WINDOWS))
def window_means(spark, sf_dir):
    """Column means over roots of their windows' means; ratios that are not defined (here every fifth root's, set to no number) count neither in a mean nor as a trial."""
    per = window_cells(spark, sf_dir).groupBy("root").agg(F.avg("n_fills").alias("n_fills"), F.avg("net_bp").alias("net_bp"), F.avg("position").alias("position"), F.count("*").alias("n"), F.stddev_samp("net_bp").alias("sd"))
    per = per.withColumn("sharpe", F.when(F.col("root") % 5 == 0, F.lit(float("nan"))).when((F.col("n") > 1) & (F.col("sd") > 0), F.try_divide("net_bp", "sd")))
    trials = F.count(F.when(F.col("sharpe").isNotNull() & ~F.isnan("sharpe"), 1))
    return per.agg(F.count("*").alias("n_roots"), trials.alias("n_trials"), *[F.round(nan_mean(c), 9).alias(c) for c in ("sharpe", "n_fills", "net_bp", "position")])
