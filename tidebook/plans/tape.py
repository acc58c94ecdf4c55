"""Queries on books and trades: merging, as-of states, signs, flow, bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions import quotes as q
from tidebook.functions.stats import corr
from tidebook.operators.timeline import as_of, block, last_known, running_sum, trailing
from tidebook.sources import market as mk

from .registry import query, sql

HOUR = mk.HOUR_NS


@query(sql("""SELECT seq, sym, ts_ns, kind, row_number() OVER (PARTITION BY sym ORDER BY ts_ns, kind, seq) AS place FROM
  (SELECT seq, sym, ts_ns, 0 AS kind FROM snap UNION ALL SELECT seq, sym, ts_ns, 1 FROM trade)"""))
def event_merge(spark, sf_dir):
    """Snapshots and trades in one total order, snapshots first where times are equal."""
    cols = ["seq", "sym", "ts_ns"]
    both = mk.snapshots(spark, sf_dir).select(*cols, F.lit(0).alias("kind")).unionByName(mk.trades(spark, sf_dir).select(*cols, F.lit(1).alias("kind")))
    return running_sum(both.withColumn("one", F.lit(1).cast("long")), ["sym"], ["ts_ns", "kind", "seq"], {"one": "place"}).drop("one")


@query(sql("SELECT seq, sym, ts_ns, (bids[1].px + asks[1].px) / 2 AS mid FROM snap"))
def mid_timeline(spark, sf_dir):
    s = mk.snapshots(spark, sf_dir)
    return s.where((F.size("bids") > 0) & (F.size("asks") > 0)).select("seq", "sym", "ts_ns", q.mid().alias("mid"))


@query(sql("SELECT t.seq, t.sym, s.mid AS mid FROM trade t ASOF LEFT JOIN snap s ON t.sym = s.sym AND t.ts_ns >= s.ts_ns"))
def asof_mid(spark, sf_dir):
    """The mid known at each trade."""
    return as_of(mk.trades(spark, sf_dir), mk.snapshots(spark, sf_dir), ["sym"], "mid", "mid").select("seq", "sym", "mid")


@query(sql("""SELECT d.sym, d.day, s.bid, s.ask, s.seq FROM (SELECT sym, unnest(range(lo, hi + 1)) AS day FROM
  (SELECT sym, min(ts_ns // 86400000000000) AS lo, max(ts_ns // 86400000000000) AS hi FROM snap GROUP BY sym)) d
  ASOF JOIN snap s ON d.sym = s.sym AND d.day * 86400000000000 + 43200000000000 >= s.ts_ns"""))
def book_reconstruct(spark, sf_dir):
    """Each symbol's book at noon of every day from its first to its last: the last snapshot until then."""
    s = mk.snapshots(spark, sf_dir).withColumn("book", F.struct("seq", mk.best("bids").alias("bid"), mk.best("asks").alias("ask")))
    noon = s.groupBy("sym").agg(F.min(block()).alias("lo"), F.max(block()).alias("hi")).select("sym", F.explode(F.sequence("lo", "hi")).alias("day"))
    noon = noon.select("sym", "day", (F.col("day") * mk.DAY_NS + mk.DAY_NS // 2).alias("ts_ns"), F.lit(2**62).cast("long").alias("seq"))
    return as_of(noon, s, ["sym"], "book", "b").where("b is not null").select("sym", "day", "b.bid", "b.ask", "b.seq")


@query(sql("""SELECT seq, sym, CASE WHEN bid_at IS NULL THEN NULL ELSE bid_px END AS bid_px, CASE WHEN ask_at IS NULL THEN NULL ELSE ask_px END AS ask_px FROM (
  SELECT seq, sym, last_value(CASE WHEN event_type = 'view' THEN bid WHEN event_type = 'signup' THEN 0 END IGNORE NULLS) OVER w AS bid_px,
    last_value(CASE WHEN event_type = 'click' THEN ask WHEN event_type = 'signup' THEN 0 END IGNORE NULLS) OVER w AS ask_px, 1 AS bid_at, 1 AS ask_at
  FROM snap WINDOW w AS (PARTITION BY sym ORDER BY ts_ns, seq))"""))
def l1_locf_book(spark, sf_dir):
    """One-sided updates (views move the bid, clicks the ask, signups empty the book) carried to two-sided rows."""
    s = mk.snapshots(spark, sf_dir)
    kind = F.col("event_type")
    s = s.withColumns({"b": F.when(kind == "view", mk.best("bids")).when(kind == "signup", 0.0), "a": F.when(kind == "click", mk.best("asks")).when(kind == "signup", 0.0)})
    return last_known(s, ["sym"], ["ts_ns", "seq"], {"b": "bid_px", "a": "ask_px"}).select("seq", "sym", "bid_px", "ask_px")


SIGN = "signed AS (SELECT t.*, s.mid AS m, coalesce(sign(t.price - s.mid), 0)::INT AS quote_sign FROM trade t ASOF LEFT JOIN snap s ON t.sym = s.sym AND t.ts_ns >= s.ts_ns)"


def quote_signs(spark, sf_dir) -> DataFrame:
    t = as_of(mk.trades(spark, sf_dir), mk.snapshots(spark, sf_dir), ["sym"], "mid", "m")
    return t.withColumn("quote_sign", F.coalesce(F.signum(F.col("price") - F.col("m")), F.lit(0)).cast("int"))


def tick_signs(t: DataFrame) -> DataFrame:
    """Adds prev (price before) and tick (sign of the change; null at first)."""
    t = last_known(t, ["sym"], ["ts_ns", "seq"], {"price": "prev"}, before=True)
    return t.withColumn("tick", F.signum(F.col("price") - F.col("prev")).cast("int"))


@query(sql("SELECT seq, sym, quote_sign FROM signed", SIGN))
def quote_rule_sign(spark, sf_dir):
    return quote_signs(spark, sf_dir).select("seq", "sym", "quote_sign")


TICK = """ticked AS (SELECT *, coalesce(last_value(nullif(tick, 0) IGNORE NULLS) OVER w, 1) AS tick_sign FROM
  (SELECT *, sign(price - lag(price) OVER w0)::INT AS tick FROM signed WINDOW w0 AS (PARTITION BY sym ORDER BY ts_ns, seq)) WINDOW w AS (PARTITION BY sym ORDER BY ts_ns, seq))"""


def ticked(spark, sf_dir) -> DataFrame:
    t = tick_signs(quote_signs(spark, sf_dir)).withColumn("moved", F.nullif("tick", F.lit(0)))
    return last_known(t, ["sym"], ["ts_ns", "seq"], {"moved": "k"}).withColumn("tick_sign", F.coalesce("k", F.lit(1)))


@query(sql("SELECT seq, sym, tick_sign FROM ticked", SIGN, TICK))
def tick_rule(spark, sf_dir):
    """Sign of the last price change; plus before the first."""
    return ticked(spark, sf_dir).select("seq", "sym", "tick_sign")


@query(sql("""SELECT seq, sym, coalesce(last_value(coalesce(nullif(quote_sign, 0), nullif(tick, 0)) IGNORE NULLS) OVER (PARTITION BY sym ORDER BY ts_ns, seq), 0) AS sign FROM ticked""", SIGN, TICK))
def lee_ready(spark, sf_dir):
    """Quote rule, then the price change, then the last sign."""
    t = tick_signs(quote_signs(spark, sf_dir)).withColumn("own", F.coalesce(F.nullif("quote_sign", F.lit(0)), F.nullif("tick", F.lit(0))))
    return last_known(t, ["sym"], ["ts_ns", "seq"], {"own": "k"}).select("seq", "sym", F.coalesce("k", F.lit(0)).alias("sign"))


@query(sql("""SELECT seq, sym, CASE WHEN sd > 0 THEN sign(dp) ELSE 0 END::INT AS sign FROM (
  SELECT seq, sym, dp, stddev_pop(dp) OVER (PARTITION BY sym, d ORDER BY ts_ns, seq ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS sd
  FROM (SELECT *, ts_ns // 86400000000000 AS d, coalesce(price - lag(price) OVER (PARTITION BY sym ORDER BY ts_ns, seq), 0) AS dp FROM trade))"""))
def bvc_sign(spark, sf_dir):
    """Sign of a price change against the spread of the last 50 changes of its day."""
    t = last_known(mk.trades(spark, sf_dir), ["sym"], ["ts_ns", "seq"], {"price": "prev"}, before=True)
    t = t.withColumns({"dp": F.coalesce(F.col("price") - F.col("prev"), F.lit(0.0)), "d": block()})
    sd = F.stddev_pop("dp").over(Window.partitionBy("sym", "d").orderBy("ts_ns", "seq").rowsBetween(-49, 0))
    return t.select("seq", "sym", F.when(sd > 0, F.signum("dp")).otherwise(F.lit(0.0)).cast("int").alias("sign"))


@query(sql("""SELECT sym, count(*) AS n, round(avg((side > 0)::INT), 9) AS buy_share, round(avg(CASE WHEN tick_sign != 0 THEN (tick_sign = side)::INT END), 9) AS tick_accuracy,
  round(avg(CASE WHEN quote_sign != 0 THEN (quote_sign = side)::INT END), 9) AS quote_accuracy FROM ticked GROUP BY sym""", SIGN, TICK))
def sign_accuracy(spark, sf_dir):
    """How often the tick and the quote rule find a trade's side."""
    def right(c):
        return F.round(F.avg(F.when(F.col(c) != 0, (F.col(c) == F.col("side")).cast("int"))), 9)

    return ticked(spark, sf_dir).groupBy("sym").agg(F.count("*").alias("n"), F.round(F.avg((F.col("side") > 0).cast("int")), 9).alias("buy_share"),
                                                    right("tick_sign").alias("tick_accuracy"), right("quote_sign").alias("quote_accuracy"))


@query(sql("""SELECT seq, sym FROM (SELECT *, lag((bid, bsz, ask, asz)) OVER (PARTITION BY sym ORDER BY ts_ns, seq) AS was FROM snap) WHERE was IS DISTINCT FROM (bid, bsz, ask, asz)"""))
def throttle_topk(spark, sf_dir):
    """Snapshots whose touch differs from the one before."""
    s = mk.snapshots(spark, sf_dir).withColumn("top", F.struct(F.slice("bids", 1, 1).alias("b"), F.slice("asks", 1, 1).alias("a")))
    s = last_known(s, ["sym"], ["ts_ns", "seq"], {"top": "was"}, before=True)
    return s.where(~F.col("top").eqNullSafe(F.col("was"))).select("seq", "sym")


@query(sql("SELECT sym, ts_ns - ts_ns % 3600000000000 AS bin, arg_max(mid, (ts_ns, seq)) AS mid, count(*) AS n FROM snap GROUP BY ALL"))
def coarsen_last(spark, sf_dir):
    """The last mid of every hour."""
    s = mk.snapshots(spark, sf_dir).withColumn("bin", F.expr(f"ts_ns - ts_ns % {HOUR}"))
    return s.groupBy("sym", "bin").agg(F.max_by("mid", F.struct("ts_ns", "seq")).alias("mid"), F.count("*").alias("n"))


@query(sql("""SELECT s.seq, s.sym, px, list_filter(bids, lambda l: abs(l.px - px) <= 1e-9)[1].sz AS sz FROM snap s, (SELECT unnest([98e0, 100e0, 102e0]) AS px)"""))
def level_size_lookup(spark, sf_dir):
    """Visible bid size at three prices; null where the book doesn't show them."""
    s = mk.snapshots(spark, sf_dir).withColumn("px", F.explode(F.array(*[F.lit(x) for x in (98.0, 100.0, 102.0)])))
    return s.select("seq", "sym", "px", q.size_at(F.col("bids"), F.col("px")).alias("sz"))


@query(sql("""SELECT sym, interval, count(*) AS n, sum(size) AS qty FROM (SELECT t.*, s.seq AS interval FROM trade t ASOF LEFT JOIN snap s ON t.sym = s.sym AND t.ts_ns >= s.ts_ns) GROUP BY ALL"""))
def interval_assign(spark, sf_dir):
    """Trades by the snapshot they follow."""
    s = mk.snapshots(spark, sf_dir).withColumn("interval", F.col("seq"))
    return as_of(mk.trades(spark, sf_dir), s, ["sym"], "interval", "interval").groupBy("sym", "interval").agg(F.count("*").alias("n"), F.sum("size").alias("qty"))


@query(sql("""SELECT seq, sym, mid, round((bid * asz + ask * bsz) / (bsz + asz), 9) AS weighted, round(mid + (bsz - asz) / (bsz + asz) * (ask - bid) / 2, 9) AS micro,
  round(abs(mid + (bsz - asz) / (bsz + asz) * (ask - bid) / 2 - mid) / mid * 1e4, 7) AS micro_dev_bp, round(abs(bsz - asz) / (bsz + asz), 9) AS imbalance FROM snap"""))
def reference_prices(spark, sf_dir):
    """Mid, size-weighted mid, microprice, and the two book filters that are made of them."""
    bz, az = mk.best("bids", "sz"), mk.best("asks", "sz")
    return mk.snapshots(spark, sf_dir).select(
        "seq", "sym", q.mid().alias("mid"), F.round(q.weighted_mid(), 9).alias("weighted"), F.round(q.microprice(), 9).alias("micro"),
        F.round(F.abs(q.microprice() - q.mid()) / q.mid() * 1e4, 7).alias("micro_dev_bp"), F.round(F.abs(bz - az) / (bz + az), 9).alias("imbalance"))


@query(sql("""SELECT seq, sym, round(sum(price * size) OVER w / sum(size) OVER w, 9) AS vwap FROM trade WINDOW w AS (PARTITION BY sym ORDER BY ts_ns RANGE BETWEEN 7199999999999 PRECEDING AND CURRENT ROW)"""))
def vwap_trailing(spark, sf_dir):
    """Volume-weighted price of the last two hours."""
    t = trailing(mk.trades(spark, sf_dir), ["sym"], 2 * HOUR, {"pv": F.col("price") * F.col("size"), "v": F.col("size")})
    return t.select("seq", "sym", F.round(F.col("pv") / F.col("v"), 9).alias("vwap"))


@query(sql("""SELECT seq, sym, round(abs(sum(side * size) OVER w) / sum(size) OVER w, 9) AS ofi, (abs(sum(side * size) OVER w) / sum(size) OVER w >= 0.6) AS ofi_on,
  (greatest(sum(CASE WHEN side > 0 THEN size ELSE 0 END) OVER w, sum(CASE WHEN side < 0 THEN size ELSE 0 END) OVER w) / sum(size) OVER w >= 0.75) AS toxic,
  (abs(sum(side * size) OVER w) / sum(size) OVER w >= 0.6 OR greatest(sum(CASE WHEN side > 0 THEN size ELSE 0 END) OVER w, sum(CASE WHEN side < 0 THEN size ELSE 0 END) OVER w) / sum(size) OVER w >= 0.75) AS hybrid_any,
  (abs(sum(side * size) OVER w) / sum(size) OVER w >= 0.6 AND greatest(sum(CASE WHEN side > 0 THEN size ELSE 0 END) OVER w, sum(CASE WHEN side < 0 THEN size ELSE 0 END) OVER w) / sum(size) OVER w >= 0.75) AS hybrid_all
  FROM trade WINDOW w AS (PARTITION BY sym ORDER BY ts_ns RANGE BETWEEN 14399999999999 PRECEDING AND CURRENT ROW)"""))
def flow_filters(spark, sf_dir):
    """Imbalance and one-sidedness of the last four hours' trades, and filters on them alone and combined."""
    def one(side):
        return F.when(F.col("side") == side, F.col("size")).otherwise(0.0)

    t = trailing(mk.trades(spark, sf_dir), ["sym"], 4 * HOUR, {"net": F.col("side") * F.col("size"), "v": F.col("size"), "buy": one(1), "sell": one(-1)})
    ofi, toxic = F.abs("net") / F.col("v"), F.greatest("buy", "sell") / F.col("v") >= 0.75
    return t.select("seq", "sym", F.round(ofi, 9).alias("ofi"), (ofi >= 0.6).alias("ofi_on"), toxic.alias("toxic"),
                    ((ofi >= 0.6) | toxic).alias("hybrid_any"), ((ofi >= 0.6) & toxic).alias("hybrid_all"))


TOXIC = """tox AS (SELECT s.seq, s.sym, s.ts_ns, (SELECT round(abs(sum(t.side * t.size)) / sum(t.size), 9) FROM trade t WHERE t.sym = s.sym AND t.ts_ns <= s.ts_ns AND t.ts_ns > s.ts_ns - 3600000000000) AS toxicity FROM snap s)"""


def toxicity(spark, sf_dir) -> DataFrame:
    """Imbalance of the last hour's trades at each snapshot, null without trades."""
    t = mk.trades(spark, sf_dir).select("seq", "sym", "ts_ns", F.col("size").alias("v"), (F.col("side") * F.col("size")).alias("s"), F.lit(1).alias("kind"))
    both = mk.snapshots(spark, sf_dir).select("seq", "sym", "ts_ns", F.lit(0).alias("kind")).unionByName(t, allowMissingColumns=True)
    both = trailing(both, ["sym"], HOUR, {"sv": F.col("s"), "vv": F.col("v")}).where("kind = 0")
    return both.select("seq", "sym", "ts_ns", F.round(F.try_divide(F.abs("sv"), "vv"), 9).alias("toxicity"))


@query(sql("SELECT seq, sym, toxicity FROM tox", TOXIC))
def flow_toxicity(spark, sf_dir):
    return toxicity(spark, sf_dir).select("seq", "sym", "toxicity")


@query(sql("""SELECT seq, sym, coalesce(last_value(CASE WHEN toxicity >= 0.8 THEN ts_ns END IGNORE NULLS) OVER (PARTITION BY sym ORDER BY ts_ns, seq) + 7200000000000 > ts_ns, false) AS pulled FROM tox""", TOXIC))
def gate_mask(spark, sf_dir):
    """Quotes stay pulled for two hours after the last toxic snapshot."""
    t = toxicity(spark, sf_dir).withColumn("hit", F.when(F.col("toxicity") >= 0.8, F.col("ts_ns")))
    t = last_known(t, ["sym"], ["ts_ns", "seq"], {"hit": "last"})
    return t.select("seq", "sym", F.coalesce(F.col("last") + 2 * HOUR > F.col("ts_ns"), F.lit(False)).alias("pulled"))


@query(sql("""SELECT s.seq, s.sym, n, round(net / vol, 9) AS imbalance, round(pv / vol, 9) AS vwap, CASE WHEN n > 0 THEN round(dev, 7) END AS size_dev FROM (
  SELECT s.seq, s.sym, count(t.seq) AS n, sum(t.side * t.value) AS net, sum(t.value) AS vol, sum(t.price * t.value) AS pv, stddev_pop(t.value) AS dev
  FROM snap s LEFT JOIN (SELECT t.*, ev.value / 7 AS value FROM trade t JOIN ev USING (seq)) t ON t.sym = s.sym AND t.ts_ns <= s.ts_ns AND t.ts_ns > s.ts_ns - 3600000000000 GROUP BY ALL) s"""))
def flow_fractional(spark, sf_dir):
    """The last hour's trades at each snapshot, sizes with fractions: imbalance, volume-weighted price and deviation of sizes, null without trades."""
    t = mk.trades(spark, sf_dir, F.col("value") / 7).select("seq", "sym", "ts_ns", F.lit(1).alias("kind"), "side", "price", "size")
    both = mk.snapshots(spark, sf_dir).select("seq", "sym", "ts_ns", F.lit(0).alias("kind")).unionByName(t, allowMissingColumns=True)
    size = F.col("size")
    w = trailing(both, ["sym"], HOUR, {"net": F.col("side") * size, "vol": size, "pv": F.col("price") * size}, moments={"size": size}).where("kind = 0")
    return w.select("seq", "sym", F.col("size_n").alias("n"), F.round(F.try_divide("net", "vol"), 9).alias("imbalance"), F.round(F.try_divide("pv", "vol"), 9).alias("vwap"), F.round(F.sqrt("size_var"), 7).alias("size_dev"))


def _side(px: str, pp: str, sz: str, pz: str, up: str) -> str:
    return f"(CASE WHEN {px} {up} {pp} THEN {sz} WHEN {px} = {pp} THEN {sz} - {pz} ELSE -{pz} END)"


OFI = "ofi AS (SELECT seq, sym, ts_ns, mid, coalesce(" + " + ".join(
    f"{_side(f'bids[{l}].px', f'pb[{l}].px', f'bids[{l}].sz', f'pb[{l}].sz', '>')} - {_side(f'asks[{l}].px', f'pa[{l}].px', f'asks[{l}].sz', f'pa[{l}].sz', '<')}" for l in range(1, 11)) + """, 0) AS ofi
  FROM (SELECT *, lag(bids) OVER w AS pb, lag(asks) OVER w AS pa FROM snap WINDOW w AS (PARTITION BY sym ORDER BY ts_ns, seq)))"""


def order_flow(spark, sf_dir) -> DataFrame:
    """Order-flow imbalance over ten levels against the snapshot before; 0 at first, levels that either book lacks don't count."""
    s = mk.snapshots(spark, sf_dir).withColumn("book", F.struct("bids", "asks"))
    s = last_known(s, ["sym"], ["ts_ns", "seq"], {"book": "was"}, before=True, size=HOUR)

    def side(now: str, was: str, sign: int):
        def step(a, b):
            better = (a["px"] - b["px"]) * sign
            return F.when(a.isNull() | b.isNull(), 0.0).when(better > 0, a["sz"]).when(better == 0, a["sz"] - b["sz"]).otherwise(-b["sz"])

        return F.aggregate(F.zip_with(F.col(now), F.col(was), step), F.lit(0.0), lambda x, y: x + y)

    return s.withColumn("ofi", F.coalesce(side("bids", "was.bids", 1) - side("asks", "was.asks", -1), F.lit(0.0)))


@query(sql("SELECT seq, sym, ofi FROM ofi", OFI))
def ofi_multilevel(spark, sf_dir):
    return order_flow(spark, sf_dir).select("seq", "sym", "ofi")


@query(sql("""SELECT sym, ts_ns // 3600000000000 AS bin, sum(ofi) AS ofi, arg_max(mid, (ts_ns, seq)) AS mid_close, count(*) AS n_upd FROM ofi GROUP BY ALL""", OFI))
def ofi_bins(spark, sf_dir):
    """Summed flow, last mid and updates, by hour."""
    return order_flow(spark, sf_dir).groupBy("sym", F.expr(f"ts_ns div {HOUR}").alias("bin")).agg(
        F.sum("ofi").alias("ofi"), F.max_by("mid", F.struct("ts_ns", "seq")).alias("mid_close"), F.count("*").alias("n_upd"))


@query(sql("""SELECT sym, count(*) AS n_bins, round(corr(ofi, dm) ** 2, 8) AS r2 FROM (
  SELECT sym, ofi, mid_close - lag(mid_close) OVER (PARTITION BY sym ORDER BY bin) AS dm FROM
  (SELECT sym, ts_ns // 3600000000000 AS bin, sum(ofi) AS ofi, arg_max(mid, (ts_ns, seq)) AS mid_close FROM ofi GROUP BY ALL)) WHERE dm IS NOT NULL GROUP BY sym""", OFI))
def ofi_r2(spark, sf_dir):
    """Share of hourly mid changes that flow explains."""
    w = Window.partitionBy("sym").orderBy("bin")  # one row an hour
    b = ofi_bins(spark, sf_dir).withColumn("dm", F.col("mid_close") - F.lag("mid_close").over(w)).where("dm is not null")
    return b.groupBy("sym").agg(F.count("*").alias("n_bins"), F.round(F.pow(corr("ofi", "dm"), 2), 8).alias("r2"))


BARS = "bars AS (SELECT sym, ts_ns // 14400000000000 AS bar, arg_min(mid, (ts_ns, seq)) AS o, max(mid) AS h, min(mid) AS l, arg_max(mid, (ts_ns, seq)) AS c, count(*) AS n FROM snap GROUP BY ALL)"


def bars(spark, sf_dir, width: int = 4 * HOUR) -> DataFrame:
    at = F.struct("ts_ns", "seq")
    return mk.snapshots(spark, sf_dir).groupBy("sym", F.expr(f"ts_ns div {width}").alias("bar")).agg(
        F.min_by("mid", at).alias("o"), F.max("mid").alias("h"), F.min("mid").alias("l"), F.max_by("mid", at).alias("c"), F.count("*").alias("n"))


@query(sql("SELECT * FROM bars", BARS))
def ohlc_bars(spark, sf_dir):
    """Four-hour bars of the mid; hours without snapshots have none."""
    return bars(spark, sf_dir)


@query(sql("""SELECT sym, bar, round(r, 9) AS logret, CASE WHEN count(r) OVER w = 6 THEN round(avg(abs(r)) OVER w, 9) END AS vol, CASE WHEN count(r) OVER w = 6 THEN round(avg(r) OVER w, 9) END AS drift
  FROM (SELECT sym, bar, ln(c) - ln(lag(c) OVER (PARTITION BY sym ORDER BY bar)) AS r FROM bars) WINDOW w AS (PARTITION BY sym ORDER BY bar ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""", BARS))
def bar_features(spark, sf_dir):
    """Log returns of bars, and means over six bars, null unless all six are there."""
    w = Window.partitionBy("sym").orderBy("bar")  # a few rows a day
    six = w.rowsBetween(-5, 0)
    b = bars(spark, sf_dir).withColumn("r", F.log("c") - F.log(F.lag("c").over(w)))
    full = F.count("r").over(six) == 6
    return b.select("sym", "bar", F.round("r", 9).alias("logret"), F.when(full, F.round(F.avg(F.abs("r")).over(six), 9)).alias("vol"),
                    F.when(full, F.round(F.avg("r").over(six), 9)).alias("drift"))


GRID = """grid AS (SELECT sym, unnest(range(lo, hi + 1)) * 3600000000000 AS ts_ns FROM (SELECT sym, min(ts_ns) // 3600000000000 + 1 AS lo, max(ts_ns) // 3600000000000 AS hi FROM snap GROUP BY sym)),
gm AS (SELECT g.sym, g.ts_ns, s.mid FROM grid g ASOF JOIN snap s ON g.sym = s.sym AND g.ts_ns >= s.ts_ns),
gr AS (SELECT sym, ln(mid) - ln(lag(mid) OVER (PARTITION BY sym ORDER BY ts_ns)) AS r FROM gm)"""


@query(sql("SELECT sym, count(r) AS n, round(1e4 * stddev_samp(r), 7) AS rv_bp, round(1e4 * var_samp(r) / 8, 9) AS lvr_bp FROM gr GROUP BY sym", GRID))
def realized_vol(spark, sf_dir):
    """Volatility of hourly mids on a clock grid, and the loss of a passive provider that it implies."""
    s = mk.snapshots(spark, sf_dir)
    lim = s.groupBy("sym").agg(F.expr(f"min(ts_ns) div {HOUR} + 1").alias("lo"), F.expr(f"max(ts_ns) div {HOUR}").alias("hi"))
    hours = lim.select("sym", F.explode(F.sequence("lo", "hi")).alias("hour"))
    grid = hours.select("sym", (F.col("hour") * HOUR).alias("ts_ns"), F.lit(2**62).cast("long").alias("seq"))
    g = as_of(grid, s, ["sym"], "mid", "mid")
    r = g.withColumn("r", F.log("mid") - F.log(F.lag("mid").over(Window.partitionBy("sym").orderBy("ts_ns"))))  # one row an hour
    return r.groupBy("sym").agg(F.count("r").alias("n"), F.round(F.stddev_samp("r") * 1e4, 7).alias("rv_bp"), F.round(F.var_samp("r") * 1e4 / 8, 9).alias("lvr_bp"))


def returns_in_window(s: DataFrame, width_ns: int) -> DataFrame:
    """Adds to each row the number of mids inside (t - width, t], and count, mean and variance (r_n, r_mean, r_var) of the log returns between them."""
    s = s.withColumn("d", F.struct("mid", "ts_ns"))
    s = last_known(s, ["sym"], ["ts_ns", "seq"], {"d": "p"}, before=True)
    r = F.log("mid") - F.log("p.mid")
    # A return counts while both its ends are inside, that is until its earlier end leaves.
    return trailing(s, ["sym"], width_ns, {"n": F.lit(1)}, since={"r": F.coalesce("p.ts_ns", "ts_ns")}, moments={"r": r})


@query(sql("""SELECT seq, sym, CASE WHEN n > 1 THEN round(sqrt(greatest(0, (s2 - r0 * r0) / (n - 1) - ((s1 - r0) / (n - 1)) ** 2)), 7) END AS sigma, n FROM (
  SELECT seq, sym, count(*) OVER w AS n, sum(r) OVER w AS s1, sum(r * r) OVER w AS s2, first_value(r) OVER w AS r0 FROM
    (SELECT *, coalesce(ln(mid) - ln(lag(mid) OVER (PARTITION BY sym ORDER BY ts_ns, seq)), 0) AS r FROM snap)
  WINDOW w AS (PARTITION BY sym ORDER BY ts_ns RANGE BETWEEN 86399999999999 PRECEDING AND CURRENT ROW))"""))
def rolling_sigma(spark, sf_dir):
    """Population deviation of the log returns between mids of the last day."""
    s = returns_in_window(mk.snapshots(spark, sf_dir), mk.DAY_NS)
    return s.select("seq", "sym", F.when(F.col("r_n") > 0, F.round(F.sqrt("r_var"), 7)).alias("sigma"), "n")


@query(sql("""SELECT sym, win, is_from, count(CASE WHEN ts_ns < oos_from THEN 1 END) AS n_is, count(CASE WHEN ts_ns >= oos_from THEN 1 END) AS n_oos FROM (
  SELECT lo, k AS win, t0 + k * 172800000000000 AS is_from, t0 + k * 172800000000000 + 432000000000000 AS oos_from FROM (SELECT min(ts_ns) AS t0, max(ts_ns) AS t1, 0 AS lo FROM snap), (SELECT unnest(range(0, 100)) AS k)
  WHERE t0 + k * 172800000000000 + 604800000000000 <= t1) w JOIN snap ON ts_ns >= is_from AND ts_ns < is_from + 604800000000000 GROUP BY ALL""".replace("SELECT lo, k AS win", "SELECT k AS win")))
def wfo_windows(spark, sf_dir):
    """Walk-forward windows of five days in and two days out of sample, and the snapshots of each."""
    s = mk.snapshots(spark, sf_dir)
    n_in, n_out = 5 * mk.DAY_NS, 2 * mk.DAY_NS
    lim = s.agg(F.min("ts_ns").alias("t0"), F.max("ts_ns").alias("t1"))
    k = F.expr(f"(ts_ns - t0) div {n_out}")
    # A row is in a few windows, found by arithmetic and not by a range join.
    s = s.join(F.broadcast(lim), how="cross").withColumn("win", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), k - (n_in + n_out) // n_out), k)))
    s = s.withColumn("is_from", F.col("t0") + F.col("win") * n_out).where(f"ts_ns < is_from + {n_in + n_out} and is_from + {n_in + n_out} <= t1")
    inside = F.col("ts_ns") < F.col("is_from") + n_in
    return s.groupBy("sym", "win", "is_from").agg(F.count(F.when(inside, 1)).alias("n_is"), F.count(F.when(~inside, 1)).alias("n_oos"))


@query(sql("SELECT CASE WHEN ts_ns <= cut THEN 'train' ELSE 'holdout' END AS part, count(*) AS n, max(ts_ns) AS last_ns FROM ev, (SELECT max(ts_ns) - 259200000000000 AS cut FROM ev) GROUP BY ALL"))
def carve_holdout(spark, sf_dir):
    """The last three days apart from the rest."""
    e = mk.events(spark, sf_dir)
    cut = e.agg((F.max("ts_ns") - 3 * mk.DAY_NS).alias("cut"))
    part = F.when(F.col("ts_ns") <= F.col("cut"), "train").otherwise("holdout")
    return e.join(F.broadcast(cut), how="cross").groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.max("ts_ns").alias("last_ns"))


@query(sql("""SELECT bin, """ + ", ".join(f"max(CASE WHEN root = {r} THEN m END) AS r{r}" for r in range(3)) + """ FROM
  (SELECT ts_ns // 86400000000000 AS bin, user_id % 3 AS root, avg(mid) AS m FROM snap GROUP BY ALL) GROUP BY bin HAVING count(*) = 3"""))
def panel_inner_join(spark, sf_dir):
    """Daily means of three roots side by side, for the days that all of them have."""
    p = mk.snapshots(spark, sf_dir).withColumns({"bin": block(), "root": F.expr("user_id % 3")})
    p = p.groupBy("bin").pivot("root", [0, 1, 2]).agg(F.avg("mid")).withColumnsRenamed({str(r): f"r{r}" for r in range(3)})
    return p.where("r0 is not null and r1 is not null and r2 is not null")


@query(sql("""SELECT user_id, d, n FROM (SELECT user_id, ts_ns // 86400000000000 AS d, count(*) AS n FROM snap GROUP BY ALL) s
  WHERE EXISTS (SELECT 1 FROM trade t WHERE t.user_id = s.user_id AND t.ts_ns // 86400000000000 = s.d)"""))
def semi_join_control(spark, sf_dir):
    """Snapshots of the users and days that have trades as well."""
    keys = ["user_id", "d"]
    s = mk.snapshots(spark, sf_dir).withColumn("d", block()).groupBy(*keys).agg(F.count("*").alias("n"))
    return s.join(mk.trades(spark, sf_dir).withColumn("d", block()).select(*keys), keys, "left_semi")


@query(sql("""SELECT seq, sym, n_levels, round(0.5e0 + 0.25e0 * (n_levels - 1), 9) AS last_even, round(0.5e0 * 1.5e0 ** (n_levels - 1), 9) AS last_geometric FROM (
  SELECT seq, sym, greatest(1, round_even(5 * (1 - least(greatest((abs(size * side) - 3) / 3e0, 0), 1)), 0)::INT) AS n_levels FROM trade)"""))
def quote_shapes(spark, sf_dir):
    """Ladders whose depth tapers with the size of each trade, taken as an inventory."""
    n = q.shape_depth(F.col("size") * F.col("side"), 5, 3.0)
    t = mk.trades(spark, sf_dir).withColumn("n_levels", n)
    half = F.lit(0.5)
    return t.select("seq", "sym", "n_levels", F.round(F.element_at(q.shape_levels(half, 0.25, F.col("n_levels")), -1), 9).alias("last_even"),
                    F.round(F.element_at(q.shape_geometric(half, 1.5, F.col("n_levels")), -1), 9).alias("last_geometric"))


@query(sql("""SELECT seq, sym, round(-0.1e0 * i, 9) AS linear, round(-sign(i) * 0.1e0 * i * i, 9) AS quadratic, round(-sign(i) * 0.1e0 * (exp(abs(i) / 4e0) - 1), 9) AS exponential,
  round(CASE WHEN i >= 0 THEN -0.1e0 * i ELSE -0.05e0 * i END, 9) AS asymmetric, round(-0.1e0 * i - CASE WHEN abs(i) > 4 THEN sign(i) * 0.1e0 * 4 * (abs(i) / 4e0 - 1) ** 2 ELSE 0 END, 9) AS soft_cap,
  i < 6 AS bid_allowed, i > -6 AS ask_allowed FROM (SELECT seq, sym, size * side AS i FROM trade)"""))
def inventory_penalties(spark, sf_dir):
    """Every penalty of an inventory, here each trade's signed size."""
    i = F.col("i")
    cols = {"linear": q.penalty_linear(i, 0.1), "quadratic": q.penalty_quadratic(i, 0.1), "exponential": q.penalty_exponential(i, 0.1, 4.0),
            "asymmetric": q.penalty_asymmetric(i, 0.1, 0.05), "soft_cap": q.penalty_soft_cap(i, 0.1, 4.0)}
    t = mk.trades(spark, sf_dir).withColumn("i", F.col("size") * F.col("side"))
    return t.select("seq", "sym", *[F.round(c, 9).alias(n) for n, c in cols.items()], (i < 6).alias("bid_allowed"), (i > -6).alias("ask_allowed"))


@query(sql("""SELECT seq, sym, bids[1 + least(9, greatest(0, round_even(2 * (bid - (mid - 1.6e0)), 0)::INT))].px AS bid, asks[1 + least(9, greatest(0, round_even(2 * (mid + 1.6e0 - ask), 0)::INT))].px AS ask FROM snap"""))
def level_snap(spark, sf_dir):
    """Quotes 1.6 from the mid, moved to the nearest visible level."""
    s = mk.snapshots(spark, sf_dir)
    return s.select("seq", "sym", q.nearest_level(F.col("bids"), q.mid() - 1.6).alias("bid"), q.nearest_level(F.col("asks"), q.mid() + 1.6).alias("ask"))
