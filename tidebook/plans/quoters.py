"""Quoters side by side in one book: fixed prices, reference prices with a half spread, leaning on flow, wider in wild times; what they cost and how two compare."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.functions import quotes as q
from tidebook.operators import fills as sim
from tidebook.operators.ranking import quantiles
from tidebook.operators.timeline import looked_up, running_sum
from tidebook.sources import market as mk
from tidebook.sources.storage import stored

from .fills import FILLS, LOOKUP, SIZE, with_mids
from .registry import query, sql
from .tape import OFI, order_flow, returns_in_window

DAY = mk.DAY_NS
#: Quoters by the number that their orders carry.
TOUCH, CONSTANT, SYMMETRIC, MICRO, SKEW, WIDEN = range(6)
#: Prices of the fixed quoter, half spread of those around a reference, weight of flow in the lean, deviation from which times are wild.
FIXED, HALF, LEAN, WILD = (99.5, 100.5), 0.5, 1e-12, 0.01
#: Costs of a side as shares of notional, and the delay that a mark is tried with.
MAKER, SLIP, LATENCY_NS = 0.00002, 0.00001, 5 * 10**9
CORPUS_FEE, CORPUS_SLIP = 0.0002, 0.0002

_LEVEL = "CASE WHEN {side} = 1 THEN {b} ELSE {a} END"
QUOTES = f"""seen AS (SELECT s.*, o.ofi, g.sigma, s.mid + (bsz - asz) / (bsz + asz) * (ask - bid) / 2 AS micro FROM snap s JOIN ofi o USING (seq) JOIN sig g ON g.seq = s.seq),
quotes AS (SELECT sym, seq, ts_ns, side, px, {SIZE}e0 AS size, idx FROM (
  SELECT sym, seq, ts_ns, side, idx, CASE idx
    WHEN {TOUCH} THEN {_LEVEL.format(side='side', b='bid', a='ask')}
    WHEN {CONSTANT} THEN {_LEVEL.format(side='side', b=f'{FIXED[0]}e0', a=f'{FIXED[1]}e0')}
    WHEN {SYMMETRIC} THEN mid - side * {HALF}e0
    WHEN {MICRO} THEN micro - side * {HALF}e0
    WHEN {SKEW} THEN CASE WHEN side * (micro - mid + {LEAN} * ofi) >= 0 THEN {_LEVEL.format(side='side', b='bid', a='ask')} END
    WHEN {WIDEN} THEN CASE WHEN coalesce(sigma >= {WILD}, false) THEN {_LEVEL.format(side='side', b='bids[2].px', a='asks[2].px')} ELSE {_LEVEL.format(side='side', b='bid', a='ask')} END END AS px
  FROM seen, (SELECT unnest([1, -1]) AS side) d, (SELECT unnest(range(6)) AS idx) i) WHERE px IS NOT NULL)"""
SIGMA = """sig AS (SELECT seq, CASE WHEN n > 1 THEN round(sqrt(greatest(0, (s2 - r0 * r0) / (n - 1) - ((s1 - r0) / (n - 1)) ** 2)), 7) END AS sigma FROM (
  SELECT seq, count(*) OVER w AS n, sum(r) OVER w AS s1, sum(r * r) OVER w AS s2, first_value(r) OVER w AS r0 FROM
    (SELECT *, coalesce(ln(mid) - ln(lag(mid) OVER (PARTITION BY sym ORDER BY ts_ns, seq)), 0) AS r FROM snap)
  WINDOW w AS (PARTITION BY sym ORDER BY ts_ns RANGE BETWEEN 86399999999999 PRECEDING AND CURRENT ROW)))"""
ALL_FILLS = (OFI, SIGMA, QUOTES, LOOKUP, FILLS)


def signals(spark, sf_dir) -> DataFrame:
    """Snapshots with flow and whether times are wild. Books stay out of the windows of a day: what those find comes by snapshot."""
    s = order_flow(spark, sf_dir).select("seq", "sym", "ts_ns", "mid", "ofi")
    s = returns_in_window(s, DAY)
    wild = F.coalesce(F.when(F.col("r_n") > 0, F.round(F.sqrt("r_var"), 7)) >= WILD, F.lit(False))
    return looked_up(mk.snapshots(spark, sf_dir), s.select("seq", "sym", "ts_ns", "ofi", wild.alias("wild")), ["sym", "ts_ns", "seq"], ["ofi", "wild"])


def all_quoters(spark, sf_dir) -> DataFrame:
    """Fills of all quoters; idx is the quoter. Orders at prices that the book doesn't show are not placed."""
    s = signals(spark, sf_dir)
    mid, micro, size, wild = q.mid(), q.microprice(), F.lit(SIZE), F.col("wild")
    orders = []
    for side in (1, -1):
        touch, deep = mk.best("bids" if side == 1 else "asks"), mk.best("bids" if side == 1 else "asks", level=1)
        leans = side * (micro - mid + LEAN * F.col("ofi")) >= 0
        prices = {TOUCH: touch, CONSTANT: F.lit(FIXED[0] if side == 1 else FIXED[1]), SYMMETRIC: mid - side * HALF, MICRO: micro - side * HALF, SKEW: F.when(leans, touch), WIDEN: F.when(wild, deep).otherwise(touch)}
        orders += [q.order(side, px, size, idx) for idx, px in prices.items()]
    return sim.fills(mk.trades(spark, sf_dir), sim.resting(s, F.array(*orders)))


@query(sql("SELECT idx::INT AS quoter, seq, sym, ts_ns, interval, side, price, size FROM fills", *ALL_FILLS))
def quoter_fills(spark, sf_dir):
    """Fills of six quoters that rest in the book at once and do not see each other."""
    return all_quoters(spark, sf_dir).select(F.col("idx").alias("quoter"), "seq", "sym", "ts_ns", "interval", "side", "price", "size")


_MIDS = "timed AS (SELECT f.*, a.mid AS m0, b.mid AS m10, c.mid AS l0, d.mid AS l10 FROM fills f" + "".join(
    f" ASOF LEFT JOIN snap {k} ON f.sym = {k}.sym AND f.ts_ns + {v} >= {k}.ts_ns" for k, v in (("a", 0), ("b", 10 * 10**9), ("c", LATENCY_NS), ("d", LATENCY_NS + 10 * 10**9))) + ")"
_UP = "round({}::DECIMAL(38, 12), 3)::DOUBLE"


def timed(spark, sf_dir) -> DataFrame:
    f = stored(all_quoters(spark, sf_dir), "quoter-fills")
    return with_mids(f, mk.snapshots(spark, sf_dir), {"10s": 10 * 10**9, "l0": LATENCY_NS, "l10": LATENCY_NS + 10 * 10**9})


@query(sql(f"""SELECT idx::INT AS quoter, count(*) AS n_fills, {_UP.format('avg(-1e4 * side * (m10 - price) / m0)')} AS realised_bp, {_UP.format(f'avg(-1e4 * side * (m10 - price) / m0 - {(MAKER + SLIP) * 1e4!r}e0)')} AS net_bp,
  {_UP.format(f'avg(-1e4 * side * (m10 - price) / m0 - {2 * (MAKER + SLIP) * 1e4!r}e0)')} AS round_trip_bp, {_UP.format(f'avg(-1e4 * side * (l10 - price) / l0 - {2 * (MAKER + SLIP) * 1e4!r}e0)')} AS late_bp,
  {_UP.format(f'sum(size * price) * {CORPUS_FEE}')} AS fees, {_UP.format(f'sum(size * price) * {CORPUS_SLIP}')} AS slippage FROM timed GROUP BY idx""", *ALL_FILLS, _MIDS))
def quoter_nets(spark, sf_dir):
    """By quoter: realised spread after ten seconds in bp, net of one side's costs, of a round trip's, and of those with marks that come late; and fees and slippage at a corpus's flat rates. Rounded half up."""
    m = timed(spark, sf_dir)
    gross, late = -1e4 * F.col("side") * (F.col("m10s") - F.col("price")) / F.col("m0"), -1e4 * F.col("side") * (F.col("ml10") - F.col("price")) / F.col("ml0")
    up = lambda c: F.round(c.cast("decimal(38,12)"), 3).cast("double")
    side = (MAKER + SLIP) * 1e4
    notional = F.sum(F.col("size") * F.col("price"))
    return m.groupBy(F.col("idx").alias("quoter")).agg(
        F.count("*").alias("n_fills"), up(F.avg(gross)).alias("realised_bp"), up(F.avg(gross - side)).alias("net_bp"), up(F.avg(gross - 2 * side)).alias("round_trip_bp"), up(F.avg(late - 2 * side)).alias("late_bp"),
        up(notional * CORPUS_FEE).alias("fees"), up(notional * CORPUS_SLIP).alias("slippage"))


#: Days of a window, and how much mean profit two quoters may differ by to count as equal.
SPAN, TOLERANCE = 2 * DAY, 50.0


@query(sql(f"""SELECT quoter::INT AS quoter, count(*) AS n_windows, round(avg(base - cvar), 9) AS cvar_reduction, round(abs(avg(pnl) - avg(base_pnl)), 6) AS pnl_diff, avg(base - cvar) > 0 AND abs(avg(pnl) - avg(base_pnl)) <= {TOLERANCE} AS passes FROM
  (SELECT c.idx AS quoter, c.cvar, c.pnl, b.cvar AS base, b.pnl AS base_pnl FROM cells c JOIN cells b ON b.win = c.win AND b.idx = {TOUCH} WHERE c.idx != {TOUCH}) GROUP BY quoter""", *ALL_FILLS, _MIDS,
           f"""paths AS (SELECT idx, win, pnl, abs(sum(size * side) OVER (PARTITION BY idx, sym, win ORDER BY ts_ns, seq)) AS a FROM (SELECT *, ts_ns // {SPAN} AS win, size * side * (m10 - price) - size * price * {MAKER} AS pnl FROM timed))""",
           "cells AS (SELECT idx, win, avg(a) FILTER (a >= cut) AS cvar, sum(pnl) AS pnl FROM (SELECT *, quantile_cont(a, 0.95) OVER (PARTITION BY idx, win) AS cut FROM paths) GROUP BY ALL)"))
def quoter_compare(spark, sf_dir):
    """Each quoter against the touch, window by window: how much less its largest inventories are, and whether mean profits are about equal."""
    m = timed(spark, sf_dir).withColumns({"win": F.expr(f"ts_ns div {SPAN}"), "signed": F.col("size") * F.col("side"), "pnl": F.col("size") * F.col("side") * (F.col("m10s") - F.col("price")) - F.col("size") * F.col("price") * MAKER})
    a = running_sum(m, ["idx", "sym", "win"], ["ts_ns", "seq"], {"signed": "inv"}).select("idx", "win", "pnl", F.abs("inv").alias("a"))
    a = stored(a, "quoter-inventories")
    cut = quantiles(a, ["idx", "win"], "a", {"cut": 0.95}).drop("n")
    cells = stored(a.join(cut, ["idx", "win"]).groupBy("idx", "win").agg(F.avg(F.when(F.col("a") >= F.col("cut"), F.col("a"))).alias("cvar"), F.sum("pnl").alias("pnl")), "quoter-windows")
    base = cells.where(F.col("idx") == TOUCH).select("win", F.col("cvar").alias("base"), F.col("pnl").alias("base_pnl"))
    less, diff = F.avg(F.col("base") - F.col("cvar")), F.abs(F.avg("pnl") - F.avg("base_pnl"))
    return cells.where(F.col("idx") != TOUCH).join(base, "win").groupBy(F.col("idx").alias("quoter")).agg(
        F.count("*").alias("n_windows"), F.round(less, 9).alias("cvar_reduction"), F.round(diff, 6).alias("pnl_diff"), ((less > 0) & (diff <= TOLERANCE)).alias("passes"))
