"""Nested walk-forward: many configurations from one scan, chosen on one stretch of time and scored on the next."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidebook.functions import quotes as q
from tidebook.operators import fills as sim
from tidebook.operators.timeline import last_known
from tidebook.sources import market as mk
from tidebook.sources.storage import stored

from .fills import FILLS, LOOKUP, MARK, TOUCHED, markouts, marked, quoted, with_mids
from .registry import query, sql
from .tape import TOXIC, toxicity

HOUR, DAY = mk.HOUR_NS, mk.DAY_NS
FEE_BP = 0.015
#: A gate's window, of which the first half chooses and the second is scored; its settings in order of preference.
SPAN = 6 * DAY
GATES = [(th, cd) for th in (0.3, 0.6, 0.8) for cd in (0, 1, 3)]
#: Least fills that a setting is judged by, and the share of fills that a gate must keep.
LEAST, KEEP = 5, 0.5


def _lasts() -> str:
    return ", ".join(f"last_value(CASE WHEN toxicity >= {th}e0 THEN ts_ns END IGNORE NULLS) OVER (PARTITION BY sym ORDER BY ts_ns, seq) AS last{k}" for k, th in enumerate(dict.fromkeys(t for t, _ in GATES)))


_TH = list(dict.fromkeys(t for t, _ in GATES))
_PULLED = "[" + ", ".join(f"coalesce(last{_TH.index(th)} + {max(1, cd * HOUR)} > ts_ns, false)" for th, cd in GATES) + "]"


@query(sql(f"""SELECT sym, win, [{', '.join(f'{t}e0' for t, _ in GATES)}][g + 1] AS threshold, [{', '.join(str(c) for _, c in GATES)}][g + 1]::INT AS cooldown_h, round(is_bp, 9) AS is_bp, pulled, base_n, gate_n, round(base_bp, 9) AS base_bp, round(gate_bp, 9) AS gate_bp,
  coalesce(gate_bp > base_bp AND gate_n > {KEEP} * base_n, false) AS passes FROM best JOIN scored USING (sym, win, g) JOIN shares USING (sym, win, g)""", *TOUCHED, MARK, TOXIC,
           f"lasts AS (SELECT seq, sym, ts_ns, {_lasts()} FROM tox)",
           f"gated AS (SELECT seq, sym, (ts_ns - (SELECT min(ts_ns) FROM snap)) // {SPAN} AS win, 2 * ((ts_ns - (SELECT min(ts_ns) FROM snap)) % {SPAN}) >= {SPAN} AS late, {_PULLED} AS pulled FROM lasts)",
           f"each AS (SELECT f.sym, win, late, g, x, pulled[g + 1] AS out FROM (SELECT sym, interval, 1e4 * side * (m1h - price) / m0 - {FEE_BP}e0 AS x FROM marks) f JOIN gated s ON s.seq = f.interval, (SELECT unnest(range({len(GATES)})) AS g) WHERE x IS NOT NULL)",
           f"""best AS (SELECT sym, win, g, is_bp FROM (SELECT sym, win, g, avg(x) AS is_bp, row_number() OVER (PARTITION BY sym, win ORDER BY round(avg(x), 9) DESC, g) AS k FROM each WHERE NOT late AND NOT out GROUP BY sym, win, g HAVING count(*) >= {LEAST}) WHERE k = 1)""",
           """scored AS (SELECT sym, win, g, count(*) AS base_n, count(*) FILTER (NOT out) AS gate_n, avg(x) AS base_bp, avg(x) FILTER (NOT out) AS gate_bp FROM each WHERE late GROUP BY ALL)""",
           f"""shares AS (SELECT sym, win, g, round(avg(pulled[g + 1]::INT), 9) AS pulled FROM gated, (SELECT unnest(range({len(GATES)})) AS g) WHERE late GROUP BY ALL)"""))
def nested_gate(spark, sf_dir):
    """By symbol and window: the gate on one-sided flow that did best in the window's first half, and what it does to the second half's fills against quoting always.

    A pulled snapshot has no orders, and orders live for one snapshot, so a gate's fills are the fills of the snapshots that it leaves: all
    settings are judged from one set of fills and one pass over the snapshots.
    """
    t = toxicity(spark, sf_dir).withColumns({f"hit{k}": F.when(F.col("toxicity") >= th, F.col("ts_ns")) for k, th in enumerate(_TH)})
    t = last_known(t, ["sym"], ["ts_ns", "seq"], {f"hit{k}": f"last{k}" for k in range(len(_TH))})
    t0 = mk.snapshots(spark, sf_dir).agg(F.min("ts_ns").alias("t0"))
    pulled = F.array(*[F.coalesce(F.col(f"last{_TH.index(th)}") + max(1, cd * HOUR) > F.col("ts_ns"), F.lit(False)) for th, cd in GATES])
    s = t.join(F.broadcast(t0), how="cross").select(F.col("seq").alias("interval"), "sym", F.expr(f"(ts_ns - t0) div {SPAN}").alias("win"), F.expr(f"2 * ((ts_ns - t0) % {SPAN}) >= {SPAN}").alias("late"), pulled.alias("pulled"))  # one row
    s = stored(s, "gates")
    f = marked(spark, sf_dir).select("interval", (F.col("markout_1h") * 1e4 - FEE_BP).alias("x")).where("x is not null").join(s, "interval")
    per = f.select("sym", "win", "late", "x", F.posexplode("pulled").alias("g", "out"))
    left = F.when(~F.col("out"), F.col("x"))
    cells = stored(per.groupBy("sym", "win", "g", "late").agg(F.count("*").alias("base_n"), F.count(left).alias("gate_n"), F.avg("x").alias("base_bp"), F.avg(left).alias("gate_bp")), "gate-cells")
    choice = Window.partitionBy("sym", "win").orderBy(F.desc(F.round("gate_bp", 9)), "g")  # one row a setting
    best = cells.where(f"not late and gate_n >= {LEAST}").withColumn("k", F.row_number().over(choice)).where("k = 1").select("sym", "win", "g", F.col("gate_bp").alias("is_bp"))
    share = s.where("late").select("sym", "win", F.posexplode("pulled").alias("g", "out")).groupBy("sym", "win", "g").agg(F.round(F.avg(F.col("out").cast("int")), 9).alias("pulled"))
    out = best.join(cells.where("late"), ["sym", "win", "g"]).join(share, ["sym", "win", "g"])
    of = F.get(F.array(*[F.struct(F.lit(th).alias("th"), F.lit(cd).alias("cd")) for th, cd in GATES]), F.col("g"))
    return out.select("sym", "win", of["th"].alias("threshold"), of["cd"].alias("cooldown_h"), F.round("is_bp", 9).alias("is_bp"), "pulled", "base_n", "gate_n", F.round("base_bp", 9).alias("base_bp"), F.round("gate_bp", 9).alias("gate_bp"),
                      F.coalesce((F.col("gate_bp") > F.col("base_bp")) & (F.col("gate_n") > KEEP * F.col("base_n")), F.lit(False)).alias("passes"))


#: Families of quoters by the level that they join, and sizes; each size is also tried doubled.
LEVELS, SIZES, TOP = (0, 1), (1, 2, 4), 3
ALL_SIZES = sorted({s * k for s in SIZES for k in (1, 2)})
STRETCH = 2 * DAY
#: Slippage in basis points, and what costs are made worse by.
SLIP_BP, WORSE = 0.02, 1.5
_CFG = ", ".join(f"({level}, {size})" for level in LEVELS for size in ALL_SIZES)


@query(sql(f"""SELECT p.family::INT AS family, p.win, picks, round(is_bp, 9) AS is_bp, round(p.sigma, 9) AS sigma_micro, sum(n) AS oos_n, round(sum(s) / sum(n), 9) AS oos_bp FROM
  (SELECT family, win, string_agg(size::VARCHAR, ',' ORDER BY k) AS picks, max(bp) AS is_bp, avg(sigma) AS sigma FROM chosen WHERE k <= {TOP} GROUP BY ALL) p
  JOIN chosen c ON c.family = p.family AND c.win = p.win AND c.k <= {TOP} JOIN grid o ON o.family = c.family AND o.size = c.size AND o.win = c.win + 1 GROUP BY p.family, p.win, picks, is_bp, p.sigma""",
           f"quotes AS (SELECT sym, seq, ts_ns, side, CASE WHEN side = 1 THEN bids[level + 1].px ELSE asks[level + 1].px END AS px, size::DOUBLE AS size, level * 100 + size AS idx FROM snap, (SELECT * FROM (VALUES {_CFG}) AS c(level, size)) c, (SELECT unnest([1, -1]) AS side) d)",
           LOOKUP, FILLS, MARK,
           f"grid AS (SELECT idx // 100 AS family, idx % 100 AS size, (ts_ns - (SELECT min(ts_ns) FROM snap)) // {STRETCH} AS win, count(*) AS n, sum(1e4 * side * (m1h - price) / m0 - {FEE_BP + SLIP_BP}e0) AS s FROM marks GROUP BY ALL)",
           f"""tried AS (SELECT g.family, g.size, g.win, g.s / g.n AS bp, sqrt(list_var_pop([g.s / g.n, g.s / g.n - {FEE_BP * (WORSE - 1)}e0, g.s / g.n - {SLIP_BP * (WORSE - 1)}e0, d.s / d.n])) AS sigma FROM grid g JOIN grid d ON d.family = g.family AND d.win = g.win AND d.size = 2 * g.size WHERE g.size IN {SIZES})""",
           "chosen AS (SELECT *, row_number() OVER (PARTITION BY family, win ORDER BY round(bp, 9) DESC, size) AS k FROM tried)"))
def config_walk(spark, sf_dir):
    """By family of quoters and window: the sizes that did best in it, how far their net moves when costs and sizes are made worse, and the next window's net of their fills together.

    All configurations rest in one book at once, told apart by a number, so events are read once for all of them.
    """
    side = lambda s, level, size: q.at_level(s, F.lit(float(size)), level, level * 100 + size)
    orders = F.array(*[side(s, level, size) for level in LEVELS for size in ALL_SIZES for s in (1, -1)])
    f = stored(sim.fills(mk.trades(spark, sf_dir), quoted(spark, sf_dir, orders)), "grid-fills")
    m = markouts(with_mids(f, mk.snapshots(spark, sf_dir), {"1h": HOUR}), {"1h": HOUR})
    t0 = mk.snapshots(spark, sf_dir).agg(F.min("ts_ns").alias("t0"))
    m = m.join(F.broadcast(t0), how="cross")  # one row
    grid = stored(m.groupBy(F.expr("idx div 100").cast("int").alias("family"), F.expr("idx % 100").alias("size"), F.expr(f"(ts_ns - t0) div {STRETCH}").alias("win")).agg(
        F.count("*").alias("n"), F.sum(F.col("markout_1h") * 1e4 - (FEE_BP + SLIP_BP)).alias("s")), "grid")
    double = grid.select("family", "win", (F.col("size") / 2).cast("int").alias("size"), (F.col("s") / F.col("n")).alias("doubled"))
    bp = F.col("s") / F.col("n")
    tried = grid.where(F.col("size").isin(*SIZES)).join(double, ["family", "win", "size"]).withColumns({"bp": bp, "all": F.array(bp, bp - FEE_BP * (WORSE - 1), bp - SLIP_BP * (WORSE - 1), "doubled")})
    mean = F.expr("aggregate(all, 0D, (a, x) -> a + x) / size(all)")
    tried = tried.withColumn("mean", mean).withColumn("sigma", F.sqrt(F.expr("aggregate(all, 0D, (a, x) -> a + (x - mean) * (x - mean)) / size(all)")))
    best = Window.partitionBy("family", "win").orderBy(F.desc(F.round("bp", 9)), "size")  # one row a size
    chosen = tried.withColumn("k", F.row_number().over(best)).where(F.col("k") <= TOP).select("family", "win", "size", "k", "bp", "sigma")
    ahead = grid.select("family", "size", (F.col("win") - 1).alias("win"), "n", "s")
    per = chosen.groupBy("family", "win").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "size"))), lambda c: c["size"].cast("string")), ",").alias("picks"), F.max("bp").alias("is_bp"), F.avg("sigma").alias("sigma"))  # TOP rows
    out = chosen.join(ahead, ["family", "win", "size"]).groupBy("family", "win").agg(F.sum("n").alias("oos_n"), F.sum("s").alias("oos_s"))
    return per.join(out, ["family", "win"]).select("family", "win", "picks", F.round("is_bp", 9).alias("is_bp"), F.round("sigma", 9).alias("sigma_micro"), "oos_n", F.round(F.col("oos_s") / F.col("oos_n"), 9).alias("oos_bp"))
