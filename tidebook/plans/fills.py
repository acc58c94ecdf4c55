"""Queries on simulated fills."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebook.functions import quotes as q
from tidebook.operators import fills as sim
from tidebook.operators.ranking import quantiles
from tidebook.operators.timeline import as_of, block, last_known, running_sum
from tidebook.sources import market as mk
from tidebook.sources.storage import stored

from .registry import query, sql

SIZE = 3.0


def touch_orders(size: float = SIZE):
    s = F.lit(size)
    return F.array(q.at_level(1, s), q.at_level(-1, s))


def quoted(spark: SparkSession, sf_dir: str, orders, queued: bool = True) -> DataFrame:
    return sim.resting(mk.snapshots(spark, sf_dir), orders, queued)


def touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sim.fills(mk.trades(spark, sf_dir), quoted(spark, sf_dir, touch_orders()))


def touch_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, for plans that read fills more than once: they are few against the events that they come from."""
    return stored(touch(spark, sf_dir), "touch-fills")


OUT = ["seq", "sym", "ts_ns", "interval", "side", "price", "size", "idx"]
#: From orders(sym, seq, ts_ns, side, px, size, idx, queue): fills(seq, sym, ts_ns, user_id, interval, side, price, size, idx).
FILLS = """
snaps_now AS (SELECT t.seq, t.sym, t.ts_ns, t.user_id, t.side, t.price, t.size, s.seq AS interval FROM trade t
  ASOF JOIN snap s ON t.sym = s.sym AND t.ts_ns >= s.ts_ns),
hits AS (SELECT n.*, o.px, o.side AS oside, o.size AS osize, o.idx, o.queue,
    sum(n.size) OVER (PARTITION BY n.sym, n.interval, o.side, o.idx ORDER BY n.ts_ns, n.seq) AS c
  FROM snaps_now n JOIN orders o ON o.sym = n.sym AND o.seq = n.interval AND n.side = -o.side AND abs(n.price - o.px) <= 1e-9),
fills AS (SELECT * FROM (SELECT seq, sym, ts_ns, user_id, interval, oside AS side, px AS price,
    least(osize, greatest(0, c - queue)) - least(osize, greatest(0, c - size - queue)) AS size, idx FROM hits) WHERE size > 0)"""
#: The same with the queue looked up in the book.
LOOKUP = """
orders AS (SELECT * FROM (SELECT q.*, list_filter(CASE WHEN q.side = 1 THEN s.bids ELSE s.asks END, lambda l: abs(l.px - q.px) <= 1e-9)[1].sz AS queue
  FROM quotes q JOIN snap s USING (sym, seq)) WHERE queue IS NOT NULL)"""
TOUCH = """
quotes AS (SELECT sym, seq, ts_ns, 1 AS side, bid AS px, 3e0 AS size, 0 AS idx FROM snap
  UNION ALL SELECT sym, seq, ts_ns, -1, ask, 3e0, 0 FROM snap)"""
TAKE = "SELECT seq, sym, ts_ns, interval, side, price, size, idx FROM fills"
TOUCHED = (TOUCH, LOOKUP, FILLS)


@query(sql(TAKE, *TOUCHED))
def touch_fills(spark, sf_dir):
    """Both sides at the touch."""
    return touch(spark, sf_dir).select(OUT)


@query(sql(TAKE, "quotes AS (SELECT sym, seq, ts_ns, 1 AS side, bids[2].px AS px, 3e0 AS size, 0 AS idx FROM snap UNION ALL SELECT sym, seq, ts_ns, -1, ask, 3e0, 0 FROM snap)", LOOKUP, FILLS))
def depth_skew_fills(spark, sf_dir):
    """Bid one level behind the touch (at it, if there is only one), ask at the touch."""
    bid, queue = (F.coalesce(mk.best("bids", x, 1), mk.best("bids", x)) for x in ("px", "sz"))
    orders = F.array(q.order(1, bid, F.lit(SIZE), 0, queue), q.at_level(-1, F.lit(SIZE)))
    return sim.fills(mk.trades(spark, sf_dir), quoted(spark, sf_dir, orders)).select(OUT)


@query(sql("SELECT rank, side, count(*) AS n_fills, sum(size) AS qty FROM (" + TAKE.replace("idx", "idx AS rank") + ") GROUP BY ALL",
           "quotes AS (SELECT sym, seq, ts_ns, 1 AS side, bids[r].px AS px, 3e0 AS size, r AS idx FROM snap, (SELECT unnest(range(1, 6))::INT AS r) UNION ALL SELECT sym, seq, ts_ns, -1, asks[r].px, 3e0, r FROM snap, (SELECT unnest(range(1, 6))::INT AS r))",
           LOOKUP, FILLS))
def rank_fills(spark, sf_dir):
    """Orders at depth ranks 1 to 5 on both sides, each with its own queue; fills by rank and side."""
    s = F.lit(SIZE)
    orders = F.array(*[q.at_level(side, s, r - 1, r) for side in (1, -1) for r in range(1, 6)])
    found = sim.fills(mk.trades(spark, sf_dir), quoted(spark, sf_dir, orders))
    return found.groupBy(F.col("idx").alias("rank"), "side").agg(F.count("*").alias("n_fills"), F.sum("size").alias("qty"))


@query(sql(TAKE, "quotes AS (SELECT sym, seq, ts_ns, 1 AS side, bid AS px, 3e0 AS size, 0 AS idx FROM snap WHERE bsz >= asz UNION ALL SELECT sym, seq, ts_ns, -1, ask, 3e0, 0 FROM snap WHERE bsz <= asz)", LOOKUP, FILLS))
def microskew_fills(spark, sf_dir):
    """Only the bid where the microprice leans up, only the ask where it leans down, both where it doesn't lean."""
    lean, s = q.microprice() - q.mid(), F.lit(SIZE)
    orders = F.array(q.at_level(1, s, when=lean >= 0), q.at_level(-1, s, when=lean <= 0))
    return sim.fills(mk.trades(spark, sf_dir), quoted(spark, sf_dir, orders)).select(OUT)


NAIVE = """
naive AS (SELECT * FROM (SELECT seq, sym, ts_ns, interval, side, px AS price, least(osize, c) - least(osize, c - size) AS size FROM (
  SELECT n.seq, n.sym, n.ts_ns, n.interval, n.size, o.side, o.px, o.size AS osize,
    sum(n.size) OVER (PARTITION BY n.sym, n.interval, o.side ORDER BY n.ts_ns, n.seq) AS c
  FROM snaps_now n JOIN quotes o ON o.sym = n.sym AND o.seq = n.interval AND n.side = -o.side
    AND (CASE WHEN o.side = 1 THEN n.price <= o.px ELSE n.price >= o.px END))) WHERE size > 0)"""


@query(sql("SELECT * FROM naive", *TOUCHED, NAIVE))
def naive_fills(spark, sf_dir):
    """The touch without a queue."""
    found = sim.naive_fills(mk.trades(spark, sf_dir), quoted(spark, sf_dir, touch_orders(), queued=False))
    return found.drop("user_id")


@query(sql("""SELECT n_naive, n_queue, round(n_naive / n_queue, 9) AS ratio, (n_naive >= 2 * n_queue OR 2 * n_naive <= n_queue) AS separated
  FROM (SELECT count(*) AS n_naive FROM naive), (SELECT count(*) AS n_queue FROM fills)""", *TOUCHED, NAIVE))
def queue_vs_naive(spark, sf_dir):
    """How many more fills a simulation sees that forgets the queue."""
    trades = mk.trades(spark, sf_dir)
    naive = sim.naive_fills(trades, quoted(spark, sf_dir, touch_orders(), queued=False)).agg(F.count("*").alias("n_naive"))
    both = naive.crossJoin(touch(spark, sf_dir).agg(F.count("*").alias("n_queue")))  # one row each
    return both.select("n_naive", "n_queue", F.round(F.try_divide("n_naive", "n_queue"), 9).alias("ratio"),
                       F.expr("n_naive >= 2 * n_queue or 2 * n_naive <= n_queue").alias("separated"))


WALK = """
walk AS (SELECT seq, sym, ts_ns, l - 1 AS level, asks[l].px AS price, asks[l].sz AS sz,
    sum(asks[l].sz) OVER (PARTITION BY sym, seq ORDER BY l) AS c FROM snap, (SELECT unnest(range(1, 11)) AS l) WHERE asks[l].px <= mid + 2)"""


@query(sql("""SELECT seq, sym, count(*) AS n_levels, sum(size) AS qty, sum(size * price) AS cost FROM
  (SELECT *, least(7, c) - least(7, c - sz) AS size FROM walk) WHERE size > 0 GROUP BY ALL""", WALK))
def taker_walk(spark, sf_dir):
    """A buy of seven at each snapshot, at most two above the mid."""
    snaps = mk.snapshots(spark, sf_dir)
    found = sim.taker_fills(snaps.withColumn("asks", F.filter("asks", lambda l: l["px"] <= F.col("mid") + 2)), 7.0, 1)
    return found.groupBy("seq", "sym").agg(F.count("*").alias("n_levels"), F.sum("size").alias("qty"), F.sum(F.col("size") * F.col("price")).alias("cost"))


@query(sql("""SELECT is_maker, side, count(*) AS n_fills, sum(size) AS qty, sum(size * price) AS notional FROM (
  SELECT true AS is_maker, side, size, price FROM fills UNION ALL
  SELECT false, 1, size, price FROM (SELECT *, least(2, c) - least(2, c - sz) AS size FROM (
    SELECT s.asks[l].px AS price, s.asks[l].sz AS sz, sum(s.asks[l].sz) OVER (PARTITION BY s.sym, s.seq ORDER BY l) AS c
    FROM (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY ts_ns, seq) AS n FROM snap) s, (SELECT unnest(range(1, 11)) AS l) WHERE n % 50 = 0)) WHERE size > 0)
  GROUP BY ALL""", *TOUCHED))
def bracket_fills(spark, sf_dir):
    """Makers at the touch, and a buy of two at every fiftieth snapshot of a symbol."""
    snaps = running_sum(mk.snapshots(spark, sf_dir).withColumn("one", F.lit(1)), ["sym"], ["ts_ns", "seq"], {"one": "n"})
    takers = sim.taker_fills(snaps.where("n % 50 = 0"), 2.0, 1)
    cols = ["side", "size", "price"]
    both = touch(spark, sf_dir).select(F.lit(True).alias("is_maker"), *cols).union(takers.select(F.lit(False), *cols))
    return both.groupBy("is_maker", "side").agg(F.count("*").alias("n_fills"), F.sum("size").alias("qty"), F.sum(F.col("size") * F.col("price")).alias("notional"))


@query(sql("SELECT idx, side, count(*) AS n_fills, sum(size) AS qty FROM fills GROUP BY ALL",
           "quotes AS (SELECT sym, seq, ts_ns, sd AS side, (bid + ask) / 2 - sd * (0.5e0 + 0.5e0 * k) AS px, 2e0 AS size, k AS idx FROM snap, (SELECT unnest(range(0, 4))::INT AS k), (SELECT unnest([1, -1]) AS sd))",
           LOOKUP, FILLS))
def ladder_fills(spark, sf_dir):
    """Four orders a side, half a unit apart around the mid."""
    def rung(side, k):
        return q.order(side, q.mid() - side * (F.lit(0.5) + F.lit(0.5) * k), F.lit(2.0), k)

    orders = F.array(*[rung(s, k) for k in range(4) for s in (1, -1)])
    found = sim.fills(mk.trades(spark, sf_dir), quoted(spark, sf_dir, orders))
    return found.groupBy("idx", "side").agg(F.count("*").alias("n_fills"), F.sum("size").alias("qty"))


PATH = """
path AS (SELECT *, sum(size * side) OVER w AS inventory, greatest(0, max(inv) OVER w) AS peak_long, least(0, min(inv) OVER w) AS peak_short FROM (
  SELECT *, sum(size * side) OVER (PARTITION BY sym ORDER BY ts_ns, seq, idx) AS inv FROM fills) WINDOW w AS (PARTITION BY sym ORDER BY ts_ns, seq, idx))"""


def inventory(fills: DataFrame) -> DataFrame:
    """Fills with the inventory after them, in total order."""
    return running_sum(fills.withColumn("signed", F.col("size") * F.col("side")), ["sym"], ["ts_ns", "seq", "idx"], {"signed": "inventory"})


@query(sql("SELECT seq, sym, inventory, peak_long, peak_short FROM path", *TOUCHED, PATH))
def inventory_path(spark, sf_dir):
    """Inventory after each fill, and its largest long and short so far."""
    inv = inventory(touch_stored(spark, sf_dir))
    w = Window.partitionBy("sym", "b").orderBy("ts_ns", "seq", "idx")
    inv = inv.withColumn("b", block())
    tops = inv.groupBy("sym", "b").agg(F.max("inventory").alias("hi"), F.min("inventory").alias("lo"))
    earlier = Window.partitionBy("sym").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("sym", "b", F.max("hi").over(earlier).alias("hi0"), F.min("lo").over(earlier).alias("lo0"))
    return inv.withColumns({"hi": F.max("inventory").over(w), "lo": F.min("inventory").over(w)}).join(tops, ["sym", "b"]).select(
        "seq", "sym", "inventory", F.greatest(F.lit(0.0), "hi", "hi0").alias("peak_long"), F.least(F.lit(0.0), "lo", "lo0").alias("peak_short"))


LEDGER = """
marked AS (SELECT f.*, s.mid FROM fills f ASOF LEFT JOIN snap s ON f.sym = s.sym AND f.ts_ns >= s.ts_ns),
ledger AS (SELECT seq, sym, ts_ns, side, price, size, mid, size * price AS notional, size * price * 0.0002e0 AS fee,
    coalesce(sum(size * side) OVER b, 0) AS inv0, lag(mid) OVER w AS mid0, lag(ts_ns) OVER w AS ts0, side * size * (mid - price) AS edge
  FROM marked WINDOW w AS (PARTITION BY sym ORDER BY ts_ns, seq, idx), b AS (PARTITION BY sym ORDER BY ts_ns, seq, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
costed AS (SELECT *, inv0 * coalesce(mid - mid0, 0) AS carry, coalesce(abs(inv0) * abs(mid0) * 0.0001e0 * (ts_ns - ts0) / 28800000000000e0, 0) AS funding FROM ledger)"""


def costed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of touch fills: marks, fees, inventory before, carry, edge, funding, net."""
    fills = touch_stored(spark, sf_dir)
    fills = as_of(fills, mk.snapshots(spark, sf_dir), ["sym"], "mid", "mid")
    fills = fills.withColumns({"signed": F.col("size") * F.col("side"), "before": F.struct("mid", "ts_ns")})
    order = ["ts_ns", "seq", "idx"]
    fills = running_sum(fills, ["sym"], order, {"signed": "inventory"}, before=True)
    fills = last_known(fills, ["sym"], order, {"before": "prev"}, before=True)
    notional = F.col("size") * F.col("price")
    out = fills.withColumns({
        "notional": notional, "fee": q.fee(notional, F.lit(True), 0.0002, 0.0005), "slippage": F.lit(0.0),
        "carry": F.col("inventory") * F.coalesce(F.col("mid") - F.col("prev.mid"), F.lit(0.0)),
        "edge": F.col("signed") * (F.col("mid") - F.col("price")),
        "funding": F.coalesce(q.funding(F.col("inventory"), F.col("prev.mid"), F.col("ts_ns") - F.col("prev.ts_ns"), 0.0001), F.lit(0.0))})
    return out.withColumn("net", F.expr("edge + carry - fee - slippage - funding")).select(mk.LEDGER)


@query(sql("""SELECT seq, sym, mid, notional, round(fee, 9) AS fee, inv0 AS inventory, carry, edge, round(funding, 9) AS funding,
  round(edge + carry - fee - funding, 8) AS net FROM costed""", *TOUCHED, LEDGER))
def ledger_costed(spark, sf_dir):
    return costed(spark, sf_dir).select("seq", "sym", "mid", "notional", F.round("fee", 9).alias("fee"), "inventory", "carry", "edge",
                                        F.round("funding", 9).alias("funding"), F.round("net", 8).alias("net"))


HORIZONS = {"1s": 10**9, "10s": 10 * 10**9, "60s": 60 * 10**9, "1h": mk.HOUR_NS}


def with_mids(fills: DataFrame, snaps: DataFrame, horizons: dict[str, int], shift: int = 0) -> DataFrame:
    """fills with the mid known at each fill's time (m0) and after each horizon; one pass in time order for all of them."""
    names = {"0": 0, **horizons}
    whole = F.struct(*fills.columns).alias("whole")
    probe = fills.select("sym", "seq", "idx", whole, F.explode(F.array(*[F.struct(F.lit(n).alias("h"), (F.col("ts_ns") + v + shift).alias("ts_ns")) for n, v in names.items()])).alias("p"))
    probe = probe.select("sym", "seq", "idx", "whole", F.col("p.h").alias("h"), F.col("p.ts_ns").alias("ts_ns"))
    # A fill's probes come together again with the fill itself, so it is made once.
    known = as_of(probe, snaps, ["sym"], "mid", "m").groupBy("sym", "seq", "idx").agg(
        F.first("whole").alias("whole"), *[F.max(F.when(F.col("h") == n, F.col("m"))).alias(f"m{n}") for n in names])
    return known.select("whole.*", *[f"m{n}" for n in names])


def markouts(fills: DataFrame, horizons: dict[str, int]) -> DataFrame:
    """Adds, for each horizon, markout, realised spread (its negative) and adverse selection, relative to m0."""
    cols = {}
    for n in horizons:
        m = F.col(f"m{n}")
        cols |= {f"markout_{n}": F.try_divide(F.col("side") * (m - F.col("price")), "m0"), f"adverse_{n}": F.try_divide(F.col("side") * (m - F.col("m0")), "m0")}
        cols[f"realised_{n}"] = -cols[f"markout_{n}"]
    return fills.withColumns(cols)


def marked(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    return markouts(with_mids(touch_stored(spark, sf_dir), mk.snapshots(spark, sf_dir), HORIZONS, shift), HORIZONS)


MARK = "marks AS (SELECT f.*, s.mid AS m0" + "".join(f", s{k}.mid AS m{n}" for k, n in enumerate(HORIZONS)) + """ FROM fills f
  ASOF LEFT JOIN snap s ON f.sym = s.sym AND f.ts_ns >= s.ts_ns""" + "".join(
    f"\n  ASOF LEFT JOIN snap s{k} ON f.sym = s{k}.sym AND f.ts_ns + {v} >= s{k}.ts_ns" for k, v in enumerate(HORIZONS.values())) + ")"


@query(sql("SELECT seq, sym, " + ", ".join(f"round(side * (m{n} - price) / m0, 12) AS markout_{n}, round(side * (m{n} - m0) / m0, 12) AS adverse_{n}" for n in HORIZONS) + " FROM marks", *TOUCHED, MARK))
def markout_decompose(spark, sf_dir):
    """Each fill's markout and adverse selection at the horizons."""
    m = marked(spark, sf_dir)
    return m.select("seq", "sym", *[F.round(f"{w}_{n}", 12).alias(f"{w}_{n}") for n in HORIZONS for w in ("markout", "adverse")])


DECOMP = """SELECT {keys}, count(*) AS n_fills, round(avg(1e4 * (side * (m0 - price) / m0)), 9) AS captured_bp,
  round(avg(1e4 * side * (m1h - m0) / m0), 9) AS adverse_bp, round(avg(1e4 * side * (m1h - price) / m0) - 0.015e0, 9) AS net_bp"""


def decomposed() -> list:
    bp = {"captured_bp": F.col("side") * (F.col("m0") - F.col("price")) / F.col("m0"), "adverse_bp": F.col("adverse_1h")}
    return [F.count("*").alias("n_fills"), *[F.round(F.avg(v * 1e4), 9).alias(k) for k, v in bp.items()], F.round(F.avg(F.col("markout_1h") * 1e4) - 0.015, 9).alias("net_bp")]


@query(sql(DECOMP.format(keys="root") + " FROM (SELECT *, user_id % 13 AS root FROM marks) GROUP BY GROUPING SETS ((root), ())", *TOUCHED, MARK))
def decomp_by_root(spark, sf_dir):
    """Captured spread, adverse selection and net, by root and over all of them."""
    m = marked(spark, sf_dir).withColumn("root", F.expr("user_id % 13"))
    return m.groupingSets([["root"], []], "root").agg(*decomposed())


@query(sql(DECOMP.format(keys="root, session") + """ FROM (SELECT *, user_id % 13 AS root,
  CASE WHEN ts_ns % 86400000000000 < 21600000000000 THEN 'open' ELSE 'rest' END AS session FROM marks) GROUP BY GROUPING SETS ((root, session), (session))""", *TOUCHED, MARK))
def decomp_by_session(spark, sf_dir):
    m = marked(spark, sf_dir).withColumns({
        "root": F.expr("user_id % 13"), "session": F.when(F.expr("ts_ns % 86400000000000 < 21600000000000"), "open").otherwise("rest")})
    return m.groupingSets([["root", "session"], ["session"]], "root", "session").agg(*decomposed())


@query(sql("""SELECT root, n_fills, ratio FROM (SELECT root, count(*) AS n_fills, round(try_cast(-100 * sum(side * (m1h - m0) / m0) / nullif(sum(side * (m0 - price) / m0), 0) AS DOUBLE), 6) AS ratio
  FROM (SELECT *, user_id % 13 AS root FROM marks) GROUP BY root)""", *TOUCHED, MARK))
def pooled_ratio(spark, sf_dir):
    """Adverse selection in percent of captured spread, by root."""
    m = marked(spark, sf_dir).withColumn("root", F.expr("user_id % 13"))
    captured = F.sum(F.col("side") * (F.col("m0") - F.col("price")) / F.col("m0"))
    return m.groupBy("root").agg(F.count("*").alias("n_fills"), F.round(F.try_divide(-100 * F.sum("adverse_1h"), captured), 6).alias("ratio"))


LATE = [0, 10**9, 60 * 10**9, mk.HOUR_NS]


@query(sql(" UNION ALL ".join(f"""SELECT {v}::BIGINT AS offset_ns, count(*) AS n_fills, round(avg(-1e4 * f.side * (b.mid - f.price) / a.mid), 8) AS realised_bp FROM fills f
  ASOF LEFT JOIN snap a ON f.sym = a.sym AND f.ts_ns + {v} >= a.ts_ns ASOF LEFT JOIN snap b ON f.sym = b.sym AND f.ts_ns + {v + mk.HOUR_NS} >= b.ts_ns""" for v in LATE), *TOUCHED))
def latency_cliff(spark, sf_dir):
    """Realised spread after an hour if every fill came later by an offset; the first mark moves too."""
    f, snaps = touch_stored(spark, sf_dir), mk.snapshots(spark, sf_dir)
    late = f.withColumn("offset_ns", F.explode(F.array(*[F.lit(v).cast("long") for v in LATE])))
    late = late.withColumns({"ts_ns": F.col("ts_ns") + F.col("offset_ns"), "after": F.col("ts_ns") + F.col("offset_ns") + mk.HOUR_NS})
    late = as_of(as_of(late, snaps, ["sym"], "mid", "m0"), snaps, ["sym"], "mid", "m1", at="after")
    bp = -F.col("side") * (F.col("m1") - F.col("price")) / F.col("m0") * 1e4
    return late.groupBy("offset_ns").agg(F.count("*").alias("n_fills"), F.round(F.avg(bp), 8).alias("realised_bp"))


@query(sql("""SELECT seq, sym, side, px AS price, queue, q_trades, frozen, round(CASE WHEN frozen THEN NULL ELSE
    q_trades - (CASE WHEN q_trades > 0 AND visible > nxt THEN least(q_trades, (visible - nxt) * q_trades / visible) ELSE 0 END) END, 9) AS queue_after FROM (
  SELECT o.*, greatest(0, o.queue - coalesce(t.v, 0)) AS q_trades, greatest(0, o.queue - coalesce(t.v, 0)) AS visible, n.nxt, n.nxt IS NULL AS frozen FROM (
    SELECT o.*, o.seq AS interval, lead(0) OVER (PARTITION BY sym, side ORDER BY ts_ns, seq) AS has_next, lead(seq) OVER (PARTITION BY sym, side ORDER BY ts_ns, seq) AS nseq FROM orders o WHERE idx = 0) o
  LEFT JOIN (SELECT interval, oside, sum(size) AS v FROM hits GROUP BY ALL) t ON t.interval = o.seq AND t.oside = o.side
  LEFT JOIN (SELECT o2.seq AS i, o2.side AS sd, list_filter(CASE WHEN o2.side = 1 THEN s.bids ELSE s.asks END, lambda l: abs(l.px - o2.px) <= 1e-9)[1].sz AS nxt FROM (
    SELECT *, lead(seq) OVER (PARTITION BY sym, side ORDER BY ts_ns, seq) AS nseq FROM orders) o2 JOIN snap s ON s.seq = o2.nseq) n ON n.i = o.seq AND n.sd = o.side
  WHERE o.nseq IS NOT NULL) o""", *TOUCHED))
def queue_pos_log(spark, sf_dir):
    """Each touch order's place in the queue when the next snapshot comes: trades first, then cancels in proportion; frozen if the level is gone."""
    snaps, trades = mk.snapshots(spark, sf_dir), mk.trades(spark, sf_dir)
    quotes = sim.resting(snaps, touch_orders())
    nxt = _next_book(snaps)
    orders = quotes.select("seq", "sym", F.explode("orders").alias("o")).join(nxt, ["sym", "seq"])
    eaten = sim.in_interval(trades, quotes).withColumn("o", F.explode("orders")).where(
        (F.col("side") == -F.col("o.side")) & (F.abs(F.col("price") - F.col("o.px")) <= 1e-9)).groupBy(
        F.col("interval").alias("seq"), F.col("o.side").alias("side")).agg(F.sum("size").alias("v"))
    o = orders.select("seq", "sym", F.col("o.side").alias("side"), F.col("o.px").alias("price"), F.col("o.queue").alias("queue"), "next")
    o = o.join(eaten, ["seq", "side"], "left").withColumn("q_trades", F.greatest(F.lit(0.0), F.col("queue") - F.coalesce("v", F.lit(0.0))))
    there = F.when(F.col("side") == 1, q.size_at(F.col("next.bids"), F.col("price"))).otherwise(q.size_at(F.col("next.asks"), F.col("price")))
    gone = F.when((F.col("q_trades") > 0) & (F.col("q_trades") > F.col("nxt")), F.least("q_trades", F.col("q_trades") - F.col("nxt"))).otherwise(F.lit(0.0))
    return o.withColumn("nxt", there).select("seq", "sym", "side", "price", "queue", "q_trades", F.col("nxt").isNull().alias("frozen"),
                                             F.round(F.when(F.col("nxt").isNotNull(), F.col("q_trades") - gone), 9).alias("queue_after"))


def _next_book(snaps: DataFrame) -> DataFrame:
    """(sym, seq, next): the book of the symbol's next snapshot. Time runs backwards, so the next one is the last known."""
    back = snaps.select("sym", "seq", (-F.col("ts_ns")).alias("r"), (-F.col("seq")).alias("s"), F.struct("bids", "asks").alias("book"))
    return last_known(back, ["sym"], ["r", "s"], {"book": "next"}, ts="r", before=True).where("next is not null").select("sym", "seq", "next")


@query(sql("SELECT seq, sym, ts_ns, interval, side, price, size, idx FROM fills",
           "quotes AS (SELECT sym, seq, ts_ns, 1 AS side, bid AS px, 3e0 AS size, 0 AS idx FROM snap WHERE abs(bsz - asz) / (bsz + asz) < 0.4e0 UNION ALL SELECT sym, seq, ts_ns, -1, ask, 3e0, 0 FROM snap WHERE abs(bsz - asz) / (bsz + asz) < 0.4e0)", LOOKUP, FILLS))
def gated_fills(spark, sf_dir):
    """The touch, pulled while the touch sizes are too uneven."""
    bz, az = mk.best("bids", "sz"), mk.best("asks", "sz")
    calm = F.abs(bz - az) / (bz + az) < 0.4
    orders = F.array(q.at_level(1, F.lit(SIZE), when=calm), q.at_level(-1, F.lit(SIZE), when=calm))
    return sim.fills(mk.trades(spark, sf_dir), quoted(spark, sf_dir, orders)).select(OUT)


@query(sql("""SELECT win, count(*) AS n, round(cvar, 9) AS cvar FROM (SELECT *, avg(CASE WHEN a >= qt THEN a END) OVER (PARTITION BY win) AS cvar FROM (
  SELECT *, quantile_cont(a, 0.95) OVER (PARTITION BY win) AS qt FROM (SELECT ts_ns // 86400000000000 AS win, abs(inventory) AS a FROM path))) GROUP BY win, cvar""", *TOUCHED, PATH))
def wfo_cvar(spark, sf_dir):
    """Mean of the largest five percent of absolute inventory, by day."""
    a = stored(inventory(touch_stored(spark, sf_dir)).select(F.expr("ts_ns div 86400000000000").alias("win"), F.abs("inventory").alias("a")), "inventories")
    q95 = quantiles(a, ["win"], "a", {"q": 0.95})
    return a.join(q95, "win").groupBy("win", "n").agg(F.round(F.avg(F.when(F.col("a") >= F.col("q"), F.col("a"))), 9).alias("cvar")).select("win", "n", "cvar")


@query(sql("""SELECT sec, coalesce(n, 0) AS n_fills, coalesce(qty, 0) AS qty FROM (SELECT unnest(range(lo, hi + 1)) AS sec FROM (SELECT min(ts_ns // 3600000000000) AS lo, max(ts_ns // 3600000000000) AS hi FROM fills))
  LEFT JOIN (SELECT ts_ns // 3600000000000 AS sec, count(*) AS n, sum(size) AS qty FROM fills GROUP BY ALL) USING (sec)""".replace("sec", "bucket"), *TOUCHED))
def fill_rate_buckets(spark, sf_dir):
    """Fills and quantity by hour, with empty hours."""
    f = touch(spark, sf_dir).withColumn("bucket", F.expr("ts_ns div 3600000000000"))
    per = f.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("qty"))
    grid = per.agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias("bucket"))
    return grid.join(per, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n_fills"), F.coalesce("qty", F.lit(0.0)).alias("qty"))


@query(sql("""SELECT bucket, sym, coalesce(last_value(inv IGNORE NULLS) OVER (PARTITION BY sym ORDER BY bucket), 0) AS inventory, sum(coalesce(n, 0)) OVER (PARTITION BY sym ORDER BY bucket)::BIGINT AS n_fills FROM
  (SELECT sym, unnest(range(lo, hi + 1)) AS bucket FROM (SELECT sym, min(ts_ns // 3600000000000) AS lo, max(ts_ns // 3600000000000) AS hi FROM fills GROUP BY sym))
  LEFT JOIN (SELECT sym, ts_ns // 3600000000000 AS bucket, arg_max(inventory, (ts_ns, seq, idx)) AS inv, count(*) AS n FROM path GROUP BY ALL) USING (sym, bucket)""", *TOUCHED, PATH))
def inventory_buckets(spark, sf_dir):
    """Inventory at each hour's end and fills so far, carried through empty hours."""
    p = inventory(touch_stored(spark, sf_dir)).withColumn("bucket", F.expr("ts_ns div 3600000000000"))
    per = p.groupBy("sym", "bucket").agg(F.max_by("inventory", F.struct("ts_ns", "seq", "idx")).alias("inv"), F.count("*").alias("n"))
    grid = per.groupBy("sym").agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi")).select("sym", F.explode(F.sequence("lo", "hi")).alias("bucket"))
    w = Window.partitionBy("sym").orderBy("bucket")  # one row an hour
    return grid.join(per, ["sym", "bucket"], "left").select(
        "bucket", "sym", F.coalesce(F.last("inv", ignorenulls=True).over(w), F.lit(0.0)).alias("inventory"), F.sum(F.coalesce("n", F.lit(0))).over(w).alias("n_fills"))
