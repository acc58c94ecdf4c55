"""Fills of resting orders, without a loop over events.

All orders are replaced at each snapshot, so an order lives for one interval between
snapshots of its symbol. In that interval the trades on its side first eat the
queue that was visible at its price, then the order: after a traded volume c,
``least(size, greatest(0, c - queue))`` of it is filled, and a trade fills the difference that it makes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions.quotes import size_at
from tidebook.sources.market import HOUR_NS

from .timeline import last_known, looked_up

ORDER = "struct<side:int,px:double,size:double,idx:int>"


def resting(snaps: DataFrame, orders, queued: bool = True) -> DataFrame:
    """snaps with its array of orders, each with its queue; orders at prices that the book doesn't show are dropped."""
    snaps = snaps.withColumn("_orders", F.filter(orders, lambda o: o["px"].isNotNull()))
    own = F.transform("_orders", lambda o: F.struct(
        o["side"].alias("side"), o["px"].alias("px"), o["size"].alias("size"), o["idx"].alias("idx"),
        F.coalesce(o["queue"], F.when(o["side"] == 1, size_at(F.col("bids"), o["px"])).otherwise(size_at(F.col("asks"), o["px"]))).alias("queue")))
    keep = F.filter(own, lambda o: o["queue"].isNotNull()) if queued else own
    return snaps.select("seq", "sym", "ts_ns", keep.alias("orders"))


def in_interval(trades: DataFrame, quoted: DataFrame) -> DataFrame:
    """Trades with the snapshot they follow: its seq as interval, and its orders. Earlier trades are dropped.

    Only the snapshots' numbers are carried in time order; orders, which are most of a row, come by the number.
    """
    state = quoted.select("sym", "ts_ns", F.lit(0).alias("kind"), "seq", F.struct("ts_ns", "seq").alias("state"))
    both = state.unionByName(trades.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    out = last_known(both, ["sym"], ["ts_ns", "kind", "seq"], {"state": "now"}, size=HOUR_NS).where("kind = 1 and now is not null")
    out = out.select(*trades.columns, F.col("now.ts_ns").alias("_since"), F.col("now.seq").alias("interval"))
    orders = quoted.select("sym", F.col("ts_ns").alias("_since"), F.col("seq").alias("interval"), "orders")
    return looked_up(out, orders, ["sym", "_since", "interval"], ["orders"]).drop("_since")


def fills(trades: DataFrame, quoted: DataFrame) -> DataFrame:
    """Queue-aware maker fills: seq (of the trade), sym, ts_ns, interval, side (+1 we bought), price, size, idx, user_id, queue (before the order at first)."""
    at = in_interval(trades, quoted).withColumn("o", F.explode("orders")).drop("orders")
    hit = at.where((F.col("side") == -F.col("o.side")) & (F.abs(F.col("price") - F.col("o.px")) <= 1e-9))
    w = Window.partitionBy("sym", "interval", "o.side", "o.idx").orderBy("ts_ns", "seq")
    hit = hit.withColumn("_c", F.sum("size").over(w))

    def filled(c):
        return F.least(F.col("o.size"), F.greatest(F.lit(0.0), c - F.col("o.queue")))

    hit = hit.withColumn("fill", filled(F.col("_c")) - filled(F.col("_c") - F.col("size")))
    return hit.where("fill > 0").select("seq", "sym", "ts_ns", "user_id", "interval", F.col("o.side").alias("side"), F.col("o.px").alias("price"),
                                        F.col("fill").alias("size"), F.col("o.idx").alias("idx"), F.col("o.queue").alias("queue"))


def naive_fills(trades: DataFrame, quoted: DataFrame) -> DataFrame:
    """Fills of one order a side without a queue: any trade at the order's price or through it fills it."""
    at = in_interval(trades, quoted).withColumn("o", F.explode("orders")).drop("orders")
    through = F.when(F.col("o.side") == 1, F.col("price") <= F.col("o.px")).otherwise(F.col("price") >= F.col("o.px"))
    hit = at.where((F.col("side") == -F.col("o.side")) & through)
    w = Window.partitionBy("sym", "interval", "o.side").orderBy("ts_ns", "seq")
    hit = hit.withColumn("_c", F.sum("size").over(w))
    fill = F.least(F.col("o.size"), F.col("_c")) - F.least(F.col("o.size"), F.col("_c") - F.col("size"))
    return hit.withColumn("fill", fill).where("fill > 0").select(
        "seq", "sym", "ts_ns", "user_id", "interval", F.col("o.side").alias("side"), F.col("o.px").alias("price"), F.col("fill").alias("size"))


def taker_fills(snaps: DataFrame, size, side: int, limit=None) -> DataFrame:
    """A market order at each snapshot: it walks the other side's levels, up to a limit price, and leaves the book alone."""
    levels = F.col("asks" if side == 1 else "bids")
    walk = snaps.select("seq", "sym", "ts_ns", F.lit(float(size)).alias("want"), F.posexplode(levels).alias("level", "l"))
    if limit is not None:
        walk = walk.where((F.col("l.px") - limit) * side <= 0)
    w = Window.partitionBy("sym", "seq").orderBy("level")
    walk = walk.withColumn("_c", F.sum("l.sz").over(w))
    fill = F.least(F.col("want"), F.col("_c")) - F.least(F.col("want"), F.col("_c") - F.col("l.sz"))
    return walk.withColumn("size", fill).where("size > 0").select("seq", "sym", "ts_ns", "level", F.lit(side).alias("side"), F.col("l.px").alias("price"), "size")
