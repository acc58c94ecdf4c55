"""Queries whose state depends on its own past, in sessions and as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebook.operators import sessions as ses
from tidebook.sources import market as mk
from tidebook.sources.storage import scratch
from tidebook.streaming import fills as stream

from .fills import FILLS, LOOKUP, TAKE, TOUCH, TOUCHED, touch
from .registry import query, sql


def rows(spark, sf_dir):
    return ses.sessions(mk.snapshots(spark, sf_dir), mk.trades(spark, sf_dir))


@query()
def ewma_fair(spark, sf_dir):
    """Fair value: the mid averaged with a half-life of two hours, anew every day."""
    mids = rows(spark, sf_dir).where("kind = 0").select("sym", "day", "ts_ns", "kind", "seq", "mid")
    out = ses.fold(mids, ses.ewma(2 * mk.HOUR_NS), "seq long, fair double")
    return out.select("seq", "sym", "day", F.round("fair", 9).alias("fair"))


@query()
def refresh_triggers(spark, sf_dir):
    """When quotes would be renewed by time, by moves of the mid, and by changes of the inventory."""
    return ses.fold(rows(spark, sf_dir).drop("bids", "asks", "price"), ses.triggers(mk.HOUR_NS, 50.0, 5.0), "seq long, on_time boolean, on_move boolean, on_inventory boolean")


@query()
def model_quotes(spark, sf_dir):
    """Fills of the four inventory models, by model and symbol."""
    levels = {f"{s}_{w}": F.col(f"{s}s.{w}") for s in ("bid", "ask") for w in ("px", "sz")}
    every = rows(spark, sf_dir).withColumns(levels).drop("bids", "asks")
    out = ses.fold(every, ses.model_fills(), "model string, seq long, side int, price double, size double, inventory double")
    return out.groupBy("model", "sym").agg(F.count("*").alias("n_fills"), F.sum("size").alias("qty"), F.max(F.abs("inventory")).alias("peak"),
                                           F.sum(-F.col("side") * F.col("size") * F.col("price")).alias("cash"))


@query()
def hedge_fires(spark, sf_dir):
    """Hedges of the touch quoter's fills: all of the net at ten, anew every day."""
    f = touch(spark, sf_dir).select("sym", "seq", "ts_ns", F.lit(1).alias("kind"), (F.col("size") * F.col("side")).alias("signed"), F.expr("ts_ns div 86400000000000").alias("day"))
    return ses.fold(f, ses.hedges(10.0, 1.0), "seq long, side int, size double, net double")


@query()
def queue_tracker(spark, sf_dir):
    """The queue ahead of one bid a session that stays where it was put."""
    return ses.fold(rows(spark, sf_dir).drop("asks", "mid"), ses.queue_track, "seq long, queue double, cause string")


@query(sql(TAKE.replace(", idx", ""), *TOUCHED))
def stream_touch_fills(spark, sf_dir):
    """Touch fills from a stream over the events table; the rows must be those of the batch plan."""
    return stream.replay(spark, sf_dir, scratch(spark, "stream"))


KEPT = """kept AS (SELECT * FROM (SELECT *, ts_ns // 86400000000000 AS day, row_number() OVER w = 1 OR (bid, bsz, ask, asz) IS DISTINCT FROM lag((bid, bsz, ask, asz)) OVER w AS new
  FROM snap WINDOW w AS (PARTITION BY sym, ts_ns // 86400000000000 ORDER BY ts_ns, seq)) WHERE new)"""
SESSION_FILLS = FILLS.replace("ASOF JOIN snap s ON t.sym = s.sym", "ASOF JOIN kept s ON t.sym = s.sym AND t.ts_ns // 86400000000000 = s.day")


@query(sql("SELECT seq, ts_ns, interval, side, price, size, sym FROM fills", KEPT, TOUCH, LOOKUP, SESSION_FILLS))
def stream_sessions(spark, sf_dir):
    """Touch fills from a stream, each symbol's day a session of its own, over books whose best level changed."""
    return stream.replay(spark, sf_dir, scratch(spark, "sessions"), by_day=True, throttle=True)
