"""Market tables: a book and a tape derived from the events table, and their schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEVEL = "struct<px:double,sz:double>"
#: Schemas of stored book snapshots and trades.
SNAPSHOTS = f"ts_ns long, recv_ns long, symbol string, venue string, depth long, bids array<{LEVEL}>, asks array<{LEVEL}>"
TRADES = "ts_ns long, recv_ns long, symbol string, venue string, price double, size double, side long"
#: Columns of a costed ledger row, in order.
LEDGER = ["seq", "sym", "ts_ns", "side", "price", "size", "mid", "notional", "fee", "slippage", "inventory", "carry", "edge", "funding", "net"]

HOUR_NS, DAY_NS = 3_600_000_000_000, 86_400_000_000_000
DEPTH = 10


def _level(px: Column, sz: Column) -> Column:
    return F.struct(px.cast("double").alias("px"), sz.cast("double").alias("sz"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with nanosecond time, symbol, six-hour bucket and the bucket's mid price."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ts = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) * 1000")
    bucket = F.expr("((ts_ns % 237600000000000) - (ts_ns % 21600000000000)) div 21600000000000")
    return (e.select(F.col("event_id").alias("seq"), ts.alias("ts_ns"), "user_id", F.expr("user_id % 2").alias("sym"), "event_type", "value")
            .withColumn("bk", bucket).withColumn("mid", F.lit(100.0) + F.lit(0.5) * F.expr("(bk * 7) % 11").cast("double")))


def snapshots(spark: SparkSession, sf_dir: str, depth: int = DEPTH) -> DataFrame:
    """Book snapshots, best level first: seq, sym, ts_ns, user_id, event_type, mid, bids, asks."""
    s = events(spark, sf_dir).where("event_type in ('view', 'click', 'signup')")
    half = F.lit(0.5)

    def side(sign: int, shift: int, mod: int) -> Column:
        top = _level(F.col("mid") + half * sign, 1 + F.col("seq") % mod)
        deep = [_level(F.col("mid") + half * sign * (l + 1), 1 + (F.col("seq") * (l + shift)) % 5) for l in range(1, depth)]
        return F.array(top, *deep)

    return s.select("seq", "sym", "ts_ns", "user_id", "event_type", "mid", side(-1, 3, 5).alias("bids"), side(1, 4, 3).alias("asks"))


def trades(spark: SparkSession, sf_dir: str, size: Column | None = None) -> DataFrame:
    """Trades: seq, sym, ts_ns, user_id, side, price, size (whole numbers from 1 to 8, or what is given)."""
    t = events(spark, sf_dir).where("event_type in ('purchase', 'error')")
    side = F.when(F.col("event_type") == "purchase", 1).otherwise(-1)
    return t.select("seq", "sym", "ts_ns", "user_id", side.alias("side"), (F.col("mid") + F.lit(0.5) * side).alias("price"),
                    (size if size is not None else (1 + F.expr("floor(value) % 8")).cast("double")).alias("size"))


def read_snapshots(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """Stored snapshots; the symbol filter reaches the scan."""
    df = spark.read.schema(SNAPSHOTS).parquet(path)
    return df.where(F.col("symbol") == symbol) if symbol else df


def read_trades(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    df = spark.read.schema(TRADES).parquet(path)
    return df.where(F.col("symbol") == symbol) if symbol else df


def best(levels: str, what: str = "px", level: int = 0) -> Column:
    """One field of one level, null where the book is not that deep."""
    return F.get(F.col(levels), F.lit(level))[what]
