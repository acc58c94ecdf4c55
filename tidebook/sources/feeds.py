"""Vendor CSV feeds as DataFrames in the shape of stored snapshots and trades, and the jobs that store them.

Order within a file is part of its meaning, so every row carries its place: the byte
at which its part of the file starts, and its number in reading order. Plain files are split among tasks,
gzipped ones are streamed by one task each; what one part leaves open is carried to the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.operators.timeline import last_known

from .market import LEVEL, SNAPSHOTS, TRADES

DAY_NS, SECOND_NS = 86_400_000_000_000, 1_000_000_000
#: Message types of the futures tape.
QUOTES, EMPTY, BUY, SELL = (161, 97), (172, 108), 162, 98
#: The columns of the equity and futures tapes and of a depth file.
EQUITY_COLUMNS, TAPE_COLUMNS, DEPTH_COLUMNS = 8, 20, 45
PLACE = ["file", "part", "line"]


def lines(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """file, part, line and the trimmed fields c0, c1, ... of every row below a file's header; (part, line) grow within a file.

    Fields that a row lacks are null; empty rows are left out.
    """
    schema = ", ".join(f"c{k} string" for k in range(columns))
    read = spark.read.schema(schema).csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, quote="", enforceSchema=True)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"),
                       F.monotonically_increasing_id().alias("line"), *[f"c{k}" for k in range(columns)])


def _num(k: int) -> Column:
    return F.col(f"c{k}").try_cast("double")


def _carried(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """last_known in the file's order; its parts are the blocks."""
    return last_known(rows, ["file"], ["part", "line"], columns, ts="part", size=1)


def day_ns(day: Column) -> Column:
    """A day written as YYYYMMDD, in nanoseconds since the epoch."""
    return F.unix_date(F.try_to_timestamp(day, F.lit("yyyyMMdd")).cast("date")).cast("long") * DAY_NS


def clock_ns(text: Column) -> Column:
    """HH:MM:SS with a fraction that is cut or filled to milliseconds, in nanoseconds."""
    part = F.split(text, ":")
    second = F.split(F.get(part, F.lit(2)), "\\.")
    ms = F.substring(F.concat(F.coalesce(F.get(second, F.lit(1)), F.lit("")), F.lit("000")), 1, 3)
    whole = F.get(part, F.lit(0)).try_cast("long") * 3600 + F.get(part, F.lit(1)).try_cast("long") * 60 + F.get(second, F.lit(0)).try_cast("long")
    return whole * SECOND_NS + ms.try_cast("long") * 1_000_000


def utc_ns(text: Column) -> Column:
    """HHMMSS and nine digits of nanoseconds, as one number."""
    v = text.try_cast("long")
    s = F.floor(v / SECOND_NS).cast("long")
    return (F.floor(s / 10000) * 3600 + F.floor(s / 100) % 100 * 60 + s % 100).cast("long") * SECOND_NS + v % SECOND_NS


def equity_tape(spark: SparkSession, path: str | None, regular_hours: bool = True, rows: DataFrame | None = None) -> DataFrame:
    """Best bids and offers and trades of an equity file, or of rows that were read already: file, part, line, ts_ns, kind (bid, ask, trade), symbol, price, size."""
    kind = F.create_map(*[F.lit(x) for pair in {"QUOTE BID NB": "bid", "QUOTE ASK NB": "ask", "TRADE": "trade", "TRADE NB": "trade"}.items() for x in pair])
    rows = (lines(spark, path, EQUITY_COLUMNS) if rows is None else rows).where("c5 is not null").withColumn("clock", clock_ns(F.col("c1")))
    rows = rows.select(*PLACE, "clock", (day_ns(F.col("c0")) + F.col("clock")).alias("ts_ns"), F.try_element_at(kind, F.col("c2")).alias("kind"),
                       F.col("c3").alias("symbol"), _num(4).alias("price"), _num(5).alias("size")).where("kind is not null")
    if regular_hours:
        rows = rows.where(f"clock >= {34200 * SECOND_NS} and clock < {57600 * SECOND_NS}")
    return rows.drop("clock")


def sign_by_quote(tape: DataFrame) -> DataFrame:
    """Trades of an equity tape with the side of the mid they are on, as the file's order has it; 0 at the mid or without one."""
    t = tape.withColumns({f"_{k}": F.when(F.col("kind") == k, F.col("price")) for k in ("bid", "ask")})
    t = _carried(t, {"_bid": "bid", "_ask": "ask"}).where("kind = 'trade'")
    return t.select(*PLACE, "ts_ns", "symbol", "price", "size", F.coalesce(F.signum(F.col("price") - (F.col("bid") + F.col("ask")) / 2), F.lit(0.0)).cast("int").alias("side"))


def _anchored(rows: DataFrame) -> DataFrame:
    """Adds ts_ns, from the file's first day and each row's clock."""
    first = rows.groupBy("file").agg(F.min_by("c0", F.struct("part", "line")).alias("first"))
    return rows.join(first, "file").withColumn("ts_ns", day_ns(F.col("first")) + utc_ns(F.col("c1"))).drop("first")


def _books(rows: DataFrame, own: Column, side: Column) -> DataFrame:
    """Both sides of the book at each row, of which own is the levels of one; a side that has not come yet is empty."""
    rows = rows.withColumns({"_b": F.when(side == "B", own), "_a": F.when(side == "S", own)})
    rows = _carried(rows, {"_b": "bids", "_a": "asks"})
    none = F.array().cast(f"array<{LEVEL}>")
    return rows.select(*PLACE, "ts_ns", "symbol", F.coalesce("bids", none).alias("bids"), F.coalesce("asks", none).alias("asks"))


def futures_depth(spark: SparkSession, path: str) -> DataFrame:
    """Two-sided books of a one-sided depth file: each row updates one side, the other is carried along.

    file, part, line, ts_ns, symbol, bids, asks.
    """
    rows = _anchored(lines(spark, path, DEPTH_COLUMNS)).where("c44 is not null and c8 in ('B', 'S')").withColumn("symbol", F.col("c7"))
    levels = F.array(*[F.struct(_num(15 + 3 * k).alias("px"), _num(16 + 3 * k).alias("sz")) for k in range(10)])
    shown = F.filter(F.slice(levels, 1, F.when(_num(14) > 0, _num(14).cast("int")).otherwise(10)), lambda l: (l["px"] > 0) & (l["sz"] > 0))
    return _books(rows, shown.cast(f"array<{LEVEL}>"), F.col("c8"))


def futures_trades(spark: SparkSession, path: str | None, rows: DataFrame | None = None) -> DataFrame:
    """Trades of a futures tape, or of rows that were read already: file, part, line, ts_ns, symbol, price, size, side; rows without a quantity are left out."""
    rows = _anchored(lines(spark, path, TAPE_COLUMNS) if rows is None else rows)
    kind = _num(8).cast("int")
    rows = rows.withColumn("kind", kind).where(F.col("kind").isin(BUY, SELL) & (_num(13) > 0))
    return rows.select(*PLACE, "ts_ns", F.col("c7").alias("symbol"), _num(12).alias("price"), _num(13).alias("size"), F.when(F.col("kind") == BUY, 1).otherwise(-1).alias("side"))


def futures_quotes(spark: SparkSession, path: str) -> DataFrame:
    """Top of the book from a futures tape's quote rows, each side carried along and cleared where it is empty: file, part, line, ts_ns, symbol, bids, asks."""
    rows = _anchored(lines(spark, path, TAPE_COLUMNS)).withColumns({"kind": _num(8).cast("int"), "symbol": F.col("c7")})
    rows = rows.where((F.col("kind").isin(*QUOTES) & (_num(11) == 0)) | F.col("kind").isin(*EMPTY))
    none = F.array().cast(f"array<{LEVEL}>")
    own = F.when(F.col("kind").isin(*EMPTY), none).otherwise(F.array(F.struct(_num(12).alias("px"), _num(13).alias("sz"))).cast(f"array<{LEVEL}>"))
    return _books(rows, own, F.col("c10"))


def _columns(schema: str) -> list[str]:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).names


def store_snapshots(books: DataFrame, path: str, venue: str, per_second: int | None = None) -> None:
    """Writes books (ts_ns, symbol, bids, asks, and recv_ns if it is known) as stored snapshots, a folder a symbol.

    per_second keeps the last book of every so many parts of a second only.
    """
    if per_second:
        at = [c for c in ("part", "line") if c in books.columns]
        books = books.groupBy("symbol", F.expr(f"ts_ns div {SECOND_NS // per_second}").alias("slot")).agg(
            F.max_by(F.struct(*books.columns), F.struct("ts_ns", *at)).alias("b")).select("b.*")
    recv = F.col("recv_ns") if "recv_ns" in books.columns else F.col("ts_ns")
    rows = books.select("ts_ns", recv.alias("recv_ns"), "symbol", F.lit(venue).alias("venue"), F.greatest(F.size("bids"), F.size("asks")).cast("long").alias("depth"), "bids", "asks")
    # Rows of a symbol may fill many files, so a hot one is no single task's.
    rows.select(_columns(SNAPSHOTS)).withColumn("sym", F.col("symbol")).write.partitionBy("sym").parquet(path)


def store_trades(trades: DataFrame, path: str, venue: str) -> None:
    """Writes trades (ts_ns, symbol, price, size, side) as stored trades, a folder a symbol."""
    recv = F.col("recv_ns") if "recv_ns" in trades.columns else F.col("ts_ns")
    rows = trades.select("ts_ns", recv.alias("recv_ns"), "symbol", F.lit(venue).alias("venue"), "price", "size", F.col("side").cast("long").alias("side"))
    rows.select(_columns(TRADES)).withColumn("sym", F.col("symbol")).write.partitionBy("sym").parquet(path)
