"""Tapes from a manifest: files of vendors' rows found, pruned, parsed and stored by root and date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.sources import feeds
from tidebook.sources import market as mk
from tidebook.sources import sink, tapes
from tidebook.sources.storage import scratch, stored

from .fills import MARK, TOUCHED, marked
from .registry import query, sql

DAY = mk.DAY_NS
#: Roots and dates that the query asks for.
FROM_DATE, ROOT = "20240108", "S1"
#: The regular hours of an equity tape, in seconds.
OPEN_S, CLOSE_S = 34_200, 57_600


def _clock(colons: bool) -> str:
    """SQL of a time of day as tapes write it: HH:MM:SS.mmm, or HHMMSS and nine digits."""
    s, between = f"(ts_ns % {DAY} div 1000000000)", "':', " if colons else ""
    hms = f"lpad({s} div 3600, 2, '0'), {between}lpad({s} div 60 % 60, 2, '0'), {between}lpad({s} % 60, 2, '0')"
    return f"concat({hms}, '.', lpad(ts_ns % 1000000000 div 1000000, 3, '0'))" if colons else f"concat({hms}, lpad(ts_ns % 1000000000, 9, '0'))"


def write_tapes(rows: DataFrame, folder: str) -> None:
    """rows (root, date, ts_ns, n, value) as one file a root and day, with a header, in order of time and n."""
    head = rows.select("root", "date").distinct().select("root", "date", F.lit(-1).cast("long").alias("ts_ns"), F.lit(-1).cast("long").alias("n"), F.lit("header").alias("value"))
    # A vendor's file is a root's day in order; that is what a task writes.
    whole = rows.unionByName(head).repartition("root", "date").sortWithinPartitions("root", "date", "ts_ns", "n")
    whole.select("root", "date", "value").write.partitionBy("root", "date").text(folder)


def vendor_rows(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Rows of a futures tape (trades) and of an equity tape (best prices and trades), made from the market tables."""
    date, root = F.date_format(F.date_from_unix_date(F.expr(f"ts_ns div {DAY}").cast("int")), "yyyyMMdd"), F.concat(F.lit("S"), "sym")
    t, s = mk.trades(spark, sf_dir), mk.snapshots(spark, sf_dir)
    kind = F.when(F.col("side") == 1, feeds.BUY).otherwise(feeds.SELL)
    futures = t.select(root.alias("root"), date.alias("date"), "ts_ns", F.col("seq").alias("n"), F.concat_ws(
        ",", date, F.expr(_clock(False)), date, *[F.lit(x) for x in (0, 1, "P", "G")], root, kind, F.lit(""), F.lit(""), F.lit(0), "price", "size", *[F.lit(0)] * 6).alias("value"))

    def line(event: str, px, sz):
        return F.concat_ws(", ", date, F.expr(_clock(True)), F.lit(event), root, px, sz, F.lit("X"), F.lit(""))

    quotes = s.select(root.alias("root"), date.alias("date"), "ts_ns", (3 * F.col("seq")).alias("n"), F.explode(F.array(
        line("QUOTE BID NB", mk.best("bids"), mk.best("bids", "sz")), line("QUOTE ASK NB", mk.best("asks"), mk.best("asks", "sz")))).alias("value"))
    trades = t.select(root.alias("root"), date.alias("date"), "ts_ns", (3 * F.col("seq") + 2).alias("n"), line("TRADE NB", F.col("price") - F.when(F.col("seq") % 4 == 0, 0.5 * F.col("side")).otherwise(0.0), F.col("size")).alias("value"))
    return futures, quotes.unionByName(trades)


@query(sql(f"""SELECT feed, root, date, count(*) AS n, sum(size) AS qty, sum(side * size) AS net, sum(price * size) AS notional FROM (SELECT * FROM fu WHERE date >= '{FROM_DATE}' UNION ALL SELECT * FROM eq WHERE root = '{ROOT}' AND date >= '{FROM_DATE}') GROUP BY ALL""", """fu AS (SELECT 'futures' AS feed, 'S' || sym AS root, strftime(make_timestamp(ts_ns // 1000), '%Y%m%d') AS date, side, size, price FROM trade)""", f"""eq AS (SELECT 'equity' AS feed, 'S' || t.sym AS root, strftime(make_timestamp(t.ts_ns // 1000), '%Y%m%d') AS date, coalesce(sign(t.px - s.mid), 0)::INT AS side, t.size, t.px AS price FROM
  (SELECT *, price - CASE WHEN seq % 4 = 0 THEN 0.5e0 * side ELSE 0 END AS px, ts_ns // {DAY} AS day FROM trade WHERE ts_ns % {DAY} >= {OPEN_S}000000000 AND ts_ns % {DAY} < {CLOSE_S}000000000) t
  ASOF LEFT JOIN (SELECT *, ts_ns // {DAY} AS day FROM snap WHERE ts_ns % {DAY} >= {OPEN_S}000000000 AND ts_ns % {DAY} < {CLOSE_S}000000000) s ON s.sym = t.sym AND s.day = t.day AND s.ts_ns <= t.ts_ns)"""))
def tape_feeds(spark, sf_dir):
    """Both vendors' tapes written as files, listed in manifests, and the days asked for read back: trades, volume and signed volume by root and date; other files are not opened."""
    found = []
    for feed, rows, columns in zip(("futures", "equity"), vendor_rows(spark, sf_dir), (feeds.TAPE_COLUMNS, feeds.EQUITY_COLUMNS)):
        folder = scratch(spark, f"{feed}-tape")
        write_tapes(rows, f"{folder}/files")
        tapes.list_tapes(spark, f"{folder}/files", f"{folder}/manifest")
        raw = tapes.tape(spark, f"{folder}/manifest", columns, 1 << 20).where(F.col("date") >= FROM_DATE)
        if feed == "futures":
            trades = feeds.futures_trades(spark, None, rows=raw)
        else:
            trades = feeds.sign_by_quote(feeds.equity_tape(spark, None, rows=raw.where(F.col("root") == ROOT)))
        day = F.date_format(F.date_from_unix_date(F.expr(f"ts_ns div {DAY}").cast("int")), "yyyyMMdd")
        found.append(trades.groupBy(F.lit(feed).alias("feed"), F.col("symbol").alias("root"), day.alias("date")).agg(
            F.count("*").alias("n"), F.sum("size").alias("qty"), F.sum(F.col("side") * F.col("size")).alias("net"), F.sum(F.col("price") * F.col("size")).alias("notional")))
    return found[0].unionByName(found[1])


@query(sql(f"""SELECT (user_id % 13)::BIGINT AS root, ts_ns // {DAY} AS day, side, count(*) AS n_fills, round(sum(1e4 * side * (m1h - price) / m0 - 0.015e0), 6) AS net_bp, 1 AS runs FROM marks GROUP BY ALL""", *TOUCHED, MARK))
def root_day_store(spark, sf_dir):
    """Results of root-days in a store that is filled in two runs, of which the second does what the first left."""
    f = stored(marked(spark, sf_dir).select(F.expr("user_id % 13").alias("root"), F.expr(f"ts_ns div {DAY}").alias("day"), "side", (F.col("markout_1h") * 1e4 - 0.015).alias("x")), "marked-fills")
    keys, path = f.select("root", "day").distinct(), scratch(spark, "root-days")

    def work(some: DataFrame) -> DataFrame:
        per = f.join(some, ["root", "day"], "left_semi").groupBy("root", "day", "side").agg(F.count("*").alias("n_fills"), F.round(F.sum("x"), 6).alias("net_bp"))
        return per.withColumn("runs", F.lit(1))

    sink.store_by_key(keys.where("day % 2 = 0"), work, path)
    sink.store_by_key(keys, work, path)
    return sink.read_by_key(spark, path, work(keys).schema, ["root", "day"])
