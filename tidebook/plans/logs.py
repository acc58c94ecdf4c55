"""Logs of a run by second, as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.operators.timeline import running_sum
from tidebook.sources.storage import scratch

from .fills import TOUCHED, touch_stored
from .inference import brier_by_rank
from .registry import query, sql

SECOND_NS, HOUR_S = 10**9, 3_600
#: The log's columns in order, and how numbers with fractions are written.
COLUMNS, FRACTION = ["bucket_s", "t_ns_start", "n_fills", "total_qty", "inv", "n_fills_so_far"], "%.12f"


def by_second(fills: DataFrame) -> DataFrame:
    """Fills, quantity, inventory at the end and fills so far of every second from the first fill's to the last one's, empty ones too."""
    per = fills.groupBy(F.expr(f"ts_ns div {SECOND_NS}").alias("bucket_s")).agg(F.count("*").alias("n"), F.sum("size").alias("qty"), F.sum(F.col("size") * F.col("side")).alias("signed"))
    lim = per.agg(F.min("bucket_s").alias("lo"), F.max("bucket_s").alias("hi")).where("lo is not null")  # one row
    hours = lim.withColumn("h", F.explode(F.expr(f"sequence(lo div {HOUR_S}, hi div {HOUR_S})"))).repartition("h")
    grid = hours.select(F.explode(F.expr(f"sequence(greatest(lo, h * {HOUR_S}), least(hi, h * {HOUR_S} + {HOUR_S - 1}))")).alias("bucket_s"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n", "qty", "signed")}
    rows = grid.join(per, "bucket_s", "left").withColumns(zero | {"log": F.lit(0)})
    return running_sum(rows, ["log"], ["bucket_s"], {"signed": "inv", "n": "n_fills_so_far"}, ts="bucket_s", size=HOUR_S).select(
        "bucket_s", (F.col("bucket_s") * SECOND_NS).alias("t_ns_start"), F.col("n").alias("n_fills"), F.col("qty").alias("total_qty"), "inv", "n_fills_so_far")


def write_csv(log: DataFrame, path: str) -> None:
    """A header in each file, seconds in order over all of them."""
    text = {c: F.format_string(FRACTION, F.col(c).cast("double")) for c in ("total_qty", "inv")}
    log.repartitionByRange("bucket_s").sortWithinPartitions("bucket_s").withColumns(text).select(COLUMNS).write.csv(path, header=True)


@query(sql(f"""SELECT bucket_s // {HOUR_S} AS hour, count(*) AS n_seconds, sum(n)::BIGINT AS n_fills, sum(qty) AS qty, sha256(string_agg(printf('%d,%d,%d,%.12f,%.12f,%d', bucket_s, bucket_s * {SECOND_NS}, n, qty, inv, so_far), chr(10) ORDER BY bucket_s)) AS lines_sha256 FROM (
  SELECT *, sum(signed) OVER w AS inv, (sum(n) OVER w)::BIGINT AS so_far FROM (SELECT bucket_s, coalesce(n, 0) AS n, coalesce(qty, 0e0) AS qty, coalesce(signed, 0e0) AS signed FROM
    (SELECT unnest(range(lo, hi + 1)) AS bucket_s FROM (SELECT min(ts_ns // {SECOND_NS}) AS lo, max(ts_ns // {SECOND_NS}) AS hi FROM fills)) LEFT JOIN
    (SELECT ts_ns // {SECOND_NS} AS bucket_s, count(*) AS n, sum(size) AS qty, sum(size * side) AS signed FROM fills GROUP BY 1) USING (bucket_s)) WINDOW w AS (ORDER BY bucket_s)) GROUP BY 1""", *TOUCHED))
def second_logs(spark, sf_dir):
    """The run's log by second written as CSV and read again: by hour its seconds, fills, quantity and the digest of its lines."""
    path = scratch(spark, "second-log")
    write_csv(by_second(touch_stored(spark, sf_dir)), path)
    back = spark.read.schema(", ".join(f"{c} string" for c in COLUMNS)).csv(path, header=True)
    rows = back.select(F.col("bucket_s").cast("long").alias("s"), F.col("n_fills").cast("long").alias("n"), F.col("total_qty").cast("double").alias("q"), F.concat_ws(",", *COLUMNS).alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("s", "line"))), lambda x: x["line"])  # an hour's seconds
    return rows.groupBy(F.expr(f"s div {HOUR_S}").alias("hour")).agg(F.count("*").alias("n_seconds"), F.sum("n").alias("n_fills"), F.sum("q").alias("qty"), F.sha2(F.array_join(lines, "\n"), 256).alias("lines_sha256"))


@query(sql("""SELECT sum(n)::BIGINT AS n, round(sum(nf * (p - 1) ** 2 + (n - nf) * p ** 2) / sum(n), 9) AS brier, round(sum(-nf * ln(p) - (n - nf) * ln(1 - p)) / sum(n), 9) AS log_loss FROM (
  SELECT r AS rank, count(*) AS n, count(f.interval)::DOUBLE AS nf, greatest(1e-12, least(1 - 1e-12, 0.5e0 / r)) AS p FROM (SELECT s.seq, r FROM snap s, (SELECT unnest(range(1, 6))::INT AS r)) a LEFT JOIN (SELECT DISTINCT interval, idx FROM fills) f ON f.interval = a.seq AND f.idx = a.r GROUP BY r)""",
           "quotes AS (SELECT sym, seq, ts_ns, 1 AS side, bids[r].px AS px, 3e0 AS size, r AS idx FROM snap, (SELECT unnest(range(1, 6))::INT AS r))", *TOUCHED[1:]))
def depth_scores(spark, sf_dir):
    """Brier score and log loss of a prediction by depth rank, a half over the rank, from each rank's orders and filled ones."""
    per = brier_by_rank(spark, sf_dir).withColumns({"nf": F.round(F.col("p") * F.col("n")), "p": F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.lit(0.5) / F.col("rank")))})
    n, nf, p = (F.col(c) for c in ("n", "nf", "p"))
    return per.agg(F.sum(n).alias("n"), F.round(F.sum(nf * F.pow(p - 1, 2) + (n - nf) * F.pow(p, 2)) / F.sum(n), 9).alias("brier"), F.round(F.sum(-nf * F.log(p) - (n - nf) * F.log(1 - p)) / F.sum(n), 9).alias("log_loss"))
