"""Ranks and running values over one order of all rows, without putting all rows into one task.

Rows are dealt to tasks by ranges of the order. Inside a range a window runs; a table with one row for each range
and key carries what the ranges before it, or after it, contribute.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.sources.storage import stored

PART = "_part"


def in_ranges(df: DataFrame, by: list[str], order: list[str], partitions: int | None = None) -> DataFrame:
    """df dealt by ranges of (by, order), stored with each row's range as _part; ascending, nulls first."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(n, *by, *order).withColumn(PART, F.spark_partition_id()), "ranges")


def running(ranged: DataFrame, by: list[str], order: list[str], name: str, value: Column, fold: Callable[[Column], Column], join: Callable[[Column, Column], Column],
            backwards: bool = False) -> DataFrame:
    """Adds name: fold (F.sum, F.min, F.max) of value over the rows of the same ``by`` up to this one in the order, or from this one on if backwards.

    ranged comes from ``in_ranges`` with the same by and order, which must tell a key's rows apart; join combines two folded values, neither of them null.
    """
    w = Window.partitionBy(*by, PART).orderBy(*[F.desc(c) if backwards else F.asc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    own = ranged.withColumn("_own", fold(value).over(w))
    # Keys that lie in several ranges: as many rows as there are ranges, twice, whatever the number of keys and rows.
    per = ranged.groupBy(*by, PART).agg(fold(value).alias("_total"))
    ends = per.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(PART, "_total"))).alias("_parts")).where(F.size("_parts") > 1)

    def before(p: Column) -> Column:
        others = F.filter("_parts", lambda o: (o[PART] > p[PART]) if backwards else (o[PART] < p[PART]))
        return F.reduce(F.slice(others, 2, F.greatest(F.size(others), F.lit(1))), F.try_element_at(others, F.lit(1))["_total"], lambda a, o: join(a, o["_total"]))

    carry = ends.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.explode(F.transform("_parts", lambda p: F.struct(p[PART].alias("at"), before(p).alias("carry")))).alias("_c"))
    carry = carry.where("_c.carry is not null").select(*[f"_k_{c}" for c in by], F.col("_c.at").alias("_k_at"), F.col("_c.carry").alias("_carry"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by], F.col(PART) == F.col("_k_at"))
    out = own.join(carry, same, "left")
    return out.withColumn(name, F.when(F.col("_carry").isNull(), F.col("_own")).otherwise(F.coalesce(join(F.col("_carry"), F.col("_own")), "_carry"))).drop("_own", "_carry", "_k_at", *[f"_k_{c}" for c in by])


def average_ranks(df: DataFrame, value: str, name: str, by: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """Adds average-tie ranks of value, from 1, inside each ``by``. Only distinct values with their counts are put in order, so ties cost nothing."""
    by = by or []
    per = in_ranges(df.groupBy(*by, value).agg(F.count("*").alias("_n")), by, [value], partitions)
    per = running(per, by, [value], "_upto", F.col("_n"), F.sum, lambda a, b: a + b)
    per = per.select(*[F.col(b).alias(f"_{b}") for b in by], F.col(value).alias("_v"), (F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2).alias(name))
    same = [F.col(value).eqNullSafe(F.col("_v")), *[F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by]]
    return df.join(per, reduce(lambda a, b: a & b, same)).drop("_v", *[f"_{b}" for b in by])


def step_up(p: DataFrame, alpha: float = 0.1, partitions: int | None = None) -> DataFrame:
    """Benjamini-Hochberg and -Yekutieli over one family (a row a hypothesis: id, p): adjusted p and decisions. Ids tell rows apart."""
    ranged = in_ranges(p.select("id", "p"), [], ["p", "id"], partitions)
    ranked = running(ranged, [], ["p", "id"], "rank", F.lit(1), F.sum, lambda a, b: a + b)
    m = ranged.agg(F.count("*").alias("m"))
    # The harmonic number from its first terms or, beyond, from its expansion, which then is exact in doubles.
    near = F.aggregate(F.sequence(F.lit(1), F.least("m", F.lit(1_000_000)).cast("int")), F.lit(0.0), lambda a, i: a + F.lit(1.0) / i)
    far = F.log("m") + 0.5772156649015329 + 1 / (2.0 * F.col("m")) - 1 / (12.0 * F.col("m") * F.col("m"))
    m = m.where("m > 0").withColumn("h", F.when(F.col("m") <= 1_000_000, near).otherwise(far))
    raw = ranked.join(F.broadcast(m), how="cross").withColumn("raw", F.col("p") * F.col("m") / F.col("rank"))  # one row
    out = running(raw, [], ["p", "id"], "least", F.col("raw"), F.min, F.least, backwards=True)
    out = running(out.withColumn("raw_y", F.col("raw") * F.col("h")), [], ["p", "id"], "least_y", F.col("raw_y"), F.min, F.least, backwards=True)
    qb, qy = F.least(F.lit(1.0), "least"), F.least(F.lit(1.0), "least_y")
    return out.select("id", "p", F.col("rank").cast("long").alias("rank"), F.round(qb, 9).alias("q_bh"), F.round(qy, 9).alias("q_bhy"), (qb <= alpha).alias("bh"), (qy <= alpha).alias("bhy"))


def quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float], partitions: int | None = None) -> DataFrame:
    """(by, n, each name): interpolated quantiles of the non-null values inside each ``by``, from counts of distinct values in order; no key's values meet in one place."""
    per = in_ranges(df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n")), by, [value], partitions)
    per = running(per, by, [value], "_upto", F.col("_n"), F.sum, lambda a, b: a + b)
    total = per.groupBy(*[F.col(b).alias(f"_{b}") for b in by]).agg(F.sum("_n").alias("n"))
    per = per.join(total, reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by], F.lit(True)))
    at = {name: F.lit(share) * (F.col("n") - 1) for name, share in shares.items()}
    ends = {f"_{end}_{name}": F.min(F.when(F.col("_upto") > cut(p), F.col(value))) for name, p in at.items() for end, cut in (("lo", F.floor), ("hi", F.ceil))}
    out = per.groupBy(*by).agg(F.max("n").alias("n"), *[e.alias(c) for c, e in ends.items()])
    mid = {name: F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (p - F.floor(p)) for name, p in at.items()}
    return out.select(*by, "n", *[e.alias(name) for name, e in mid.items()])
