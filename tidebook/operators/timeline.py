"""Windows over time that keep working when one key holds most of the rows.

A window over a key's whole history would put that history into one task. Here
it is cut into blocks of time: windows run inside blocks, and a table with
one row for each key and block carries what earlier blocks contribute.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_NS = 86_400_000_000_000


def block(ts: str = "ts_ns", size: int = BLOCK_NS) -> Column:
    return F.expr(f"{ts} div {size}")


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys over all shuffle partitions. Adaptive execution would put partitions together until there is one a core, and a task would sort a core's share of the input at once."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _same(keys: list[str], other: DataFrame, here: DataFrame) -> Column:
    return reduce(lambda a, b: a & b, [here[k].eqNullSafe(other[f"_{k}"]) for k in keys])


def _with_carry(df: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    renamed = carry.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in carry.columns if c not in keys])
    return df.join(renamed, _same(keys, renamed, df), "left").drop(*[f"_{k}" for k in keys])


def last_known(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, str], ts: str = "ts_ns",
               before: bool = False, size: int = BLOCK_NS) -> DataFrame:
    """Adds for each column (source: new name) its last non-null value up to this row, or before it.

    Rows are ordered by ``order``, whose first column must be ts. Null where nothing came yet.
    """
    df = df.withColumn("_blk", block(ts, size))
    by = keys + ["_blk"]
    inside = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    place = F.struct(*order)
    ends = df.groupBy(*by).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), place)).alias(f"_end_{n}") for c, n in columns.items()])
    earlier = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*by, *[F.last(f"_end_{n}", ignorenulls=True).over(earlier).alias(f"_carry_{n}") for n in columns.values()])
    own = df.withColumns({f"_own_{n}": F.last(c, ignorenulls=True).over(inside) for c, n in columns.items()})
    out = _with_carry(own, carry, by).withColumns({n: F.coalesce(f"_own_{n}", f"_carry_{n}") for n in columns.values()})
    return out.drop("_blk", *[f"_own_{n}" for n in columns.values()], *[f"_carry_{n}" for n in columns.values()])


def running_sum(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, str], ts: str = "ts_ns",
                before: bool = False, size: int = BLOCK_NS) -> DataFrame:
    """Adds for each column (source: new name) its sum over the key's rows up to this row, or before it; 0 at first."""
    df = df.withColumn("_blk", block(ts, size))
    by = keys + ["_blk"]
    inside = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    totals = df.groupBy(*by).agg(*[F.sum(c).alias(f"_total_{n}") for c, n in columns.items()])
    earlier = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*by, *[F.sum(f"_total_{n}").over(earlier).alias(f"_carry_{n}") for n in columns.values()])
    own = df.withColumns({f"_own_{n}": F.sum(c).over(inside) for c, n in columns.items()})
    zero = F.lit(0)
    out = _with_carry(own, carry, by).withColumns(
        {n: F.coalesce(f"_own_{n}", zero) + F.coalesce(f"_carry_{n}", zero) for n in columns.values()})
    return out.drop("_blk", *[f"_own_{n}" for n in columns.values()], *[f"_carry_{n}" for n in columns.values()])


def _added(parts: list[Column]) -> Column:
    """Sum of the parts that are not null, null if all are."""
    return reduce(lambda a, b: F.coalesce(a + b, a, b), parts)


def _merged(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """(count, mean, sum of squares about the mean) of two sets of numbers together."""
    (n, mean, m2), (k, other, o2) = a, b
    n, k, total, off = n.cast("double"), k.cast("double"), (n + k).cast("double"), other - mean
    some = (n > 0) & (k > 0)
    return (n + k, F.when(some, mean + off * k / total).otherwise(F.coalesce(mean, other)),
            F.when(some, m2 + o2 + off * off * n * k / total).otherwise(F.coalesce(m2, o2)))


def trailing(df: DataFrame, keys: list[str], width_ns: int, columns: dict[str, Column], since: dict[str, Column] | None = None,
             moments: dict[str, Column] | None = None, ts: str = "ts_ns") -> DataFrame:
    """Adds sums of columns over the rows with time in (t - width, t], ties included; null where no value is in the window.

    ``moments`` adds for each of its columns name_n, name_mean and name_var, the population variance, from merged central moments. A value whose name is in ``since``
    counts only while that time is inside the window too; it must be the time of the row before, at which what the value measures began
    (a log return's earlier end), so at most one value of a key spans a block's border; more raise.

    Time is cut into blocks as wide as the window, which then is the rest of one block and the beginning of the next. Sums run from a
    block's beginning and from its end, and nothing is ever taken off: an emptied window is null, and a NaN is only in windows that hold it.
    A row with values serves its own block and the next.
    """
    since, moments = since or {}, moments or {}
    values = columns | moments
    blk, at = F.expr(f"{ts} div {width_ns}"), F.col(ts)
    own, cross = F.col("_e.own"), {n: (c < blk * width_ns) for n, c in since.items()}

    def entry(shift: int, here: bool, at: Column, names: list[str]) -> Column:
        def value(n: str) -> Column:
            v = values[n]
            return F.when(F.lit(n in names) & ~F.coalesce(cross.get(n, F.lit(False)) if here else F.lit(False), F.lit(False)), v)

        return F.struct((blk + shift).alias("blk"), at.alias("at"), F.lit(here).alias("own"), *[value(n).alias(n) for n in values],
                        *[(F.when(cross[n] & v.isNotNull(), F.struct(at.alias("lo"), (since[n] + width_ns).alias("hi"), v.alias("v"))) if here
                           else F.lit(None).cast("struct<lo:bigint,hi:bigint,v:double>")).alias(f"x_{n}") for n, v in values.items() if n in since])

    leaving = [(at, [n for n in values if n not in since])] + [(c, [n]) for n, c in since.items()]
    entries = [entry(0, True, at, list(values))]
    for left, names in leaving:
        if names:
            serves = reduce(lambda a, b: a | b, [values[n].isNotNull() for n in names]) & (left >= blk * width_ns)
            entries.append(F.when(serves, entry(1, False, left + width_ns, names)))
    both = df.withColumn("_e", F.explode(F.array_compact(F.array(*entries)))).withColumn("_part", F.col("_e.blk"))
    both = _spread(both, *keys, "_part")
    part = Window.partitionBy(*keys, "_part")
    first, last = part.orderBy("_e.at").rangeBetween(Window.unboundedPreceding, 0), part.orderBy(F.desc("_e.at")).rangeBetween(Window.unboundedPreceding, -1)
    sides = (("a", first, own), ("b", last, ~own))
    run = {f"_{s}_{n}": F.sum(F.when(mine, F.col(f"_e.{n}"))).over(w) for s, w, mine in sides for n in columns}
    run |= {f"_{s}_{what}_{n}": f(F.when(mine, F.col(f"_e.{n}"))).over(w) for s, w, mine in sides for n in moments for what, f in (("n", F.count), ("mean", F.avg), ("var", F.var_pop))}
    run |= {f"_x_{n}": F.max(f"_e.x_{n}").over(part) for n in since} | {f"_xs_{n}": F.count(f"_e.x_{n}").over(part) for n in since}
    out = both.withColumns(run).where(own)
    spans = {n: F.when(F.col(f"_xs_{n}") > 1, F.raise_error(F.lit(f"trailing: values of {n} do not begin at the row before")).cast("double"))
             .when((F.col(f"_x_{n}.lo") <= at) & (at < F.col(f"_x_{n}.hi")), F.col(f"_x_{n}.v")) for n in since}
    made = {n: _added([F.col(f"_a_{n}"), F.col(f"_b_{n}"), *([spans[n]] if n in spans else [])]) for n in columns}
    for n in moments:
        parts = [(F.col(f"_{s}_n_{n}"), F.col(f"_{s}_mean_{n}"), F.col(f"_{s}_var_{n}") * F.col(f"_{s}_n_{n}")) for s in "ab"]
        if n in spans:
            parts.append((F.when(spans[n].isNotNull(), 1).otherwise(0), spans[n], F.when(spans[n].isNotNull(), spans[n] * 0)))
        count, mean, m2 = reduce(_merged, parts)
        made |= {f"{n}_n": count.cast("long"), f"{n}_mean": mean, f"{n}_var": m2 / count}
    return out.withColumns(made).drop("_e", "_part", *run)


def as_of(probes: DataFrame, states: DataFrame, keys: list[str], value: str, name: str, at: str = "ts_ns", tie: str = "seq") -> DataFrame:
    """Adds to each probe the last non-null ``value`` of states with ts_ns at or before ``at``; of equal times the largest seq counts.

    One union and one pass in time order, so no pair of rows is ever formed.
    """
    cols = probes.columns
    left = probes.withColumns({"_at": F.col(at), "_kind": F.lit(1), "_tie": F.col(tie), "_value": F.lit(None).cast(states.schema[value].dataType)})
    right = states.select(*keys, F.col("ts_ns").alias("_at"), F.lit(0).alias("_kind"), F.col(tie).alias("_tie"), F.col(value).alias("_value"))
    both = left.unionByName(right, allowMissingColumns=True)
    out = last_known(both, keys, ["_at", "_kind", "_tie"], {"_value": name}, ts="_at")
    return out.where("_kind = 1").select(*cols, name)


def looked_up(df: DataFrame, other: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Adds to each row the columns of other where all keys are equal, nulls too; null where there is none, and of repeated ones one counts.

    One union and one pass, in windows of one value of the keys.
    """
    both = other.select(*keys, *columns, F.lit(0).alias("_kind")).unionByName(df.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_kind").rowsBetween(Window.unboundedPreceding, 0)
    return _spread(both, *keys).withColumns({c: F.first(c, ignorenulls=True).over(w) for c in columns}).where("_kind = 1").select(*df.columns, *columns)
