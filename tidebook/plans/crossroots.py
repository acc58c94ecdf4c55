"""Queries across roots: rolling regressions of a root's move on its own and all roots' flow, what they earn, and a null by permuted blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions.stats import corr
from tidebook.operators.linear import SMALL, products, solve
from tidebook.operators.resampling import shuffle_step, shuffled
from tidebook.sources import market as mk
from tidebook.sources.storage import stored

from .desk import CROSS, hourly_moves
from .registry import query, sql
from .tape import OFI, order_flow

ROOTS, DAY_NS = 13, mk.DAY_NS
#: Four-hour bins; a window is three blocks of bins to fit and one to score.
BIN, BLOCK, IN_BLOCKS = 4 * mk.HOUR_NS, 20, 3
#: A taker's fee in basis points, beside half the spread.
FEE_BP = 0.015
X, Y = range(1, 1 + ROOTS), range(1 + ROOTS, 1 + 2 * ROOTS)


def panel(spark, sf_dir) -> DataFrame:
    """k (bin from the first), x: each root's flow, y: its move to the next bin in bp, h: half its spread in bp; 0 where a root has no snapshot."""
    at = F.struct("ts_ns", "seq")
    e = order_flow(spark, sf_dir).select(F.expr(f"user_id % {ROOTS}").cast("int").alias("root"), F.expr(f"ts_ns div {BIN}").alias("bin"), "ts_ns", "seq", "ofi", "mid")
    e = e.groupBy("root", "bin").agg(F.sum("ofi").alias("x"), F.max_by("mid", at).alias("c"))
    w = Window.partitionBy("root").orderBy("bin")  # one row a bin
    move = F.when(F.lead("bin").over(w) == F.col("bin") + 1, 1e4 * (F.log(F.lead("c").over(w)) - F.log("c")))
    e = stored(e.withColumns({"y": F.coalesce(move, F.lit(0.0)), "h": F.lit(5e3) / F.col("c")}), "root-bins")
    first = e.agg(F.min("bin").alias("t0"))
    rows = e.groupBy("bin").agg(F.map_from_entries(F.collect_list(F.struct("root", F.struct("x", "y", "h")))).alias("m")).join(F.broadcast(first), how="cross")  # one row

    def each(what: str):
        return F.transform(F.sequence(F.lit(0), F.lit(ROOTS - 1)), lambda r: F.coalesce(F.try_element_at("m", r)[what], F.lit(0.0)))

    return rows.select((F.col("bin") - F.col("t0")).alias("k"), each("x").alias("x"), each("y").alias("y"), each("h").alias("h"))


def window_sums(p: DataFrame) -> DataFrame:
    """(win, i, j, v): sums of products of (1, x, y) over each window's bins to fit, from sums of blocks; only windows whose bins to score are all there."""
    b = p.select(F.expr(f"k div {BLOCK}").alias("b"), F.concat(F.array(F.lit(1.0)), "x", "y").alias("z"))
    per = stored(products(b, ["b"], "z"), "block-products")
    last = p.agg(((F.max("k") + 1 - IN_BLOCKS * BLOCK - BLOCK) / BLOCK).cast("long").alias("last"), F.max("k").alias("top"))
    w = per.join(F.broadcast(last), how="cross")  # one row
    w = w.withColumn("win", F.explode(F.sequence(F.col("b") - (IN_BLOCKS - 1), "b"))).where(f"win >= 0 and win <= last and top + 1 >= {(IN_BLOCKS + 1) * BLOCK}")
    return w.groupBy("win", "i", "j").agg(F.sum("v").alias("v"))


def fitted(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = stored(panel(spark, sf_dir), "root-panel")
    sums = stored(window_sums(p), "window-sums")
    models = {f"own{r}": ([0, X[r]], [Y[r]]) for r in range(ROOTS)} | {"cross": ([0, *X], list(Y))}
    return p, sums, solve(sums, "win", 1 + 2 * ROOTS, models)


_WIDE = ", ".join(f"coalesce(max(CASE WHEN root = {r} THEN {c} END), 0) AS {c}{r}" for c in "xyh" for r in range(ROOTS))
PANEL = [f"""rb AS (SELECT root, bin, x, 5e3 / c AS h, CASE WHEN lead(bin) OVER w = bin + 1 THEN 1e4 * (ln(lead(c) OVER w) - ln(c)) ELSE 0 END AS y FROM
  (SELECT ofi.sym, user_id % {ROOTS} AS root, ofi.ts_ns // {BIN} AS bin, sum(ofi) OVER q AS x, last_value(ofi.mid) OVER (PARTITION BY user_id % {ROOTS}, ofi.ts_ns // {BIN} ORDER BY ofi.ts_ns, seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS c,
    row_number() OVER q AS one FROM ofi JOIN snap USING (seq) WINDOW q AS (PARTITION BY user_id % {ROOTS}, ofi.ts_ns // {BIN})) WHERE one = 1 WINDOW w AS (PARTITION BY root ORDER BY bin))""",
         f"panel AS MATERIALIZED (SELECT bin - (SELECT min(bin) FROM rb) AS k, {_WIDE} FROM rb GROUP BY bin)",
         f"wins AS (SELECT unnest(range(0, (SELECT (max(k) + 1) // {BLOCK} FROM panel) - {IN_BLOCKS})) AS win)",
         f"long AS (SELECT k, j, v FROM (SELECT k, list_value(1e0, {', '.join(f'{c}{r}' for c in 'xy' for r in range(ROOTS))}) AS z FROM panel), (SELECT unnest(range({1 + 2 * ROOTS})) AS j) i, LATERAL (SELECT z[j + 1] AS v))",
         f"s0 AS MATERIALIZED (SELECT win, a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM wins JOIN long a ON a.k >= win * {BLOCK} AND a.k < (win + {IN_BLOCKS}) * {BLOCK} JOIN long b USING (k) GROUP BY ALL)",
         *[f"""s{n + 1} AS MATERIALIZED (SELECT a.win, a.i, a.j, CASE WHEN NOT p.v > {SMALL} * greatest(o.v, 1e-300) THEN a.v WHEN a.i = {n} AND a.j = {n} THEN 1 / p.v WHEN a.i = {n} THEN a.v / p.v WHEN a.j = {n} THEN -a.v / p.v ELSE a.v - c.v * (r.v / p.v) END AS v
  FROM s{n} a JOIN s{n} p ON p.win = a.win AND p.i = {n} AND p.j = {n} JOIN s{n} r ON r.win = a.win AND r.i = {n} AND r.j = a.j JOIN s{n} c ON c.win = a.win AND c.i = a.i AND c.j = {n} JOIN s0 o ON o.win = a.win AND o.i = {n} AND o.j = {n})""" for n in range(1 + ROOTS)],
         f"""held AS ({' UNION ALL '.join(f'SELECT p.win, {n} AS i, p.v > {SMALL} * greatest(o.v, 1e-300) AS used FROM s{n} p JOIN s0 o USING (win, i, j) WHERE i = {n} AND j = {n}' for n in range(1 + ROOTS))})""",
         f"""crossed AS (SELECT s.win, s.j - {1 + ROOTS} AS root, s.i, CASE WHEN used THEN v ELSE 0 END AS beta FROM s{1 + ROOTS} s JOIN held USING (win, i) WHERE s.i <= {ROOTS} AND s.j > {ROOTS})""",
         f"""own AS (SELECT win, root, CASE WHEN used THEN sxy / sxx ELSE 0 END AS slope, sy / n - CASE WHEN used THEN sxy / sxx ELSE 0 END * sx / n AS level FROM (SELECT *, xy - sx * (sy / n) AS sxy, xx - sx * (sx / n) AS sxx, xx - sx * (sx / n) > {SMALL} * greatest(xx, 1e-300) AS used FROM (
  SELECT x.win, x.i - 1 AS root, n.v AS n, sx.v AS sx, sy.v AS sy, x.v AS xx, xy.v AS xy FROM s0 x JOIN s0 n ON n.win = x.win AND n.i = 0 AND n.j = 0 JOIN s0 sx ON sx.win = x.win AND sx.i = 0 AND sx.j = x.i
    JOIN s0 sy ON sy.win = x.win AND sy.i = 0 AND sy.j = x.i + {ROOTS} JOIN s0 xy ON xy.win = x.win AND xy.i = x.i AND xy.j = x.i + {ROOTS} WHERE x.i = x.j AND x.i BETWEEN 1 AND {ROOTS})))"""]


@query(sql("""SELECT win, root::INT AS root, i::INT AS j, 'cross' AS model, round(beta, 6) AS beta FROM crossed
  UNION ALL SELECT win, root::INT, 0, 'own', round(level, 6) FROM own UNION ALL SELECT win, root::INT, (root + 1)::INT, 'own', round(slope, 6) FROM own""", OFI, *PANEL))
def cross_betas(spark, sf_dir):
    """Each window's coefficients of a root's next move on its own flow, and on all roots' flows; j is 0 for the level, else the root's number and one."""
    betas = fitted(spark, sf_dir)[2]
    own = F.col("model") != "cross"
    out = betas.select("win", (F.col("y") - (1 + ROOTS)).cast("int").alias("root"), own.alias("own"), F.posexplode("betas").alias("n", "beta"))
    return out.select("win", "root", F.when(F.col("own") & (F.col("n") > 0), F.col("root") + 1).otherwise(F.col("n")).cast("int").alias("j"),
                      F.when(F.col("own"), "own").otherwise("cross").alias("model"), F.round("beta", 6).alias("beta"))


def _net(p: str) -> str:
    """SQL: gross and net of positions in proportion to predictions over their scale."""
    return f"avg(gross_{p}) AS gross_{p}, avg(gross_{p} - cost_{p}) AS net_{p}"


@query(sql(f"""SELECT r.win, round(r2_own, 6) AS r2_own, round(r2_cross, 6) AS r2_cross, round(incr_r2, 6) AS incr_r2, round(gross_own, 6) AS gross_own, round(net_own, 6) AS net_own, round(gross_cross, 6) AS gross_cross, round(net_cross, 6) AS net_cross FROM
  (SELECT win, avg(a) AS r2_own, avg(b) AS r2_cross, avg(b - a) AS incr_r2 FROM (SELECT win, root, CASE WHEN sum(y * y) > 0 THEN 1 - sum((y - own) ** 2) / sum(y * y) END AS a, CASE WHEN sum(y * y) > 0 THEN 1 - sum((y - crossp) ** 2) / sum(y * y) END AS b FROM scored GROUP BY ALL) GROUP BY win) r
  JOIN (SELECT win, {_net('own')}, {_net('cross')} FROM (SELECT win, k, {', '.join(f'sum(q_{p} * y) AS gross_{p}, sum(d_{p} * (h + {FEE_BP}e0)) AS cost_{p}' for p in ('own', 'cross'))} FROM traded GROUP BY ALL) GROUP BY win) USING (win)""", OFI, *PANEL,
           f"""scored AS MATERIALIZED (SELECT win, k, root, x.x, x.y, x.h, level + slope * x.x AS own, crossp, sd FROM wins JOIN panel p ON k >= (win + {IN_BLOCKS}) * {BLOCK} AND k < (win + {IN_BLOCKS + 1}) * {BLOCK}
  CROSS JOIN LATERAL (SELECT unnest(range({ROOTS})) AS root, unnest([{', '.join(f'p.x{r}' for r in range(ROOTS))}]) AS x, unnest([{', '.join(f'p.y{r}' for r in range(ROOTS))}]) AS y, unnest([{', '.join(f'p.h{r}' for r in range(ROOTS))}]) AS h) x
  JOIN own USING (win, root) JOIN (SELECT win, k, root, sum(beta * v) AS crossp FROM crossed JOIN long ON j = i GROUP BY ALL) c USING (win, k, root)
  JOIN (SELECT y.win, y.i - {1 + ROOTS} AS root, sqrt(greatest(y.v / n.v - (m.v / n.v) ** 2, 0)) AS sd FROM s0 y JOIN s0 n ON n.win = y.win AND n.i = 0 AND n.j = 0 JOIN s0 m ON m.win = y.win AND m.i = 0 AND m.j = y.i WHERE y.i = y.j AND y.i > {ROOTS}) USING (win, root))""",
           """sized AS (SELECT *, w_own / CASE WHEN sum(abs(w_own)) OVER g > 0 THEN sum(abs(w_own)) OVER g ELSE 1 END AS q_own, w_cross / CASE WHEN sum(abs(w_cross)) OVER g > 0 THEN sum(abs(w_cross)) OVER g ELSE 1 END AS q_cross
  FROM (SELECT *, own / CASE WHEN sd > 1e-6 THEN sd ELSE 1 END AS w_own, crossp / CASE WHEN sd > 1e-6 THEN sd ELSE 1 END AS w_cross FROM scored) WINDOW g AS (PARTITION BY win, k))""",
           "traded AS (SELECT *, abs(q_own - lag(q_own, 1, 0) OVER o) AS d_own, abs(q_cross - lag(q_cross, 1, 0) OVER o) AS d_cross FROM sized WINDOW o AS (PARTITION BY win, root ORDER BY k))"))
def cross_wfo(spark, sf_dir):
    """Windows over time: share of the next block's moves that each model explains against a prediction of nothing, and what positions in proportion to its predictions earn, in bp a bin, before and after costs."""
    p, sums, betas = fitted(spark, sf_dir)
    root = F.col("y") - (1 + ROOTS)
    fit = betas.groupBy("win").agg(F.map_from_entries(F.collect_list(F.when(F.col("model") != "cross", F.struct(root, "betas")))).alias("own"),  # nulls are left out
                                   F.map_from_entries(F.collect_list(F.when(F.col("model") == "cross", F.struct(root, "betas")))).alias("crossed"))
    cell = lambda i, j: F.max(F.when((F.col("i") == i) & (F.col("j") == j), F.col("v")))
    spread = sums.groupBy("win").agg(cell(0, 0).alias("n"), *[c for y in Y for c in (cell(0, y).alias(f"m{y}"), cell(y, y).alias(f"q{y}"))])
    spread = spread.select("win", F.array(*[F.sqrt(F.greatest(F.col(f"q{y}") / F.col("n") - F.pow(F.col(f"m{y}") / F.col("n"), 2), F.lit(0.0))) for y in Y]).alias("sd"))
    rows = p.withColumn("win", F.expr(f"k div {BLOCK} - {IN_BLOCKS}")).join(fit.join(spread, "win"), "win")  # a row a window
    at = rows.select("win", "k", "x", "own", "crossed", "sd", F.posexplode(F.arrays_zip("x", "y", "h")).alias("root", "r"))
    cross = F.expr("aggregate(arrays_zip(slice(crossed[root], 2, size(x)), x), crossed[root][0], (s, b) -> s + b['0'] * b.x)")
    at = at.select("win", "k", "root", F.col("r.y").alias("y"), F.col("r.h").alias("h"), F.expr("own[root][0] + own[root][1] * r.x").alias("own"), cross.alias("cross"), F.expr("if(sd[root] > 1e-6, sd[root], 1)").alias("sd"))
    bin_, path = Window.partitionBy("win", "k"), Window.partitionBy("win", "root").orderBy("k")  # a root each, a block each
    for m in ("own", "cross"):
        gross = F.sum(F.abs(F.col(m) / F.col("sd"))).over(bin_)
        at = at.withColumn(f"q_{m}", F.col(m) / F.col("sd") / F.when(gross > 0, gross).otherwise(1.0))
    for m in ("own", "cross"):
        at = at.withColumn(f"d_{m}", F.abs(F.col(f"q_{m}") - F.lag(f"q_{m}", 1, 0.0).over(path)))
    at = stored(at, "root-positions")
    whole = F.sum(F.col("y") * F.col("y"))
    r2 = at.groupBy("win", "root").agg(*[F.when(whole > 0, 1 - F.sum(F.pow(F.col("y") - F.col(m), 2)) / whole).alias(m) for m in ("own", "cross")])
    r2 = r2.groupBy("win").agg(F.avg("own").alias("r2_own"), F.avg("cross").alias("r2_cross"), F.avg(F.col("cross") - F.col("own")).alias("incr_r2"))
    pnl = at.groupBy("win", "k").agg(*[e for m in ("own", "cross") for e in (F.sum(F.col(f"q_{m}") * F.col("y")).alias(f"gross_{m}"), F.sum(F.col(f"d_{m}") * (F.col("h") + FEE_BP)).alias(f"cost_{m}"))])
    pnl = pnl.groupBy("win").agg(*[e for m in ("own", "cross") for e in (F.avg(f"gross_{m}").alias(f"gross_{m}"), F.avg(F.col(f"gross_{m}") - F.col(f"cost_{m}")).alias(f"net_{m}"))])
    out = r2.join(pnl, "win")
    return out.select("win", *[F.round(c, 6).alias(c) for c in out.columns if c != "win"])


#: Hours of a block, and permutations.
HOURS, DRAWS = 12, 1000


@query(sql(f"""SELECT s.sym, any_value(s.n) AS n, round(any_value(s.r2), 8) AS observed, (count(*) FILTER (t.r2 >= s.r2 - 1e-12) + 1) / {DRAWS + 1}e0 AS p
  FROM (SELECT sym, n, (r1 * r1 + r2 * r2 - 2 * r1 * r2 * r12) / (1 - r12 * r12) - r1 * r1 AS r2 FROM fit WHERE abs(r12) < 1) s JOIN drawn t USING (sym) GROUP BY s.sym""", OFI, CROSS,
           f"""ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY bin) - 1 AS i, count(*) OVER (PARTITION BY sym) AS n FROM wide)""",
           f"""blocks AS (SELECT sym, n, nb, unnest(range(nb)) AS b, ceil(sqrt(nb))::BIGINT AS r, (nb + ceil(sqrt(nb))::BIGINT - 1) // ceil(sqrt(nb))::BIGINT AS c FROM (SELECT DISTINCT sym, n, (n + {HOURS - 1}) // {HOURS} AS nb FROM ranked))""",
           f"""places AS MATERIALIZED (WITH RECURSIVE walk AS (SELECT sym, n, nb, r, c, b, j, {shuffle_step('b', 'r', 'c', 'j', '//')} AS x, 1 AS step FROM blocks, (SELECT unnest(range(1, {DRAWS + 1})) AS j)
  UNION ALL SELECT sym, n, nb, r, c, b, j, {shuffle_step('x', 'r', 'c', 'j', '//')}, step + 1 FROM walk WHERE x >= nb) SELECT sym, n, nb, b, j, x AS place FROM walk WHERE x < nb)""",
           f"""moved AS (SELECT p.sym, p.j, p.place * {HOURS} + a.i % {HOURS} - CASE WHEN l.place < p.place THEN p.nb * {HOURS} - p.n ELSE 0 END AS i, a.x2 AS z
  FROM places p JOIN places l ON l.sym = p.sym AND l.j = p.j AND l.b = p.nb - 1 JOIN ranked a ON a.sym = p.sym AND a.i // {HOURS} = p.b)""",
           """drawn AS (SELECT sym, j, (r1 * r1 + r2 * r2 - 2 * r1 * r2 * r12) / (1 - r12 * r12) - r1 * r1 AS r2 FROM (
  SELECT a.sym, j, corr(a.y, a.x1) AS r1, corr(a.y, z) AS r2, corr(a.x1, z) AS r12 FROM moved m JOIN ranked a USING (sym, i) GROUP BY ALL) WHERE abs(r12) < 1)"""))
def block_permutation_null(spark, sf_dir):
    """What the other symbol's flow adds, against its flow with blocks of hours in random order: each series keeps what it is inside a block, and only their alignment goes.

    A block's place in a permutation is arithmetic on its number and the permutation's, so every row knows where it goes; nothing is sorted for a draw.
    """
    h = hourly_moves(spark, sf_dir)
    w = h.where("dm is not null").join(h.select((1 - F.col("sym")).alias("sym"), "bin", F.col("ofi").alias("x2")), ["sym", "bin"])
    by = Window.partitionBy("sym")  # one row an hour
    w = stored(w.select("sym", "dm", "ofi", "x2", (F.row_number().over(by.orderBy("bin")) - 1).cast("long").alias("i"), F.count("*").over(by).alias("n")), "hourly-moves")
    blocks = w.groupBy("sym", "n", F.expr(f"i div {HOURS}").alias("b")).agg(F.collect_list(F.struct(F.expr(f"i % {HOURS}").alias("o"), "x2")).alias("part"))  # a block's hours
    nb = f"((n + {HOURS - 1}) div {HOURS})"
    drawn = blocks.withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(DRAWS)))).withColumns({"place": shuffled("b", nb, "j"), "short": shuffled(f"{nb} - 1", nb, "j")})
    moved = drawn.select("sym", "j", "place", F.expr(f"if(short < place, {nb} * {HOURS} - n, 0)").alias("less"), F.explode("part").alias("p"))
    moved = moved.select("sym", "j", (F.col("place") * HOURS + F.col("p.o") - F.col("less")).alias("i"), F.col("p.x2").alias("z"))
    added = F.expr("(r1 * r1 + r2 * r2 - 2 * r1 * r2 * r12) / (1 - r12 * r12) - r1 * r1")
    f = w.join(moved, ["sym", "i"]).groupBy("sym", "j").agg(corr("dm", "ofi").alias("r1"), corr("dm", "z").alias("r2"), corr("ofi", "z").alias("r12")).where("abs(r12) < 1")
    seen = w.groupBy("sym", "n").agg(corr("dm", "ofi").alias("r1"), corr("dm", "x2").alias("r2"), corr("ofi", "x2").alias("r12")).where("abs(r12) < 1").select("sym", "n", added.alias("observed"))
    hits = f.select("sym", added.alias("r2")).join(seen, "sym").groupBy("sym", "n", "observed").agg(F.count(F.when(F.col("r2") >= F.col("observed") - 1e-12, 1)).alias("hits"))
    return hits.select("sym", "n", F.round("observed", 8).alias("observed"), ((F.col("hits") + 1) / (DRAWS + 1)).alias("p"))


#: Bins of a day, and how many that all roots have make a day count.
DAY_BIN, COMMON = 6 * mk.HOUR_NS, 2


@query(sql(f"""SELECT day, bin, root::INT AS root, ofi, round(ret, 9) AS ret, round(half_bp, 9) AS half_bp FROM (
  SELECT *, count(*) OVER (PARTITION BY day) AS cells, ln(lead(c) OVER (PARTITION BY root, day ORDER BY bin)) - ln(c) AS ret FROM (SELECT *, count(*) OVER (PARTITION BY day, bin) AS roots FROM rows13) WHERE roots = {ROOTS}) WHERE cells >= {ROOTS * COMMON}""", OFI,
           f"""rows13 AS (SELECT root, day, bin, any_value(ofi) AS ofi, any_value(c) AS c, 5e3 / any_value(c) AS half_bp FROM (SELECT user_id % {ROOTS} AS root, o.ts_ns // {DAY_NS} AS day, o.ts_ns % {DAY_NS} // {DAY_BIN} AS bin, sum(ofi) OVER q AS ofi,
    last_value(o.mid) OVER (PARTITION BY user_id % {ROOTS}, o.ts_ns // {DAY_NS}, o.ts_ns % {DAY_NS} // {DAY_BIN} ORDER BY o.ts_ns, seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS c FROM ofi o JOIN snap USING (seq)
  WINDOW q AS (PARTITION BY user_id % {ROOTS}, o.ts_ns // {DAY_NS}, o.ts_ns % {DAY_NS} // {DAY_BIN})) GROUP BY root, day, bin)"""))
def root_panel(spark, sf_dir):
    """Bins that all thirteen roots have, of days with enough of them: each root's flow, its log return to the next such bin of the day, and half its spread in bp."""
    at = F.struct("ts_ns", "seq")
    e = order_flow(spark, sf_dir).select(F.expr(f"user_id % {ROOTS}").cast("int").alias("root"), F.expr(f"ts_ns div {DAY_NS}").alias("day"), F.expr(f"ts_ns % {DAY_NS} div {DAY_BIN}").alias("bin"), "ts_ns", "seq", "ofi", "mid")
    e = e.groupBy("day", "bin", "root").agg(F.sum("ofi").alias("ofi"), F.max_by("mid", at).alias("c"))
    # One row a bin and root from here on: a bin's roots and a day's bins are few.
    e = e.withColumn("roots", F.count("*").over(Window.partitionBy("day", "bin"))).where(F.col("roots") == ROOTS)
    e = e.withColumns({"cells": F.count("*").over(Window.partitionBy("day")), "next": F.lead("c").over(Window.partitionBy("day", "root").orderBy("bin"))})
    return e.where(F.col("cells") >= ROOTS * COMMON).select("day", "bin", "root", "ofi", F.round(F.log("next") - F.log("c"), 9).alias("ret"), F.round(F.lit(5e3) / F.col("c"), 9).alias("half_bp"))
