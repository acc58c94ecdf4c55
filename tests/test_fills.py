"""Closed-form fills, sessions and windows against event-by-event replays."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebook.functions import quotes as q
from tidebook.operators import fills as sim
from tidebook.operators import sessions as ses
from tidebook.operators import timeline
from tidebook.operators.resampling import bootstrap_means, sign_flip_null, splitmix
from tidebook.plans import stateful
from tidebook.plans.fills import touch, touch_orders
from tidebook.streaming import fills as stream

from .conftest import SF

LEVEL = "array<struct<px:double,sz:double>>"


def replay(snaps, trades, size=3.0):
    """Event by event: all orders are replaced at each snapshot, trades eat the queue first."""
    events = sorted([(s.ts_ns, 0, s.seq, s) for s in snaps] + [(t.ts_ns, 1, t.seq, t) for t in trades], key=lambda e: e[:3])
    orders, out = {}, []
    for _, kind, _, e in events:
        if kind == 0:
            orders[e.sym] = {1: [e.bids[0].px, e.bids[0].sz, size], -1: [e.asks[0].px, e.asks[0].sz, size]}
        elif e.sym in orders:
            o = orders[e.sym][-e.side]
            if abs(o[0] - e.price) <= 1e-9:
                ahead = min(e.size, o[1])
                fill = min(e.size - ahead, o[2])
                o[1] -= ahead
                o[2] -= fill
                if fill > 0:
                    out.append((e.seq, -e.side, o[0], fill))
    return sorted(out)


def books(spark, seed, n=200):
    r = random.Random(seed)
    snaps, trades = [], []
    for k in range(n):
        ts = r.randrange(n) * 3_600_000_000_000
        mid = 100 + r.randrange(3)
        if r.random() < 0.5:
            snaps.append((k, r.randrange(2), ts, mid * 1.0, [(mid - 0.5, float(r.randrange(4)))], [(mid + 0.5, float(r.randrange(4)))]))
        else:
            side = r.choice([1, -1])
            trades.append((k, r.randrange(2), ts, 0, side, mid + 0.5 * side, float(r.randrange(1, 9))))
    return (spark.createDataFrame(snaps, f"seq long, sym long, ts_ns long, mid double, bids {LEVEL}, asks {LEVEL}"),
            spark.createDataFrame(trades, "seq long, sym long, ts_ns long, user_id long, side int, price double, size double"))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_touch_fills_replay(spark, seed):
    snaps, trades = books(spark, seed)
    got = sim.fills(trades, sim.resting(snaps, touch_orders())).collect()
    assert sorted((f.seq, f.side, f.price, f.size) for f in got) == replay(snaps.collect(), trades.collect())


def test_touch_fills_count(spark):
    got = touch(spark, SF)
    assert got.count() == 177


def test_later_events_change_nothing_before(spark):
    snaps, trades = books(spark, 7)
    cut = 100 * 3_600_000_000_000
    early = sim.fills(trades.where(f"ts_ns <= {cut}"), sim.resting(snaps.where(f"ts_ns <= {cut}"), touch_orders()))
    every = sim.fills(trades, sim.resting(snaps, touch_orders())).where(f"ts_ns <= {cut}")
    assert sorted(early.collect()) == sorted(every.collect())


def test_blocks_of_time_do_not_show(spark):
    r = random.Random(4)
    data = [(k, k % 3, r.randrange(50), r.choice([None, 1.0, 2.0, 3.0])) for k in range(300)]
    df = spark.createDataFrame(data, "seq long, sym long, ts_ns long, v double")
    small, large = (
        timeline.running_sum(timeline.last_known(df, ["sym"], ["ts_ns", "seq"], {"v": "known"}, size=s), ["sym"], ["ts_ns", "seq"], {"v": "total"}, size=s)
        for s in (7, 1000))
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))


def inside(rows, width):
    """For each row of (seq, sym, ts, value, time of the row before): the values in its window, and those that began in it."""
    for seq, sym, ts, *_ in rows:
        mine = [r for r in rows if r[1] == sym and ts - width < r[2] <= ts]
        yield seq, [r[3] for r in mine if r[3] is not None], [r[3] for r in mine if r[3] is not None and r[4] > ts - width]


@pytest.mark.parametrize("width", [1, 9, 50, 1000])
def test_trailing_windows(spark, width):
    """Fractional values, ties, nulls and one NaN against sums over each window; what began before the window doesn't count."""
    r, rows, before = random.Random(width), [], {}
    for seq, ts in enumerate(sorted(r.randrange(900) for _ in range(300))):
        sym = seq % 3
        rows.append((seq, sym, ts, float("nan") if seq == 40 else r.choice([None, 0.1, 0.2, 0.3, r.random() * 1e-9, -7.7]), before.get(sym, ts)))
        before[sym] = ts
    df = spark.createDataFrame(rows, "seq long, sym long, ts_ns long, v double, p long").repartition(5)
    got = timeline.trailing(df, ["sym"], width, {"s": F.col("v"), "n": F.when(F.col("v").isNotNull(), 1), "late": F.col("v")},
                            since={"late": F.col("p"), "m": F.col("p")}, moments={"m": F.col("v"), "w": F.col("v")})
    got = {x.seq: x for x in got.collect()}
    near = lambda a, b: (a is None and b is None) or (math.isnan(a) and math.isnan(b)) or abs(a - b) <= 1e-12 * max(1, abs(b))
    assert len(got) == len(rows)
    for seq, every, late in inside(rows, width):
        x = got[seq]
        assert near(x.s, sum(every) if every else None) and x.n == (len(every) or None) and near(x.late, sum(late) if late else None)
        for count, mean, var, want in ((x.m_n, x.m_mean, x.m_var, late), (x.w_n, x.w_mean, x.w_var, every)):
            mid = sum(want) / len(want) if want else None
            assert count == len(want) and near(mean, mid) and near(var, sum((v - mid) ** 2 for v in want) / len(want) if want else None)


def test_trailing_takes_nothing_off(spark):
    """An emptied window is null, not what rounding left; a NaN is in its own windows only; large values leave small variances alone."""
    df = spark.createDataFrame([(1, 0, 0.1), (2, 1, 0.2), (3, 2, 0.3), (4, 10**12, None)], "seq long, ts_ns long, v double").withColumn("sym", F.lit(1))
    last = timeline.trailing(df, ["sym"], 1000, {"net": F.col("v"), "vol": F.abs("v")}).where("seq = 4").first()
    assert last.net is None and last.vol is None
    df = spark.createDataFrame([(1, 1, float("nan")), (2, 50, 1.0), (3, 200, 2.0)], "seq long, ts_ns long, v double").withColumn("sym", F.lit(1))
    got = {x.seq: x.s for x in timeline.trailing(df, ["sym"], 10, {"s": F.col("v")}).collect()}
    assert math.isnan(got[1]) and (got[2], got[3]) == (1.0, 2.0)
    df = spark.createDataFrame([(k, k, 1e9 + k % 2) for k in range(40)], "seq long, ts_ns long, v double").withColumn("sym", F.lit(1))
    assert all(abs(x.m_var - 0.25) < 1e-6 for x in timeline.trailing(df, ["sym"], 8, {}, moments={"m": F.col("v")}).where("seq >= 7").collect())


def test_trailing_refuses_values_that_overlap(spark):
    df = spark.createDataFrame([(1, 11, 2), (2, 12, 3)], "seq long, ts_ns long, p long").withColumn("sym", F.lit(1))
    with pytest.raises(Exception, match="do not begin at the row before"):
        timeline.trailing(df, ["sym"], 10, {"s": F.lit(1.0)}, since={"s": F.col("p")}).collect()


def test_windows_are_not_put_together(spark):
    """Few rows, which adaptive execution would give to one task: sums over windows use all shuffle partitions."""
    df = spark.createDataFrame([(k, k % 2, k * 100, 1.0) for k in range(200)], "seq long, sym long, ts_ns long, v double")
    assert timeline.trailing(df, ["sym"], 1000, {"s": F.col("v")}).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_orders_come_by_number(spark):
    """Orders stay out of the pass in time order; a repeated snapshot does not repeat trades, and a null number is a number."""
    snaps = spark.createDataFrame([(1, 0, 10, [1]), (1, 0, 10, [1]), (None, 0, 20, [2]), (3, 1, 5, [])], "seq long, sym long, ts_ns long, orders array<int>")
    trades = spark.createDataFrame([(7, 0, 15, 1.0), (8, 0, 25, 1.0), (9, 1, 5, 1.0), (10, 1, 4, 1.0)], "seq long, sym long, ts_ns long, price double")
    at = sim.in_interval(trades, snaps)
    assert sorted((r.seq, r.interval, r.orders) for r in at.collect()) == [(7, 1, [1]), (8, None, [2]), (9, 3, [])]
    assert at.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_empty_tables(spark):
    snaps, trades = books(spark, 1)
    none = snaps.limit(0)
    assert sim.fills(trades, sim.resting(none, touch_orders())).count() == 0
    assert sim.fills(trades.limit(0), sim.resting(snaps, touch_orders())).count() == 0


def test_ewma_seed_and_ties():
    pdf = pd.DataFrame({"seq": [1, 2, 3], "ts_ns": [0, 0, 10], "mid": [1.0, 2.0, 4.0]})
    assert [v for _, v in ses.ewma(10)(pdf)] == [1.0, 2.0, 3.0]


def test_triggers_count_from_their_last_fire():
    pdf = pd.DataFrame({"kind": [0] * 4, "seq": range(4), "ts_ns": [0, 6, 10, 19], "mid": [100.0, 100.4, 100.6, 100.7], "side": [0] * 4, "size": [0.0] * 4})
    assert [r[1:] for r in ses.triggers(10, 50, 1.0)(pdf)] == [(True, True, True), (False, False, False), (True, True, False), (False, False, False)]


def test_hedge_and_queue():
    pdf = pd.DataFrame({"seq": [1, 2, 3], "signed": [4.0, 7.0, -12.0]})
    assert list(ses.hedges(10.0, 1.0)(pdf)) == [(2, -1, 11.0, 0.0), (3, 1, 12.0, 0.0)]
    book = lambda sz: [{"px": 99.0, "sz": sz}]
    pdf = pd.DataFrame({"kind": [0, 1, 0, 0], "seq": range(4), "bids": [book(10.0), None, book(4.0), [{"px": 98.0, "sz": 1.0}]],
                        "side": [0, -1, 0, 0], "price": [0, 99.0, 0, 0], "size": [0, 2.0, 0, 0]})
    assert list(ses.queue_track(pdf)) == [(0, 10.0, "placed"), (1, 8.0, "fill_ahead"), (2, 4.0, "cancel_ahead"), (3, 4.0, "level_lost")]


def test_models_lean_against_inventory():
    m = ses.Quoting()
    for name in ses.MODELS:
        flat, long = m.prices(name, 100.0, 0.0, 1e-6, 1e9), m.prices(name, 100.0, 5.0, 1e-6, 1e9)
        assert flat[0] < flat[1] and sum(long) <= sum(flat)


@pytest.mark.parametrize("window", [1, 30, 500])
def test_sigma_of_each_window(window):
    """Against both passes over each window, with equal times and with gaps that empty it; the work of an addition does not grow with the window."""
    r, sigma, t, seen = random.Random(window), ses.Sigma(window), 0, []
    for _ in range(800):
        t, mid = t + r.choice([0, 0, 1, 2, 9, 60]), 100 + r.choice([0.0, 0.5, 3.3])
        seen = [x for x in seen if x[0] > t - window] + [(t, mid)]
        rs = [math.log(b[1] / a[1]) for a, b in zip(seen, seen[1:])]
        want = np.std(rs) / math.sqrt(max(1, t - seen[0][0]) / len(rs)) if rs else None
        assert sigma.add(t, mid) == (want if want is None else pytest.approx(want, rel=1e-12, abs=1e-15))
    wide, n = ses.Sigma(10**9), 150_000
    assert all(wide.add(k, 100.0) in (None, 0.0) for k in range(n)) and len(wide.old) + len(wide.new) == n - 1


def test_sessions_come_in_frames(spark):
    """A session that is longer than a frame comes in several, in order, and its state goes on; sessions in one partition do not mix."""
    n, spark_rows = 1000, spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = spark.range(3 * n).select((F.col("id") % 3).alias("sym"), F.lit(0).cast("long").alias("day"), (3 * n - F.col("id")).alias("ts_ns"), F.lit(0).alias("kind"), F.col("id").alias("seq"))

    def step(frames):
        count = 0
        for pdf in [frames] if isinstance(frames, pd.DataFrame) else frames:
            for seq in pdf["seq"]:
                count += 1
                yield seq, count, len(pdf)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = ses.fold(rows.repartition(5), step, "seq long, place long, frame long").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", spark_rows)
    assert max(r.frame for r in got) <= 64 and len(got) == 3 * n
    for sym in range(3):
        assert [r.seq for r in sorted((r for r in got if r.sym == sym), key=lambda r: r.place)] == list(range(3 * n - 3 + sym, -1, -3))


@pytest.mark.parametrize("name, want", [("queue_tracker", "bids kind price seq side size ts_ns"), ("refresh_triggers", "kind mid seq side size ts_ns"), ("ewma_fair", "kind mid seq ts_ns")])
def test_workers_get_what_a_fold_reads(spark, monkeypatch, name, want):
    """Books are most of a row, and of a worker's memory."""
    seen, real = [], ses.fold
    monkeypatch.setattr(ses, "fold", lambda rows, *how: seen.append(rows.columns) or real(rows, *how))
    assert getattr(stateful, name)(spark, SF).count() and sorted(set(seen[0]) - set(ses.KEYS)) == want.split()


def test_model_queries_are_deterministic(spark):
    a, b = (sorted(stateful.model_quotes(spark, SF).collect()) for _ in range(2))
    assert a == b and a


def test_splitmix_and_resampling(spark):
    first = [0xE220A8397B1DCDAF, 0x6E789E6AA1B965F4, 0x06C45D188009454F]
    assert [int(x) for x in splitmix(np.arange(3), 0)] == first
    df = spark.createDataFrame([("a", k, 1.0 + k % 3) for k in range(60)] + [("b", k, (-1.0) ** k) for k in range(60)], "g string, d long, x double")
    p = {r.g: r.p for r in sign_flip_null(df, "g", "d", "x", 400, 1).collect()}
    assert p["a"] == 1 / 401 and p["b"] > 0.2
    ci = {r.g: r for r in bootstrap_means(df, "g", "d", "x", 400, 1, 0.05).collect()}
    assert ci["a"].lo < 2 < ci["a"].hi and math.isclose(ci["a"].mean, 2) and ci["a"].lo > 1.5


def test_quote_functions(spark):
    row = spark.createDataFrame([([(99.0, 2.0), (98.0, 1.0)], [(101.0, 6.0)], None)], f"bids {LEVEL}, asks {LEVEL}, none {LEVEL}").select(
        q.mid().alias("m"), q.microprice().alias("u"), q.weighted_mid().alias("w"), q.mid("none").alias("n")).first()
    assert (row.m, row.n) == (100.0, None) and row.u == pytest.approx(99.5) and row.w == pytest.approx(99.5)


def fills_of(df):
    return sorted((r.seq, r.ts_ns, r.interval, r.side, r.price, r.size, r.sym) for r in df.collect())


@pytest.fixture
def few_states(spark):
    """Each partition of state costs a worker and a commit in every micro-batch."""
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", was)


def test_stream_in_any_cut(spark, tmp_path, few_states):
    """Part files in no order of time, one in each micro-batch, all of which wait: the fills of one run over all."""
    events, how = spark.read.parquet(f"{SF}/events.parquet"), {"by_day": True, "throttle": True}
    want = fills_of(stream.replay(spark, SF, f"{tmp_path}/once", **how))
    events.repartition(5).write.parquet(f"{tmp_path}/whole/events.parquet")
    shuffled = stream.read_events(spark, f"{tmp_path}/whole", files=1)
    stream.touch_fills(shuffled, f"{tmp_path}/a", delay="60 days", **how).awaitTermination()
    assert not fills_of(stream.read_fills(spark, f"{tmp_path}/a"))
    stream.close(spark, f"{tmp_path}/a")
    stream.touch_fills(shuffled, f"{tmp_path}/a", delay="60 days", **how).awaitTermination()
    assert want and fills_of(stream.read_fills(spark, f"{tmp_path}/a")) == want


def test_stream_goes_on(spark, tmp_path, few_states):
    """Five runs from one checkpoint over a table that grows give the batch plan's fills; most come before the end, and what is late then is dropped and counted."""
    events, want = spark.read.parquet(f"{SF}/events.parquet"), fills_of(touch(spark, SF))
    cuts, early = [int(x) for x in np.linspace(0, events.count(), 6)], 0

    def go_on():
        run = stream.touch_fills(stream.read_events(spark, str(tmp_path)), f"{tmp_path}/out")
        run.awaitTermination()
        return run

    for lo, hi in zip(cuts, cuts[1:]):  # ids are in order of time
        events.where(f"event_id >= {lo} and event_id < {hi}").repartition(2).write.mode("append").parquet(f"{tmp_path}/events.parquet")
        if hi == cuts[-1]:
            early = len(fills_of(stream.read_fills(spark, f"{tmp_path}/out")))
            stream.close(spark, f"{tmp_path}/out")
        go_on()
    assert fills_of(stream.read_fills(spark, f"{tmp_path}/out")) == want and 0.7 * len(want) < early < len(want)
    late = events.where("event_id < 50").withColumn("event_id", F.col("event_id") + 1_000_000)
    late.write.mode("append").parquet(f"{tmp_path}/events.parquet")
    assert stream.late_rows(go_on()) == late.where("event_type in ('view', 'click', 'signup', 'purchase', 'error')").count()
    assert fills_of(stream.read_fills(spark, f"{tmp_path}/out")) == want


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("throttle", [False, True])
def test_session_step_in_pieces(seed, throttle):
    """Any cut of a session's events gives the fills of an event-by-event replay, also with missing sides."""
    r, rows = random.Random(seed), []
    for seq in range(400):
        if r.random() < 0.4:
            side = lambda px: (px, float(r.randrange(1, 4))) if r.random() < 0.9 else (None, None)
            rows.append((seq, seq * 10, 0, *side(99.0 + r.randrange(2)), *side(101.0), None, None, None))
        else:
            rows.append((seq, seq * 10, 1, *[None] * 4, r.choice([1, -1]), r.choice([99.0, 100.0, 101.0]), r.choice([0.5, 1.0, 2.5])))
    want, book, orders, last = [], None, {}, None
    for seq, ts, kind, bid, bz, ask, az, side, px, size in rows:
        if kind == 0:
            if not throttle or (bid, bz, ask, az) != last:
                book, orders = seq, {1: [bid, bz, 3.0], -1: [ask, az, 3.0]}
            last = (bid, bz, ask, az)
        elif book is not None and orders[-side][0] == px:
            o = orders[-side]
            ahead = min(o[1], size)
            fill = min(o[2], size - ahead)
            orders[-side] = [px, o[1] - ahead, o[2] - fill]
            want += [(seq, book, -side, fill)] if fill else []
    for cuts in ([0, 400], [0, 1, 2, 77, 203, 400], list(range(0, 401, 10))):
        got, state = [], None
        for lo, hi in zip(cuts, cuts[1:]):
            fills, state = stream.session_step(pd.DataFrame(rows[lo:hi], columns=stream.EVENT).sample(frac=1, random_state=seed), state, 3.0, throttle)
            got += list(zip(fills["seq"], fills["interval"], fills["side"], fills["size"]))
        assert got == want


class State:
    """One key's state in memory, as a map or as a value."""

    def __init__(self):
        self.kept = {}

    exists = lambda self: bool(self.kept)
    keys = lambda self: iter(list(self.kept))
    getValue = lambda self, k: self.kept[k]
    removeKey = lambda self, k: self.kept.pop(k)
    clear = lambda self: self.kept.clear()
    get = lambda self: self.kept[0]

    def updateValue(self, k, v):
        self.kept[k] = v

    def update(self, v):
        self.kept[0] = v


@pytest.mark.parametrize("cuts", [[10**9], [40, 41, 90, 10**9]])
def test_a_stream_is_taken_in_parts_of_time(monkeypatch, cuts):
    """Events of a hundred hours that wait in no order: no step takes more than a slot's, and their fills are those of one step over all; a watermark inside a slot leaves its later events."""
    r, hour = random.Random(5), 3_600_000_000_000
    rows = [(k, k * hour // 10, 0, 99.0, 1.0, 101.0, 1.0, None, None, None) if k % 3 == 0 else (k, k * hour // 10, 1, *[None] * 4, r.choice([1, -1]), r.choice([99.0, 101.0]), 2.0) for k in range(1000)]
    events = pd.DataFrame(rows, columns=stream.EVENT)
    want, _ = stream.session_step(events, None, 3.0, False)
    sizes, step = [], stream.session_step
    monkeypatch.setattr(stream, "session_step", lambda e, *how: sizes.append(len(e)) or step(e, *how))
    monkeypatch.setattr(stream, "SORTED_ROWS", 150)

    class Handle:
        getMapState = getValueState = getListState = lambda self, *a: State()
        registerTimer = lambda self, at: None

    s = stream.Sessions(3.0, False)
    s.init(Handle())
    mixed = events.sample(frac=1, random_state=1)
    assert not list(s.handleInputRows((1,), iter([mixed[k : k + 100] for k in range(0, 1000, 100)]), None))
    got = []
    for cut in cuts:
        now = type("Now", (), {"getCurrentWatermarkInMs": lambda self: cut * hour // 1_000_000})()
        part = list(s.handleExpiredTimer((1,), now, None))
        assert all((f["ts_ns"] <= cut * hour).all() for f in part)
        got += part
    cols = ["seq", "interval", "side", "price", "size"]
    assert pd.concat(got)[cols].values.tolist() == want[cols].values.tolist() and len(want)
    assert max(sizes) <= 10 * stream.SLOT_NS // hour and sum(sizes) == 1000 and not s.waiting.kept
