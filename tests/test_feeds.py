"""Feed parsers against plain ones, on files drawn from a seed and cut into small parts."""

import gzip
import random
from datetime import datetime, timedelta, timezone

import pytest

from tidebook.sources import feeds, market

ZERO = datetime(1970, 1, 1, tzinfo=timezone.utc)


def nanos(day: datetime, clock_ns: int) -> int:
    return (day - ZERO).days * 86_400 * 10**9 + clock_ns


def day_of(r: random.Random) -> datetime:
    return datetime(2001, 1, 1, tzinfo=timezone.utc) + timedelta(days=r.randrange(9000))


@pytest.fixture
def small_parts(spark):
    """Files are cut every few hundred bytes, so what is carried crosses many borders."""
    keys = {"spark.sql.files.maxPartitionBytes": "700b", "spark.sql.files.openCostInBytes": "1b"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def order(r):
    return (r.file, r.part, r.line)


def test_clocks(spark):
    from pyspark.sql import functions as F

    r = random.Random(5)
    rows, want = [], []
    for _ in range(40):
        day, h, m, s, ns = day_of(r), r.randrange(24), r.randrange(60), r.randrange(60), r.randrange(10**9)
        digits = r.randrange(0, 5)
        frac = f"{r.randrange(10**digits):0{digits}d}" if digits else ""
        rows.append((day.strftime("%Y%m%d"), f"{h:02d}:{m:02d}:{s:02d}" + f".{frac}" * bool(frac), f"{h:02d}{m:02d}{s:02d}{ns:09d}"))
        second = ((h * 60 + m) * 60 + s) * 10**9
        want.append((nanos(day, 0), second + int((frac + "000")[:3]) * 10**6, second + ns))
    got = spark.createDataFrame(rows, "d string, c string, u string").select(feeds.day_ns(F.col("d")), feeds.clock_ns(F.col("c")), feeds.utc_ns(F.col("u"))).collect()
    assert [tuple(x) for x in got] == want


def equity_file(seed):
    """Text of an equity tape, and what a plain reader makes of it: (rows in hours, rows in all, sides of the trades in hours)."""
    r = random.Random(seed)
    day, out, every, inside, sides = day_of(r), [], [], [], []
    best = {"bid": None, "ask": None}
    for _ in range(150):
        ms = r.randrange(6 * 3600_000, 20 * 3600_000)
        kind = r.choice(["QUOTE BID NB", "QUOTE ASK NB", "TRADE", "TRADE NB", "QUOTE ASK", "STATUS"])
        px, size = r.randrange(100, 140) / 4, r.randrange(1, 900)
        s = ms // 1000
        out.append(f"{day:%Y%m%d}, {s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}.{ms % 1000:03d}, {kind}, Q{seed}, {px}, {size}, V, {r.randrange(9)}")
        if r.random() < 0.1:
            out.append(r.choice(["", "not a row", "a,b,c"]))
        name = {"QUOTE BID NB": "bid", "QUOTE ASK NB": "ask", "TRADE": "trade", "TRADE NB": "trade"}.get(kind)
        if name is None:
            continue
        row = (nanos(day, ms * 10**6), name, px, float(size))
        every.append(row)
        if 34_200_000 <= ms < 57_600_000:
            inside.append(row)
            if name == "trade":
                middle = None if None in best.values() else sum(best.values()) / 2
                sides.append(0 if middle is None or px == middle else 1 if px > middle else -1)
            else:
                best[name] = px
    return "Date, Timestamp, EventType, Ticker, Price, Quantity, Exchange, Conditions\n" + "\n".join(out) + "\n", inside, every, sides


@pytest.mark.parametrize("seed", [11, 12])
def test_equity_tape(spark, tmp_path, small_parts, seed):
    text, inside, every, sides = equity_file(seed)
    (tmp_path / "a.csv").write_text(text)
    path = str(tmp_path / "a.csv")
    tape = feeds.equity_tape(spark, path)
    assert tape.rdd.getNumPartitions() > 3
    plain = lambda df: [(x.ts_ns, x.kind, x.price, x["size"]) for x in sorted(df.collect(), key=order)]
    assert plain(tape) == inside and plain(feeds.equity_tape(spark, path, regular_hours=False)) == every
    assert [x.side for x in sorted(feeds.sign_by_quote(tape).collect(), key=order)] == sides


def tape_file(seed):
    """Text of a futures tape, its trades and its books, read plainly."""
    r = random.Random(seed)
    day, clock, out, trades, books, book = day_of(r), r.randrange(10**13), [], [], [], {"B": [], "S": []}
    for _ in range(120):
        clock += r.randrange(10**9)
        kind, side, level = r.choice([161, 97, 162, 98, 172, 108, 49, 51]), r.choice("BS"), r.choice([0, 0, 1, 2])
        px, qty = r.randrange(400, 440) / 8, r.randrange(0, 9)
        s = clock // 10**9
        stamp = f"{s // 3600:02d}{s // 60 % 60:02d}{s % 60:02d}{clock % 10**9:09d}"
        out.append(f"{day:%Y%m%d},{stamp},0,0,{r.randrange(99)},P,G,T{seed},{kind},I,{side},{level},{px},{qty},1,0,2,0,0,0")
        ts = nanos(day, clock)
        if kind in (162, 98) and qty > 0:
            trades.append((ts, px, float(qty), 1 if kind == 162 else -1))
        if (kind in (161, 97) and level == 0) or kind in (172, 108):
            book = book | {side: [] if kind in (172, 108) else [(px, float(qty))]}
            books.append((ts, book["B"], book["S"]))
    return ",".join(f"h{k}" for k in range(20)) + "\n" + "\n".join(out) + "\n", trades, books


@pytest.mark.parametrize("zipped", [False, True])
def test_futures_tape(spark, tmp_path, small_parts, zipped):
    found = [tape_file(seed) for seed in (21, 22)]
    for k, (text, _, _) in enumerate(found):
        with (gzip.open(tmp_path / f"t{k}.csv.gz", "wt") if zipped else open(tmp_path / f"t{k}.csv", "w")) as f:
            f.write(text)
    trades = sorted(feeds.futures_trades(spark, str(tmp_path)).collect(), key=order)
    assert [(x.ts_ns, x.price, x["size"], x.side) for x in trades] == [t for _, own, _ in found for t in own]
    books = sorted(feeds.futures_quotes(spark, str(tmp_path)).collect(), key=order)
    assert [(x.ts_ns, [tuple(l) for l in x.bids], [tuple(l) for l in x.asks]) for x in books] == [b for _, _, own in found for b in own]


def test_futures_depth(spark, tmp_path, small_parts):
    r = random.Random(31)
    day, clock, out, want, book = day_of(r), 10**12, [], [], {"B": [], "S": []}
    for _ in range(80):
        clock += r.randrange(10**8)
        side, depth = r.choice("BBSSX"), r.choice([0, 1, 3, 10])
        levels = [(r.randrange(0, 50) / 2, r.randrange(0, 4)) for _ in range(10)]
        s = clock // 10**9
        flat = ",".join(f"{p},{z},1" for p, z in levels)
        out.append(f"{day:%Y%m%d},{s // 3600:02d}{s // 60 % 60:02d}{s % 60:02d}{clock % 10**9:09d},0,0,7,P,G,D,{side},0,2,0,0,0,{depth},{flat}")
        if side != "X":
            book = book | {side: [(p, float(z)) for p, z in levels[: depth or 10] if p > 0 and z > 0]}
            want.append((nanos(day, clock), book["B"], book["S"]))
    (tmp_path / "d.csv").write_text(",".join(f"h{k}" for k in range(45)) + "\n" + "\n".join(out) + "\n")
    books = feeds.futures_depth(spark, str(tmp_path / "d.csv"))
    got = [(x.ts_ns, [tuple(l) for l in x.bids], [tuple(l) for l in x.asks]) for x in sorted(books.collect(), key=order)]
    assert got == want
    # Stored and read again; the throttle keeps the last book of each fifth of a second.
    feeds.store_snapshots(books, str(tmp_path / "all"), "V")
    feeds.store_snapshots(books, str(tmp_path / "some"), "V", per_second=5)
    back = lambda p: sorted((x.ts_ns, [tuple(l) for l in x.bids], [tuple(l) for l in x.asks]) for x in market.read_snapshots(spark, str(tmp_path / p), "D").collect())
    assert back("all") == sorted(want)
    assert back("some") == sorted({t // 200_000_000: (t, b, a) for t, b, a in want}.values())


def test_stored_tables(spark, tmp_path):
    r = random.Random(41)
    rows = [(r.randrange(10**9), None, r.choice("XY"), "V", 1, [(r.randrange(9) + 1.0, 1.0)], []) for _ in range(30)]
    spark.createDataFrame(rows, market.SNAPSHOTS).write.parquet(str(tmp_path / "s"))
    got = market.read_snapshots(spark, str(tmp_path / "s"), "X").collect()
    assert sorted(x.ts_ns for x in got) == sorted(x[0] for x in rows if x[2] == "X")
    trades = spark.createDataFrame([(r.randrange(10**9), r.choice("XY"), r.randrange(9) + 0.5, 2.0, 1) for _ in range(30)], "ts_ns long, symbol string, price double, size double, side int")
    feeds.store_trades(trades, str(tmp_path / "t"), "V")
    assert market.read_trades(spark, str(tmp_path / "t"), "Y").count() == trades.where("symbol = 'Y'").count()


def manifest_of(tmp_path, r, sizes):
    """Tape files of a root and date each, with ragged rows, and their manifest."""
    want = {}
    for (root, date), n in sizes.items():
        rows = [",".join(f" {root}{date}x{k}f{c}" for c in range(r.randrange(1, 5))) for k in range(n)]
        folder = tmp_path / "files" / f"root={root}" / f"date={date}"
        folder.mkdir(parents=True)
        text = "head,er\n" + "".join(f"{x}\n\n" if r.random() < 0.2 else f"{x}\n" for x in rows)
        if root == "Z":
            with gzip.open(folder / "a.csv.gz", "wt") as f:
                f.write(text)
        else:
            (folder / "a.csv").write_text(text if r.random() < 0.5 else text.rstrip("\n"))
        want |= {(root, date): [tuple([c.strip() for c in x.split(",")][:3] + [None] * (3 - len(x.split(",")))) for x in rows]}
    return want


@pytest.mark.parametrize("part", [1, 7, 100, 1 << 20])
def test_tape_source(spark, tmp_path, part):
    """However files are cut, each row is there once and in order; files that filters leave out are never opened."""
    from tidebook.sources import tapes

    want = manifest_of(tmp_path, random.Random(part), {("A", "20240101"): 9, ("A", "20240102"): 0, ("B", "20240101"): 12, ("Z", "20240103"): 5} if part < 100 else {("A", "20240101"): 200, ("Z", "20240103"): 50})
    tapes.list_tapes(spark, str(tmp_path / "files"), str(tmp_path / "manifest"))
    rows = sorted(tapes.tape(spark, str(tmp_path / "manifest"), 3, part).collect(), key=lambda x: (x.root, x.date, x.part, x.line))
    assert [(x.root, x.date, x.c0, x.c1, x.c2) for x in rows] == [(*k, *v) for k in sorted(want) for v in want[k]]
    for f in (tmp_path / "files").rglob("root=A/**/a.csv"):
        f.unlink()
    other = tapes.tape(spark, str(tmp_path / "manifest"), 3, part).where("root = 'Z' and date >= '20240102' and c0 is not null")
    assert [x.c0 for x in sorted(other.collect(), key=lambda x: x.line)] == [v[0] for v in want["Z", "20240103"]]
    with pytest.raises(Exception, match="(?i)no such file|not found|does not exist"):
        tapes.tape(spark, str(tmp_path / "manifest"), 3, part).collect()


def test_tape_stream(spark, tmp_path):
    """A stream takes each manifest entry once, over restarts."""
    from tidebook.sources import tapes

    want = {}
    for k, root in enumerate("ABC"):
        want |= manifest_of(tmp_path / root, random.Random(k), {(root, "20240101"): 20 + k})
        tapes.list_tapes(spark, str(tmp_path / root / "files"), str(tmp_path / "manifest"))
        # Names of Spark's files are in no order, so entries are dealt to files whose names are.
        new = [f for f in (tmp_path / "manifest").iterdir() if f.name.startswith("part-")]
        new[0].rename(tmp_path / "manifest" / f"{k:05d}.json")
        run = tapes.stream(spark, str(tmp_path / "manifest"), 3).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check"))
        run.trigger(availableNow=True).start().awaitTermination()
        got = spark.read.parquet(str(tmp_path / "out")).collect()
        assert sorted((x.root, x.c0) for x in got) == sorted((r, v[0]) for (r, _), rows in want.items() for v in rows)


def test_sink_goes_on(spark, tmp_path):
    """A second run writes nothing, one that is killed leaves nothing that is seen, and the next one does its keys whole."""
    from pyspark.sql import functions as F

    from tidebook.sources import sink

    keys, asked = spark.createDataFrame([(k, f"d{k % 3}") for k in range(12)], "k long, d string"), []

    def work(some, fail=False):
        asked.append(sorted(r.k for r in some.collect()))
        out = some.where("k != 5").withColumn("v", F.explode(F.array(F.col("k"), F.col("k") + 1)))
        return out.withColumn("v", F.when(F.col("k") == 7, F.raise_error(F.lit("killed")).cast("long")).otherwise(F.col("v"))) if fail else out

    path, schema = str(tmp_path / "store"), work(keys).schema
    asked.clear()
    with pytest.raises(Exception, match="killed"):
        sink.store_by_key(keys.where("k < 9"), lambda s: work(s, True), path)
    assert sink.committed(spark, path, keys.schema).count() == 0
    assert sink.store_by_key(keys.where("k < 6"), work, path) == 6 and asked.pop() == list(range(6))
    assert sink.store_by_key(keys, work, path, at_once=4) == 6
    assert sorted(k for a in asked[1:] for k in a) == list(range(6, 12))
    n = len(asked)
    assert sink.store_by_key(keys, work, path) == 0 and len(asked) == n
    got = sink.read_by_key(spark, path, schema, ["k", "d"])
    assert sorted((r.k, r.v) for r in got.collect()) == sorted((k, v) for k in range(12) if k != 5 for v in (k, k + 1))
    assert {r.k: r.rows for r in sink.committed(spark, path, keys.schema).collect()} == {k: 2 * (k != 5) for k in range(12)}
