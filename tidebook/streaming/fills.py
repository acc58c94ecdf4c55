"""Touch fills from a stream, the same as the batch plan's, with state that Spark keeps.

Events come in any order and any cut into micro-batches. A key's events wait in Spark's state store, parted by the time they are from, until the watermark has
passed them; then no earlier event can follow, and they are taken in their order, a part of time at once, so a worker never holds a key's history. What is carried on is the last book's two orders with what is left of
them and of their queues. A timer at each batch's last event makes them ready, and one at the session's end
drops the session's state. What counts as late is a matter of event time and the watermark's delay alone: Spark drops such events
and counts them (``late_rows``).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from tidebook.sources.market import DAY_NS

OUT = "seq long, ts_ns long, interval long, side int, price double, size double, sym long"
#: What a session carries on: its last book, what is left of its two orders and their queues.
BOOK = "interval long, bid double, bid_queue double, bid_left double, ask double, ask_queue double, ask_left double, bid_sz double, ask_sz double"
EVENT = ["seq", "ts_ns", "kind", "bid", "bid_sz", "ask", "ask_sz", "side", "price", "size"]
#: Kinds of events; a clock only moves the watermark.
SNAPSHOT, TRADE, CLOCK = 0, 1, 2
#: The clock's last tick, some 260 years after 1970.
CLOSING_NS = 8_200_000_000_000_000_000
#: Events that wait are kept, and taken, by so much time; so many are sorted into it at once. Each part of the state costs a call or two.
SLOT_NS, SORTED_ROWS = 6 * 3_600_000_000_000, 500_000
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _packed(pdf: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(pdf[EVENT], preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_all().to_pandas()


def session_step(events: pd.DataFrame, book: tuple | None, size: float, throttle: bool) -> tuple[pd.DataFrame, tuple | None]:
    """Fills of one key's next events, and the book after them. book: as BOOK, before them.

    With throttle, a snapshot whose best level is that of the last one kept is dropped, so its orders and queues stay.
    """
    e = events.astype({c: "float64" for c in EVENT[3:]}).drop_duplicates(["ts_ns", "kind", "seq"]).sort_values(["ts_ns", "kind", "seq"], ignore_index=True)
    snap = e["kind"].eq(SNAPSHOT)
    if throttle:
        top = e.loc[snap, ["bid", "bid_sz", "ask", "ask_sz"]]
        before = top.shift()
        if book is not None and len(before):
            before.iloc[0] = [book[1], book[7], book[4], book[8]]
        keep = ~((top == before) | (top.isna() & before.isna())).all(axis=1)
        if book is None and len(keep):
            keep.iloc[0] = True
        e = e.drop(index=keep.index[~keep]).reset_index(drop=True)
        snap = e["kind"].eq(SNAPSHOT)
    era = snap.cumsum()
    books = e.loc[snap, ["seq", "bid", "bid_sz", "ask", "ask_sz"]].set_axis(["interval", "bid", "bid_sz", "ask", "ask_sz"], axis=1).assign(era=era[snap])
    books = books.assign(bid_queue=books["bid_sz"], ask_queue=books["ask_sz"], bid_left=size, ask_left=size)
    if book is not None and books.empty:
        books = pd.DataFrame([book], columns=[c.split()[0] for c in BOOK.split(", ")]).assign(era=0)
    elif book is not None:
        books = pd.concat([pd.DataFrame([book], columns=[c.split()[0] for c in BOOK.split(", ")]).assign(era=0), books], ignore_index=True)
    trade = e["kind"].eq(TRADE)
    trades = e.loc[trade, ["seq", "ts_ns", "side", "price", "size"]].assign(era=era[trade]).merge(books, on="era", how="inner")
    buys = trades["side"] == -1  # a seller's trade fills our bid
    own = lambda name: trades[f"bid{name}"].where(buys, trades[f"ask{name}"])
    hit = trades[(trades["price"] - own("")).abs() <= 1e-9].assign(at=own(""), queue=own("_queue"), left=own("_left"), mine=(-trades["side"]).astype("int32"))
    total = hit.groupby(["era", "mine"])["size"].cumsum()
    filled = lambda c: (c - hit["queue"]).clip(lower=0).combine(hit["left"], min) if len(hit) else c
    fills = hit.assign(fill=filled(total) - filled(total - hit["size"]))
    if len(books):
        last = books.iloc[-1].to_dict()
        eaten = hit[hit["era"] == last["era"]].groupby("mine")["size"].sum()
        for name, side in (("bid", 1), ("ask", -1)):
            c = float(eaten.get(side, 0.0))
            left = min(last[f"{name}_left"], max(0.0, c - last[f"{name}_queue"]))
            last |= {f"{name}_queue": max(0.0, last[f"{name}_queue"] - c), f"{name}_left": last[f"{name}_left"] - left}
        book = (int(last["interval"]), *[float(last[c.split()[0]]) for c in BOOK.split(", ")[1:]])
    return fills.loc[fills["fill"] > 0, ["seq", "ts_ns", "interval", "mine", "at", "fill"]].set_axis(["seq", "ts_ns", "interval", "side", "price", "size"], axis=1), book


class Sessions(StatefulProcessor):
    """A key's events wait for the watermark; the key is (sym) or (sym, day)."""

    def __init__(self, size: float, throttle: bool) -> None:
        self.size, self.throttle = size, throttle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("slots", "slot long, part long", "chunk binary")
        self.parts = handle.getValueState("parts", "n long")
        self.book = handle.getValueState("book", BOOK)

    def _wait(self, events: pd.DataFrame) -> None:
        """Puts events into their slots; parts of a slot are told apart by a number that only grows."""
        n = self.parts.get()[0] if self.parts.exists() else 0
        for slot, chunk in events.groupby(events["ts_ns"] // SLOT_NS):
            self.waiting.updateValue((int(slot), n), (_packed(chunk),))
        self.parts.update((n + 1,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest, some, n = None, [], 0
        for pdf in rows:
            pdf = pdf[pdf["kind"] != CLOCK]
            if len(pdf):
                some, n = [*some, pdf[EVENT]], n + len(pdf)
                latest = max(latest or 0, int(pdf["ts_ns"].max()))
            if n >= SORTED_ROWS:
                self._wait(pd.concat(some, ignore_index=True))
                some, n = [], 0
        if some:
            self._wait(pd.concat(some, ignore_index=True))
        if latest is not None:
            self.handle.registerTimer(latest // 1_000_000 + 1)
            if len(key) > 1:
                self.handle.registerTimer((int(key[1]) + 1) * DAY_NS // 1_000_000)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1_000  # in microseconds, as Spark judges what is late
        places = sorted((int(s), int(n)) for s, n in self.waiting.keys()) if self.waiting.exists() else []
        book = self.book.get() if self.book.exists() else None
        taken, rest = [], False
        for slot, parts in groupby((p for p in places if p[0] * SLOT_NS // 1_000 <= passed), lambda p: p[0]):
            parts = list(parts)
            events = pd.concat([_unpacked(self.waiting.getValue(p)[0]) for p in parts], ignore_index=True)
            ready = events["ts_ns"] // 1_000 <= passed
            if ready.any():
                taken += parts
                if not ready.all():
                    self._wait(events[~ready])
                    rest = True
                fills, book = session_step(events[ready], book, self.size, self.throttle)
                if len(fills):
                    yield fills.assign(sym=int(key[0])).astype({"side": "int32"})
        if taken and not rest and len(taken) == len(places):
            self.waiting.clear()
        else:
            for p in taken:
                self.waiting.removeKey(p)
        if taken and book is not None:
            self.book.update(book)
        if len(key) > 1 and passed * 1_000 >= (int(key[1]) + 1) * DAY_NS:
            self.book.clear()


def touch_fills(events: DataFrame, folder: str, size: float = 3.0, by_day: bool = False, throttle: bool = False, delay: str = "1 hour") -> StreamingQuery:
    """Starts a stream over what is there now, from where the folder's last one stopped; fills go to the folder's Parquet table ``fills``.

    events: a streaming DataFrame (sym, seq, ts_ns, kind, bid, bid_sz, ask, ask_sz, side, price, size). Events may be up to ``delay`` behind the latest one. by_day: each symbol's day
    is a session of its own, which starts without a book. Events of the last ``delay`` wait for later ones, or for ``close``. Fills are the same
    however the events are cut into micro-batches, as long as none is late.
    """
    spark = events.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != _ROCKS:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
        spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    clock = f"{folder}/clock"
    spark.createDataFrame([], "ts_ns long").write.mode("ignore").parquet(clock)
    ticks = spark.readStream.schema("ts_ns long").parquet(clock).select(F.lit(-1).cast("long").alias("sym"), "ts_ns", F.lit(CLOCK).alias("kind"))
    keys = ["sym", "day"] if by_day else ["sym"]
    every = events.unionByName(ticks, allowMissingColumns=True).withColumns({"at": F.expr("timestamp_micros(ts_ns div 1000)"), "day": F.expr(f"ts_ns div {DAY_NS}")})
    every = every.withWatermark("at", delay).select(*keys, "at", *EVENT)
    fills = every.groupBy(*keys).transformWithStateInPandas(Sessions(size, throttle), OUT, "Append", "EventTime")
    return fills.writeStream.format("parquet").option("path", f"{folder}/fills").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def close(spark: SparkSession, folder: str) -> None:
    """No event will come any more: the next start takes all that wait. Later ones will be late."""
    spark.createDataFrame([(CLOSING_NS,)], "ts_ns long").write.mode("append").parquet(f"{folder}/clock")


def late_rows(query: StreamingQuery) -> int:
    """Events that the query's run dropped as late."""
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])


def read_events(spark: SparkSession, sf_dir: str, files: int | None = None) -> DataFrame:
    """The events table as a stream, with the same derivation as the batch tables; files: of a folder, how many come in one micro-batch."""
    table = f"{sf_dir}/events.parquet"
    source = spark.readStream.schema(spark.read.parquet(table).schema)
    if files:
        source = source.option("maxFilesPerTrigger", files)
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    if path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(path).isDirectory():
        e = source.parquet(table)
    else:  # a stream reads folders; the filter is on file names
        e = source.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    ts = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) * 1000")
    e = e.select(F.col("event_id").alias("seq"), ts.alias("ts_ns"), F.expr("user_id % 2").alias("sym"), "event_type", "value")
    e = e.withColumn("bk", F.expr("((ts_ns % 237600000000000) - (ts_ns % 21600000000000)) div 21600000000000"))
    e = e.withColumn("mid", 100 + F.lit(0.5) * F.expr("(bk * 7) % 11")).withColumn("kind", F.when(F.col("event_type").isin("purchase", "error"), TRADE).otherwise(SNAPSHOT))
    side = F.when(F.col("event_type") == "purchase", 1).otherwise(-1)
    return e.where("event_type in ('view', 'click', 'signup', 'purchase', 'error')").select(
        "sym", "seq", "ts_ns", "kind", (F.col("mid") - 0.5).alias("bid"), (1 + F.col("seq") % 5).cast("double").alias("bid_sz"),
        (F.col("mid") + 0.5).alias("ask"), (1 + F.col("seq") % 3).cast("double").alias("ask_sz"), side.alias("side"),
        (F.col("mid") + F.lit(0.5) * side).alias("price"), (1 + F.expr("floor(value) % 8")).cast("double").alias("size"))


def read_fills(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(OUT).parquet(f"{folder}/fills")


def replay(spark: SparkSession, sf_dir: str, folder: str, **how) -> DataFrame:
    """Runs the stream over all of a table that is complete, into Parquet under folder, and reads that back."""
    close(spark, folder)  # the clock comes with the last events, so one run does
    touch_fills(read_events(spark, sf_dir), folder, **how).awaitTermination()
    return read_fills(spark, folder)
