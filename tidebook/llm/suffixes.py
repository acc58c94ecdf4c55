"""Removal of byte strings that an earlier document has too, by minimum-anchor hashing in place of prefix doubling.

No ranks are paired in rounds: 16-byte strings are named by hashes, and Spark sorts some of the names once
with their documents. Two things keep the rows few.
Only positions that are the least of 35 neighbours by name (every 50-byte string has
such an anchor, and equal strings have equal ones) are sorted at first, and those
with a unique name are done: no string around them repeats. And an anchor stands
for all the strings it is the anchor of: if their union, up to 84 bytes, is in an earlier
document, they are all covered by one row. Only where documents differ around a shared
anchor are positions named at the full length and compared one by one, for each different
segment's first document; for one in very many documents they are sorted by Spark as well.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches
from .lines import NO_ID

#: Bytes of a repeated string, and of the strings named first.
LENGTH, FIRST = 50, 16
#: Neighbours of which an anchor is the least.
SPAN = LENGTH - FIRST + 1
#: Bits and parts of the filters that tell which anchors are shared and which segments are looked at closely; what passes
#: by chance only makes more rows.
BITS, PARTS = 1 << 26, 64
#: Bits of a packed place beside where it starts: how many strings start there in a row.
LEN_BITS = 6

_U = np.uint64
_K = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A name for each pair of names."""
    h = (a ^ (a >> _U(32))) * _K[0] + (b ^ (b >> _U(29))) * _K[1]
    h ^= h >> _U(32)
    h *= _K[3]
    h ^= h >> _U(28)
    return h


class Block:
    """Some texts' bytes end to end, with the names of all their 16-byte strings."""

    def __init__(self, texts: list[bytes]):
        data = self.data = b"".join(texts)
        self.size = np.array([len(t) for t in texts], np.int64)
        self.start = np.cumsum(self.size) - self.size
        n = len(data)
        if n < LENGTH:
            self.lo = self.hi = self.at = self.row = np.zeros(0, np.int64)
            return
        self.name_all(data)
        val, pos, span = self.name, np.arange(len(self.name), dtype=np.int32), 1
        while span < SPAN:
            step = min(span, SPAN - span)
            later = val[step:] <= val[:-step]
            val = np.where(later, val[step:], val[:-step])
            pos = np.where(later, pos[step:], pos[:-step])
            span += step
        # Strings must end inside their text; each run of strings with one anchor becomes a segment.
        row = np.repeat(np.arange(len(texts), dtype=np.int32), self.size)[: len(pos)]
        inside = np.arange(len(pos)) + LENGTH <= (self.start + self.size)[row]
        new = np.append(True, (pos[1:] != pos[:-1]) | (row[1:] != row[:-1]))
        first = np.flatnonzero(new)
        count = np.add.reduceat(inside, first) if len(first) else np.zeros(0, np.int64)
        keep = count > 0
        self.lo = first[keep].astype(np.int64)
        self.hi = self.lo + count[keep] - 1
        self.at = pos[self.lo].astype(np.int64)
        self.row = row[self.lo].astype(np.int64)

    def name_all(self, data: bytes) -> None:
        """Names of all 16-byte strings of data, at least that long."""
        n = len(data)
        eight = np.empty(n - 7, _U)
        for r in range(8):
            eight[r::8] = np.frombuffer(data, "<u8", (n - r) // 8, r)
        self.name = _mix(eight[:-8], eight[8:])

    def segment_names(self) -> np.ndarray:
        """Names of the segments' whole bytes, from names that cover them."""
        end = self.hi + LENGTH
        h = (end - self.lo).astype(_U)
        for at in (self.lo, self.lo + 16, self.lo + 32, end - 48, end - 32, end - 16):
            h = _mix(h, self.name[at])
        return h

    def full_names(self, at: np.ndarray) -> np.ndarray:
        """Names of 50 bytes, doubled from 16 over 32."""
        half = lambda p: _mix(self.name[p], self.name[p + 16])
        return _mix(half(at), half(at + LENGTH - 32))


def _blocks(pdfs: Iterator[pd.DataFrame], most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray, Block]]:
    """Blocks of about ``most`` bytes with their rows' ids and text marks."""
    for pdf in pdfs:
        lo = size = 0
        texts: list[bytes] = []
        d, t = pdf["d"].to_numpy(), pdf["t"].to_numpy()
        for k, x in enumerate(pdf["x"]):
            texts.append((x or "").encode("utf-8", "replace"))
            size += len(texts[-1])
            if size >= most or k + 1 == len(pdf):
                yield d[lo : k + 1], t[lo : k + 1], Block(texts)
                lo, size, texts = k + 1, 0, []


def _place(lo: np.ndarray, extra: np.ndarray) -> np.ndarray:
    return (lo << LEN_BITS) | extra


def _names(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The names of all anchors, and nothing else; of one that a block has several times, two are enough."""
    for _, _, b in _blocks(pdfs):
        if len(b.lo):
            h, times = np.unique(b.name[b.at].view(np.int64), return_counts=True)
            yield pd.DataFrame({"h": np.repeat(h, np.minimum(times, 2))})


def _again(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of sorted names, those that are there twice or more."""
    last = None
    for pdf in pdfs:
        h = pdf["h"].to_numpy()
        if len(h):
            same = np.append(last == h[0], h[1:] == h[:-1])
            last = h[-1]
            if same.any():
                yield pd.DataFrame({"h": np.unique(h[same])})


def _anchors(shared: bytes):
    """Anchors whose names are shared, with their segments' names and places; done tells that the block has the same segment in an earlier document.

    So of a segment that very many documents have, few rows of each block wait for rows of others.
    """
    def batches(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        on = np.frombuffer(shared, np.uint8)
        for d, t, b in _blocks(pdfs):
            if len(b.lo):
                use = _in(on, b.name[b.at].view(np.int64))
                h, c, doc = b.name[b.at].view(np.int64)[use], b.segment_names().view(np.int64)[use], d[b.row[use]]
                order = np.lexsort((doc, _key(h, c)))
                key = _key(h, c)[order]
                run = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
                done = np.zeros(len(h), bool)
                done[order] = doc[order] > np.repeat(doc[order][run], np.diff(np.append(run, len(key))))
                yield pd.DataFrame({"h": h, "c": c, "d": doc, "t": t[b.row[use]], "x": _place((b.lo - b.start[b.row])[use], (b.hi - b.lo)[use]), "done": done})
    return batches


def _key(h: np.ndarray, c: np.ndarray, d: np.ndarray | None = None) -> np.ndarray:
    both = _mix(h.view(_U), c.view(_U))
    return (both if d is None else _mix(both, d.view(_U))).view(np.int64)


def _covered(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by h, c, d: segments that an earlier document has (kind 0), and segments to be looked at closely (kind 1, as keys); done ones pass through.

    The latter are each different segment's first document's, where an anchor has
    different segments in different documents: any other is covered as a whole.
    """
    last, wait, several, low, high = None, np.zeros(0, np.int64), False, 0, 0
    for pdf in pdfs:
        done = pdf["done"].to_numpy(dtype=bool)
        if done.any():
            yield pdf.loc[done, ["d", "t", "x"]].assign(kind=np.int32(0))[["kind", "d", "t", "x"]]
            pdf = pdf[~done]
        h, c, d = (np.ascontiguousarray(pdf[k].to_numpy()) for k in "hcd")
        if not len(h):
            continue
        same_h = np.append(last is not None and last[0] == h[0], h[1:] == h[:-1])
        same = same_h & np.append(last is not None and last[1] == c[0], c[1:] == c[:-1])
        run = np.flatnonzero(~same)
        least = np.repeat(np.append(last[2] if last else 0, d[run]), np.diff(np.concatenate([[0], run, [len(h)]])))
        later = d > least
        if later.any():
            yield pdf.loc[later, ["d", "t", "x"]].assign(kind=np.int32(0))[["kind", "d", "t", "x"]]
        # Per anchor: whether it has several segments, and its documents' range; the first may go on from the last batch.
        start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        many = np.add.reduceat(same_h & ~same, start) > 0
        lo, hi = np.minimum.reduceat(d, start), np.maximum.reduceat(d, start)
        if same_h[0]:
            many[0], lo[0], hi[0] = many[0] or several, min(lo[0], low), max(hi[0], high)
        else:
            wait = np.zeros(0, np.int64)
        close = many & (lo < hi)
        key, first = _key(h, c, d), ~later
        use = first & np.repeat(close, np.diff(np.append(start, len(h))))
        out = np.concatenate([wait, key[use]]) if close[0] else key[use]
        if len(out):
            yield pd.DataFrame({"kind": np.int32(1), "d": out, "t": 0, "x": 0})
        kept = np.zeros(0, np.int64) if close[-1] else key[start[-1] :][first[start[-1] :]]
        wait = np.concatenate([wait, kept]) if len(start) == 1 and not close[0] else kept
        several, low, high, last = bool(many[-1]), lo[-1], hi[-1], (h[-1], c[-1], least[-1])


def _bits(h: np.ndarray) -> list[np.ndarray]:
    """The two bits of each name."""
    shift = _U(64 - BITS.bit_length() + 1)
    return [((h.view(_U) * k) >> shift).astype(np.int64) for k in (_K[1], _K[2])]


def _in(on: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which names a bitmap has, and a few more."""
    one, two = (on[k >> 3] >> (7 - (k & 7)).astype(np.uint8) & 1 for k in _bits(h))
    return np.flatnonzero(one & two)


def _filter(h: DataFrame) -> bytes:
    """A bitmap of BITS bits with two set for each name; fixed in size, combined by Spark."""
    width = BITS // 8 // PARTS

    def bits(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        on = np.zeros(BITS // 8, np.uint8)
        for pdf in pdfs:
            for k in _bits(np.ascontiguousarray(pdf.iloc[:, 0].to_numpy())):
                np.bitwise_or.at(on, k >> 3, np.uint8(128) >> (k & 7).astype(np.uint8))
        yield pd.DataFrame({"part": np.arange(PARTS), "blob": [zlib.compress(x.tobytes(), 1) for x in on.reshape(PARTS, width)]})

    def join(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for pdf in pdfs:
            for part, blob in zip(pdf["part"], pdf["blob"]):
                x = np.frombuffer(zlib.decompress(blob), np.uint8)
                total[part] = total[part] | x if part in total else x
        for part, x in total.items():
            yield pd.DataFrame({"part": [part], "blob": [x.tobytes()]})

    got = h.mapInPandas(bits, "part int, blob binary").repartition("part").mapInPandas(join, "part int, blob binary").collect()
    return b"".join(bytes(r.blob) for r in sorted(got, key=lambda r: r.part)) or bytes(BITS // 8)


def _contexts(shared: bytes, close: bytes):
    """Segments to be looked at closely: anchor, document, place, and the segment's bytes."""
    def batches(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        on, near = np.frombuffer(shared, np.uint8), np.frombuffer(close, np.uint8)
        for d, t, b in _blocks(pdfs):
            if not len(b.lo):
                continue
            h, c = b.name[b.at], b.segment_names()
            use = _in(on, h.view(np.int64))
            use = use[_in(near, _key(h[use], c[use], d[b.row[use]]))]
            lo, hi, row = b.lo[use], b.hi[use], b.row[use]
            if len(use):
                yield pd.DataFrame({"h": h[use].view(np.int64), "d": d[row], "t": t[row], "x": _place(lo - b.start[row], hi - lo),
                                    "bytes": [b.data[p : q + LENGTH] for p, q in zip(lo.tolist(), hi.tolist())]})
    return batches


def _strings(rows: list[tuple]) -> pd.DataFrame:
    """Every 50-byte string of segments (d, t, x, bytes): its name w, its document d and text t, and its own place x."""
    b = Block.__new__(Block)
    b.name_all(b"".join(r[3] for r in rows))
    d, t, x = (np.array([r[k] for r in rows], np.int64) for k in range(3))
    count = (x & ((1 << LEN_BITS) - 1)) + 1
    size = count + LENGTH - 1
    seg = np.repeat(np.arange(len(rows)), count)
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    place = (x[seg] & ~np.int64((1 << LEN_BITS) - 1)) + (offset << LEN_BITS)
    at = (np.cumsum(size) - size)[seg] + offset
    return pd.DataFrame({"w": b.full_names(at).view(np.int64), "d": d[seg], "t": t[seg], "x": place})


#: Segments of whole anchors that are compared in one go, and of one anchor that are left to a sort by string instead.
GO, LEAVE = 8_000, 20_000
_COMPARED = ["kind", "w", "d", "t", "x"]


def _compared(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Segments in order of their anchors: places of strings that a smaller document has (kind 0), or of a very frequent anchor all strings (kind 1)."""
    done: list[tuple] = []  # of whole anchors
    now: list[tuple] = []  # of the anchor that may go on
    key, large = None, False

    def settle(rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            s = _strings(rows)
            w, d = s["w"].to_numpy(), s["d"].to_numpy()
            order = np.lexsort((d, w))
            first = np.append(True, w[order][1:] != w[order][:-1])
            least = d[order][np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
            gone = order[d[order] > least]
            if len(gone):
                yield pd.DataFrame({"kind": np.int32(0), "w": 0, "d": d[gone], "t": s["t"].to_numpy()[gone], "x": s["x"].to_numpy()[gone]})

    for pdf in pdfs:
        for h, d, t, x, data in zip(*(pdf[c].to_numpy() for c in "hdtx"), pdf["bytes"]):
            if h != key:
                if large:
                    if now:
                        yield _strings(now).assign(kind=np.int32(1))[_COMPARED]
                else:
                    done += now
                    if len(done) >= GO:
                        yield from settle(done)
                        done = []
                key, now, large = h, [], False
            now.append((d, t, x, data))
            if len(now) >= LEAVE or (large and len(now) >= GO):
                large = True
                yield _strings(now).assign(kind=np.int32(1))[_COMPARED]
                now = []
    if large and now:
        yield _strings(now).assign(kind=np.int32(1))[_COMPARED]
    yield from settle(done + ([] if large else now))


def _repeated(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by w and d: positions whose string starts in an earlier document."""
    last = None
    for pdf in pdfs:
        w, d = pdf["w"].to_numpy(), pdf["d"].to_numpy()
        if not len(w):
            continue
        same = np.append(last is not None and last[0] == w[0], w[1:] == w[:-1])
        run = np.flatnonzero(~same)
        least = np.repeat(np.append(last[1] if last else 0, d[run]), np.diff(np.concatenate([[0], run, [len(w)]])))
        later = d > least
        if later.any():
            yield pdf.loc[later, ["d", "t", "x"]]
        last = (w[-1], least[-1])


def merged(places: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by packed places."""
    if not len(places):
        return []
    lo = places >> LEN_BITS
    hi = lo + (places & ((1 << LEN_BITS) - 1)) + LENGTH
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.append(True, lo[1:] > hi[:-1])
    return list(zip(lo[new].tolist(), hi[np.append(np.flatnonzero(new)[1:] - 1, len(hi) - 1)].tolist()))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   finish: Callable[[pd.DataFrame], pd.DataFrame] | None = None, schema: str | None = None) -> DataFrame:
    """Each row's text as bytes without those covered by a 50-byte string that also starts in a document with a smaller id.

    One row for each row of docs: the id, n_bytes, spans (array of start, end of the
    removed runs, maximal) and kept (binary); or what finish makes of batches of these
    columns, with its schema. Strings are judged on the input. A null text is empty; one of fewer
    than 50 bytes stays. A null id counts as smaller than all others; rows that share an id do not
    remove anything from each other, and equal rows get equal results.
    """
    small_batches(docs.sparkSession)
    d = F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))
    t = F.xxhash64(F.coalesce(F.col(text), F.lit("")))  # tells the rows of one id apart
    texts = docs.select(d.alias("d"), t.alias("t"), F.col(text).alias("x"))
    names = texts.mapInPandas(_names, "h long").repartition("h").sortWithinPartitions("h")
    shared = _filter(names.mapInPandas(_again, "h long"))
    anchors = texts.mapInPandas(_anchors(shared), "h long, c long, d long, t long, x long, done boolean")
    dealt = anchors.repartition(F.when(F.col("done"), F.xxhash64("d", "t", "x")).otherwise(F.col("h"))).sortWithinPartitions("h", "c", "d")
    found = materialize(dealt.mapInPandas(_covered, "kind int, d long, t long, x long"), "segments")
    close = _filter(found.where("kind = 1").select("d"))
    near = texts.mapInPandas(_contexts(shared, close), "h long, d long, t long, x long, bytes binary")
    near = near.repartition("h").sortWithinPartitions("h").mapInPandas(_compared, "kind int, w long, d long, t long, x long")
    near = materialize(near, "compared")
    late = near.where("kind = 1").select("w", "d", "t", "x").repartition("w").sortWithinPartitions("w", "d").mapInPandas(_repeated, "d long, t long, x long")
    places = found.where("kind = 0").select("d", "t", "x").unionByName(near.where("kind = 0").select("d", "t", "x")).unionByName(late)
    places = places.groupBy("d", "t").agg(F.collect_list("x").alias("places"))
    places = materialize(places, "covered-places").select(F.col("d").alias("d1"), F.col("t").alias("t1"), "places")
    rows = docs.select(F.col(doc_id).alias("id"), d.alias("d"), t.alias("t"), F.col(text).alias("x"))
    rows = rows.join(places, (F.col("d") == F.col("d1")) & (F.col("t") == F.col("t1")), "left").select("id", "x", "places")

    def batches(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for lo in range(0, max(1, len(pdf)), 300):
                out, part = [], pdf.iloc[lo : lo + 300]
                for i, x, p in zip(part["id"], part["x"], part["places"]):
                    data = (x or "").encode("utf-8", "replace")
                    spans = merged(np.asarray(p, dtype=np.int64)) if p is not None else []
                    ends = [0, *(y for s in spans for y in s), len(data)]
                    kept = b"".join(data[ends[k] : ends[k + 1]] for k in range(0, len(ends), 2))
                    out.append((i, len(data), [{"start": a, "end": b} for a, b in spans], kept))
                frame = pd.DataFrame(out, columns=[doc_id, "n_bytes", "spans", "kept"])
                frame[doc_id] = frame[doc_id].astype("Int64")
                yield finish(frame) if finish else frame

    return rows.mapInPandas(batches, schema or f"`{doc_id}` long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary")
