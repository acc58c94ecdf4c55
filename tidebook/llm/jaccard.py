"""Exact Jaccard join of word n-gram sets, as a join in a metric space.

The symmetric difference of two sets, and Jaccard distance, are metrics. Sampled
documents are useless as first pivots for text: nearly every document is at distance 1 from
all of them, so one Voronoi region holds the corpus. The first pivots are therefore
single n-grams: a document is nearer to {s} than to nothing if it holds s. A window
from the triangle inequality says how many of its pivots' regions a document must be
copied to: of a sets' n-grams in one global order (rare ones first), the first
``a - ceil(0.75 a) + 1``; two linked documents then meet in some region. Inside a region
a set's size is its distance to the empty set, so sizes are cut into rings, with the documents at a ring's border in both,
and the first document of a ring is the pivot of the next level: its cell holds all that share a ring
with it in any region. Cells are joined twice. First all members are compared with their pivot, which
finds most links. Then cells that still hold several components are joined within themselves: members
of different components are compared, in one task or, in large cells, in blocks without the largest component's own pairs.
Both joins first bound each distance from below by the distances of small signatures, and compare whole sets
only of members with a partner within the bound; components are merged as links are found, and only links leave a task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, discard, materialize, small_batches, unused
from .lines import row_key
from .words import Hasher, blocks

#: Counters of the sketch that tells frequent n-grams from rare ones (a power of two), and the parts it is shipped in.
COUNTERS, PARTS = 1 << 24, 64
#: Members, and n-grams of all members together, from which on a cell is cut into blocks.
BLOCK, BLOCK_GRAMS = 400, 400_000
#: Rows of a region that are held at a time; a larger one, and one at a border of partitions, is cut into rings by Spark.
HELD = 50_000
#: Tables up to this many pairs of 64-bit numbers (some 40 MB) may be broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Sets that a task remembers to tell copies; when full it forgets them, which only makes more rows.
SEEN = 500_000

_U = np.uint64
_SHIFT = _U(65 - COUNTERS.bit_length())


def gram_set(h: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes."""
    h = np.sort(h)
    return h[np.append(True, h[1:] != h[:-1])] if len(h) else h


def set_id(h: np.ndarray) -> int:
    """One number for a whole set; equal sets share it."""
    return int(np.int64(_U(xxhash.xxh3_64_intdigest(h.tobytes())))) if len(h) else 0


def signature(h: np.ndarray) -> np.ndarray:
    """How many n-grams of a set each class has (255 at most), a class being the first bits of a hash; half as many classes as n-grams at least."""
    bits = max(6, (len(h) - 1).bit_length() - 1)
    count = np.bincount((h >> _U(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(count, 255).astype(np.uint8)


def frequent(texts: DataFrame, n: int) -> bytes:
    """A bitmap of COUNTERS bits: which counters hold n-grams that many documents share.

    Every n-gram of every document is counted. Tasks count into a table of fixed size, one byte
    a counter and 255 at most, send its compressed parts, and only one bit a counter reaches the driver.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total = Hasher(), np.zeros(COUNTERS, np.uint8)
        for rb in batches:
            for _, _, data, ends in blocks(rb.column("x")):
                held = list(hasher.shingles(data, ends, n))
                at = np.sort((np.concatenate(held) >> _SHIFT).astype(np.uint32))
                first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)
                times = np.diff(np.append(first, len(at)))
                at = at[first]
                total[at] = np.minimum(total[at] + times, 255)
        blobs = [zlib.compress(x.tobytes(), 1) for x in np.split(total, PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for rb in batches:
            for part, blob in zip(rb.column("part").to_pylist(), rb.column("blob").to_pylist()):
                x = np.frombuffer(zlib.decompress(blob), np.uint8)
                totals[part] = totals[part] + x if part in totals else x.astype(np.int64)
        for part, x in totals.items():
            usual = np.median(x)
            bits = np.packbits(x > usual + max(24, 6 * usual**0.5)).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([bits], pa.binary())], ["part", "blob"])

    kind = "part int, blob binary"
    got = texts.select("x").mapInArrow(count, kind).repartition("part").mapInArrow(add, kind).collect()
    return b"".join(bytes(r.blob) for r in sorted(got, key=lambda r: r.part)) or bytes(COUNTERS // 8)


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A column of arrays, or of bytes."""
    offsets = np.cumsum([0, *map(len, values)]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    if kind == pa.binary():
        return pa.Array.from_buffers(kind, len(values), [None, pa.py_buffer(offsets), pa.py_buffer(flat.tobytes())])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _prefixes(texts: DataFrame, n: int, percent: int, hot: bytes) -> DataFrame:
    """(d, t, n, f, sig, prefix) of each row; sig and prefix are empty where the task has just had the same set."""
    def batches(rbs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, is_hot, seen = Hasher(), np.frombuffer(hot, np.uint8), set()
        none = np.zeros(0, _U)
        for rb in rbs:
            for lo, hi, data, ends in blocks(rb.column("x")):
                sizes, ids, sigs, prefixes = [], [], [], []
                for h in hasher.shingles(data, ends, n):
                    h = gram_set(h)
                    size, f = len(h), set_id(h)
                    sizes.append(size)
                    ids.append(f)
                    if not size or f in seen:
                        sigs.append(none.view(np.uint8))
                        prefixes.append(none)
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(f)
                    length = size - -(-percent * size // 100) + 1
                    at = (h >> _SHIFT).astype(np.int64)
                    late = (is_hot[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
                    first = h[~late][:length]
                    prefixes.append(first if len(first) == length else np.concatenate([first, h[late][: length - len(first)]]))
                    sigs.append(signature(h))
                part = rb.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [part.column("d"), part.column("t"), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()),
                     _lists(sigs, pa.binary()), _lists(prefixes, pa.list_(pa.int64()))], ["d", "t", "n", "f", "sig", "prefix"])

    return texts.mapInArrow(batches, "d long, t long, n long, f long, sig binary, prefix array<long>")


#: Rows of _regions: a pivot and a member of its cell; a row of a region that is cut into rings by Spark.
CELL, OPEN = 0, 1


def _rings(n: np.ndarray, f: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """(pivot, member) of one region whose sets come by size: rings, those at a border in both."""
    out, pivot, before, limit = [], 0, None, 0
    for k in range(1, len(n)):
        if percent * n[k] > 100 * n[pivot]:
            before, limit, pivot = pivot, 100 * n[k - 1], k
        else:
            out.append((f[pivot], f[k]))
        if before is not None and percent * n[k] <= limit:
            out.append((f[before], f[k]))
    return out


def _regions(percent: int):
    """Rows (s, n, f) sorted by s, n and f, streamed; regions of one set go."""
    def rows(kind: int, a: np.ndarray, b: np.ndarray, n: np.ndarray | int = 0) -> pa.RecordBatch:
        k = np.full(len(a), kind, np.int32)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (k, a, b, np.broadcast_to(np.int64(n), len(a)))], ["kind", "a", "b", "n"])

    def cells(s: np.ndarray, n: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        """Pivots and members of whole regions."""
        start = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        size = np.diff(np.append(start, len(s)))
        at = np.repeat(start, size)
        far = percent * n > 100 * n[at]
        plain = ~np.repeat(np.add.reduceat(far, start) > 0, size) & (at != np.arange(len(s)))
        p, m = [f[at][plain]], [f[plain]]
        for r in np.unique(at[far]).tolist():
            end = r + size[np.searchsorted(start, r)]
            if got := _rings(n[r:end], f[r:end], percent):
                p.append(np.array([x for x, _ in got], np.int64))
                m.append(np.array([x for _, x in got], np.int64))
        p, m = np.concatenate(p), np.concatenate(m)
        with np.errstate(over="ignore"):
            keep = np.unique(p * np.int64(0x1E3779B97F4A7C15) + m, return_index=True)[1]
        return rows(CELL, p[keep], m[keep])

    def batches(rbs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = [np.zeros(0, np.int64)] * 3, None  # rows of the region that may go on; the key of the first one
        for rb in rbs:
            got = [np.concatenate([h, rb.column(k).to_numpy()]) for h, k in zip(held, "snf")]
            s, n, f = got
            if not len(s):
                continue
            keep = np.append(True, (s[1:] != s[:-1]) | (f[1:] != f[:-1]))
            s, n, f = s[keep], n[keep], f[keep]
            first = s[0] if first is None else first
            lo, hi = int(np.searchsorted(s, first, "right")) if s[0] == first else 0, int(np.searchsorted(s, s[-1]))
            if lo:
                yield rows(OPEN, s[:lo], f[:lo], n[:lo])
            if hi > lo:
                yield cells(s[lo:hi], n[lo:hi], f[lo:hi])
            hi = max(lo, hi)
            held = [s[hi:], n[hi:], f[hi:]]
            if len(held[0]) > HELD:  # all that follows of this region is open as well
                first = s[-1]
                yield rows(OPEN, held[0], held[2], held[1])
                held = [x[:0] for x in held]
        yield rows(OPEN, held[0], held[2], held[1])

    return batches


def _cells(rows: DataFrame, percent: int) -> DataFrame:
    """(p, f): pivots and the other members of their cells."""
    spread = rows.where("size(prefix) > 0").select(F.explode("prefix").alias("s"), "n", "f")
    spread = spread.repartitionByRange("s", "n", "f").sortWithinPartitions("s", "n", "f")
    found = materialize(spread.mapInArrow(_regions(percent), "kind int, a long, b long, n long"), "regions")
    # Rings of regions that are too large or lie in several partitions: powers of the ratio, each with the next one's members.
    ring = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("long")
    rest = found.where(f"kind = {OPEN}").select(F.col("a").alias("s"), F.col("b").alias("f"), "n").distinct()
    rest = rest.withColumn("r", F.explode(F.array(ring, ring - 1, ring - 2)))
    pivots = materialize(rest.groupBy("s", "r").agg(F.min("f").alias("p"), F.max("f").alias("q")).where("p < q").drop("q"), "ring-pivots")
    rest = rest.join(pivots, ["s", "r"]).where("p != f").select("p", "f")
    out = materialize(found.where(f"kind = {CELL}").select(F.col("a").alias("p"), F.col("b").alias("f")).union(rest).distinct(), "cells")
    discard(found, pivots)
    return out


def _meetings(rbs: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, np.ndarray], list[np.ndarray]]]:
    """Of rows sorted by k, the columns side, f, c, n and the bytes of each meeting (rows of one k)."""
    def each(parts: list[pa.RecordBatch]):
        rb = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        col = {x: rb.column(x).to_numpy() for x in ("k", "side", "f", "c", "n")}
        x = rb.column("bytes")
        off = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1]
        data = np.frombuffer(x.buffers()[2], np.uint8) if x.buffers()[2] is not None else np.zeros(0, np.uint8)
        start = np.flatnonzero(np.append(True, col["k"][1:] != col["k"][:-1]))
        for lo, hi in zip(start.tolist(), [*start[1:].tolist(), len(x)]):
            yield {name: v[lo:hi] for name, v in col.items()}, [data[off[r] : off[r + 1]] for r in range(lo, hi)]

    held: list[pa.RecordBatch] = []
    key = None
    for rb in rbs:
        if not rb.num_rows:
            continue
        k = rb.column("k").to_numpy()
        if not (held and k[-1] == key):
            cut = int(np.searchsorted(k, k[-1]))
            if held or cut:
                yield from each([*held, rb.slice(0, cut)] if cut else held)
            held, key = [], k[-1]
            rb = rb.slice(cut)
        held.append(rb)
    if held:
        yield from each(held)


def _folded(sigs: list[np.ndarray]) -> np.ndarray:
    """Signatures of one width, that of the narrowest; adding up classes keeps distances from growing."""
    width = min(map(len, sigs))
    return np.stack([x.astype(np.int16) if len(x) == width else x.reshape(width, -1).sum(axis=1, dtype=np.int16) for x in sigs])


def _near(sig: np.ndarray, n: np.ndarray, i: int, others: np.ndarray, percent: int) -> np.ndarray:
    """Of others, those that may be linked with i by size and signature.

    A link allows a symmetric difference of ``(a + b) (100 - percent) / (100 + percent)``, and classes' differences add up to no more.
    """
    a, b = np.minimum(n[others], n[i]), np.maximum(n[others], n[i])
    others = others[100 * a >= percent * b]
    if len(others):
        far = np.abs(sig[others] - sig[i]).sum(axis=1, dtype=np.int64)
        others = others[far * (100 + percent) <= (n[others] + n[i]) * (100 - percent)]
    return others


def _sides(side: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each row of the left side (0) or of both (2), with the rows it is to be compared with."""
    right = np.flatnonzero(side > 0)
    for i in np.flatnonzero(side != 1).tolist():
        yield i, right[(right > i) | (side[right] == 1)] if side[i] == 2 else right


def _active(percent: int):
    """Members with a partner of another component that the signatures allow; at most one row comes out for each that goes in."""
    def batches(rbs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[np.ndarray]] = []
        size = 0
        names = ["k", "side", "f", "c"]

        def frame() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names)

        for col, sigs in _meetings(rbs):
            sig, n, c = _folded(sigs), col["n"], col["c"]
            live = np.zeros(len(n), bool)
            for i, others in _sides(col["side"]):
                near = _near(sig, n, i, others[c[others] != c[i]], percent)
                live[near] = True
                live[i] |= len(near) > 0
            if live.any():
                out.append([col[x][live] for x in names])
                size += int(live.sum())
                if size > 20_000:
                    yield frame()
                    out, size = [], 0
        if out:
            yield frame()
    return batches


def _linked(percent: int):
    """Links between components, compared exactly; what a link has merged is not compared again."""
    def batches(rbs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []

        def frame() -> pa.RecordBatch:
            both = np.array(out, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

        for col, data in _meetings(rbs):
            sets = [x.view(_U) if x.ctypes.data % 8 == 0 else np.frombuffer(x.tobytes(), _U) for x in data]
            n, c, f = np.array([len(x) for x in sets]), col["c"].copy(), col["f"]
            sig = _folded([signature(x) for x in sets])
            for i, others in _sides(col["side"]):
                near = _near(sig, n, i, others[c[others] != c[i]], percent)
                while len(near):
                    j = near[0]
                    a, b = (sets[i], sets[j]) if n[i] < n[j] else (sets[j], sets[i])
                    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                    near = near[1:]
                    if 100 * both >= percent * (n[i] + n[j] - both):
                        out.append((f[i], f[j]))
                        c[c == c[j]] = c[i]
                        near = near[c[near] != c[i]]
            if len(out) > 20_000:
                yield frame()
                out = []
        yield frame()
    return batches


def _sets(ids: DataFrame, nodes: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """(f, bytes): whole sets of the nodes ids, made from their texts once more."""
    where = materialize(nodes.join(ids, "f", "left_semi").select("d", "t"), "set-rows")
    known = F.broadcast(where) if where.count() <= BROADCAST_ROWS else where

    def sets(rbs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = Hasher(), set()
        for rb in rbs:
            for _, _, data, ends in blocks(rb.column("x")):
                got = [gram_set(h) for h in hasher.shingles(data, ends, n)]
                ids = [set_id(h) for h in got]
                new = [k for k, f in enumerate(ids) if f not in seen and not seen.add(f)]
                if len(seen) >= SEEN:
                    seen.clear()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[k] for k in new], pa.int64()), _lists([got[k].view(np.uint8) for k in new], pa.binary())], ["f", "bytes"])

    full = texts.join(known, ["d", "t"], "left_semi").select("x").mapInArrow(sets, "f long, bytes binary")
    out = materialize(full, "sets")
    discard(where)
    return out


def _joined(meetings: DataFrame, nodes: DataFrame, texts: DataFrame, n: int, percent: int, name: str) -> DataFrame:
    """Links (a, b) among the members (f, of component c) of meetings k: side 0 with side 1, side 2 with all."""
    cols = ["k", "side", "f", "c", "n", "bytes"]

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.select(*cols).repartition("k").sortWithinPartitions("k")

    by_signature = dealt(meetings.join(nodes.select("f", "n", F.col("sig").alias("bytes")), "f"))
    active = materialize(by_signature.mapInArrow(_active(percent), "k long, side int, f long, c long"), f"{name}-active")
    sets = _sets(active.select("f").distinct(), nodes, texts, n)
    by_set = dealt(active.join(sets, "f").withColumn("n", F.lit(0).cast("long")))
    links = materialize(by_set.mapInArrow(_linked(percent), "a long, b long"), f"{name}-links")
    discard(active, sets)
    return links


def _key(*parts: Column | str) -> Column:
    return F.xxhash64(*parts).alias("k")


def _spokes(cells: DataFrame) -> DataFrame:
    """Meetings of pivots with the members of their cells, large cells in parts."""
    size = materialize(cells.groupBy("p").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("parts")), "cell-sizes")
    part = F.pmod(F.xxhash64("f"), F.coalesce("parts", F.lit(1)).cast("long"))
    members = cells.join(size.where("parts > 1"), "p", "left").select(_key("p", part), F.lit(1).alias("side"), "f", F.col("f").alias("c"))
    pivots = size.select("p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    return members.union(pivots.select(_key("p", "part"), F.lit(0).alias("side"), F.col("p").alias("f"), F.col("p").alias("c")))


def _mixed(cells: DataFrame, groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """Meetings of members of different components in cells of three or more members.

    A large cell's members come in blocks: every two blocks of those outside its largest component meet, and
    these meet all blocks of that one.
    """
    member = cells.union(cells.select("p", F.col("p").alias("f")).distinct())
    member = member.join(groups.withColumnRenamed("node", "f"), "f", "left").join(nodes.select("f", "n"), "f").select(
        "p", "f", "n", F.coalesce("component", "f").alias("c"))
    member = materialize(member, "cell-members")
    size = member.groupBy("p").agg(F.count("*").alias("m"), F.sum("n").alias("grams"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("m > 2 and c0 != c1")
    size = materialize(size.select("p", (F.expr(f"m > {BLOCK} or grams > {BLOCK_GRAMS}")).alias("large")), "mixed-cells")
    whole = member.join(size.where("not large"), "p").select(_key("p"), F.lit(2).alias("side"), "f", "c")
    if size.where("large").isEmpty():
        return whole

    inner = member.join(size.where("large"), "p", "left_semi")
    share = materialize(inner.groupBy("p", "c").agg(F.count("*").alias("m"), F.sum("n").alias("grams")), "shares")
    top = share.groupBy("p").agg(F.max(F.struct("m", "grams", "c")).alias("top"), F.sum("m").alias("m"), F.sum("grams").alias("grams"))

    def count(m: str, grams: str) -> Column:
        return F.expr(f"cast(greatest(ceil(({m}) / {BLOCK}), ceil(({grams}) / {BLOCK_GRAMS}), 1) as long)")

    top = top.select("p", F.col("top.c").alias("big"), count("top.m", "top.grams").alias("bs"), count("m - top.m", "grams - top.grams").alias("rs"))
    inner = inner.join(materialize(top, "block-counts"), "p").withColumn("is_big", F.expr("c = big"))
    inner = inner.withColumn("at", F.expr("pmod(xxhash64(f, 7), if(is_big, bs, rs))"))
    with_big = F.expr("if(is_big, transform(sequence(0L, rs - 1), x -> struct(1 as kind, x as i, at as j, 1 as side)),"
                      " transform(sequence(0L, bs - 1), x -> struct(1 as kind, at as i, x as j, 0 as side)))")
    others = F.expr("if(is_big, array(), transform(sequence(0L, rs - 1), x -> struct(0 as kind, least(x, at) as i, greatest(x, at) as j,"
                    " if(x = at, 2, if(at < x, 0, 1)) as side)))")
    blocks = inner.select("p", "f", "c", F.explode(F.concat(with_big, others)).alias("x"))
    return whole.union(blocks.select(_key("p", "x.kind", "x.i", "x.j"), "x.side", "f", "c"))


def jaccard_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 75) -> DataFrame:
    """Connected components of the link relation ``100 * |A & B| >= percent * |A | B|`` of shingle sets.

    One row for each row of docs: d (the id; lines.NO_ID if null), t (xxhash64 of the
    text), n_shingles, f (the set's id: equal sets share it), group (the component's own name,
    0 for empty sets), component_id (the smallest
    id reachable by links, itself included). A null or empty text, or one without a word, has an
    empty set and is linked with nothing. Equal sets are one node, so copies cost
    one row each; no pair of copies is ever made. Repeated ids stand for themselves; repeated rows get equal results.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(*row_key(docs[doc_id], docs[text]), docs[text].alias("x"))
    rows = materialize(_prefixes(texts, n, percent, frequent(texts, n)), "prefixes")
    cells = _cells(rows, percent)
    ids = cells.select("f").union(cells.select(F.col("p").alias("f"))).distinct()
    nodes = rows.where("length(sig) > 0").join(ids, "f", "left_semi").groupBy("f").agg(F.first(F.struct("d", "t", "n", "sig")).alias("x"))
    nodes = materialize(nodes.select("f", "x.d", "x.t", "x.n", "x.sig"), "nodes")

    links = _joined(_spokes(cells), nodes, texts, n, percent, "spokes")
    groups = materialize(components(links), "spoke-components")
    more = _joined(_mixed(cells, groups, nodes), nodes, texts, n, percent, "mixed")
    # Links found later join components: these are small, so they are followed as vertices of their own.
    for end in "ab":
        at = groups.withColumnRenamed("node", end)
        more = more.join(at, end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
    later = materialize(components(more).withColumnRenamed("component", "last"), "later-components")
    first = groups.join(later.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("last", "component").alias("c"))
    alone = later.join(groups.select("node"), "node", "left_anti").select("node", F.col("last").alias("c"))
    groups = materialize(first.union(alone), "components")

    sets = rows.where("n > 0").groupBy("f").agg(F.min("d").alias("least")).join(groups.withColumnRenamed("node", "f"), "f", "left")
    sets = materialize(sets.select("f", F.coalesce("c", "f").alias("c"), "least"), "labelled-sets")
    lowest = materialize(sets.groupBy("c").agg(F.min("least").alias("low")), "lowest")
    known = materialize(sets.join(lowest, "c").select("f", "c", "low"), "known")
    out = rows.select("d", "t", "n", "f").join(known, "f", "left")
    return out.select("d", "t", F.col("n").alias("n_shingles"), "f", F.coalesce("c", "f").alias("group"), F.coalesce("low", "d").alias("component_id"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 75) -> DataFrame:
    """docs without near copies: of each component, the row with the smallest id stays (by text hash where ids repeat).

    Rows with an empty set, as null and empty texts, all stay. Rows equal in id and text are copies of each other, so one of them stays at most.
    """
    groups = materialize(jaccard_groups(docs, doc_id, text, n, percent).select("d", "t", "n_shingles", "group"), "copy-groups")
    some = groups.where("n_shingles > 0")
    first = some.groupBy("group").agg(F.min(F.struct("d", "t")).alias("one")).select("one.d", "one.t")
    alone = groups.where("n_shingles = 0").select("d", "t").distinct()
    stay = first.select("d", "t", F.lit(True).alias("copies")).union(alone.select("d", "t", F.lit(False)))
    names = unused(docs, "stay_d", "stay_t", "stay_copies", "row_d", "row_t", "row_u")
    stay, (d, t) = stay.toDF(*names[:3]), row_key(docs[doc_id], docs[text])
    kept = docs.withColumns({names[3]: d, names[4]: t}).join(stay, (F.col(names[0]) == F.col(names[3])) & (F.col(names[1]) == F.col(names[4])))
    if not some.groupBy("d", "t").count().where("count > 1").isEmpty():  # else there is nothing to drop
        kept = kept.withColumn(names[5], F.when(F.col(names[2]), F.lit(0)).otherwise(F.monotonically_increasing_id())).dropDuplicates(names[3:6])
    return kept.drop(*names)
