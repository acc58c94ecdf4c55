"""Line deduplication over a whole corpus.

Hashes of line keys are range-partitioned by (hash, document) and sorted by hash,
document and position. One streaming pass over each partition then sees the lines
of a key in order, decides about them and holds no more than a few rows. A key
that very many documents share spans partitions; only its first and last runs in
each partition need a sum across partitions. What comes back is a compressed
bitmap of kept lines for each document that loses any, not text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, small_batches, unused

#: What is stripped at both ends of a line.
SPACE = b" \t\n\v\f\r"
#: Stands for a null document id inside the jobs.
NO_ID = -(2**63)


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Tells rows apart, also where ids repeat or are null; equal rows share their results."""
    return [F.coalesce(doc_id.cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("t")]


def line_keys(text: str | None, min_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes (as pairs) and positions of the lines whose key has min_chars code points at least."""
    hashes, at = [], []
    for k, line in enumerate((text or "").encode("utf-8", "replace").split(b"\n")):
        key = line.strip(SPACE).lower()
        if len(key) >= min_chars and (min_chars < 2 or len(key.decode("utf-8", "replace")) >= min_chars):
            hashes.append(xxhash.xxh3_128_digest(key))
            at.append(k)
    return np.frombuffer(b"".join(hashes), dtype="<i8").reshape(-1, 2), np.array(at, dtype=np.int64)


def _hash_lines(min_chars: int):
    def batches(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for lo in range(0, len(pdf), 500):
                part = pdf.iloc[lo : lo + 500]
                found = [line_keys(x, min_chars) for x in part["x"]]
                n = [len(at) for _, at in found]
                if sum(n):
                    h = np.concatenate([h for h, _ in found])
                    yield pd.DataFrame({"h": h[:, 0], "g": h[:, 1], "d": np.repeat(part["d"].to_numpy(), n),
                                        "t": np.repeat(part["t"].to_numpy(), n), "pos": np.concatenate([at for _, at in found])})
    return batches


_MARKS = "kind int, h long, g long, d long, t long, pos long, n long"
#: Rows of _marks: a line that goes; a line of a border run still undecided; a border run's number of documents.
GOES, OPEN, COUNT = 0, 1, 2


def _marks(min_docs: int):
    """The streaming pass over one sorted partition."""
    cols = ["h", "g", "d", "t", "pos"]

    def batches(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, docs, last_doc, key, first = [], 0, None, None, True

        def rows(kind: int, frame: pd.DataFrame) -> pd.DataFrame:
            return frame.assign(kind=np.int32(kind), n=0)[["kind", *cols, "n"]]

        def close(border: bool) -> Iterator[pd.DataFrame]:
            """The run that ends here: too small to decide if it touches a border."""
            if border and key is not None:
                yield pd.DataFrame([(COUNT, *key, 0, 0, 0, docs)], columns=["kind", *cols, "n"])
                for f in held:
                    yield rows(OPEN, f)

        for pdf in pdfs:
            h, g, d = pdf["h"].to_numpy(), pdf["g"].to_numpy(), pdf["d"].to_numpy()
            new = np.ones(len(pdf), bool)
            new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(pdf))
            fresh = new.copy()
            fresh[1:] |= d[1:] != d[:-1]
            count = np.add.reduceat(fresh, starts) if len(pdf) else np.zeros(0)
            # Runs that begin and end inside this batch are decided at once.
            inside = np.ones(len(starts), bool)
            inside[[0, -1]] = False
            big = inside & (count >= min_docs)
            if big.any():
                yield rows(GOES, pdf[np.repeat(big, ends - starts)])
            for r in dict.fromkeys((0, len(starts) - 1)):
                lo, hi = starts[r], ends[r]
                if key != (h[lo], g[lo]):
                    yield from close(first and key is not None)
                    first = first and key is None
                    key, held, docs, last_doc = (h[lo], g[lo]), [], 0, None
                docs += int(count[r]) - int(last_doc == d[lo])
                last_doc = d[hi - 1]
                held.append(pdf.iloc[lo:hi][cols])
                if docs >= min_docs:
                    for f in held:
                        yield rows(GOES, f)
                    held = []
        yield from close(True)

    return batches


def dropped_lines(docs: DataFrame, doc_id: str, text: str, min_docs: int, min_chars: int, partitions: int) -> DataFrame:
    """(d, t, pos) of every line whose key is in min_docs documents at least."""
    src = docs.select(*row_key(docs[doc_id], docs[text]), docs[text].alias("x")).where("x is not null")
    lines = materialize(src.mapInPandas(_hash_lines(min_chars), "h long, g long, d long, t long, pos long"), "lines")
    dealt = lines.repartitionByRange(partitions, "h", "g", "d").sortWithinPartitions("h", "g", "d", "pos")
    marks = materialize(dealt.mapInPandas(_marks(min_docs), _MARKS), "line-marks")
    # A key's runs in several partitions are all border runs, so their counts are all here.
    shared = marks.where(f"kind = {COUNT}").groupBy("h", "g").agg(F.sum("n").alias("n")).where(f"n >= {min_docs}")
    late = marks.where(f"kind = {OPEN}").join(shared.select("h", "g"), ["h", "g"], "left_semi")
    return marks.where(f"kind = {GOES}").select("d", "t", "pos").unionByName(late.select("d", "t", "pos"))


@F.pandas_udf(T.BinaryType())
def _pack(n: pd.Series, gone: pd.Series) -> pd.Series:
    out = []
    for size, at in zip(n, gone):
        keep = np.ones(-(-int(size) // 8) * 8, bool)
        keep[np.asarray(at, dtype=np.int64)] = False
        out.append(zlib.compress(np.packbits(keep).tobytes()))
    return pd.Series(out)


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1,
                 partitions: int | None = None) -> DataFrame:
    """Bitmaps of kept lines, (d, t, n_dropped, keep binary), for the documents that lose lines.

    A line's key is the line without white space at its ends, A-Z lower-cased; keys
    of min_chars code points at least that min_docs different ids have lose
    all their lines. (d, t) is ``row_key`` of the row. keep is zlib over packed bits
    up to the byte of the last dropped line; lines after that stay. Rows with a null id count as
    one document, repeated rows as well; null and empty texts are one empty line,
    which has no key. Texts may be very long: only hashes are shuffled.
    """
    small_batches(docs.sparkSession)
    partitions = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    gone = dropped_lines(docs, doc_id, text, min_docs, min_chars, partitions).distinct()
    each = gone.groupBy("d", "t").agg(F.collect_list("pos").alias("gone"), F.max("pos").alias("m"))
    return each.select("d", "t", F.size("gone").cast("long").alias("n_dropped"), _pack(F.col("m") + 1, F.col("gone")).alias("keep"))


def apply_bitmap(text: str | None, packed: bytes | None) -> str:
    """The lines that a bitmap keeps, joined by newlines."""
    if not packed:
        return text or ""
    keep = np.unpackbits(np.frombuffer(zlib.decompress(packed), dtype=np.uint8))
    lines = (text or "").split("\n")
    return "\n".join([x for k, x in enumerate(lines) if k >= len(keep) or keep[k]])


@F.pandas_udf(T.StringType())
def kept_text(text: pd.Series, packed: pd.Series) -> pd.Series:
    return pd.Series([apply_bitmap(t, p) for t, p in zip(text, packed)], dtype=object)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """docs with text replaced by its kept lines, and n_lines, n_dropped (before dropping) added.

    All columns of docs stay; if it has columns called n_lines or n_dropped, they are replaced.
    """
    names = unused(docs, "map_d", "map_t", "map_n", "map_keep", "row_d", "row_t")
    maps = keep_bitmaps(docs, doc_id, text, min_docs, min_chars).select("d", "t", "n_dropped", "keep").toDF(*names[:4])
    d, t = row_key(docs[doc_id], docs[text])
    rows = docs.drop("n_lines", "n_dropped").withColumns({names[4]: d, names[5]: t})
    out = rows.join(maps, (F.col(names[4]) == F.col(names[0])) & (F.col(names[5]) == F.col(names[1])), "left")
    x = F.coalesce(F.col(text), F.lit(""))
    return out.withColumns({
        "n_lines": (F.length(x) - F.length(F.replace(x, F.lit("\n"))) + 1).cast("long"),
        "n_dropped": F.coalesce(names[2], F.lit(0)).cast("long"),
        text: F.when(F.col(names[3]).isNull(), F.col(text)).otherwise(kept_text(x, names[3])),
    }).drop(*names)
