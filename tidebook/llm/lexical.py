"""Ranked lexical search: all documents for each of a set of query items.

Documents become postings of the items' terms. A task takes them in blocks; in a block every term
has a bitmap of the documents that hold it. For an item these bitmaps, put side by side, give each
document a mask of its matched terms. Documents with one mask share a highest possible score, from
each term's largest share of a score in the block. Masks are evaluated by descending highest score,
until it is less than what the item's k-th best has already: what is left can't be among the best.
The k best go from block to block, so later blocks evaluate few masks, and a task returns k rows an item.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches
from .words import Hasher, blocks

#: Item terms that are searched for in one pass; more are searched for in several.
TERMS = 500_000
#: Documents and postings of a block, and cells of an item's matrix of terms and documents.
DOCS, POSTINGS, CELLS = 8_192, 2_000_000, 4_000_000
#: Stands for a null document id: the largest.
NO_ID = 2**63 - 1
_FOUND = "item long, d long, score long"

#: Bytes of terms are digits, letters and everything beyond ASCII.
_TERM = np.zeros(256, bool)
_TERM[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
_TERM[128:] = True


def _terms(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For blocks of texts: the first row's number, hashes of all terms in order, and how many each text has."""
    hasher = Hasher()
    for lo, _, data, ends in blocks(texts):
        yield lo, *hasher.words(data, ends, _TERM)


def _postings(vocabulary):
    """(d, n, terms, tfs) of documents with a term: n counts all terms, terms are numbers in the vocabulary."""
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in found:
            ids = batch.column(0)
            for lo, h, count in _terms(batch.column(1)):
                place = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
                hit = known[place] == h if len(known) else np.zeros(len(h), bool)
                row = np.repeat(np.arange(len(count)), count)[hit]
                cells, tf = np.unique(row * np.int64(max(1, len(known))) + place[hit], return_counts=True)
                row, term = cells // max(1, len(known)), cells % max(1, len(known))
                some = np.flatnonzero(count)
                ends = np.searchsorted(row, some, side="right")
                starts = np.searchsorted(row, some, side="left")
                offsets = pa.array(np.append(starts[:1], ends), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (term, tf)]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(some + lo)), pa.array(count[some].astype(np.int64)), *lists], names=["d", "n", "terms", "tfs"])
    return batches


class _Best:
    """An item's k best so far."""

    def __init__(self, k: int) -> None:
        self.k, self.score, self.doc = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def bar(self) -> int:
        """The least score that may still be among the best."""
        return int(self.score[-1]) if len(self.score) >= self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        keep = score >= self.bar
        s, d = np.append(self.score, score[keep]), np.append(self.doc, doc[keep])
        order = np.lexsort((d, -s))[: self.k]
        self.score, self.doc = s[order], d[order]


def by_masks(best: _Best, weights: np.ndarray, rows: np.ndarray, cols: np.ndarray, share: np.ndarray, docs: np.ndarray, most: np.ndarray) -> int:
    """Add a block's documents to the best of an item; returns how many of them were evaluated.

    weights: of the item's terms; rows, cols, share: which term a posting is of, which document, and its share; docs: ids; most: each term's largest share.
    """
    cells = np.zeros((len(weights), len(docs)), np.int64)
    cells[rows, cols] = share
    bits = np.packbits(cells > 0, axis=0)
    key = np.zeros((len(docs), -(-len(bits) // 8) * 8), np.uint8)
    key[:, : len(bits)] = bits.T
    words = key.view(np.uint64)
    if words.shape[1] == 1:
        masks, group = np.unique(words[:, 0], return_inverse=True)
        kinds = masks.view(np.uint8).reshape(len(masks), 8)
    else:
        kinds, group = np.unique(key, axis=0, return_inverse=True)
    held = np.unpackbits(kinds[:, : len(bits)], axis=1, count=len(weights)).astype(np.int64)
    highest = held @ (weights * most)
    order = np.argsort(-highest, kind="stable")
    size = np.bincount(group.ravel(), minlength=len(order))[order]
    upto, rank = np.cumsum(size), np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    place = rank[group.ravel()]
    at = seen = 0
    take = 2 * best.k
    while at < len(order) and highest[order[at]] >= best.bar:
        end = max(at + 1, int(np.searchsorted(upto, seen + take, side="right")))
        end = min(end, at + int(np.count_nonzero(highest[order[at:end]] >= best.bar)))
        chosen = np.flatnonzero((place >= at) & (place < end))
        best.add(weights @ cells[:, chosen], docs[chosen])
        at, seen, take = end, int(upto[end - 1]), 2 * take
    return seen


def _search(shared, k: int):
    def batches(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, terms, weights, first, mean = shared.value  # terms and weights of item i: from first[i] to first[i + 1]
        best = [_Best(k) for _ in items]
        held: list[pd.DataFrame] = []
        size = 0

        def block() -> None:
            pdf = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            docs = pdf["d"].to_numpy()
            many = pdf["terms"].map(len).to_numpy()
            term, tf = (np.concatenate(list(pdf[c])).astype(np.int64) for c in ("terms", "tfs"))
            doc = np.repeat(np.arange(len(pdf)), many)
            n, all_docs, all_terms = pdf["n"].to_numpy(), *mean
            m = 75 + (25 * n * all_docs) // all_terms
            share = (1_000_000_000 * tf) // (1_000 * tf + 12 * m[doc])
            order = np.argsort(term, kind="stable")
            term, doc, share = term[order], doc[order], share[order]
            lo, hi = np.searchsorted(term, terms, side="left"), np.searchsorted(term, terms, side="right")
            top = np.zeros(len(terms), np.int64)
            some = hi > lo
            if not some.any():
                return
            distinct = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
            largest = np.maximum.reduceat(share, distinct)
            top[some] = largest[np.searchsorted(term[distinct], terms[some])]
            for i in range(len(items)):
                mine = slice(first[i], first[i + 1])
                here = np.flatnonzero(some[mine])
                if not len(here) or (weights[mine] * top[mine]).sum() < best[i].bar:
                    continue
                w, a, b = weights[mine][here], lo[mine][here], hi[mine][here]
                at = np.concatenate([np.arange(x, y) for x, y in zip(a, b)])
                rows = np.repeat(np.arange(len(here)), b - a)
                step = max(1, CELLS // len(here))
                for d in range(0, len(docs), step):
                    part = slice(None) if step >= len(docs) else (doc[at] >= d) & (doc[at] < d + step)
                    by_masks(best[i], w, rows[part], doc[at][part] - d, share[at][part], docs[d : d + step], top[mine][here])

        for pdf in pdfs:
            pdf = pdf[pdf["terms"].map(len) > 0]
            for x in range(0, len(pdf), 512):
                part = pdf.iloc[x : x + 512]
                held.append(part)
                size += int(part["terms"].map(len).sum())
                if size >= POSTINGS or sum(map(len, held)) >= DOCS:
                    block()
                    held, size = [], 0
        if held:
            block()
        out = [(i, b.doc, b.score) for i, b in enumerate(best) if len(b.score)]
        if out:
            yield pd.DataFrame({"item": np.concatenate([np.full(len(d), items[i]) for i, d, _ in out]), "d": np.concatenate([d for _, d, _ in out]), "score": np.concatenate([s for *_, s in out])})
    return batches


def _item_terms(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, h, c): how often each item has each term."""
    for batch in found:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for lo, h, count in _terms(batch.column(1)):
            pdf = pd.DataFrame({"item": np.repeat(ids[lo : lo + len(count)], count), "h": h.view(np.int64), "c": 1})
            yield pa.RecordBatch.from_pandas(pdf.groupby(["item", "h"], as_index=False)["c"].sum().astype("int64"), preserve_index=False)


def _search_part(src: DataFrame, terms: DataFrame, k: int) -> DataFrame | None:
    """(item, d, score): k rows for each item and task, from items with TERMS rows of terms or about."""
    spark = src.sparkSession
    known = terms.toPandas().sort_values(["item", "h"])
    vocabulary = np.unique(known["h"].to_numpy().view(np.uint64))
    if not len(vocabulary):
        return None
    shared = spark.sparkContext.broadcast(vocabulary)
    postings = materialize(src.mapInArrow(_postings(shared), "d long, n long, terms array<int>, tfs array<int>"), "postings")
    n_docs, n_terms = postings.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return None
    df = {r.term: r["count"] for r in postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}  # a row for each item term at most
    number = np.searchsorted(vocabulary, known["h"].to_numpy().view(np.uint64))
    weight = np.array([math.floor(1_000 * math.log((2 * n_docs + 2) / (2 * df.get(int(t), 0) + 1))) for t in number], np.int64)
    items, first = np.unique(known["item"].to_numpy(), return_index=True)
    query = (items, number, weight * known["c"].to_numpy(), np.append(first, len(number)), (n_docs, n_terms))
    return postings.mapInPandas(_search(spark.sparkContext.broadcast(query), k), _FOUND)


def search(docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k documents of highest score above 0, from rank 1; equal scores by ascending id.

    Terms are runs of digits, ASCII letters (A-Z lower-cased) and other characters; a term's weight falls with the number of documents that hold it,
    and its share of a document's score grows with its count there and falls with the document's number of terms over the mean. All is whole-number
    arithmetic but the logarithm in the weight. Items equal in id and text are one; an id with several texts gets each text's rows. Each row of docs is a document, also where
    ids repeat; a null id counts as the largest and comes out null. Null texts, and texts and items without a term, are in no row. Statistics are
    of all documents. Terms are compared by 64-bit hashes. Only items' terms are broadcast, about TERMS rows of them at once (or one item's, if it alone has more).
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("x")).where("x is not null").distinct()
    rows = materialize(rows.withColumn("item", F.monotonically_increasing_id()), "items")
    terms = materialize(rows.select("item", "x").mapInArrow(_item_terms, "item long, h long, c long"), "item-terms")
    ids_type = docs.select(doc_id).schema[0].dataType
    src = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("d"), F.col(text).alias("x")).where("x is not null")
    parts = -(-terms.count() // TERMS)
    found = [_search_part(src, terms.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == i), k) for i in range(parts)]
    found = [x for x in found if x is not None] or [spark.createDataFrame([], _FOUND)]
    best = Window.partitionBy("item").orderBy(F.desc("score"), "d")
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(rows.select("item", "item_id"), "item").select(
        "item_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("d") != NO_ID, F.col("d")).cast(ids_type).alias("doc_id"), "score")
