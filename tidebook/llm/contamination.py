"""Benchmark decontamination by winnowing, with DataFrame functions only.

Each text's words are hashed k at a time, and of every w neighbouring hashes the
smallest is a fingerprint. Two texts that share a span of k + w - 1 words share the
fingerprint chosen inside it. Documents that share one with a benchmark item are
then compared in full: hits are extended over all windows of the item that occur.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, unused

#: Fixed value: what separates words once A-Z is lower case (all ASCII but digits and letters).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Tables up to this many rows may be broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else: lower() where the text is ASCII, else a translation."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN), "")


def grams(words: Column, n: int) -> Column:
    """Hashes of all runs of n words, in order; the last n - 1 places hash what is left."""
    return F.transform(words, lambda x, i: F.xxhash64(x, *[F.get(words, i + k) for k in range(1, n)]))


def _least_with(name: str, step: int) -> Column:
    """Each element or, if smaller, the one step places on; least() passes over what is beyond the end."""
    return F.transform(name, lambda x, i: F.least(x, F.get(F.col(name), i + step)))


def _fingerprints(df: DataFrame, k: int, w: int) -> DataFrame:
    """df with words replaced by its fingerprints fp; each step is a column, so nothing is computed twice."""
    df = df.withColumn("_h", grams(F.col("words"), k))
    span = 1
    while span < w:
        step = min(span, w - span)
        df = df.withColumn("_h", _least_with("_h", step))
        span += step
    return df.withColumn("fp", F.array_distinct("_h")).drop("_h")


def windows_of(words: Column, n: int) -> Column:
    """(i, win) of every run of n words: where it starts, and its words joined by spaces."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n))
    return F.transform(starts, lambda i: F.struct(i.alias("i"), F.concat_ws(" ", F.slice(words, i + 1, n)).alias("win")))


def _small(df: DataFrame) -> DataFrame:
    """A broadcast hint if the written table df is small enough; else adaptive execution decides."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def contamination(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = 13, k: int = 5) -> DataFrame:
    """Words of each document that lie inside windows of benchmark items.

    Returns one row for each different (id, text) of docs: d (the id), t (xxhash64
    of the text, null as empty), n_words, n_hit, n_items, items (sorted as strings),
    spans (array of start, length in words; the windows that occur). A null or
    empty text has no words. An item of fewer words than window is one window of
    its own; without words it has none. Null ids of documents are kept, null item ids
    occur in no list; repeated rows and repeated items change nothing.
    """
    w = window - k + 1
    items = bench.select(bench[item_id].cast("string").alias("item"), words(bench[item_text]).alias("words"))
    items = materialize(items.where(F.size("words") > 0).distinct(), "items")
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1))),
                      lambda i: F.slice("words", i, window))
    windows = items.select("item", F.explode(cut).alias("win"))
    windows = materialize(windows.select(F.concat_ws(" ", "win").alias("win"), F.size("win").alias("len"), "item").distinct(), "windows")
    lengths = sorted(r[0] for r in windows.select("len").distinct().collect())  # at most `window` numbers
    short = [n for n in lengths if n < window]

    texts = docs.select(docs[doc_id].alias("d"), F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("t"), docs[text].alias("x"))
    split = texts.select("d", "t", words(F.col("x")).alias("words"))
    split = split.withColumn("n_words", F.size("words").cast("long"))
    prints = _fingerprints(split, k, w).drop("words")
    seen = materialize(prints.select("d", "t", "n_words", "fp"), "fingerprints")
    marks = _fingerprints(items.where(F.size("words") >= window), k, w).select(F.explode_outer("fp").alias("f"))
    marks = marks.where("f is not null").distinct()
    marks = materialize(marks, "item-fingerprints")
    found = seen.select("d", "t", F.explode("fp").alias("f")).join(_small(marks), "f", "left_semi").select("d", "t")
    for n in short:  # every run of n words is a fingerprint of its own here
        whole = materialize(windows.where(F.col("len") == n).select(F.xxhash64(*[F.get(F.split("win", " "), F.lit(i)) for i in range(n)]).alias("f")).distinct(), "short-items")
        runs = split.select("d", "t", F.explode_outer(F.array_distinct(grams(F.col("words"), n))).alias("f"))
        found = found.union(runs.join(_small(whole), "f", "left_semi").select("d", "t"))
    found = materialize(found.distinct(), "documents-with-hits")

    # Extend: all windows of the documents that share a fingerprint, compared word by word.
    same = (F.col("d0").eqNullSafe(F.col("d"))) & (F.col("t0") == F.col("t"))
    keys = found.select(F.col("d").alias("d0"), F.col("t").alias("t0"))
    near = texts.join(_small(keys), same, "left_semi").distinct().select("d", "t", words(F.col("x")).alias("words"))
    # Outer generators, as the filters inferred for inner ones would compute their arrays again, inside the lambdas.
    known = _small(windows)
    hits = None
    for n in lengths:
        at = near.select("d", "t", F.inline_outer(windows_of(F.col("words"), n))).select("d", "t", "i", F.lit(n).alias("n"), "win")
        hits = at if hits is None else hits.unionByName(at)
    if hits is None:
        hits = near.select("d", "t", F.lit(0).alias("i"), F.lit(0).alias("n"), F.lit("").alias("win")).limit(0)
    hits = materialize(hits.join(known, "win").select("d", "t", "i", "n", "item"), "hits")
    spans = hits.groupBy("d", "t", "i").agg(F.max("n").alias("n")).groupBy("d", "t").agg(F.array_sort(F.collect_list(F.struct("i", "n"))).alias("spans"))
    lists = hits.groupBy("d", "t", "item").agg(F.lit(1)).groupBy("d", "t").agg(F.array_sort(F.collect_list("item")).alias("items"), F.count("*").alias("n_items"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["i"] + s["n"] - F.greatest(a["end"], s["i"]))).alias("n"),
                              F.greatest(a["end"], s["i"] + s["n"]).alias("end")),
        lambda a: a["n"].cast("long"))
    per = spans.join(lists, (spans["d"].eqNullSafe(lists["d"])) & (spans["t"] == lists["t"])).select(
        spans["d"].alias("d0"), spans["t"].alias("t0"), "spans", "items", "n_items", covered.alias("n_hit"))
    base = seen.select("d", "t", "n_words").distinct()
    out = base.join(per, (F.col("d").eqNullSafe(F.col("d0"))) & (F.col("t") == F.col("t0")), "left")
    return out.select("d", "t", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                      F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans")


def clean(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
          item_text: str = "text", share: int = 20) -> DataFrame:
    """docs without the contaminated ones: those of whose words one in ``share`` at least lies in a benchmark window."""
    found = contamination(docs, bench, doc_id, text, item_id, item_text).where(f"n_hit > 0 and {share} * n_hit >= n_words")
    d, t = unused(docs, "gone_d", "gone_t")
    gone = found.select("d", "t").toDF(d, t)
    same = docs[doc_id].eqNullSafe(F.col(d)) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == F.col(t))
    return docs.join(gone, same, "left_anti")
