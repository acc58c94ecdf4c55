"""Approximate nearest neighbours with learned partitions.

A bounded sample's neighbour graph is cut into balanced parts by recursive bisection
along a smooth vector of the graph. A softmax classifier learns which part a vector
belongs to. Every vector is put into its most probable part; a query goes to
several most probable ones, and their vectors are ranked by exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches
from .quality import sample_rows


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """For each unit vector, the places of its k nearest others."""
    k = min(k, len(x) - 1)
    out = np.zeros((len(x), k), np.int64)
    for lo in range(0, len(x), 1024):
        s = x[lo : lo + 1024] @ x.T
        s[np.arange(len(s)), lo + np.arange(len(s))] = -np.inf
        out[lo : lo + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else out[lo : lo + 1024]
    return out


def balanced_parts(x: np.ndarray, parts: int, k: int = 10, steps: int = 60, seed: int = 3) -> np.ndarray:
    """A part for each vector; parts differ in size by one at most at each bisection.

    Each bisection smooths a random vector over the graph's edges inside the set,
    without its constant part, and cuts at the median.
    """
    graph, label, rng = neighbour_graph(x, k), np.zeros(len(x), np.int64), np.random.default_rng(seed)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        rows, first, n = todo.pop()
        if n < 2 or len(rows) < 2:
            label[rows] = first
            continue
        place = np.full(len(x), -1)
        place[rows] = np.arange(len(rows))
        a = np.repeat(np.arange(len(rows)), graph.shape[1])
        b = place[graph[rows].ravel()]
        a, b = a[b >= 0], b[b >= 0]
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
        degree = np.bincount(a, minlength=len(rows)) + 1.0
        v = x[rows] @ rng.normal(size=x.shape[1])
        for _ in range(steps):
            v = v - (v * degree).sum() / degree.sum()
            v = (v + np.bincount(a, v[b], len(rows))) / degree
            v /= max(np.abs(v).max(), 1e-300)
        left = n // 2
        order = np.argsort(v, kind="stable")
        cut = len(rows) * left // n
        todo += [(rows[order[:cut]], first, left), (rows[order[cut:]], first + left, n - left)]
    return label


@dataclass
class Router:
    """A softmax classifier over parts."""

    weight: np.ndarray
    bias: np.ndarray

    def rank(self, x: np.ndarray, m: int) -> np.ndarray:
        """The m most probable parts of each vector, best first."""
        s = _unit(x) @ self.weight + self.bias
        return np.argsort(-s, axis=1, kind="stable")[:, :m]


def fit_router(x: np.ndarray, label: np.ndarray, parts: int, epochs: int = 200, rate: float = 2.0, l2: float = 1e-5) -> Router:
    """Gradient steps with momentum on the log-likelihood, over the whole sample at a time."""
    w, b, y = np.zeros((x.shape[1], parts)), np.zeros(parts), np.eye(parts)[label]
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(epochs if len(x) else 0):
        s = x @ w + b
        p = np.exp(s - s.max(axis=1, keepdims=True))
        g = (p / p.sum(axis=1, keepdims=True) - y) / len(x)
        vw = 0.9 * vw - rate * parts * (x.T @ g + l2 * w)
        vb = 0.9 * vb - rate * parts * g.sum(axis=0)
        w, b = w + vw, b + vb
    return Router(w, b)


def probes_for(router: Router, x: np.ndarray, asked: np.ndarray, k: int, target: float) -> int:
    """Parts to look into so that the share ``target`` of the k nearest of the rows asked is found, measured within x."""
    parts = router.weight.shape[1]
    home, order = router.rank(x, 1)[:, 0], router.rank(x[asked], parts)
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -np.inf
    near = np.argsort(-s, axis=1)[:, :k]
    place = np.argsort(order, axis=1)  # of each part among a query's parts
    need = np.sort(np.take_along_axis(place, home[near], axis=1).ravel())
    return int(need[min(len(need) - 1, int(np.ceil(target * len(need))))]) + 1 if len(need) else 1


def learn(vectors: DataFrame, column: str, parts: int, k: int, target: float, bound: int = 8_000, held: int = 500) -> tuple[Router, int]:
    """Router and number of probes from at most about ``bound`` vectors, which come to the driver.

    ``held`` of them are kept from training, and tell how many parts must be
    looked into: few where vectors cluster, most where they fill the sphere evenly.
    """
    got = sample_rows(vectors.select(column), F.col(column).cast("string"), bound).toPandas()[column]
    if not len(got):
        return Router(np.zeros((1, 1)), np.zeros(1)), 1
    # Vectors of the most frequent size teach; others only take part in the search.
    size = got.map(len).mode()[0]
    x = _unit(np.stack([v for v in got if len(v) == size]).astype(np.float64))
    x = np.random.default_rng(1).permutation(x[np.lexsort(x.T)])
    known = x[held:] if len(x) > 4 * held else x
    label = balanced_parts(known, min(parts, max(1, len(known) // 20)))
    router = fit_router(known, label, int(label.max()) + 1)
    return router, probes_for(router, x, np.arange(min(held, len(x))), k, target)


def usable(v: Column) -> Column:
    """Not null, not zero, no null or non-finite component."""
    bad = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda e: e != 0)


def nearest(df: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", parts: int | None = None,
            target: float = 0.95, bound: int = 8_000, block: int = 2_000, asks: int | None = None) -> DataFrame:
    """The k nearest found of each query row, by cosine in double precision; ties go to the smaller id.

    queries: a condition on df's columns; target: the share of nearest ones to find, as measured on the sample. Returns query_id, rank (from 1), vec_id,
    score; all candidates where there are fewer than k. A query's own id is no candidate.
    Vectors that are null, zero or hold a null or non-finite component take no
    part, nor do rows without an id; vectors of another size than the query's are no candidates.
    Equal rows count once. Equal vectors are searched for once: only the k + 1
    smallest ids of a vector can be among anyone's k nearest. A part of more than ``block`` vectors is
    split, and its queries go to every piece. Queries come in blocks as well, of about ``asks`` of all different ones (64 MB by
    default), to each of which the pieces are copied; a group is one block's queries of a part with one piece.
    """
    small_batches(df.sparkSession)
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("q"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v")))
    rows = materialize(rows.groupBy("id", "v").agg(F.max("q").alias("q")).withColumn("h", F.xxhash64("v")), "vectors")
    # Sorted by hash first, so that whole vectors are compared only where these are equal.
    order = Window.partitionBy("h", "v").orderBy("id")
    some = rows.withColumn("r", F.row_number().over(order)).where(f"r <= {k + 1}")
    different = some.groupBy("h", "v").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # k + 1 ids at most
    different = materialize(different.select("v", "ids", F.element_at("ids", 1).alias("g")), "different-vectors")
    # A query vector goes by the smallest of the ids that ask for it.
    asked = materialize(rows.where("q").groupBy("h", "v").agg(F.min("id").alias("a")), "asked-vectors")
    n = different.count()
    parts = parts or int(min(256, max(1, n // 400)))
    router, probes = learn(different, "v", parts, k, target, bound)
    parts = router.weight.shape[1]

    def route(m: int):
        def batches(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in pdfs:
                size = router.weight.shape[0]
                top = np.zeros((len(pdf), min(m, parts)), np.int64)
                fit = np.array([len(v) == size for v in pdf["v"]], bool)
                if fit.any():
                    top[fit] = router.rank(np.stack([v for v, f in zip(pdf["v"], fit) if f]), m)
                out = pdf.copy()
                out["part"] = list(top)
                if not fit.all():  # sizes that the router does not know are searched in full
                    out["part"] = [t if f else (np.arange(parts) if m > 1 else t) for t, f in zip(top, fit)]
                yield out
        return batches

    index = different.mapInPandas(route(1), "v array<double>, ids array<long>, g long, part array<long>")
    index = materialize(index.select("v", "ids", "g", F.element_at("part", 1).alias("part")), "index")
    pieces = index.groupBy("part").agg(F.ceil(F.count("*") / block).cast("long").alias("pieces"))
    index = index.join(F.broadcast(pieces), "part")  # at most 256 parts
    index = index.select("v", "ids", F.col("part").alias("home"), F.pmod(F.xxhash64("g"), F.col("pieces")).alias("box"))
    blocks = -(-asked.count() // (asks or max(1, (64 << 20) // (8 * router.weight.shape[0])))) or 1
    index = index.withColumn("asks", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    routed = asked.select("v", "a").mapInPandas(route(probes), "v array<double>, a long, part array<long>")
    routed = routed.select("v", "a", F.explode("part").alias("part")).join(F.broadcast(pieces), "part")
    routed = routed.select("v", "a", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"),
                           F.pmod(F.xxhash64("a"), F.lit(blocks).cast("long")).alias("asks"))

    def rank(key: tuple, ask: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        out = []
        for size in sorted({len(v) for v in ask["v"]}) if len(have) else []:
            a = ask[[len(v) == size for v in ask["v"]]]
            h = have[[len(v) == size for v in have["v"]]]
            if not len(h):
                continue
            y = np.stack(h["v"].to_list())
            ny = np.sqrt((y * y).sum(axis=1))
            ids = h["ids"].to_list()
            for lo in range(0, len(a), 256):
                x = np.stack(a["v"].iloc[lo : lo + 256].to_list())
                nx = np.sqrt((x * x).sum(axis=1))
                s = (x @ y.T) / nx[:, None] / ny
                # All that may be among the k + 1 best once scores are exact: ties are decided by id.
                take = len(y) - min(k + 1, len(y))
                least = np.partition(s, take, axis=1)[:, take] - 8 * (size + 8) * np.finfo(float).eps
                for r, name in enumerate(a["a"].iloc[lo : lo + 256]):
                    cols = np.flatnonzero(s[r] >= least[r])
                    exact = (y[cols] * x[r]).sum(axis=1) / (nx[r] * ny[cols])
                    for c in np.lexsort(([ids[j][0] for j in cols], -exact))[: k + 1]:
                        out.append((name, ids[cols[c]], float(exact[c])))
        return pd.DataFrame(out, columns=["a", "ids", "score"])

    found = routed.groupBy("part", "piece", "asks").cogroup(index.groupBy("home", "box", "asks")).applyInPandas(rank, "a long, ids array<long>, score double")
    # k + 1 best vectors hold the k best ids of every query with this vector, its own left out.
    by = Window.partitionBy("a").orderBy(F.desc("score"), F.element_at("ids", 1))
    best = found.withColumn("r", F.row_number().over(by)).where(f"r <= {k + 1}")
    best = materialize(best.groupBy("a").agg(F.collect_list(F.struct("score", "ids")).alias("best")), "best-of-vectors")
    flat = F.flatten(F.transform("best", lambda b: F.transform(b["ids"], lambda i: F.struct((-b["score"]).alias("minus"), i.alias("id")))))
    own = rows.where("q").select(F.col("id").alias("query_id"), "h", "v").join(asked, ["h", "v"]).select("query_id", "a")
    own = own.join(best.select("a", flat.alias("near")), "a")
    near = F.slice(F.array_sort(F.filter("near", lambda c: c["id"] != F.col("query_id"))), 1, k)
    out = own.select("query_id", near.alias("near")).select("query_id", F.posexplode("near").alias("p", "c"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("c.id").alias("vec_id"), (-F.col("c.minus")).alias("score"))
