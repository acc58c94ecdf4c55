"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are numpy arrays on the executors. Trees are grown on a
bounded sample of labelled rows from histograms of binned statistics, and flattened
into arrays, so that scoring is a fixed number of vectorised steps down all trees.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import no_clash, small_batches

#: Statistics of a text, in the order of ``statistics``.
NAMES = [
    "log_bytes", "log_words", "log_lines", "word_len", "word_len_sd", "upper", "digit", "space", "other_ascii", "high_bytes",
    "symbols_in_words", "end_symbol_words", "caps_words", "distinct_words", "repeat_next", "top_word", "distinct_lines",
    "line_len", "short_lines", "sentence_ends", "commas", "exclaims", "pipes", "one_letter_words", "long_words",
    "byte_entropy", "bigram_repeat", "lower_start_lines", "vowels"]

_KIND = np.zeros(256, np.int8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 above ASCII
for _lo, _hi, _k in ((97, 123, 1), (65, 91, 2), (48, 58, 3), (128, 256, 5)):
    _KIND[_lo:_hi] = _k
_KIND[[9, 10, 11, 12, 13, 32]] = 4


def statistics(text: str | None) -> np.ndarray:
    """The statistics of one whole text; all zero without text."""
    out = np.zeros(len(NAMES), np.float32)
    data = (text or "").encode("utf-8", "replace")
    if not data:
        return out
    codes = np.frombuffer(data, np.uint8)
    hist = np.bincount(codes, minlength=256)
    kinds = np.bincount(_KIND, weights=hist, minlength=6)
    n, words = len(data), data.split()
    nw, lines = max(1, len(words)), data.split(b"\n")
    lens = np.fromiter(map(len, words), np.int32, len(words)) if words else np.zeros(1, np.int32)
    ids: dict[bytes, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    freq = np.bincount(seq) if len(seq) else np.zeros(1)
    pairs = seq[:-1] * (len(ids) + 1) + seq[1:]
    p = hist[hist > 0] / n
    filled = [x for x in lines if x.strip()]
    line_lens = np.fromiter(map(len, filled), np.int32, len(filled)) if filled else np.zeros(1, np.int32)
    tail = data.translate(None, b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789").split() if words else []
    odd = sum(hist[k] for k in b"#$%&*+/<=>@[\\]^_`{|}~")
    caps = len(re.findall(rb"(?<!\S)[A-Z\x80-\xff]{2,}[!.,?]*(?!\S)", data))
    out[:] = (
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), lens.mean(), lens.std(), kinds[2] / n, kinds[3] / n, kinds[4] / n,
        kinds[0] / n, kinds[5] / n, odd / n, sum(len(x) > 1 and x[0] < 128 for x in tail) / nw, caps / nw, len(ids) / nw,
        (seq[1:] == seq[:-1]).sum() / nw, freq.max() / nw, len(set(filled)) / max(1, len(filled)), np.log1p(line_lens.mean()),
        (line_lens < 30).mean(), sum(hist[k] for k in b".?!") / nw, hist[44] / nw, hist[33] / nw, hist[124] / nw,
        (lens == 1).mean(), (lens > 14).mean(), -(p * np.log2(p)).sum(),
        1 - len(np.unique(pairs)) / max(1, len(pairs)) if len(pairs) else 0,
        sum(x[:1].islower() for x in filled) / max(1, len(filled)), sum(hist[k] for k in b"aeiouAEIOU") / n)
    return out


@dataclass
class Trees:
    """All trees in flat arrays: node k of tree t goes to left or left + 1; a leaf goes to itself."""

    edges: list[np.ndarray]
    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)]).astype(np.uint8)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row of statistics."""
        b, rows = self.bins(x), np.arange(len(x))[:, None]
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        for _ in range(self.depth):
            right = b[rows, self.feature[at]] > self.limit[at]
            at = np.where(self.left[at] == at, at, self.left[at] + right)
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64,
              least: int = 5, l2: float = 1.0) -> Trees:
    """Boosting on the logistic loss; splits are searched in histograms of binned statistics.

    Without rows the score is one half; with one label only it leans to that label.
    """
    weight = np.ones(len(y))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    pos = (weight * y).sum()
    base = float(np.log((pos + 0.5) / (weight.sum() - pos + 0.5)))
    model = Trees(edges, np.zeros(1, int), np.zeros(1, int), np.zeros(1, int), np.zeros(1), np.zeros(1, int), depth, base)
    b = model.bins(x) if len(x) else np.zeros((0, x.shape[1]), np.uint8)
    feature, limit, left, value, roots = [], [], [], [], []
    raw, d = np.full(len(y), base), x.shape[1]
    flat = b.astype(np.int64) + np.arange(d) * bins
    for _ in range(rounds if len(x) else 0):
        p = 1 / (1 + np.exp(-raw))
        g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
        roots.append(len(feature))
        todo = [(len(feature), np.arange(len(y)), 0)]
        feature.append(0), limit.append(0), left.append(len(left)), value.append(0.0)
        while todo:
            node, rows, level = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            value[node] = -rate * gs / (hs + l2)
            best = None
            if level < depth and len(rows) >= 2 * least:
                f = flat[rows].ravel()
                hg = np.bincount(f, np.repeat(g[rows], d), d * bins).reshape(d, bins).cumsum(1)
                hh = np.bincount(f, np.repeat(h[rows], d), d * bins).reshape(d, bins).cumsum(1)
                hn = np.bincount(f, minlength=d * bins).reshape(d, bins).cumsum(1)
                gain = hg**2 / (hh + l2) + (gs - hg) ** 2 / (hs - hh + l2) - gs**2 / (hs + l2)
                gain[(hn < least) | (len(rows) - hn < least)] = -1
                k = int(gain.argmax())
                if gain.flat[k] > 1e-6:
                    best = divmod(k, bins)
            if best is None:
                raw[rows] += value[node]
                continue
            feature[node], limit[node], left[node] = best[0], best[1], len(feature)
            go = b[rows, best[0]] > best[1]
            for part in (rows[~go], rows[go]):
                todo.append((len(feature), part, level + 1))
                feature.append(0), limit.append(0), left.append(len(left)), value.append(0.0)
    if not roots:
        roots, feature, limit, left, value = [0], [0], [0], [0], [0.0]
    return Trees(edges, *(np.array(v) for v in (feature, limit, left)), np.array(value), np.array(roots), depth, base)


def with_statistics(df: DataFrame, text: str, keep: dict[str, str]) -> DataFrame:
    """The columns keep (name: type) and ``stats`` of every whole text."""
    def batches(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            out = pdf[[f"k{i}" for i in range(len(keep))]].set_axis(list(keep), axis=1)
            out["stats"] = [statistics(t) for t in pdf["x"]]
            yield out

    small_batches(df.sparkSession)
    src = df.select(*[df[c].cast(k).alias(f"k{i}") for i, (c, k) in enumerate(keep.items())], df[text].alias("x"))
    return src.mapInPandas(batches, ", ".join([*(f"`{c}` {k}" for c, k in keep.items()), "stats array<float>"]))


def sample_rows(df: DataFrame, key: Column, bound: int) -> DataFrame:
    """About bound rows at most, the same ones on every run: those with the lowest hashes of key."""
    n = df.count()
    if n <= bound:
        return df
    return df.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < int((1 << 20) * bound / n))


def fit(labelled: DataFrame, text: str = "text", label: str = "label", key: str = "doc_id", bound: int = 20_000, **how) -> Trees:
    """Trees from at most about ``bound`` labelled rows, whose statistics are all that reaches the driver.

    Rows with a null label or text are left out of the fit.
    """
    rows = sample_rows(labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull()), F.col(key), bound)
    got = with_statistics(rows, text, {key: "string", label: "int"}).toPandas()
    got = got.sort_values(key, kind="stable")
    x = np.stack(got["stats"].to_list()).astype(np.float64) if len(got) else np.zeros((0, len(NAMES)))
    return fit_trees(x, got[label].to_numpy(dtype=np.float64), **how)


def score(df: DataFrame, model: Trees, text: str = "text", keep: tuple[str, ...] = (), name: str = "score") -> DataFrame:
    """The columns keep and the score, 0 to 1, of every whole text, one output row an input row.

    A null or empty text has all statistics zero and is scored as such. keep may
    hold nulls; rows may repeat; a text may be very long.
    """
    def batches(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            out = pdf[[f"k{i}" for i in range(len(keep))]].set_axis(list(keep), axis=1)
            parts = [model.score(np.stack([statistics(t) for t in pdf["x"].iloc[lo : lo + 2000]]).astype(np.float64))
                     for lo in range(0, len(pdf), 2000)]
            out[name] = np.concatenate(parts) if parts else np.zeros(0)
            yield out

    no_clash(keep, name.lower())
    small_batches(df.sparkSession)
    kinds = dict(df.dtypes)
    src = df.select(*[df[c].alias(f"k{i}") for i, c in enumerate(keep)], df[text].alias("x"))
    return src.mapInPandas(batches, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"`{name}` double"]))
