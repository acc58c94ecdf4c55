"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. An n-gram's vector binds (multiplies)
its letters' vectors, each permuted by its place; a text's vector bundles (adds) the
vectors of all its n-grams; a language's prototype bundles the vectors of its texts.
A text gets the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import no_clash, small_batches

#: Symbols: 0 for what is no letter, 1 to 26 for a to z, the rest shared by all other letters.
SYMBOLS = 64
UNKNOWN = "und"
#: Distinct n-grams whose vectors are held at a time.
GRAMS = 2048


@lru_cache(maxsize=1)
def _symbol_table() -> np.ndarray:
    """The symbol of each code point of the basic plane."""
    table = np.zeros(1 << 16, np.uint8)
    for c in range(1 << 16):
        if chr(c).isalpha():
            table[c] = c - 96 if 97 <= c < 123 else 27 + (c * 40503 >> 4) % (SYMBOLS - 27)
    return table


@dataclass(frozen=True)
class Space:
    """The random space: its size, its n, and the seed of its letters."""

    size: int = 1024
    n: int = 3
    seed: int = 7

    def letters(self) -> np.ndarray:
        """For each place in an n-gram, every symbol's vector, permuted once for each letter after it."""
        plain = np.random.default_rng(self.seed).integers(0, 2, (SYMBOLS, self.size), dtype=np.int8) * 2 - 1
        return np.stack([np.roll(plain, self.n - 1 - k, axis=1) for k in range(self.n)])

    def grams(self, text: str | None) -> np.ndarray:
        """Codes of the n-grams over letters and word borders; none without a letter."""
        cps = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
        table = _symbol_table()
        s = table[np.minimum(cps, 0xFFFF)]
        for k in np.flatnonzero(cps > 0xFFFF):
            s[k] = 27 + int(cps[k]) % (SYMBOLS - 27) if chr(cps[k]).isalpha() else 0
        if not s.any():
            return np.zeros(0, np.int64)
        s = np.concatenate([[0], s, [0]]).astype(np.int64)
        s = s[np.append(True, (s[1:] != 0) | (s[:-1] != 0))]
        if len(s) < self.n:
            return np.zeros(0, np.int64)
        code = s[: len(s) - self.n + 1]
        for k in range(1, self.n):
            code = code * SYMBOLS + s[k : len(s) - self.n + 1 + k]
        return code

    def bundle(self, texts: list, letters: np.ndarray) -> np.ndarray:
        """Unit vectors of whole texts (zero without a letter)."""
        out = np.zeros((len(texts), self.size), np.float32)
        codes = [self.grams(t) for t in texts]
        lens = [len(c) for c in codes]
        if not sum(lens):
            return out
        there, place = np.unique(np.concatenate(codes), return_inverse=True)
        row = np.repeat(np.arange(len(texts)), lens)
        for lo in range(0, len(there), GRAMS):
            part, vec = there[lo : lo + GRAMS], None
            for k in range(self.n - 1, -1, -1):
                vec = letters[k][part % SYMBOLS] if vec is None else vec * letters[k][part % SYMBOLS]
                part = part // SYMBOLS
            here = (place >= lo) & (place < lo + GRAMS)
            count = np.bincount(row[here] * len(vec) + place[here] - lo, minlength=len(texts) * len(vec))
            out += count.reshape(len(texts), -1).astype(np.float32) @ vec.astype(np.float32)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _chunks(texts: list, chars: int = 150_000, rows: int = 200) -> Iterator[slice]:
    """Slices of texts with about so many characters each and so many rows at most, so memory is bounded."""
    lo = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= chars or k + 1 - lo >= rows:
            yield slice(lo, k + 1)
            lo, size = k + 1, 0
    if lo < len(texts):
        yield slice(lo, len(texts))


def prototypes(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", bound: int = 20_000,
               space: Space = Space()) -> dict[str, np.ndarray]:
    """Each language's prototype, from at most about ``bound`` labelled rows, shared out evenly among the languages.

    Rows with a null language, a null text or no letter are left out. Sums over
    partitions are added up by Spark; one vector a language reaches the driver.
    """
    def partial(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters, total = space.letters(), {}
        for pdf in pdfs:
            texts, langs = pdf["x"].tolist(), pdf["y"].to_numpy()
            for part in _chunks(texts):
                for y, v in zip(langs[part], space.bundle(texts[part], letters)):
                    total[y] = total.get(y, 0) + v.astype(np.float64)
        for y, v in total.items():
            yield pd.DataFrame({"y": y, "i": np.arange(space.size), "v": v})

    small_batches(labelled.sparkSession)
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("x"), F.col(lang).alias("y"), F.col(key).cast("string").alias("k"))
    # One row a language: a label set, not data that grows.
    size = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    each, one = max(1, bound // max(1, len(size))), 1 << 20
    if any(n > each for n in size.values()):
        share = F.create_map(*[F.lit(x) for y, n in size.items() for x in (y, min(one, one * each // n + 1))])
        rows = rows.where(F.pmod(F.xxhash64("k"), F.lit(one)) < share[F.col("y")])
    sums = rows.select("x", "y").mapInPandas(partial, "y string, i int, v double")
    got = sums.groupBy("y", "i").agg(F.sum("v").alias("v")).toPandas().sort_values(["y", "i"])
    return {y: g["v"].to_numpy() for y, g in got.groupby("y") if g["v"].any()}


def identify(df: DataFrame, known: dict[str, np.ndarray], text: str = "text", keep: tuple[str, ...] = (),
             space: Space = Space(), sharpness: float = 20.0) -> DataFrame:
    """keep, lang_pred and score (0 to 1) of every whole text, one output row an input row.

    Texts that are null or hold no letter, or all texts if no language is known, are
    ``und`` with score 0. Ties go to the first language by name. The score is a
    softmax over the cosines. keep may hold nulls; rows may repeat.
    """
    no_clash(keep, "lang_pred", "score")
    small_batches(df.sparkSession)
    names = sorted(known)
    proto = np.stack([known[y] / max(np.linalg.norm(known[y]), 1e-9) for y in names]) if names else np.zeros((0, space.size))
    proto = proto.astype(np.float32)

    def batches(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters = space.letters()
        for pdf in pdfs:
            out = pdf[[f"k{i}" for i in range(len(keep))]].set_axis(list(keep), axis=1)
            texts, pred, score = pdf["x"].tolist(), [], []
            for part in _chunks(texts):
                vec = space.bundle(texts[part], letters)
                cos = vec @ proto.T
                for v, c in zip(vec, cos.astype(np.float64)):
                    if not len(c) or not v.any():
                        pred.append(UNKNOWN), score.append(0.0)
                        continue
                    e = np.exp(sharpness * (c - c.max()))
                    k = int(c.argmax())
                    pred.append(names[k]), score.append(float(e[k] / e.sum()))
            out["lang_pred"], out["score"] = pred, np.array(score, dtype=np.float64)
            yield out

    kinds = dict(df.dtypes)
    src = df.select(*[df[c].alias(f"k{i}") for i, c in enumerate(keep)], df[text].alias("x"))
    return src.mapInPandas(batches, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "lang_pred string", "score double"]))
