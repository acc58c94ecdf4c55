"""Spelling variants: words one code point apart, through a dictionary of pairs of trie nodes.

Every prefix of a word is a node of the forward trie, every suffix one of the reversed trie. A word
gives, for each of its positions, the pair of nodes around the position (skipped) and the pair that
meets there (split). Two words with the same skipped pair differ by one replaced code point; a
skipped pair that is another word's split pair is that word with one inserted. Nodes are numbered,
so pairs are two integers, and a pair's words differ in one code point only: no pair has more of them than
the alphabet has letters, and nothing is compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, small_batches

#: Prefixes up to so many bytes are numbered by their letters; the top byte is their length.
SHORT = 7
#: Numbers of longer prefixes begin here.
DEEP = 1 << 60
#: Bytes between the places from which names of long prefixes are carried on.
LINK = 64

_PAIRS = "word string, n long, kind int, first boolean, p long, p1 long, s long, s1 long"


def _names(data: list[bytes]) -> list[tuple[int, int]]:
    """A pair for each prefix of the code points given, from none to all: (number, 0) for short ones, else a 128-bit name.

    A long prefix is named from the name at the last multiple of LINK bytes or so and what follows it, so the work is in proportion to the length.
    """
    out, base, tail = [(0, 0)], b"", b""
    whole = 0
    for c in data:
        tail += c
        whole += len(c)
        if whole <= SHORT:
            out.append((int.from_bytes(bytes([whole]) + tail, "big"), 0))
            continue
        h = xxhash.xxh3_128_digest(base + tail)
        out.append((int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True) | 1))
        if len(tail) >= LINK:
            base, tail = h, b""
    return out


def _pairs(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each word and position the names around it: kind 0 skips a code point, kind 1 splits before it."""
    cols = ["word", "n", "kind", "first", "p", "p1", "s", "s1"]
    for pdf in pdfs:
        rows: list[tuple] = []
        for word, n in zip(pdf["word"], pdf["n"]):
            data = [c.encode("utf-8", "replace") for c in word]
            front, back = _names(data), _names(data[::-1])[::-1]
            for i in range(len(word) + 1):
                rows.append((word, n, 1, False, *front[i], *back[i]))
                if i < len(word):
                    # Of a run of equal code points the first stands for all, so each shorter word is met once.
                    rows.append((word, n, 0, i == 0 or word[i] != word[i - 1], *front[i], *back[i + 1]))
                if len(rows) >= 20_000:
                    yield pd.DataFrame(rows, columns=cols)
                    rows = []
        if rows:
            yield pd.DataFrame(rows, columns=cols)


def _numbered(pairs: DataFrame) -> DataFrame:
    """pairs with nodes as one integer each: (word, n, kind, first, p, s)."""
    deep = [pairs.where(f"{c}1 != 0").select(F.col(c).alias("a"), F.col(f"{c}1").alias("b")) for c in "ps"]
    nodes = materialize(deep[0].union(deep[1]).distinct().withColumn("node", F.monotonically_increasing_id() + F.lit(DEEP)), "trie-nodes")
    for c in "ps":
        mine = nodes.toDF("a", "b", f"{c}_node")
        pairs = pairs.join(mine, (F.col(c) == F.col("a")) & (F.col(f"{c}1") == F.col("b")), "left").drop("a", "b")
    return pairs.select("word", "n", "kind", "first", F.coalesce("p_node", "p").alias("p"), F.coalesce("s_node", "s").alias("s"))


def near_words(counts: DataFrame, word: str = "word", n: str = "n") -> DataFrame:
    """(word, n, n_near, best): for each word how many words are one code point away, and the one of them with the largest n.

    counts has a row for each word; null and empty words are left out, repeated ones raise nothing and count as one, with their largest n. best is a struct (n, word), null without near words;
    of equal n the smallest word in code-point order. One inserted, deleted or replaced code point is near; two are not.
    """
    small_batches(counts.sparkSession)
    words = counts.select(F.col(word).alias("word"), F.col(n).cast("long").alias("n")).where("word != ''").groupBy("word").agg(F.max("n").alias("n"))
    pairs = materialize(words.mapInPandas(_pairs, _PAIRS), "trie-pairs")
    entry = F.struct((-F.col("n")).alias("less"), "word")
    skips, firsts, split = F.col("kind") == 0, F.col("first"), F.col("kind") == 1
    group = Window.partitionBy("p", "s")
    ranked = group.orderBy("kind", F.desc("n"), "word")
    met = _numbered(pairs).select(
        "word", "n", "kind", "first", entry.alias("own"),
        F.sum(skips.cast("long")).over(group).alias("skips"), F.sum(firsts.cast("long")).over(group).alias("firsts"),
        F.min(F.when(skips, entry)).over(group).alias("top"), F.lead(F.when(skips, entry)).over(ranked).alias("second"),
        F.min(F.when(firsts, entry)).over(group).alias("top_first"), F.min(F.when(split, entry)).over(group).alias("whole"))
    longer = F.when(firsts, F.col("whole"))
    near = F.when(split, F.col("firsts")).otherwise(F.col("skips") - 1 + F.when(longer.isNotNull(), 1).otherwise(0))
    other = F.when(F.col("own") == F.col("top"), F.col("second")).otherwise(F.col("top"))
    best = F.when(split, F.col("top_first")).otherwise(F.least(other, longer))  # least passes over nulls
    each = met.groupBy("word").agg(F.max("n").alias("n"), F.sum(near).alias("n_near"), F.min(best).alias("best"))
    return each.select("word", "n", "n_near", F.when(F.col("best").isNotNull(), F.struct((-F.col("best.less")).alias("n"), F.col("best.word").alias("word"))).alias("best"))


def variants(counts: DataFrame, ratio: int = 5, word: str = "word", n: str = "n", max_rounds: int = 64) -> DataFrame:
    """(word, form, root, n, n_near, form_n): the form that each word is a variant of, and the last form in turn.

    A word's form is its near word of largest n (ties: the smallest) if that is ratio times its own n at least, ratio being 2 or more; else null. root
    follows forms from the word to the last. n grows by the ratio at each step, so chains are short; pointers double in each round.
    """
    if ratio < 2:
        raise ValueError("with a ratio under 2 forms could go round in circles")
    isform = F.col("best.n") >= ratio * F.col("n")
    forms = materialize(near_words(counts, word, n).select("word", "n", "n_near", F.when(isform, F.col("best.word")).alias("form"), F.when(isform, F.col("best.n")).alias("form_n")), "forms")
    link = materialize(forms.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    for _ in range(max_rounds):
        ahead = link.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if link.join(ahead, "root", "left_semi").isEmpty():
            break
        nxt = materialize(link.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        discard(link)
        link = nxt
    else:
        raise RuntimeError(f"variants: chains of forms do not end after {max_rounds} rounds")
    return forms.join(link, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def runs(docs: DataFrame, letters: str, text: str = "text", least: int = 1) -> DataFrame:
    """docs' columns but text, and run: every maximal run of ``letters`` (a regular expression's class) of least code points in the whole text, A-Z lower-cased. A null text has none."""
    if "run" in {c.lower() for c in docs.columns}:
        raise ValueError("docs already has a column run")
    lower = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.explode(F.regexp_extract_all(lower, F.lit(f"{letters}{{{least},}}"), F.lit(0))).alias("run")
    return docs.select(*[c for c in docs.columns if c != text], found)


def without(run: Column, h: Column, one_in: int) -> Column:
    """run, less its code point h % length (from 0) where one_in divides h."""
    at = (h % F.length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)
