"""URL filters: rules first, and for what no rule fits the ratio of two character models.

Smoothed Markov models of variable order are learned from the URLs that rules accept and
from those that rules reject. A character's probability after up to ``order`` others mixes
what followed that context with the probability after one character less, by the number of
different characters seen there; a context seen fewer than ``least`` times is passed over,
so the order varies with what is known. A URL's score is the difference of its log-likelihoods
over its length, and a threshold on it is calibrated on URLs held out of the models.

Counts are kept per string of order + 1 characters; the models are tables that grow with the
input and are joined, never shipped whole. Log-probabilities are whole micro-units, so sums do not
depend on how rows are dealt out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, unused

#: Stand before and after a URL inside the models.
START, END = "\x02", "\x03"
#: Strings that make up one in so many places are joined by broadcast; there are no more than that many.
HOT = 4_096
#: Scores are calibrated in steps of this many micro-units, up to so many steps either way.
STEP, STEPS = 1_000, 20_000
#: One URL in so many is held out to calibrate.
FOLDS = 5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Rule = tuple[bool, str, str]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a URL; both empty where it is null or has no "://"."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def longest_rule(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path in one string, and whether it allows; both null if none fits.

    A rule (allow, host, path) fits its host and all subdomains where the path starts with the rule's. Of equally long
    rules the one with the longer host counts, then one that blocks. Rules are part of the plan, so they must be few.
    """
    name, allow = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for ok, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), not r[0])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, allow = F.when(fits, h + p).otherwise(name), F.when(fits, ok).otherwise(allow)
    return name, allow


def _places(urls: DataFrame, order: int) -> DataFrame:
    """(all columns of urls but x, gram): a string of order + 1 characters for each character of x and its end."""
    whole = F.concat(F.lit(START * order), "x", F.lit(END))
    at = F.explode(F.sequence(F.lit(1), F.length("x") + 1)).alias("at")
    kept = [c for c in urls.columns if c != "x"]
    return urls.select(*kept, whole.alias("whole"), at).select(*kept, F.substr("whole", F.col("at"), F.lit(order + 1)).alias("gram"))


def _weights(counts: DataFrame, order: int, least: int) -> DataFrame:
    """(gram, llr): micro-units of log-probability, accepted less rejected, of every string's last character after the others.

    counts: (gram, good, bad, n), a row for each string of order + 1 characters anywhere. Each order is a sum over the next one's strings, a window over
    what follows a context (as many rows as there are characters at most), and a join with the order below.
    """
    known = None
    for k in range(order + 1):
        # Strings of k + 1 characters, from the counts themselves.
        level = counts.groupBy(F.substr("gram", F.lit(order + 1 - k)).alias("g")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        here = Window.partitionBy(F.substr("g", F.lit(1), F.lit(k)))
        level = level.withColumns({f"{c}_{what}": F.sum(e).over(here) for c in ("good", "bad") for what, e in (("all", F.col(c)), ("kinds", (F.col(c) > 0).cast("long")))})
        if known is None:
            below = level.withColumns({"p_good": F.lit(1.0) / 256, "p_bad": F.lit(1.0) / 256})
        else:
            below = level.join(known.withColumnRenamed("g", "shorter"), F.substr("g", F.lit(2)) == F.col("shorter")).drop("shorter")
        mixed = {f"p_{c}": F.when(F.col(f"{c}_all") >= (least if k else 1), (F.col(c) + F.col(f"{c}_kinds") * F.col(f"p_{c}")) / (F.col(f"{c}_all") + F.col(f"{c}_kinds"))).otherwise(F.col(f"p_{c}")) for c in ("good", "bad")}
        known = below.select("g", *[e.alias(n) for n, e in mixed.items()])
    micro = lambda c: F.floor(F.log(F.col(c)) * 1_000_000)
    return known.select(F.col("g").alias("gram"), (micro("p_good") - micro("p_bad")).cast("long").alias("llr"))


def _threshold(held: DataFrame) -> int:
    """The step from which on held-out URLs are taken for good: least sum of both error rates, of equals the nearest to 0, then the lower."""
    rows = sorted((r.step, r.good, r.bad) for r in held.groupBy("step").agg(F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad")).collect())
    good, bad = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not good or not bad:
        return 0
    found, missed, passed, last = [], 0, bad, -STEPS - 1
    for step, g, b in [*rows, (STEPS + 1, 0, 0)]:
        at = max(min(0, step), last + 1)  # all steps from the last one to this one make the same errors
        found.append((missed * bad + passed * good, abs(at), at))
        missed, passed, last = missed + g, passed - b, step
    return min(found)[2]


def judge(pages: DataFrame, rules: list[Rule], url: str = "url", order: int = 4, least: int = 4) -> DataFrame:
    """pages with host, path, rule, verdict, score and threshold added.

    verdict is allow or block: the rule's where one fits, else allow if the score (micro-units of log-likelihood difference for each character)
    is in the calibrated step or above. Where rules accept or reject nothing, the other model is compared with a uniform one, and the
    threshold is 0. A null URL is judged as an empty one; equal URLs count once in the models and get equal verdicts. Added columns whose
    names pages already has raise. Very long URLs are only more rows.
    """
    added = ["host", "path", "rule", "verdict", "score", "threshold"]
    if clash := {c.lower() for c in pages.columns} & set(added):
        raise ValueError(f"pages already has {sorted(clash)}")
    host, path = host_and_path(F.col("x"))
    urls = pages.select(F.coalesce(F.col(url), F.lit("")).alias("x")).distinct().withColumns({"host": host, "path": path})
    name, allow = longest_rule(rules, F.col("host"), F.col("path"))
    urls = urls.withColumns({"rule": name, "allow": allow, "u": F.monotonically_increasing_id(), "held": F.pmod(F.crc32("x"), F.lit(FOLDS)) == 0})
    urls = materialize(urls, "urls")
    learned = lambda ok: F.sum(F.coalesce((F.col("allow") == ok) & ~F.col("held"), F.lit(False)).cast("long"))
    counts = _places(urls.select("x", "allow", "held"), order).groupBy("gram").agg(learned(True).alias("good"), learned(False).alias("bad"), F.count("*").alias("n"))
    counts = materialize(counts, "url-strings")
    places = counts.agg(F.sum("n")).first()[0] or 0
    weights = _weights(counts, order, least)
    weights = materialize(weights.join(counts.select("gram", (F.col("n") * HOT > places).alias("hot")), "gram"), "url-weights")
    hot, rest = F.broadcast(weights.where("hot").select("gram", "llr")), weights.where("not hot").select("gram", "llr")
    at = _places(urls.select("x", "u"), order)
    each = at.join(hot, "gram").select("u", "llr").union(at.join(hot, "gram", "left_anti").join(rest, "gram").select("u", "llr"))
    total = each.groupBy("u").agg(F.sum("llr").alias("llr"), F.count("*").alias("chars"))
    step = F.greatest(F.least(F.floor(F.col("llr") / (F.col("chars") * float(STEP))), F.lit(STEPS)), F.lit(-STEPS))
    scored = materialize(urls.join(total, "u").select("x", "host", "path", "rule", "allow", "held", F.col("llr") / F.col("chars"), step).toDF(
        "x", "host", "path", "rule", "allow", "held", "score", "step"), "url-scores")
    threshold = _threshold(scored.where("held and allow is not null").select("step", F.col("allow").alias("good")))
    (key,) = unused(pages, "url_key")
    verdict = F.when(F.coalesce("allow", F.col("step") >= threshold), "allow").otherwise("block")
    judged = scored.select(F.col("x").alias(key), "host", "path", "rule", verdict.alias("verdict"), "score", F.lit(threshold * STEP).cast("long").alias("threshold"))
    return pages.join(judged, F.coalesce(F.col(url), F.lit("")) == F.col(key)).drop(key)
