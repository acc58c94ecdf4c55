"""URL filters, spelling variants and ranked search against SQL and brute force, on awkward rows."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebook.llm import lexical, spelling, urls
from tidebook.llm import queries as q

from ..conftest import SF

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def same_as_sql(spark, name, folder, tables):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'" if (folder != SF) else f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df, want = q.queries()[name](spark, folder), con.sql(q.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    rows = lambda cols, data: sorted((tuple(r[cols.index(c)] for c in sorted(cols)) for r in data), key=repr)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got == rows(want.columns, want.fetchall())
    return got


@pytest.mark.parametrize("name", ["op11_urls", "op12_spelling", "op13_lexical"])
def test_given_tables(spark, name):
    assert same_as_sql(spark, name, SF, ["documents", "pages", "benchmark"])


def words_of(seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdeé") for _ in range(r.randrange(6, 10))) for _ in range(8)] + ["aaaaaaaa", "abababab"]
    out = []
    for w in base:
        for _ in range(6):
            k, c = r.randrange(len(w)), r.choice("abcéÿ")
            out.append(r.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :]]))
    return base * 40 + out * 5 + [w.upper() for w in base] * 2


AWKWARD = [(None, "Wetter wetter"), (None, None), (1, None), (2, ""), (3, " .,- "), (4, "x"), (5, "same words here"), (5, "same words here"), (6, "same words here"),
           (7, "a" * 3000 + " " + "b" * 40), (8, "日本語 ünï_côde1 a1_b2 × ÷ÿÀ")]


def text_tables(spark, tmp_path, rows, items=()):
    docs = spark.createDataFrame([(i, x, None, "w", 1, "h", 0.5) for i, x in rows], "doc_id long, text string, run string, word string, n long, item string, score double")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, x, 9) for i, x in items], "item_id long, text string, doc_id long").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("seed", [1, 2])
def test_spelling_awkward(spark, tmp_path, seed):
    r = random.Random(seed)
    drawn = words_of(seed)
    r.shuffle(drawn)
    rows = [(k, " ".join(drawn[k::40])) for k in range(40)] + [(100 + k, x) for k in range(5) for _, x in AWKWARD] + AWKWARD
    got = same_as_sql(spark, "op12_spelling", text_tables(spark, tmp_path, rows), ["documents"])
    assert any(x[0] for x in got)
    # The definition itself: crc32, then all pairs.
    count = Counter()
    for i, x in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", x or ""):
            w = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            count[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    n = {w: c for w, c in count.items() if len(w) >= 6 and c >= 5}
    cut = {w: {w[:k] + w[k + 1 :] for k in range(len(w))} for w in n if len(w) < 1000}
    near = lambda a, b: a != b and (b in cut.get(a, ()) or a in cut.get(b, ()) or len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1)
    by = {w: sorted((-n[v], v) for v in n if near(w, v)) for w in n}
    form = {w: (x[0][1] if x and -x[0][0] >= 5 * n[w] else None) for w, x in by.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    assert sorted(((form[w] or "", n[form[w]] if form[w] else 0, n[w], len(by[w]), root(w), w) for w in n)) == sorted((x[0] or "", x[1] or 0, *x[2:]) for x in got)


def test_spelling_without_words(spark):
    none = spark.createDataFrame([], "word string, n long")
    assert spelling.variants(none).count() == 0
    odd = spark.createDataFrame([(None, 3), ("", 4), ("word", None), ("word", 2), ("word", 20), ("wird", 1), ("wind", 2)], "word string, n long")
    got = {r.word: (r.n, r.n_near, r.form, r.root) for r in spelling.variants(odd).collect()}
    assert got == {"word": (20, 1, None, "word"), "wird": (1, 2, "word", "word"), "wind": (2, 1, None, "wind")}
    with pytest.raises(ValueError, match="circles"):
        spelling.variants(odd, ratio=1)
    with pytest.raises(ValueError, match="column run"):
        spelling.runs(spark.createDataFrame([("a", "b")], "text string, run string"), "[a-z]")


def test_chains_of_forms(spark):
    """Forms of forms are followed to the last, over more steps than one round."""
    chain = [("abcdefgh"[: 8 - k] if k else "abcdefgh", 6 ** (7 - k)) for k in range(7)]
    got = {r.word: r.root for r in spelling.variants(spark.createDataFrame(chain, "word string, n long"), ratio=5).collect()}
    assert set(got.values()) == {"abcdefgh"}


def test_names_of_prefixes():
    """Prefixes get one number each, however long; equal ones the same."""
    r = random.Random(3)
    words = ["".join(r.choice("ab") for _ in range(300)) for _ in range(5)] + ["ab" * 150, "é" * 200, "ab" * 160]
    seen = {}
    for w in words:
        names = spelling._names([c.encode() for c in w])
        assert len(names) == len(w) + 1
        for k, name in enumerate(names):
            assert seen.setdefault(name, w[:k]) == w[:k]
    assert len(set(seen.values())) == len(seen)


def ranked(rows, items, k):
    """Every document's score for every item, from the definition."""
    terms = lambda x: re.findall("[0-9a-z\x80-\U0010ffff]+", (x or "").translate(LOW))
    docs = [(i, Counter(t), len(t)) for i, x in rows if (t := terms(x))]
    total, df = sum(n for *_, n in docs), Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, x in {(i, x) for i, x in items if x}:
        scores = []
        for i, c, n in docs:
            m = 75 + (25 * n * len(docs)) // total
            s = sum(k * math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, k in Counter(terms(x)).items() if t in c)
            scores += [(-s, math.inf if i is None else i)] if s else []
        out += [(item, r + 1, None if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_search_awkward(spark, tmp_path, seed, monkeypatch):
    r = random.Random(seed)
    lexicon = [f"t{k}" for k in range(90)] + ["the"] * 40
    rows = [(k, " ".join(r.choices(lexicon, k=r.randrange(1, 60)))) for k in range(150)] + [(200 + k, "same text the") for k in range(30)] + AWKWARD
    items = [(1, "The t1 t2 t3 t1"), (2, "same text the"), (2, "the"), (2, "the"), (None, "t5 t6"), (3, None), (4, ""), (5, "unknown"), (6, " ".join(lexicon))]
    folder = text_tables(spark, tmp_path, rows, items)
    want = ranked(rows, items, 20)
    assert sorted(map(tuple, q.op13_lexical(spark, folder).select("item_id", "rank", "doc_id", "score").collect()), key=repr) == want
    same_as_sql(spark, "op13_lexical", folder, ["documents", "benchmark"])
    # Items in several passes, small blocks.
    for name, least in (("TERMS", 20), ("DOCS", 16), ("CELLS", 100)):
        monkeypatch.setattr(lexical, name, least)
    docs, queries = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    assert sorted(map(tuple, lexical.search(docs, queries, k=20).collect()), key=repr) == want
    assert lexical.search(docs.limit(0), queries).count() == 0 and lexical.search(docs, queries.limit(0)).count() == 0


def test_masks_leave_documents_out():
    """Few documents are evaluated where rare terms tell them apart, and the best are all there."""
    r = np.random.default_rng(2)
    weights, docs = np.array([1, 50, 900] + [3] * 70), np.arange(5000)
    cells = np.where(r.random((73, 5000)) < np.array([0.9, 0.05, 0.004] + [0.1] * 70)[:, None], r.integers(400, 1000, (73, 5000)), 0)
    rows, cols = np.nonzero(cells)
    best = lexical._Best(10)
    seen = lexical.by_masks(best, weights, rows, cols, cells[rows, cols], docs, cells.max(axis=1))
    scores = weights @ cells
    want = np.lexsort((docs, -scores))[:10]
    assert best.doc.tolist() == want.tolist() and best.score.tolist() == scores[want].tolist() and seen < 500


URLS = [None, "", "no scheme.org/x", "http://A.Org", "http://A.org/", "https://x.example.org/es/1?q=a://b", "https://EXAMPLE.org/en/1#f", "http://notexample.org/en/1", "https://m.a.com/fr/x", "https://a.com/de/", "https://a.com/de",
        "ftp://a.net?x/y", "https://ü.net/日本/" + "x" * 3000, "https://example.org/en/2"]


@pytest.mark.parametrize("seed", [1, 2])
def test_urls_awkward(spark, tmp_path, seed):
    r = random.Random(seed)
    made = [f"https://{r.choice('abc')}{r.randrange(9)}.{r.choice(['org', 'com', 'net', 'example.org'])}/{r.choice(['en', 'es', 'fr', 'de'])}/{r.randrange(30)}" for _ in range(400)]
    rows = [(k, u) for k, u in enumerate(URLS + made + made[:50])] + [(None, "http://x.org/1"), (3, URLS[5])]
    spark.createDataFrame([(i, u, "h", "p", "r") for i, u in rows], "page_id long, url string, host string, path string, score string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    assert len(same_as_sql(spark, "op11_urls", str(tmp_path), ["pages"])) == len(rows)


def test_urls_by_definition(spark):
    """Hosts, paths and rules by a plain parser."""
    got = {r.url: r for r in urls.judge(spark.createDataFrame([(u,) for u in URLS], "url string"), q.URL_RULES).collect()}
    for u in URLS:
        host = path = ""
        if u and "://" in u:
            host, path = re.fullmatch(r"([^/?#]*)([^?#]*).*", u[u.index("://") + 3 :], re.S).groups()
            host = host.translate(LOW)
        fits = [(h + p, ok) for ok, h, p in q.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, ok = max(fits, key=lambda x: len(x[0]), default=(None, None))
        assert (got[u].host, got[u].path, got[u].rule) == (host, path, rule)
        assert ok is None or got[u].verdict == ("allow" if ok else "block")


def test_url_models_learn(spark):
    """Held-out URLs that no rule fits go with those that look alike, also where one URL is a third of all rows; nothing learned, nothing blocked."""
    r = random.Random(5)
    kind = lambda ok, k: f"http://h{k}.{'net' if k % 2 else 'org' if ok else 'com'}/{''.join(r.choice('aeiou' if ok else 'xzqk') for _ in range(9))}"
    rows = [(kind(ok, k), ok) for k in range(300) for ok in (True, False)]
    rows += rows[:1] * 300
    df = spark.createDataFrame(rows, "url string, good boolean")
    judged = urls.judge(df, [(True, "org", "/"), (False, "com", "/")]).where("rule is null")
    assert judged.where((F.col("verdict") == "allow") != F.col("good")).count() <= 0.02 * judged.count()
    assert urls.judge(df, []).where("verdict = 'block'").count() == 0
    assert urls.judge(df.limit(0), q.URL_RULES).count() == 0
    with pytest.raises(ValueError, match="already has"):
        urls.judge(df.withColumn("Host", F.lit(1)), [])
