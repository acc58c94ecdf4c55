"""Corpus operators against brute force, on the smallest data and on awkward rows."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidebook.llm import contamination, jaccard, lines, suffixes
from tidebook.llm import queries as q

from ..conftest import SF

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, d string, t string, h string, n_lines long, score string"


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def odd(spark, rows):
    """Rows with clashing extra columns and a null in each of them."""
    return spark.createDataFrame([(i, x, None, "t", None, 1, None) for i, x in rows], SCHEMA).repartition(3)


AWKWARD = [(None, "same line\nother words here to fill it up"), (None, None), (1, None), (2, ""), (3, "   "), (4, "one"), (5, "one"), (5, "one"),
           (6, "a b c d e f g " * 4000), (7, "a b c d e f g " * 4000), (8, "Ünï côde " * 30), (9, "x\n\n\ny"), (10, "ONE")]


def words(x):
    return re.findall(r"[^\x20\x09-\x0D]+", (x or "").translate(LOW))


def sets(x):
    w = words(x)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(rows):
    """Union-find over all pairs of (id, text)."""
    s = [sets(x) for _, x in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b]):
                parent[find(a)] = find(b)
    low = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        low[find(k)].append(lines.NO_ID if i is None else i)
    return [(lines.NO_ID if i is None else i, len(s[k]), min(low[find(k)]) if s[k] else lines.NO_ID if i is None else i) for k, (i, _) in enumerate(rows)]


def test_jaccard_groups(spark, docs):
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in q.op3_jaccard(spark, SF).collect())
    assert got == sorted(components(sorted(docs.items())))


def near_copies(seed, groups=6, copies=9, length=60):
    import random

    r, out = random.Random(seed), []
    for g in range(groups):
        base = [f"w{r.randrange(400)}" for _ in range(length)]
        shared = ["common"] * 3 + [f"p{k}" for k in range(12)]
        for c in range(copies):
            w = list(base)
            for _ in range(r.randrange(7)):
                w[r.randrange(length)] = f"edit{r.randrange(10**6)}"
            out.append((len(out), " ".join(w + shared * (c % 2))))
    return out


@pytest.mark.parametrize("seed,block,held", [(1, 1000, 50_000), (2, 2, 50_000), (3, 3, 4), (4, 2, 0)])
def test_jaccard_near_copies_and_shared_passages(spark, seed, block, held, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "HELD", held)
    rows = near_copies(seed)
    got = sorted((r.d, r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(odd(spark, rows)).collect())
    assert got == sorted(components(rows))


def test_jaccard_awkward(spark):
    got = jaccard.jaccard_groups(odd(spark, AWKWARD)).collect()
    assert sorted((r.d, r.n_shingles, r.component_id) for r in got) == sorted(components(AWKWARD))
    kept = jaccard.one_of_each(odd(spark, AWKWARD))
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["None", "None", "1", "2", "3", "4", "6", "8", "9"])
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert jaccard.jaccard_groups(odd(spark, AWKWARD).limit(0)).count() == 0


def test_region_streaming_over_batches(monkeypatch):
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(2)
    for held in (1, 50_000):
        monkeypatch.setattr(jaccard, "HELD", held)
        s = np.sort(r.integers(0, 40, 400))
        f = r.integers(0, 9, 400)
        rows = sorted({(int(a), int(10 + 7 * b * b), int(b)) for a, b in zip(s, f)})
        for size in (1, 2, 7, 400):
            batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[k : k + size])], ["s", "n", "f"]) for k in range(0, len(rows), size)]
            got = [x for b in jaccard._regions(75)(iter(batches)) for x in zip(*(c.to_pylist() for c in b.columns))]
            cells, meet = {}, set()
            for kind, a, b, _ in got:
                if kind == jaccard.CELL:
                    cells.setdefault(a, {a}).add(b)
            for c in cells.values():
                meet |= {(a, b) for a in c for b in c}
            whole = {}
            for kind, a, b, n in got:
                if kind == jaccard.OPEN:
                    whole.setdefault(a, set()).add((n, b))
            for a, n, b in rows:
                if a in whole:
                    assert (n, b) in whole[a]
            for a, n, b in rows:
                for c, m, d in rows:
                    if a == c and a not in whole and 4 * n >= 3 * m and 4 * m >= 3 * n and b != d:
                        assert (b, d) in meet, (a, b, d)


def test_shingles_equal_words_of_texts():
    """Vectorised words against a plain split, over block borders and awkward texts."""
    import pyarrow as pa

    from tidebook.llm import words as w

    texts = ["", " ", "A b", "a B", None, "one two three four five", " one  two\tthree\nfour five ", "x" * 3000, "ünï cödé A", "a b c d e f g", "\x0b\x0c"] * 3
    for most in (1, 10, 1 << 19):
        got, names = [], {}
        for lo, hi, data, ends in w.blocks(pa.array(texts).slice(1), most):
            got += [h.tolist() for h in w.Hasher().shingles(data, ends, 5)]
        assert len(got) == len(texts) - 1
        for text, h in zip(texts[1:], got):
            own = words(text)
            grams = [" ".join(own[k : k + 5]) for k in range(len(own) - 4)] if len(own) >= 5 else [" ".join(own)] * bool(own)
            assert len(grams) == len(h)
            for g, x in zip(grams, h):
                assert names.setdefault(g, x) == x
        assert len(set(names.values())) == len(names)


def drop_lines(rows, least, chars):
    key = lambda x: x.strip(" \t\n\v\f\r").translate(LOW)
    seen = defaultdict(set)
    for i, x in rows:
        for l in (x or "").split("\n"):
            seen[key(l)].add(i)
    out = []
    for i, x in rows:
        ls = (x or "").split("\n")
        keep = [l for l in ls if len(key(l)) < chars or len(seen[key(l)]) < least]
        out.append((i, len(ls), len(ls) - len(keep), sha("\n".join(keep))))
    return out


def test_lines(spark, docs):
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in q.op8_lines(spark, SF).collect())
    assert got == sorted(drop_lines(docs.items(), 10, 1))


@pytest.mark.parametrize("least,chars", [(2, 1), (3, 4), (1, 1)])
def test_lines_awkward(spark, least, chars):
    rows = AWKWARD + [(k, f"hot line\nown {k}\nhot line\n" + "\n" * (k % 3)) for k in range(20, 60)]
    out = lines.dedup_lines(odd(spark, rows), min_docs=least, min_chars=chars)
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped, sha(r.text or "")) for r in out.collect())
    assert got == sorted((str(i), *r) for i, *r in drop_lines(rows, least, chars))
    assert lines.dedup_lines(odd(spark, rows).limit(0)).count() == 0


def test_line_marks_over_batches():
    import numpy as np
    import pandas as pd

    r = np.random.default_rng(5)
    rows = pd.DataFrame({"h": r.integers(0, 12, 200), "g": 0, "d": r.integers(0, 9, 200), "t": 0, "pos": np.arange(200)}).sort_values(["h", "d", "pos"])
    n = rows.groupby("h")["d"].nunique()
    want = set(rows[rows["h"].map(n) >= 4]["pos"])
    for cuts in ([0, 200], [0, 60, 130, 200], [0, 5, 9, 100, 200]):  # partitions, each in batches of 7
        out = []
        for a, b in zip(cuts, cuts[1:]):
            while 0 < b < 200 and (rows.iloc[b][["h", "d"]] == rows.iloc[b - 1][["h", "d"]]).all():
                b += 1
            while 0 < a < 200 and (rows.iloc[a][["h", "d"]] == rows.iloc[a - 1][["h", "d"]]).all():
                a += 1
            out += list(lines._marks(4)(iter([rows.iloc[k : min(k + 7, b)] for k in range(a, b, 7)])))
        m = pd.concat(out)
        total = m[m.kind == lines.COUNT].groupby("h")["n"].sum()
        late = m[(m.kind == lines.OPEN) & m["h"].isin(total[total >= 4].index)]
        assert set(m[m.kind == lines.GOES]["pos"]) | set(late["pos"]) == want


TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def hits(rows, items):
    win = defaultdict(set)
    for i, x in items:
        w = TOKEN.findall((x or "").translate(LOW))
        for k in range(max(1, len(w) - 12) if w else 0):
            win[tuple(w[k : k + 13])].add(i)
    out = []
    for i, x in rows:
        w, cover, its = TOKEN.findall((x or "").translate(LOW)), set(), set()
        for n in {len(x) for x in win}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in win:
                    cover.update(range(k, k + n))
                    its |= win[tuple(w[k : k + n])]
        out.append((i, len(w), len(cover), sorted(str(j) for j in its if j is not None)))
    return out


def test_contamination(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in q.op4_contamination(spark, SF).collect())
    want = sorted((i, n, h, len(s), sha(",".join(s)), h > 0 and 20 * h >= n) for i, n, h, s in hits(docs.items(), items))
    assert got == want


def test_contamination_short_and_awkward(spark):
    long = " ".join(f"b{k}" for k in range(30))
    items = [(1, long), (2, "tiny item"), (3, "Solo"), (4, ""), (5, None), (6, long), (7, "a b c d e f g h i j k l")]
    rows = AWKWARD + [(20, "x " * 5 + " ".join(f"B{k}" for k in range(3, 20)) + " y" * 5), (21, "a tiny, item; solo SOLO"), (22, long + " " + long)]
    bench = spark.createDataFrame(items + [(2, "tiny item")], "item_id long, text string")
    got = contamination.contamination(odd(spark, rows), bench).collect()
    want = {(i, n, h, tuple(s)) for i, n, h, s in hits(rows, items)}
    assert {(r.d, r.n_words, r.n_hit, tuple(r["items"])) for r in got} == want
    assert contamination.contamination(odd(spark, rows), bench.limit(0)).where("n_hit > 0").count() == 0
    assert contamination.contamination(odd(spark, rows).limit(0), bench).count() == 0


def test_contamination_stays_native(spark):
    plan = q.op4_contamination(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def repeats(rows):
    seen, out = {}, []
    low = lambda i: lines.NO_ID if i is None else i
    for i, x in rows:
        b = (x or "").encode()
        for k in range(len(b) - 49):
            seen[b[k : k + 50]] = min(seen.get(b[k : k + 50], low(i)), low(i))
    for i, x in rows:
        b = (x or "").encode()
        mark = bytearray(len(b))
        for k in range(len(b) - 49):
            if seen[b[k : k + 50]] < low(i):
                mark[k : k + 50] = b"\1" * 50
        runs = sum(1 for k in range(len(mark)) if mark[k] and not (k and mark[k - 1]))
        out.append((i, len(b), sum(mark), runs, sha(bytes(c for c, m in zip(b, mark) if not m))))
    return out


def test_suffixes(spark, docs):
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in q.op9_suffixes(spark, SF).collect())
    assert got == sorted(repeats(sorted(docs.items())))


@pytest.mark.parametrize("seed", [1, 2])
def test_suffixes_awkward(spark, seed):
    import random

    r = random.Random(seed)
    parts = ["".join(r.choice("abcé \n") for _ in range(n)) for n in (20, 49, 50, 51, 84, 85, 140)] + ["z" * 130, "ab" * 70]
    rows = [(k, "".join(r.choice(parts) for _ in range(r.randrange(5)))) for k in range(40)] + [(3, parts[4]), (None, parts[6]), (50, None), (51, "")]
    got = suffixes.remove_repeats(odd(spark, rows)).collect()
    mine = sorted((str(x.doc_id), x.n_bytes, sum(s.end - s.start for s in x.spans), len(x.spans), sha(bytes(x.kept))) for x in got)
    assert mine == sorted((str(i), *x) for i, *x in repeats(rows))
    assert suffixes.remove_repeats(odd(spark, rows).limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    from tidebook.llm.common import components as cc

    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(200, 200), (None, 7), (5, 4)]
    got = {r.node: r.component for r in cc(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(41)} == {0} and {got[k] for k in range(100, 130)} == {100} and 200 not in got


def test_held_out_folds_agree_with_zlib(spark):
    df = spark.range(50).select(q._remainder("id", 5).alias("m"), "id")
    assert all(r.m == zlib.crc32(str(r.id).encode()) % 5 for r in df.collect())
    assert isinstance(df.first(), Row) and F is not None


def test_compared_segments_of_frequent_anchors(monkeypatch):
    """However many segments an anchor has, the same strings are found."""
    import numpy as np
    import pandas as pd

    r = np.random.default_rng(4)
    texts = [b"".join(bytes([r.integers(97, 99)]) * 30 for _ in range(3)) + bytes([97 + k % 3]) * 20 for k in range(60)]
    rows = pd.DataFrame({"h": np.arange(60) // 25, "d": r.permutation(60), "t": np.arange(60), "x": [suffixes._place(np.int64(7), np.int64(len(t) - 50)) for t in texts], "bytes": texts})

    def found(go, leave):
        monkeypatch.setattr(suffixes, "GO", go)
        monkeypatch.setattr(suffixes, "LEAVE", leave)
        out = pd.concat(list(suffixes._compared(iter([rows.iloc[k : k + 11] for k in range(0, 60, 11)]))))
        late = out[out.kind == 1].sort_values(["w", "d"])
        sure = {tuple(x) for x in out[out.kind == 0][["d", "t", "x"]].to_numpy().tolist()}
        return sure | {tuple(x) for p in suffixes._repeated(iter([late])) for x in p.to_numpy().tolist()}

    every = found(10**6, 10**6)
    assert every and found(10**6, 5) <= every
    same = rows.assign(h=0)
    rows = same
    assert found(10**6, 10**6) == found(3, 5) == found(10**6, 59)


def test_suffixes_texts_of_one_id(spark):
    """Texts of one id whose hashes agree in 26 bits: bytes of the one that repeats an earlier document go, and none of the other."""
    import xxhash

    first = "".join(chr(97 + k * k % 23) + chr(97 + k * 7 % 19) for k in range(120))
    tails, others = ([f(k) for k in range(20_000)] for f in (lambda k: f"{first} tail {k}", lambda k: f"{k} " + "".join(chr(65 + (k + j * j * 5) % 26) for j in range(240))))
    low = lambda x: xxhash.xxh64_intdigest(x.encode(), seed=42) & ((1 << 26) - 1)
    known = {low(x): x for x in tails}
    other = next(x for x in others if low(x) in known)
    rows = [(1, first), (2, known[low(other)]), (2, other), (2, other)]
    got = sorted((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), bytes(r.kept).decode()) for r in suffixes.remove_repeats(odd(spark, rows)).collect())
    assert got == sorted([(1, 240, 0, first), (2, len(rows[1][1]), 240, rows[1][1][240:]), (2, len(other), 0, other), (2, len(other), 0, other)])
