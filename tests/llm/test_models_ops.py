"""Encoding, extraction, trained models, search and the pipeline."""

import random
import re
import zlib
from array import array

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tidebook.llm import bpe, html, language, neighbours, pii, pii_examples, quality
from tidebook.llm import queries as q

from ..conftest import SF
from .test_text_ops import AWKWARD, odd, sha

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(PATH)


def test_bpe_whole_table(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {}
    for r in docs:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), sha(array("I", ids).tobytes()), sha(library.decode(ids, skip_special_tokens=False)))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in q.op1_bpe(spark, SF).collect()}
    assert got == want


def test_bpe_streams_like_the_library(library):
    merges = bpe.Merges(PATH)
    encoder, decoder, r = bpe.Encoder(merges, 50), bpe.Decoder(merges), random.Random(2)
    for k in range(400):
        x = "".join(r.choice("aabeht  \n\t'é中12!?<|>\x1c\x85᠎😀'relvs") for _ in range(r.randrange(80)))
        if k % 4 == 0:
            x = x[:20] + "<|endoftext|>" + x[20:]
        if k % 40 == 0:
            x += "the" * r.randrange(4000) + " " * r.randrange(9000) + r.choice(["x", "", "\n"]) + "1" * r.randrange(9000)
        ids = encoder.encode(x, chunk=r.choice([1, 5, 64, 5000]))
        assert list(ids) == library.encode(x, add_special_tokens=False).ids
        assert decoder.decode(ids, 3) == library.decode(list(ids), skip_special_tokens=False)


def test_bpe_window_is_bounded():
    merges = bpe.Merges(PATH)
    w, most, out = bpe.Window(merges), 0, []
    data = "hetheathinonandthe".encode() * 800
    for k in range(0, len(data), 50):
        out += w.feed(data[k : k + 50])
        most = max(most, len(w.held))
    out += w.finish()
    assert most <= w.size and out == merges.merge([merges.id_of_byte[b] for b in data])


def test_bpe_awkward(spark):
    out = bpe.tokenize(odd(spark, AWKWARD), PATH, keep=("doc_id", "d"), decode=True)
    assert out.count() == len(AWKWARD) and out.where("decoded is null").count() == 0
    assert out.where("doc_id = 1 and size(ids) = 0").count() == 1
    assert bpe.tokenize(odd(spark, AWKWARD).limit(0), PATH).count() == 0


def test_html_template(spark):
    from html import unescape

    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r for r in q.op2_html(spark, SF).collect()}
    for p in pages:
        body = re.search(r"<article>(.*?)(</article>|$)", p.html, re.S)[1]
        blocks = re.sub(r"<[^>]*>", " ", re.sub(r"</?(p|h1)>", "\0", body)).split("\0")
        want = "\n".join(x for x in (" ".join(unescape(b).split()) for b in blocks) if x)
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want)


def test_html_by_hand(spark):
    page = ("<html><body class=has-sidebar><header><h1>Site</h1></header><div class='menu'><a href=x>Home</a></div><div id=content><h2>Caf&eacute;</h2>"
            "<p>One, two,\n three<br>four<p>Five <a href=y>link</a>, six.<ul><li>a<li>b</ul><script>if (a < b) '</p>'</script>"
            "<div class=comments><p>Nice, post, really, yes, it is</p></div></div><div class=sidebar><p>side</p></div><form><p>Sign, up</p></form><footer>f</footer>")
    assert html.main_text(page) == "Café\nOne, two, three four\nFive link, six.\na\nb"
    assert html.main_text(None) == html.main_text("") == html.main_text("<nav>x</nav>") == "" and html.main_text("a &lt; b") == "a < b"
    deep = "<div>" * 3000 + "x, y" + "</p" + "<" * 50
    assert "x, y" in html.main_text(deep)
    out = html.extract(odd(spark, AWKWARD), html="text", keep=("doc_id", "h"))
    assert out.count() == len(AWKWARD) and out.where("text is null").count() == 0 and html.extract(odd(spark, []), html="text").count() == 0


@pytest.mark.parametrize("page", [
    '<div class="content has-sidebar">{}</div><div class=sidebar><p>side</p></div>', '<div class="overflow-hidden">{}</div>',
    '<div id="page-with-menu">{}</div>', '<article class="post ad-free">{}</article>', '<section data-title="Hidden costs">{}</section>',
    '<div data-note="so hidden" data-overflow=hidden>{}</div>', '<article><div class="article-header"><h1>Head</h1></div>{}</article>',
    '<div class="sidebar-layout">{}<div class=sidebar><p>side</p></div></div><div class=ad><p>Buy, now</p></div>',
    '<div class="promo-wrap"><article>{}<div class="related post"><p>more</p></div></article></div><div class=ad>Buy</div>',
    '<div class="comments">{}</div>'])
def test_html_names_do_not_take_the_article(page):
    text = html.main_text(f"<html><body>{page.format('<p>One, two, three, and a long story.</p><p>Four, five, six.</p>')}</body></html>")
    want = ["Head"] * ("Head" in page) + ["One, two, three, and a long story.", "Four, five, six."]
    assert text.split("\n") == want


S = "<p>Some text of a long story, told in full, and more, and more.</p>"


@pytest.mark.parametrize("page, want", [
    (f"<section>{S * 6}</section><section><h2>b</h2><p>Short one.</p></section><section><p>c, d.</p></section>", [S] * 6 + ["b", "Short one.", "c, d."]),
    (f"<h1>Head</h1><div>{S * 3}</div><p>The end.</p>", ["Head"] + [S] * 3 + ["The end."]),
    (f"<h1>Head</h1><div><div>{S * 3}</div></div>", ["Head"] + [S] * 3),
    (f"<h1>Head</h1><div><section><div>{S * 3}</div></section><section><div>{S * 2}</div></section></div>", ["Head"] + [S] * 5),
    (f"<div>Loose at first.<div>{S * 3}</div>and at last</div>", ["Loose at first."] + [S] * 3 + ["and at last"]),
    (f"<div><div class=widget>{S * 3}</div><div class=widget><p>End, of it.</p></div></div>", [S] * 3 + ["End, of it."]),
    (f"<div><div>{S * 3}</div><div><a href=x>More of that, and that.</a></div><p><a href=y>Next</a></p><div>Tags | Mail</div></div>", [S] * 3)])
def test_html_article_in_parts(page, want):
    assert html.main_text(f"<html><body>{page}</body></html>").split("\n") == [re.sub("<.*?>", "", w) for w in want]
    assert html.main_text(page).split("\n") == [re.sub("<.*?>", "", w) for w in want]

A = "<p>Some text of a long story, told in full, and more, and more.</p>" * 4
ITEM = "<div><b>Ann</b><p>I think so, too, and so does my cat, really.</p></div>"


@pytest.mark.parametrize("page, want", [
    # Readers' comments and notices that no class or id gives away.
    (f"<div><h1>Head</h1>{A}</div><section class='reader-reactions'><h2>Comments</h2>{ITEM * 3}</section>", ["Head"] + [S] * 4),
    (f"<div><h1>Head</h1>{A}</div><div id='discussion'><h3>5 Responses</h3>{ITEM * 3}</div>", ["Head"] + [S] * 4),
    (f"<div class='cc-window'><p>We keep small files to count visits.</p><button>Fine</button></div><div><h1>Head</h1>{A}</div>", ["Head"] + [S] * 4),
    (f"<div><h1>Head</h1>{A}<h3>12 comments</h3><ol><li><b>Ann</b><p>No.</p></li><li><b>Bob</b><p>Yes.</p></li></ol></div>", ["Head"] + [S] * 4),
    (f"<article><h1>Head</h1>{A}<h2>Discussion</h2>{ITEM * 4}</article>", ["Head"] + [S] * 4),
    (f"<article><h1>Head</h1>{A}</article><div class=t1><div><h4>Kommentare (2)</h4></div><div class=t2>{ITEM * 2}</div></div>", ["Head"] + [S] * 4),
    (f"<main><h1>Head</h1>{A}<section><h2>Comentarios</h2><p>Muy bien, gracias a todos.</p><p>No, no lo creo, lo siento.</p></section></main>", ["Head"] + [S] * 4),
    (f"<div>{A}</div><div><div>Get the news by mail, each day.<input name=m><button>Go</button></div></div>", [S] * 4),
    # Parts of an article that look a little like them.
    (f"<div><h1>Head</h1>{A}<h2>Discussion</h2>{A}<h2>Results</h2><p>All, of it, fits.</p></div>", ["Head"] + [S] * 4 + ["Discussion"] + [S] * 4 + ["Results", "All, of it, fits."]),
    (f"<h1>Comments</h1><div>{A}</div>", ["Comments"] + [S] * 4),
    (f"<div>{A}<h2>Comments on the law</h2>{A * 2}</div>", [S] * 4 + ["Comments on the law"] + [S] * 8),
    (f"<div>{A}<h2>Reactions</h2><p>The mayor, the council, and the press were glad.</p></div>", [S] * 4 + ["Reactions", "The mayor, the council, and the press were glad."]),
    (f"<div><h1>Head</h1><button>Listen</button>{A}</div>", ["Head"] + [S] * 4)])
def test_html_comments_and_notices_by_place(page, want):
    assert html.main_text(f"<html><body>{page}</body></html>").split("\n") == [re.sub("<.*?>", "", w) for w in want]


def test_html_many_headings_in_linear_time():
    import time

    for page in ("<h3>Comments</h3><div><p>x, y.</p></div>" * 8000, "<div><h3>Comments</h3><p>a, b.</p>" * 8000):
        began = time.time()
        html.main_text(f"<div>{A}</div>{page}")
        assert time.time() - began < 20


def test_html_names_still_mark_furniture():
    page = "<body><div><p>Short post.</p></div><div id=comments><p>{0}</p><p>{0}</p></div><div class='widget widget_text'><p>w</p></div><div class=hidden><p>h</p></div></body>"
    assert html.main_text(page.format("Long, long, comment " * 9)) == "Short post."
    assert html.main_text(f"<div><h1>Head</h1><article>{S}</article></div>").startswith("Head\n")
    assert html.main_text("<body><p>a, b</p><p HIDDEN>x</p><p style='display:none'>y</p><p a='b'hidden>z</p></body>") == "a, b"


def test_language_held_out(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = q.op5_language(spark, SF).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95 and all(0 <= r.score <= 1 for r in got)


def test_language_awkward(spark):
    known = language.prototypes(spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "el gato y la casa", "es"), (3, None, "de"), (4, "!!", "fr"), (5, "x", None)], "doc_id long, text string, lang string"))
    assert set(known) == {"en", "es"}
    out = language.identify(odd(spark, AWKWARD + [(30, "the dog"), (31, "12 !?")]), known, keep=("doc_id", "score") [:1])
    by = {r.doc_id: r for r in out.collect()}
    assert by[30].lang_pred == "en" and by[31].lang_pred == by[1].lang_pred == "und" and by[31].score == 0
    assert {r.lang_pred for r in language.identify(odd(spark, AWKWARD), {}).collect()} == {"und"}


def plain_bundle(text, space, letters, seen):
    """A text's vector by binding each n-gram's letters one by one, and adding up."""
    table, out = language._symbol_table(), np.zeros(space.size)
    symbols = [0]
    for c in (text or "").lower():
        s = int(table[ord(c)]) if ord(c) < 1 << 16 else 27 + ord(c) % (language.SYMBOLS - 27) if c.isalpha() else 0
        if s or symbols[-1]:
            symbols.append(s)
    symbols += [0] * bool(symbols[-1])
    if not any(symbols):
        return out
    for k in range(len(symbols) - space.n + 1):
        gram = tuple(symbols[k : k + space.n])
        if gram not in seen:
            v = np.ones(space.size)
            for place, s in enumerate(gram):
                v = v * np.roll(letters[s], space.n - 1 - place)
            seen[gram] = v
        out += seen[gram]
    return out / max(np.linalg.norm(out), 1e-9)


def test_language_equals_brute_force(spark):
    """The whole query against n-grams bound one by one; prototypes are sums of texts outside the held-out fold."""
    space = language.Space()
    letters = np.random.default_rng(space.seed).integers(0, 2, (language.SYMBOLS, space.size), dtype=np.int8) * 2.0 - 1
    rows, seen = spark.read.parquet(f"{SF}/documents.parquet").collect(), {}
    vec = {r.doc_id: plain_bundle(r.text, space, letters, seen) for r in rows}
    proto = {}
    for r in rows:
        if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            proto[r.lang] = proto.get(r.lang, 0) + vec[r.doc_id]
    names = sorted(proto)
    m = np.stack([proto[y] / np.linalg.norm(proto[y]) for y in names])
    for r in q.op5_language(spark, SF).collect():
        cos = m @ vec[r.doc_id]
        e = np.exp(20 * (cos - cos.max()))
        if not vec[r.doc_id].any():
            assert (r.lang_pred, r.score) == ("und", 0)
        elif np.sort(cos)[-1] - np.sort(cos)[-2] > 1e-5:
            assert r.lang_pred == names[int(cos.argmax())] and abs(r.score - e.max() / e.sum()) < 1e-3


def test_language_bundles_do_not_show_their_parts(monkeypatch):
    r = random.Random(3)
    texts = ["".join(r.choice("abc déß\n漢𝒜1") for _ in range(r.randrange(60))) for _ in range(50)] + [None, ""]
    space = language.Space(size=64)
    letters = space.letters()
    whole = space.bundle(texts, letters)
    monkeypatch.setattr(language, "GRAMS", 5)
    assert np.allclose(space.bundle(texts, letters), whole, atol=1e-5)
    assert [s.stop - s.start for s in language._chunks(["ab"] * 450)] == [200, 200, 50]
    plain = np.random.default_rng(space.seed).integers(0, 2, (language.SYMBOLS, space.size), dtype=np.int8) * 2.0 - 1
    assert np.allclose(whole, [plain_bundle(t, space, plain, {}) for t in texts], atol=1e-5)


def test_language_sample_keeps_rare_languages(spark):
    rows = [(k, "the cat and the dog", "en") for k in range(400)] + [(1000 + k, "el gato y la casa", "es") for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(language.prototypes(df, bound=20)) == {"en", "es"}
    assert language.prototypes(df.limit(0)) == {} and language.identify(df.limit(0), {}).count() == 0


def test_quality_equals_brute_force(spark):
    """The whole query against trees walked node by node, over statistics of one text at a time."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    m = q.quality_model(docs, spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality"))
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in q.op6_quality(spark, SF).collect():
        x, raw = quality.statistics(text[r.doc_id]).astype(np.float32).astype(np.float64), m.base
        for at in m.roots:
            while m.left[at] != at:
                j = m.feature[at]
                at = m.left[at] + int((m.edges[j] < x[j]).sum() > m.limit[at])
            raw += m.value[at]
        assert abs(r.score - 1 / (1 + np.exp(-raw))) < 1e-9 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert quality.score(docs.limit(0), m).count() == 0


def test_quality_held_out(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = {r.doc_id: r for r in q.op6_quality(spark, SF).collect()}
    held = [(labels[i], r.predicted) for i, r in got.items() if i in labels and r.held_out]
    assert np.mean([a == b for a, b in held]) > 0.9 and all(r.predicted == (r.score >= 0.3) for r in got.values())


def test_trees_walk_like_recursion():
    r = np.random.default_rng(0)
    x = r.normal(size=(400, len(quality.NAMES)))
    y = (x[:, 3] + x[:, 5] * x[:, 7] > 0).astype(float)
    m = quality.fit_trees(x, y, rounds=30)

    def walk(row, at):
        while m.left[at] != at:
            at = m.left[at] + int(row[m.feature[at]] > m.limit[at])
        return m.value[at]

    want = [1 / (1 + np.exp(-(m.base + sum(walk(b, t) for t in m.roots)))) for b in m.bins(x[:50])]
    assert np.allclose(m.score(x[:50]), want) and ((m.score(x) > 0.5) == y).mean() > 0.95
    for none in (quality.fit_trees(x[:0], y[:0]), quality.fit_trees(x[:1], y[:1])):
        assert np.isfinite(none.score(x[:3])).all()


def test_quality_awkward(spark):
    out = quality.score(odd(spark, AWKWARD), quality.fit_trees(np.zeros((0, len(quality.NAMES))), np.zeros(0)), keep=("doc_id", "h"), name="p")
    assert out.where("p between 0 and 1").count() == len(AWKWARD)
    assert quality.statistics(None).sum() == 0


def test_neighbours_recall(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x, ids = np.array([r.embedding for r in e], float), np.array([r.vec_id for r in e])
    norm = np.sqrt((x * x).sum(1))
    got = {}
    for r in q.op7_neighbours(spark, SF).collect():
        got.setdefault(r.query_id, {})[r.rank] = r
    hit = 0
    for k in np.flatnonzero(ids % 50 == 0):
        s = x @ x[k] / norm / norm[k]
        s[k] = -2
        near = [got[ids[k]][n] for n in range(1, 6)]
        hit += len({r.vec_id for r in near} & set(ids[np.lexsort((ids, -s))[:5]]))
        assert all(abs(r.score - s[ids == r.vec_id][0]) < 1e-12 for r in near)
    assert set(got) == set(ids[ids % 50 == 0]) and hit / (5 * len(got)) >= 0.9


def test_neighbours_ties_of_direction(spark):
    """Scaled copies tie: the smallest ids are found, in however many pieces they lie."""
    rows = [(i, [1.0 * 2.0 ** ((i * 17) % 60 - 30), 0.0, 2.0 * 2.0 ** ((i * 17) % 60 - 30)], i == 60) for i in range(1, 61)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, q boolean")
    for block in (2_000, 15):
        out = sorted((r.rank, r.vec_id) for r in neighbours.nearest(df, F.col("q"), k=3, parts=1, block=block).collect())
        assert out == [(1, 1), (2, 2), (3, 3)]


def test_neighbours_query_blocks(spark, monkeypatch):
    """Results do not show how many queries a group gets; the groups do."""
    x = np.random.default_rng(5).normal(size=(120, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    whole = sorted(tuple(r) for r in neighbours.nearest(df, F.lit(True), parts=1).collect())
    kind, keys = type(df.groupBy("vec_id")), []
    plain = kind.cogroup
    monkeypatch.setattr(kind, "cogroup", lambda self, other: keys.append(self._df.groupBy(*self._df.columns[1:]).count()) or plain(self, other))
    assert sorted(tuple(r) for r in neighbours.nearest(df, F.lit(True), parts=1, asks=10).collect()) == whole
    assert max(r["count"] for r in keys[0].collect()) < 30


def test_neighbours_awkward(spark):
    rows = [(k, [1.0, 0.0]) for k in range(8)] + [(8, [0.0, 1.0]), (8, [0.0, 1.0]), (9, [2.0, 0.0]), (10, None), (11, [0.0, 0.0]), (12, [1.0, None]), (13, [float("nan"), 1.0]),
                                                  (14, [float("inf"), 1.0]), (None, [1.0, 1.0]), (15, []), (16, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    out = neighbours.nearest(df, F.lit(True), k=3)
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got[0] == [1, 2, 3] and got[2] == [0, 1, 3] and got[9] == [0, 1, 2] and got[8] == [0, 1, 2] and not set(got) & set(range(10, 17))
    assert neighbours.nearest(df.limit(0), F.lit(True)).count() == 0


def test_balanced_parts_and_router():
    r = np.random.default_rng(0)
    centres = r.normal(size=(8, 16))
    x = np.repeat(centres, 100, axis=0) + 0.1 * r.normal(size=(800, 16))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    label = neighbours.balanced_parts(x, 8)
    assert set(np.bincount(label)) == {100}
    router = neighbours.fit_router(x, label, 8)
    assert (router.rank(x, 1)[:, 0] == label).mean() > 0.9


def test_html_wrappers_attributes_and_open_elements():
    """The article stands in a form, after an open nav, or under attributes that only look like a mark."""
    body = "".join(f"<p>This is paragraph number {k}, with some text, commas, and enough words to count as an article.</p>" for k in range(6))
    want = "\n".join(["Head", *re.findall("<p>(.*?)</p>", body)])
    menu = "<ul><li><a href=/>Home</a><li><a href=/b>Blog</a></ul>"
    article = f"<h1>Head</h1>{body}"
    for page in (f"<div title='the hidden costs of x'>{article}</div>", f"<div data-hidden='false'>{article}</div>", f"<div data-x=\"a style='display:none'\">{article}</div>",
                 f"<form action='/x'><div id=content>{article}</div><input name=q></form>", f"<form>{menu}<div>{article}</div><label>Search</label><button>Go</button></form>",
                 f"<nav>{menu}<div class=post>{article}</div>", f"<div class='post with-sharing'>{article}</div>", f"<div id='ad-hoc-networks'>{article}</div>"):
        assert html.main_text(f"<html><body>{page}</body></html>") == want, page
    side = "<form><p>Search our pages, please, with a word.</p><input></form><nav><a href=/>Home</a> and more, and more.</nav>"
    assert html.main_text(f"<body>{side}<div>{article}</div>") == want
    assert html.main_text(f"<body><div hidden>{body}</div><div><p>short visible text.</p></div>") == "short visible text."


def test_html_time_is_linear_in_nesting():
    import time

    for part in ("<div>x, y", "<section class=ad>x, y", "<ul><li>x, y", "<article>x, y", "<dl><center>x"):
        began = time.process_time()
        html.main_text(part * 16_000)
        assert time.process_time() - began < 5, part


def plain_spans(x):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m.group().split("."))]
    for kind, pattern, lo, hi in (("card", r"[0-9]([\x20-]?[0-9])+", 12, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, x):
            digits = re.sub(r"[^0-9]", "", m.group())
            if lo <= len(digits) <= hi and (kind == "phone" or pii.luhn(digits)):
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_pii_patterns(spark):
    r = random.Random(1)
    for _ in range(20000):
        x = "".join(r.choice("aB@@..--+%_ 0123 45(6)7é\n") for _ in range(r.randrange(50)))
        assert pii.base_spans(x) == plain_spans(x)
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = q.op10_pii(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for row in rows:
        base = plain_spans(docs[row.doc_id])
        assert row.base_sha256 == sha(pii.written(base)) and {pii.written([b]) for b in base} <= set(row.spans.split(","))
        assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == tuple(sum(b[0] == k for b in base) for k in pii.KINDS)


def test_field_learns_and_decodes():
    texts = [f"write to user{k}@mail.example.org or call +1 (555) 555-{1000 + k} now, room {k}" for k in range(60)]
    seqs, labels = [], []
    for x in texts:
        for w in pii.stretches(x):
            lab = np.zeros(len(w), np.int8)
            for kind, a, b in pii.base_spans(x):
                for k, (lo, hi) in enumerate(w):
                    lab[k] = pii.LABELS.index(kind) if lo < b and a < hi else lab[k]
            seqs.append(pii.features(x, w))
            labels.append(lab)
    field = pii.fit_field(seqs[:40], labels[:40])
    got = field.viterbi(seqs[40:])
    assert np.mean([np.array_equal(a, b) for a, b in zip(got, labels[40:])]) > 0.9
    # Viterbi's path is the best of all paths.
    from itertools import product

    ids = seqs[0][:4]
    e = field.emit[ids].sum(axis=1)
    best = max(product(range(len(pii.LABELS)), repeat=4), key=lambda p: sum(e[k, c] for k, c in enumerate(p)) + sum(field.move[a, b] for a, b in zip(p, p[1:])))
    assert list(field.viterbi([ids])[0]) == list(best)


def test_field_goes_beyond_the_patterns():
    """Held-out sentences with other values and contexts, and the forms that the patterns miss."""
    field = pii.train(pii_examples.table())
    held = pii_examples.table(500, seed=77)
    texts = [x for x, _ in held]
    want = [{(k, *pii._trim(x, a, b, k)) for k, a, b in spans} for x, spans in held]
    got = [set(s) for s in pii.added_spans(texts, [[] for _ in texts], field)]
    hits = sum(len(a & b) for a, b in zip(want, got))
    assert hits >= 0.93 * sum(map(len, want)) and hits >= 0.97 * sum(map(len, got))
    for x, kind in [('die token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" und', "secret"), ("call me (555) 555-1234 today", "phone"),
                    ("write to jane dot doe at example dot com please", "email"), ("from 2001:db8:1f::77:9c the host", "ip"), ("set password=b7db7aa4a5fcc78305 for it", "secret")]:
        assert [s[0] for s in pii.added_spans([x], [pii.base_spans(x)], field)[0]] == [kind], x
    for x in ["Licensed under CC BY-NC 4.0. the", "the General Public License, version 3.", "in 1984 about 12,345,678 people", "the token of 5 days"]:
        assert pii.added_spans([x], [[]], field) == [[]], x


def test_long_stretches_are_decoded_as_short_ones(monkeypatch):
    field = pii.train(pii_examples.table(300))
    text = " ".join(x for x, _ in pii_examples.table(120, seed=8)).replace(" a ", " 7 ")
    whole = pii.added_spans([text], [[]], field)
    monkeypatch.setattr(pii, "LONG", 1)
    monkeypatch.setattr(pii, "PART", 3)
    assert pii.added_spans([text], [[]], field) == whole and whole[0]
    words = [w for s in pii.stretches(text) for w in s]
    assert len(set(words)) == len(words) and set(words) <= {m.span() for m in re.finditer(r"\S+", text)}
    near = [m.span() for m in re.finditer(r"\S+", text)]
    for k, (a, b) in enumerate(near):
        if re.search("[0-9@]", text[a:b]):
            assert set(near[max(0, k - pii.REACH) : k + pii.REACH + 1]) <= set(words)


def test_pii_awkward(spark):
    field = pii.train(pii_examples.table(100))
    assert pii.train([]).emit.any() == False  # noqa: E712
    out = pii.find(odd(spark, AWKWARD + [(40, "9" * 30000), (41, "a" * 50000 + "@"), (42, "+1 (499) 555-6503"), (43, 'the token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" from 10.1.2.3')]),
                   pii.train(pii_examples.table()), keep=("doc_id", "d"))
    assert [s.kind for s in out.where("doc_id = 43").first().spans] == ["secret", "ip"]
    assert out.count() == len(AWKWARD) + 4 and out.where("size(spans) < size(base)").count() == 0
    assert out.where("doc_id = 42").first().base[0].kind == "phone" and pii.find(odd(spark, []), field).count() == 0


def test_pipeline_stages(spark):
    """Each stage against a plain version of its decision on its own input."""
    from .test_text_ops import components, drop_lines, hits

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    assert [n for n, _ in cp.STAGES] == ["quality", "line_dedup", "near_copies", "decontamination", "bpe"]
    stages = dict(cp.STAGES)
    rows = {r.doc_id: r for r in docs.collect()}
    good = {r.doc_id for r in q.op6_quality(spark, SF).where("predicted = 1").collect()}
    one = stages["quality"](spark, docs, SF)
    assert one.columns == names and {r.doc_id for r in one.collect()} == good
    two = stages["line_dedup"](spark, cp.materialize(one, "t"), SF).cache()
    want = {i: h for i, _, _, h in drop_lines([(i, rows[i].text) for i in good], 10, 1)}
    assert two.columns == names and {r.doc_id: sha(r.text) for r in two.collect()} == want
    assert two.where("n_chars != length(text)").count() == 0
    three = stages["near_copies"](spark, two, SF).cache()
    base = sorted((r.doc_id, r.text) for r in two.collect())
    assert {r.doc_id for r in three.collect()} == {i for i, n, c in components(base) if c == i}
    four = stages["decontamination"](spark, three, SF)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = sorted((r.doc_id, r.text) for r in three.collect())
    clean = {i for i, n, h, _ in hits(left, items) if not (h > 0 and 20 * h >= n)}
    assert four.columns == names and {r.doc_id for r in four.collect()} == clean
    assert {r.doc_id for r in cp.run(spark, SF).collect()} == clean


def test_pipeline_stages_on_awkward_rows(spark, tmp_path):
    """Nulls in any column, empty and repeated rows, other columns: each stage keeps its columns and its defined rows; empty tables stay empty."""
    rows = [*AWKWARD, (None, None), (60, "z " * 3000)]
    docs = odd(spark, rows).withColumn("n_chars", F.length("text").cast("long")).withColumn("quality_score", F.lit(None).cast("string"))
    spark.createDataFrame([(1, 1, 0), (None, 0, 0), (3, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "a b c d e f g h i j k l m n"), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(cp.STAGES)
    assert set(stages["quality"](spark, docs, str(tmp_path)).columns) == set(docs.columns)
    two = stages["line_dedup"](spark, docs, str(tmp_path))
    assert two.columns == docs.columns and two.count() == len(rows)
    three = stages["near_copies"](spark, docs, str(tmp_path))
    kept = sorted(str(r.doc_id) for r in three.collect())
    # Rows without a word all stay, repeated ones too; (5, one) is a copy of 4.
    assert three.columns == docs.columns and kept == sorted(["None", "None", "None", "1", "2", "3", "4", "6", "8", "9", "60"])
    four = stages["decontamination"](spark, docs, str(tmp_path))
    assert four.columns == docs.columns and {None, 1, 2, 3, 4, 5} <= {r.doc_id for r in four.collect()}
    assert stages["bpe"](spark, docs, str(tmp_path)).count() == len(rows)
    for stage in stages.values():
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_kept_columns_that_clash(spark):
    """A kept column with the name of one that is added raises; a table's own counts of lines go through the pipeline's stage as they are."""
    import corpus_pipeline

    df = spark.createDataFrame([(1, "a b", 7, "x")], "doc_id long, text string, n_lines long, SCORE string").withColumns({c: F.lit(1) for c in ("ids", "lang_pred", "spans", "decoded")})
    for run in (lambda: bpe.tokenize(df, q.vocabulary(), keep=("ids",)), lambda: bpe.tokenize(df, q.vocabulary(), keep=("decoded",), decode=True), lambda: language.identify(df, {}, keep=("SCORE",)),
                lambda: html.extract(df, html="SCORE", keep=("text",)), lambda: pii.find(df, None, keep=("spans",)), lambda: quality.score(df, None, keep=("SCORE",))):
        with pytest.raises(ValueError, match="twice"):
            run()
    out = corpus_pipeline.dedup_lines(spark, df, SF)
    assert out.columns == [*df.columns, "n_chars"] and out.first().n_lines == 7


def test_encoder_after_an_error():
    """A text that breaks off leaves nothing behind for the next one."""
    encoder, _ = bpe.coder(q.vocabulary())
    whole = encoder.encode("some words, and more")
    with pytest.raises(TypeError):
        encoder.encode(["half a text ", None], 1)
    assert encoder.encode("some words, and more") == whole
