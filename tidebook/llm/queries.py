"""One query for each operator, over whole tables, with production parameters."""

from __future__ import annotations

import hashlib
import os
import sys

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, contamination, html, jaccard, language, lexical, lines, neighbours, pii, pii_examples, quality, spelling, suffixes, urls
from .common import read_table


def vocabulary() -> str:
    """The vocabulary file: TIDEBOOK_VOCABULARY, else the installed public one."""
    if "TIDEBOOK_VOCABULARY" in os.environ:
        return os.environ["TIDEBOOK_VOCABULARY"]
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def token_digests(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, and digests of its ids and of their decoded text."""
    def digest(pdf: pd.DataFrame) -> pd.DataFrame:
        little = sys.byteorder == "little"
        for ids in pdf["ids"] if not little else ():
            ids.byteswap()
        data = [i.tobytes() for i in pdf["ids"]]
        return pd.DataFrame({
            "doc_id": pdf["doc_id"].astype("Int64"), "n_tokens": [len(d) // 4 for d in data],
            "ids_sha256": [_hex(d) for d in data], "decoded_sha256": [_hex(t.encode()) for t in pdf["decoded"]]})

    return bpe.tokenize(docs, vocabulary(), keep=("doc_id",), decode=True, finish=digest,
                        schema="doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text and what they decode to, as digests. A null text counts as empty; repeated rows are repeated; other columns are not read."""
    return token_digests(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page. Null and empty pages, and pages with nothing but furniture, have an empty text; ids may be null or repeat."""
    pages = html.extract(read_table(spark, sf_dir, "pages", "page_id", "url", "html"), keep=("page_id", "url"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near copies. Null and empty texts have an empty set and stand alone; repeated rows get equal results; a null id counts as the smallest."""
    groups = jaccard.jaccard_groups(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    return groups.select(F.col("d").alias("doc_id"), "n_shingles", "component_id")


def op4_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document. Null and empty texts have no words and no hits; rows equal in id and text are one; null items are in no list."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    found = contamination.contamination(docs, read_table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select(
        F.col("d").alias("doc_id"), "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.expr("n_hit > 0 and 20 * n_hit >= n_words")).alias("contaminated"))


def _remainder(doc_id: str, n: int) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(n))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text. A null text, one without a letter, and all of them without a learned language, are und with score 0; a null id is in no held-out fold."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    known = language.prototypes(docs.where(_remainder("doc_id", 4) != 2))
    found = language.identify(docs, known, keep=("doc_id",))
    return found.select("doc_id", F.coalesce(_remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


#: Labelled rows that the quality classifier is fitted on, about.
QUALITY_ROWS = 20_000


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.Trees:
    """Trees fitted to labels outside the held-out fold; the labels are sampled before they meet any text."""
    known = labels.where((_remainder("doc_id", 5) != 0) & F.col("quality").isNotNull()).select("doc_id", F.col("quality").alias("label"))
    known = quality.sample_rows(known, F.col("doc_id"), QUALITY_ROWS)
    return quality.fit(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"), bound=QUALITY_ROWS)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text. Null and empty texts have zero statistics; without labels every score is one half; a null id is in no held-out fold."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    model = quality_model(docs, read_table(spark, sf_dir, "labels", "doc_id", "quality"))
    scored = quality.score(docs, model, keep=("doc_id",))
    return scored.select("doc_id", F.coalesce(_remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth. Unusable vectors and null ids take no part, repeated rows count once, ties go to the smaller id."""
    return neighbours.nearest(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 50 == 0, k=5)


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more have go. A null or empty text is one empty line, which stays; repeated rows, and rows with a null id, count as one document."""
    kept = lines.dedup_lines(read_table(spark, sf_dir, "documents", "doc_id", "text"), min_docs=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes in 50-byte strings of an earlier document go. A null text is empty; a null id counts as the smallest; rows of one id take nothing from each other."""
    def digest(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({
            "doc_id": pdf["doc_id"], "n_bytes": pdf["n_bytes"], "n_removed": [sum(s["end"] - s["start"] for s in x) for x in pdf["spans"]],
            "n_spans": [len(x) for x in pdf["spans"]], "kept_sha256": [_hex(x) for x in pdf["kept"]]})

    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return suffixes.remove_repeats(docs, finish=digest, schema="doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in whole texts of documents: what patterns find, and beside it what a field trained on a small labelled table adds.

    Null and empty texts have no spans; rows may repeat. n_secret and n_spans count secrets, which no pattern finds, and all spans.
    """
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    found = pii.find(docs, pii.train(pii_examples.table()), keep=("doc_id",))

    def written(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select("doc_id", *[_of_kind(k) for k in pii.KINDS], F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"),
                        _of_kind("secret", "spans"), F.size("spans").cast("long").alias("n_spans"))


def _of_kind(kind: str, among: str = "base") -> Column:
    return F.size(F.filter(among, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


#: The rules of the URL filter (allow, host, path).
URL_RULES = [(True, "org", "/"), (False, "example.org", "/es/"), (False, "example.org", "/en/1"), (True, "com", "/fr/"), (False, "com", "/de/")]


def op11_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's URL: the longest rule's, else the character models'. A null URL is judged as an empty one; equal URLs get equal verdicts, repeated rows are repeated."""
    judged = urls.judge(read_table(spark, sf_dir, "pages", "page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


#: Letters of words, and one run in so many that loses a letter.
LETTERS, ONE_IN = r"[A-Za-z\u00C0-\u00FF]", 199


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among all words of documents. Null and empty texts have no words; repeated rows count each; a null id is written as nothing in a run's number."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    words = spelling.runs(docs, LETTERS, least=6).select(spelling.without(F.col("run"), h, ONE_IN).alias("word"))
    counts = words.where(F.length("word") >= 6).groupBy("word").agg(F.count("*").alias("n")).where("n >= 5")
    return spelling.variants(counts, ratio=5)


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for each benchmark item. Null texts and items without a term have no rows; each row of documents is a document of its own; a null doc_id counts as the largest."""
    docs, items = read_table(spark, sf_dir, "documents", "doc_id", "text"), read_table(spark, sf_dir, "benchmark", "item_id", "text")
    return lexical.search(docs, items, k=20)


def queries() -> dict:
    return {"op1_bpe": op1_bpe, "op2_html": op2_html, "op3_jaccard": op3_jaccard, "op4_contamination": op4_contamination,
            "op5_language": op5_language, "op6_quality": op6_quality, "op7_neighbours": op7_neighbours, "op8_lines": op8_lines,
            "op9_suffixes": op9_suffixes, "op10_pii": op10_pii, "op11_urls": op11_urls, "op12_spelling": op12_spelling, "op13_lexical": op13_lexical}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + ", '[0-9a-z\\x{80}-\\x{10FFFF}]+')"

CONTAMINATION_SQL = f"""WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents), iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, i + 1, i + 13), ' ') AS win, least(len(w), 13) AS n
  FROM (SELECT *, unnest(range(greatest(len(w) - 12, 1))) AS i FROM iw WHERE len(w) > 0)),
dwin AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i + 1, i + n), ' ') AS win
  FROM (SELECT *, unnest(range(greatest(len(w) - n + 1, 0))) AS i FROM dw, (SELECT DISTINCT n FROM win))),
h AS (SELECT DISTINCT doc_id, i, n, item_id FROM dwin JOIN win USING (win, n)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM dw LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""

LINES_SQL = f"""WITH l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
gone AS (SELECT key FROM k WHERE key != '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(g.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (g.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN gone g USING (key) GROUP BY doc_id"""

SUFFIXES_SQL = """WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, length(hex(encode(coalesce(text, '')))) // 2 AS n FROM documents),
s AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS g FROM (SELECT *, unnest(range(greatest(n - 49, 0))) AS i FROM b)),
m AS (SELECT g, min(doc_id) AS d FROM s GROUP BY g),
r AS (SELECT s.doc_id, i FROM s JOIN m USING (g) WHERE s.doc_id > m.d),
o AS (SELECT *, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 50, true) AS new FROM r),
u AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o),
p AS (SELECT doc_id, run, min(i) AS lo, max(i) + 50 AS hi FROM u GROUP BY ALL),
q AS (SELECT doc_id, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS before FROM p),
k AS (SELECT doc_id, count(*) AS spans, sum(hi - lo) AS removed, string_agg(substr(x, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS head, max(hi) AS last
  FROM q JOIN b USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN spans IS NULL THEN x ELSE head || substr(x, 2 * last + 1) END)) AS kept_sha256 FROM b LEFT JOIN k USING (doc_id)"""




def _crc32(x: str) -> str:
    """crc32 of a string's UTF-8 bytes in SQL, bit by bit."""
    one = f"('0x' || substr(hex(encode({x})), 2 * i + 1, 2))::BIGINT"
    bits = f"flatten(list_transform(range(octet_length(encode({x}))), lambda i: [{one}, 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"


def _urls_sql(order: int = 4, least: int = 4) -> str:
    """The URL filter in SQL: a step for each order of the two models, then scores, threshold and verdicts."""
    fits = [(f"(host = '{h}' OR suffix(host, '.{h}')) AND prefix(path, '{p}')", h + p, ok) for ok, h, p in sorted(URL_RULES, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0]))]
    rule, allow = (f"CASE {' '.join(f'WHEN {f} THEN {v}' for f, v in x)} END" for x in ([(f, f"'{n}'") for f, n, _ in fits], [(f, str(ok)) for f, _, ok in fits]))
    parts = [f"""u0 AS (SELECT DISTINCT coalesce(url, '') AS x FROM pages),
u1 AS (SELECT x, CASE WHEN instr(x, '://') > 0 THEN substr(x, instr(x, '://') + 3) ELSE '' END AS rest FROM u0),
u2 AS (SELECT x, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u1),
u AS (SELECT *, {rule} AS rule, {allow} AS allow, {_crc32("x")} % {urls.FOLDS} = 0 AS held FROM u2),
places AS (SELECT x, allow, held, substr(repeat(chr(2), {order}) || x || chr(3), i, {order + 1}) AS gram FROM (SELECT *, unnest(range(1, length(x) + 2)) AS i FROM u)),
counts AS (SELECT gram, count(*) FILTER (allow AND NOT held) AS good, count(*) FILTER (NOT allow AND NOT held) AS bad FROM places GROUP BY 1)"""]
    for k in range(order + 1):
        sums = ", ".join(f"sum({c}) OVER w AS {c}_all, sum(({c} > 0)::INT) OVER w AS {c}_kinds" for c in ("good", "bad"))
        parts.append(f"l{k} AS (SELECT *, {sums} FROM (SELECT substr(gram, {order + 1 - k}) AS g, sum(good) AS good, sum(bad) AS bad FROM counts GROUP BY 1) WINDOW w AS (PARTITION BY substr(g, 1, {k})))")
        below = {c: f"p.p_{c}" if k else "(1.0::DOUBLE / 256)" for c in ("good", "bad")}
        mixed = ", ".join(f"CASE WHEN {c}_all >= {least if k else 1} THEN ({c} + {c}_kinds * {below[c]})::DOUBLE / ({c}_all + {c}_kinds) ELSE {below[c]} END AS p_{c}" for c in ("good", "bad"))
        parts.append(f"p{k} AS (SELECT l.g, {mixed} FROM l{k} l" + (f" JOIN p{k - 1} p ON substr(l.g, 2) = p.g)" if k else ")"))
    parts.append(f"""llr AS (SELECT g AS gram, floor(ln(p_good) * 1000000)::BIGINT - floor(ln(p_bad) * 1000000)::BIGINT AS llr FROM p{order}),
scored AS (SELECT x, greatest(least(floor(sum(llr) / (count(*) * {urls.STEP}.0::DOUBLE)), {urls.STEPS}), -{urls.STEPS})::BIGINT AS step FROM places JOIN llr USING (gram) GROUP BY x),
held AS (SELECT step, count(*) FILTER (allow) AS good, count(*) FILTER (NOT allow) AS bad FROM u JOIN scored USING (x) WHERE held AND allow IS NOT NULL GROUP BY 1),
ends AS (SELECT * FROM held UNION ALL SELECT {urls.STEPS + 1}, 0, 0),
errors AS (SELECT greatest(least(0, step), lag(step, 1, -{urls.STEPS + 1}) OVER (ORDER BY step) + 1) AS t, coalesce(sum(good) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * (SELECT sum(bad) FROM held)
  + sum(bad) OVER (ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) * (SELECT sum(good) FROM held) AS error FROM ends),
threshold AS (SELECT coalesce((SELECT t FROM errors WHERE (SELECT sum(good) > 0 AND sum(bad) > 0 FROM held) ORDER BY error, abs(t), t LIMIT 1), 0) AS t)
SELECT page_id, u.host, u.path, u.rule, CASE WHEN coalesce(u.allow, step >= t) THEN 'allow' ELSE 'block' END AS verdict
FROM pages JOIN u ON coalesce(url, '') = u.x JOIN scored USING (x), threshold""")
    return "WITH " + ",\n".join(parts)


SPELLING_SQL = f"""WITH r AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
c AS (SELECT *, count(*) AS k FROM r WHERE length(run) >= 6 GROUP BY ALL),
h AS (SELECT run, k, {_crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM c),
v AS (SELECT CASE WHEN h % {ONE_IN} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM h),
w AS (SELECT word, sum(k)::BIGINT AS n FROM v WHERE length(word) >= 6 GROUP BY 1 HAVING sum(k) >= 5),
cut AS (SELECT word, n, i, substr(word, 1, i) AS a, substr(word, i + 2) AS b FROM (SELECT *, unnest(range(length(word))) AS i FROM w)),
near AS (SELECT DISTINCT x.word, x.n, y.word AS other, y.n AS m FROM cut x JOIN cut y USING (a, b) WHERE x.word != y.word
  UNION SELECT x.word, x.n, y.word, y.n FROM cut x JOIN w y ON y.word = x.a || x.b
  UNION SELECT y.word, y.n, x.word, x.n FROM cut x JOIN w y ON y.word = x.a || x.b),
best AS (SELECT word, n, count(*) AS n_near, max(m) AS m, min(other) FILTER (m = top) AS other FROM (SELECT *, max(m) OVER (PARTITION BY word) AS top FROM near) GROUP BY ALL),
f AS (SELECT word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * w.n THEN other END AS form, CASE WHEN m >= 5 * w.n THEN m END AS form_n FROM w LEFT JOIN best USING (word)),
walk AS (WITH RECURSIVE s AS (SELECT word, word AS last, 0 AS k FROM f UNION ALL SELECT s.word, f.form, k + 1 FROM s JOIN f ON f.word = s.last WHERE f.form IS NOT NULL) SELECT word, max_by(last, k) AS root FROM s GROUP BY 1)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n FROM f JOIN walk USING (word)"""

_TERMS = "regexp_extract_all(" + _LOWER.format("text") + ", '[0-9a-z\\x{80}-\\x{10FFFF}]+')"

LEXICAL_SQL = f"""WITH d AS (SELECT * FROM (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents WHERE text IS NOT NULL) WHERE len(w) > 0),
s AS (SELECT count(*)::BIGINT AS docs, sum(len(w))::BIGINT AS terms FROM d),
i AS (SELECT *, row_number() OVER () AS item FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
q AS (SELECT item, t, count(*) AS c FROM (SELECT item, unnest({_TERMS}) AS t FROM i) GROUP BY ALL),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) SEMI JOIN q USING (t) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY t, docs),
m AS (SELECT r, doc_id, 75 + (25 * len(w)::BIGINT * docs) // terms AS m FROM d, s),
score AS (SELECT item, r, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM q JOIN tf USING (t) JOIN w USING (t) JOIN m USING (r) GROUP BY ALL),
best AS (SELECT item, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM score JOIN m USING (r) WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM best JOIN i USING (item) WHERE rank <= 20"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the result; the other operators are tested against brute force."""
    return {"op4_contamination": CONTAMINATION_SQL, "op8_lines": LINES_SQL, "op9_suffixes": SUFFIXES_SQL,
            "op11_urls": _urls_sql(), "op12_spelling": SPELLING_SQL, "op13_lexical": LEXICAL_SQL}
