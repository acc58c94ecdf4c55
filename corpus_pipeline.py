"""The corpus pipeline: stages over the table documents, each written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm import contamination, jaccard, lines, quality
from tidebook.llm import queries as q
from tidebook.llm.common import materialize, read_table, unused

#: Documents that score less are rejected.
QUALITY = 0.3


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose quality score is QUALITY at least.

    A null or empty text is scored as such; null ids are never labelled; repeated rows get the same score.
    """
    model = q.quality_model(docs, read_table(spark, sf_dir, "labels", "doc_id", "quality"))
    (score,) = unused(docs, "quality_score")
    return quality.score(docs, model, keep=tuple(docs.columns), name=score).where(F.col(score) >= QUALITY).drop(score)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that ten documents or more have; n_chars follows the text.

    No document goes; a null or empty text has no line that could. Repeated rows, and rows with a null id, count as one document.
    """
    # A table's own columns of these names are kept under others while the operator adds its counts.
    own = [c for c in docs.columns if c.lower() in ("n_lines", "n_dropped")]
    aside = dict(zip(own, unused(docs, *own)))
    kept = lines.dedup_lines(docs.withColumnsRenamed(aside), min_docs=10).drop("n_lines", "n_dropped").withColumnsRenamed({n: c for c, n in aside.items()}).select(*docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast("long"))


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one with the smallest id, of each group of near copies.

    Documents without a word, as null and empty texts, all stay. A row repeated with its id is a copy, so one stays at most; a null id counts as the smallest.
    """
    return jaccard.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of whose words one in twenty at least lies in a benchmark window.

    Null and empty texts have no words and stay; repeated rows stay or go together; null ids are judged like others.
    """
    return contamination.clean(docs, read_table(spark, sf_dir, "benchmark", "item_id", "text"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document kept; a null text counts as empty, and repeated rows are repeated."""
    return q.token_digests(docs)


STAGES = [
    ("quality", classify_quality),
    ("line_dedup", dedup_lines),
    ("near_copies", join_near_copies),
    ("decontamination", decontaminate),
    ("bpe", encode),
]
#: The first stage is a trained model, which SQL cannot express; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
