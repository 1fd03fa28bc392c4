"""From raw documents to token ids: quality, near-duplicates, secrets, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last keep the columns of
documents. run() writes each stage's result as Parquet to shared storage and reads it back as
the next one's input, so a lost executor never costs more than a stage's own tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.llm import jaccard, mixing, pieces, quality, secrets, simhash
from loomdex.llm.common import forget, release, shared_dir, stored, table


def _recounted(docs: DataFrame, like: DataFrame) -> DataFrame:
    """docs with n_chars of the text as it is now, where documents have that column."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(like.schema["n_chars"].dataType))
    return docs.select(*like.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: those that operator 4 links, and those of a similarity of 0.8 in 5-word shingles."""
    return simhash.one_of_each(docs, groups=jaccard.near_duplicates)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced."""
    return _recounted(secrets.redact(secrets.scan_secrets(docs)), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return _recounted(mixing.mixed(docs), docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids) of each row."""
    return pieces.encode(docs.select("doc_id", "source", "text"), keep_text=False).select("doc_id", "source", F.size("ids").alias("n_tokens"), "ids")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("sentencepiece", sentencepiece),
]

#: A trained classifier, XXH64 and merges by rank can't be written in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's table is deleted once the next is written, the last one when the driver ends."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = shared_dir(spark)
        docs = stored(stage(spark, docs, sf_dir), path)
        if before:
            forget(spark, before)
        before = path
        release(spark)  # the next stage, or the session's next query, finds small heaps
    return docs
