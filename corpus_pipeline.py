"""Corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all
that its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from keyloom.llm import decontaminate, lines, neardocs, packing, quality
from keyloom.llm.common import bound_batches, materialize, quoted, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned list pass; the list is learned from ``labels``.

    Null and empty texts go. Repeated rows share their verdict.
    """
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, rules).where(F.col(quality.added(docs.columns)[1])).select(*quoted(docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand in an earlier place; one that loses all its lines goes.

    ``n_chars``, where present, counts the new text. Null and empty texts stay,
    and so do blank lines of texts that keep another; rows that repeat a doc_id
    and text lose the same lines.
    """
    bound_batches(spark)
    _, removed = lines.added(docs.columns)
    found = lines.dedup_lines(docs).where((F.col(removed) == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        found = found.withColumn("n_chars", F.when(F.col(removed) == 0, F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return found.select(*quoted(docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at a Jaccard similarity of 0.8 or more of five-word shingles: the smallest doc_id.

    Candidates are what SimHash fingerprints find by deletion variants, and what
    MinHash bands add where linked texts differ in more bits than those reach;
    both are verified. Null and wordless texts are one group; rows that repeat a
    doc_id and text are one document.
    """
    bound_batches(spark)
    return neardocs.keep_one(docs, shingle=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``; null and empty texts hold none, and rows that repeat one stay repeated."""
    bound_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens; a null or empty text is its closing token alone."""
    bound_batches(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Tokenizing and similarity joins are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return materialize(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
