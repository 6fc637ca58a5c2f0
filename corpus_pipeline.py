"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns a frame.

The first four return the columns of documents: rows that the quality classifier rejects go,
one document of each near-duplicate group stays, documents with benchmark passages go, and
secrets are masked.  The last encodes what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.llm.bpe import bpe_round_trip, digests
from eventlens.llm.common import Scratch, table
from eventlens.llm.decontaminate import contaminated_words
from eventlens.llm.ngram_jaccard import jaccard_components
from eventlens.llm.quality import score_quality, train_quality
from eventlens.llm.secret_scan import examples, fit_grammar, redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels outside the held-out fold, finds good."""
    model = train_quality(docs, table(spark, sf_dir, "labels"))
    return docs.where(score_quality("text", model) >= 0.5)


def spare(docs: DataFrame) -> str:
    """A column name that the documents don't have."""
    name = "_row"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at 0.8 or more: that of smallest doc_id.

    A null doc_id comes after all others.  Rows that share a doc_id, or have none, are rows of
    their own: they are numbered first, and of equal ones the first stays.
    """
    odd = docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1")
    if not odd.limit(1).count():
        groups = jaccard_components(docs.select("doc_id", "text"), width=5, percent=80)
        return docs.join(groups.where("component_id = doc_id").select("doc_id"), "doc_id", "left_semi")
    row = spare(docs)
    keyed = Scratch(spark, "numbered").keep(docs.withColumn(row, F.monotonically_increasing_id()))
    groups = jaccard_components(keyed.select(row, "text"), key=row, width=5, percent=80).select(row, "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", row)
    kept = keyed.select(row, "doc_id").join(groups, row).groupBy("component_id").agg(F.min(order).alias("least")).select(f"least.{row}")
    return keyed.join(kept, row, "left_semi").drop(row)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of any benchmark item; each row's own text decides, whatever its doc_id."""
    row = spare(docs)
    keyed = docs.withColumn(row, F.struct("doc_id", F.xxhash64("text").alias("h")))
    found = contaminated_words(keyed.select(row, "text"), table(spark, sf_dir, "benchmark"), key=row)
    return keyed.join(found.where("n_hit > 0").select(row).distinct(), row, "left_anti").drop(row)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars counted again."""
    masked = docs.withColumn("text", redact_secrets("text", fit_grammar(examples(docs))))
    return masked.withColumn("n_chars", F.length("text").cast("long"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their number, and digests of ids and decoded text."""
    coded = bpe_round_trip(docs.select("doc_id", "text"))
    return digests(coded)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("encoding", encoding),
]

#: Training, grammar inference and tokenization are no SQL: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again."""
    scratch, kept = Scratch(spark, "pipeline"), None
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, kept = kept, scratch.keep(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
