"""A training-data pipeline of five stages over the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duosignal.llm.mixing import label_domains, mixed_documents
from duosignal.llm.ngram_jaccard import ngram_jaccard
from duosignal.llm.packing import pack
from duosignal.llm.quality import keep_good
from duosignal.llm.shared import discard, free_names, stored, table
from duosignal.llm.suffix_dedup import without_repeats

#: Weights of the domains' tokens after mixing. The high domain is used up; where another has fewer than its weight
#: asks for, all of it stays.
TARGETS = {"high": 0.97, "low": 0.02, "toxic": 0.01}

#: Packing and mixing can't be written as SQL over the tables.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the outlier test keep; null and wordless texts go."""
    return keep_good(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group that 5-word shingles link at 0.8.

    Rows of one doc_id count as one document; equal ones of these stay once. A text without words
    is a group of its own, so it stays.
    """
    (name,) = free_names(docs, "first")
    first = ngram_jaccard(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(first, docs.doc_id.eqNullSafe(F.col(name)), "left_semi").dropDuplicates(["doc_id", "text"])


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without strings of 200 bytes that stand elsewhere too; cut characters stay.

    Every row stays, if with an empty text.
    """
    return without_repeats(docs)


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents thinned so that the expected tokens of the domains of the labels table meet TARGETS.

    None repeats. Rates round up or down by a hash of the row, so equal rows stay or go together;
    labels of documents that are gone count nowhere. Texts without tokens weigh nothing and stay as
    their posteriors say.
    """
    return mixed_documents(docs, label_domains(table(spark, sf_dir, "labels")), TARGETS, size="high", most=1.0)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their places in sequences of 1024 tokens; empty texts are one token."""
    return pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", one_of_each_group),
    ("suffix-array dedup", without_repeated_passages),
    ("mixing to target weights", to_target_weights),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents table, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, stored(stage(spark, docs, sf_dir), "stage")
        if i:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
