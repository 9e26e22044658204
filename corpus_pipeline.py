"""Corpus pipeline: five stages over `documents`, each written and read again by the caller or chained by run().

Language ID and toxicity drop the documents that they reject, the n-gram join
keeps one document of each group, substring dedup cuts passages that another
document keeps, and packing returns the pieces of what is left. All but the last stage
return the columns that they were given.

Rows with a null doc_id pass every filter that works by id; rows that repeat a doc_id are kept or dropped together. Null and
empty texts are rejected by language ID. Empty tables pass through empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import durable, fresh_name, measured, small, small_batches, table
from tracemill.llm.op02_packing import pack
from tracemill.llm.op04_substring_dedup import passages, remove_passages
from tracemill.llm.op05_ngram_jaccard_join import jaccard_classes
from tracemill.llm.op08_language_id import document_evidence, identify, train_trigrams
from tracemill.llm.op10_toxicity import clean, train


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs whose doc_id is not among ids (doc_id); a null doc_id stays."""
    name = fresh_name(docs, "gone")
    gone, count = measured(ids.select(F.col("doc_id").alias(name)).filter(F.col(name).isNotNull()).distinct())
    return docs.join(small(gone, count.rows), F.col("doc_id") == F.col(name), "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: drops documents whose language is unknown or unsure.

    Null and empty texts, and texts without letters, go; a null doc_id stays; rows that repeat a doc_id go together if one of
    them is rejected. All columns are kept as they are; an empty table stays empty.
    """
    small_batches(spark, 300)
    found = identify(document_evidence(docs), train_trigrams(docs))
    return without(docs, found.filter("rejected"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10, fitted on these documents and the labels: drops texts that score 0.5 or more.

    Every row is judged by its own text, whatever its id; null and empty texts stay. All columns are kept as
    they are; an empty table stays empty, and without labels nothing goes.
    """
    small_batches(spark, 300)
    return clean(docs, train(docs, table(spark, sf_dir, "labels")))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: keeps the document of least id of each group of near copies.

    Rows that repeat a doc_id are one document, kept or dropped together; null ids and null or empty texts stay. All columns are kept
    as they are; an empty table stays empty.
    """
    small_batches(spark, 300)
    classes = jaccard_classes(docs)
    return without(docs, classes.filter(F.col("component_id") != F.col("doc_id")))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: cuts passages of 50 words or more that a document standing for them keeps; no row goes.

    n_chars, where it is a column, is counted anew; other columns are kept as they are. Null texts and null ids stay as they
    are; rows that repeat a doc_id lose the same word places. An empty table stays empty.
    """
    small_batches(spark, 300)
    out = remove_passages(docs, durable(passages(docs)))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: the pieces of every row's text. Null and empty texts are one end id; rows that repeat are packed each; an empty table gives none."""
    small_batches(spark, 300)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxicity),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

#: Models, tokenizers and near-duplicate passages are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order. Between them the rows go through the checkpoint folder, as if written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = durable(docs)
    return docs
