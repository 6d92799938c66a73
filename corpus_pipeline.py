"""The corpus pipeline: five stages over ``documents``.

quality classifier -> exact dedup -> near-duplicate dedup -> repeated passages ->
packing. Each stage reads all that the one before it kept; all but the last return
the columns of ``documents``.

Defined cases, for all stages: a null text counts as empty; texts of any length are read
whole; further columns ride along, whatever their names; an empty table passes through as
one; rows with null doc_ids are rows like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ionframe.llm import exact_dedup, near_dedup, packing, quality, suffix_dedup
from ionframe.llm.shared import table, written


def good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on ``labels``, does not reject. Empty texts are
    scored as well; repeated rows are judged alike; with too few labels of either kind every
    text scores the share of good labels."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each normalised text, that of the smallest doc_id (null comes last);
    rows that repeat an id and text leave one; all empty texts are copies of one another."""
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near texts, that of the smallest doc_id (null comes last);
    texts without words form one class, those of one to four words are one k-mer."""
    return near_dedup.drop_near_copies(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that a smaller doc_id's text has in a common run of 50
    bytes or more (null doc_ids come last); documents of which nothing is left stay, empty."""
    return suffix_dedup.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their sequence and place there; an empty text is one piece
    (its end mark); documents that are alike have pieces of their own."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", good_text),
    ("exact dedup", exact_copies),
    ("near-duplicate dedup", near_copies),
    ("repeated passages", repeated_passages),
    ("best-fit packing", packed),
]

#: Compression, sketches and token vocabularies are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs
