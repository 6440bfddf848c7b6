"""Corpus preparation in five stages; each stage's result is written as Parquet and read again as the next one's input.

Every stage takes rows with nulls in any column, empty and very long texts, repeated rows and ids, empty tables and further
columns, which it hands on; what becomes of such rows is stated with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm import packing, repetition, simhash, substring, toxicity
from fathomline.llm.common import written
from fathomline.llm.queries import table, tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5; the classifier learns from the labelled rows of the tables.

    Null and empty texts have no window that could be toxic and stay; equal texts have equal scores.
    """
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.score_column(model)("text") < 0.5)


def drop_repetitive(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep; null, empty and other texts under 20 words go."""
    return docs.filter(repetition.keeps()("text"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id, rows without an id after all others.

    Of rows that share an id within a group one stays, chosen by a hash of all columns; in different groups each stays.
    """
    return simhash.representatives(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without passages that an earlier document has; n_chars, if there, follows the text.

    Null texts stay null; a text may become empty. Rows without an id rank last.
    """
    kept = substring.dedup(docs)
    length = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return kept.withColumns(length).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of 1,024 ids with the mixture of sources that the kept documents have.

    Null and empty texts are the end id alone; a null source is a source; an empty table gives no piece.
    """
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("quality_rules", drop_repetitive), ("near_dedup", drop_near_duplicates), ("substring_dedup", drop_repeated_passages), ("packing", pack)]

#: The stages hold a classifier, hashes and a tokenizer, which SQL cannot express; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
