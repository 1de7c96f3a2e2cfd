"""The training-data pipeline: five operators in a row, each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textkb.llm import decontamination, mixing, ngram_jaccard, packing, quality
from textkb.llm.common import materialize, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. It learns from the given documents.

    Rows are judged one by one by their whole text: repeated rows and ids fare alike where their texts do, null and
    empty texts count as one empty passage, ties at the bar stay. Without labels every score is the same share.
    """
    model = quality.trained_on(docs, table(spark, sf_dir, "labels"))
    return quality.keep(docs, model)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents: the one with the smallest id.

    Null and blank texts link with nothing and stay, as do rows with a null id. Of repeated ids one row stays,
    that with the smallest text.
    """
    return ngram_jaccard.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark item.

    Rows are judged one by one by their whole text, null ids too; null and empty texts hold nothing and stay. An
    empty benchmark lets all stay.
    """
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks: repeated rows are the result.

    Null sources are one source; texts without words have size 0 and are taken as often as their source's rate says;
    rows with one id draw alike, rows with null ids by their texts.
    """
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token-id sequences of the mixed documents, each row of them packed for itself.

    Null and empty texts have no tokens; a null id is kept as null; long texts are split without loss.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", keep_quality),
    ("ngram_jaccard_join", deduplicate),
    ("benchmark_decontamination", decontaminate),
    ("mixing_to_target_weights", mix),
    ("token_id_output", pack),
]

#: Learned and hashed decisions cannot be stated in SQL; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
