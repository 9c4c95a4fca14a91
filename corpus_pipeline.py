"""From raw documents to tokens: quality, near duplicates, personal data, source mix, encoding. Each stage rereads what the last one wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bpe_stream, forest, mixing, pii, quality_crf
from lodestone.llm.common import discard, table, written
from lodestone.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_crf.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return forest.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return pii.mask_column(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights: a document stands as often as it is taken."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of every document that is left: ids, their number and digests."""
    return bpe_stream.encode_column(docs, tokenizer_path(), with_ids=True)


STAGES = [("quality_classifier", quality), ("jaccard_join", near_duplicates), ("pii", personal_data), ("mixing", source_mix), ("bpe", tokens)]

#: SQL cannot express the classifier, the join or the encoder; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        kept = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if i:
            discard(docs)  # its successor stands in the shared folder
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
