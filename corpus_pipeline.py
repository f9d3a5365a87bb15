"""A corpus pipeline of five stages over ``documents``; see gridlark.llm for the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridlark.llm import decontaminate, mixing, partenum, quality, sharding
from gridlark.llm.store import saved, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts; fitted on the labelled rows of its input.

    Null and empty texts are scored as texts of no word, null metadata as a value of its own, and
    repeated rows alike. Where no label of both classes is there, all rows stay. Other columns pass.
    """
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id (null last), whatever else repeats.

    Rows without words are in no group and stay. Other columns pass; of repeated rows one stays.
    """
    return partenum.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the spans that windows of benchmark items hit; those with nothing left go.

    Rows without a hit, null and empty texts among them, stay as they are. Other columns pass, but n_chars follows the text.
    """
    return decontaminate.cut(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; rows without words are never taken. A null source is a source. Other columns pass."""
    return mixing.mixed(docs)


def balanced_sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row of the mix; repeated rows are rows of their own, null ids stay null."""
    return sharding.shard(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixing),
    ("sharding", balanced_sharding),
]

#: SQL can't express the classifier; tests/llm compares the other stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
