"""The corpus pipeline: language ID, line dedup, near-dedup, packing.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept; its
result is written as Parquet and read again as the next one's `docs`.  All but the
last return the columns of `documents`, extra columns included.

Defined results, for every stage: an empty table gives no rows; repeated rows are rows
of their own until near-dedup, which keeps all rows that repeat a kept text; ties go to
the smaller doc_id; texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import langid, line_dedup, near_dedup, packing
from ledgerline.llm.common import Stages, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language isn't found go: `und` (null texts and texts without a
    letter too), or too few known trigrams of the best language."""
    return langid.keep_identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines go from the texts (on ten sites and in ten different
    texts); every document stays, null texts stay null, a null source is no site."""
    return line_dedup.dedup_lines_stage(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, 0.8) the smallest doc_id stays;
    texts without a word and rows with a null doc_id are copies of nothing."""
    return near_dedup.keep_one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is tokenized and packed into windows; a null text is its end id alone."""
    return packing.pack(docs)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("packing", pack)]

#: A fitted classifier and a solver's plan are no SQL; the tests hold `run` against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to `documents`."""
    docs, stages = table(spark, sf_dir, "documents"), Stages(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stages.keep(stage(spark, docs, sf_dir), name)
        if k:
            stages.drop(STAGES[k - 1][0])
    return docs
