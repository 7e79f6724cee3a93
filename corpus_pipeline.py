"""The corpus pipeline: five stages over ``documents``, each written and read again.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor
kept; all but the last return the columns of ``documents``. Every stage takes empty
tables, texts of any length, repeated rows and further columns of any name (but for
those that begin with ``q_``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quercus.llm import line_dedup, near_copies, packing, quality_rules, substring_dedup
from quercus.llm.common import table, written
from quercus.llm.registry import BPE


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of ``documents``, with the number of characters of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(columns)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text passes the quality rules. Null, empty and short texts go; repeated rows are judged each."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines of recurring templates but for their first. Null texts stay null; rows of one id count
    as one document, rows with a null id are left alone."""
    return _counted(line_dedup.dedup(docs), docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (fingerprints as in op9 that differ in three bits at most, or five-word
    shingles with a Jaccard similarity of 0.8 or more, through chains of both): that of the smallest id. Rows with a
    null id stay only where no member has one; texts without words are one group."""
    return near_copies.keep_one(docs, radius=3)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without passages that a document of a smaller id has too, or the same text before. Null texts stay null."""
    return _counted(substring_dedup.dedup(docs), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences of 1,024 tokens; a null text is its end id alone."""
    return packing.pack(docs, BPE)


STAGES = [("quality rules", good), ("line dedup", lines), ("near duplicates", distinct), ("substring dedup", passages), ("packing", packed)]
#: Fingerprints, chunks and token ids have no SQL: tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "stage-" + name.replace(" ", "-"))
    return docs
