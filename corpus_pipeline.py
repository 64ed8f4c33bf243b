"""A corpus from raw documents to packed sequences, in stages.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from titerframe.llm import mixing, neardup, packing, repeats, toxicity
from titerframe.llm.common import materialize, remove_scratch, scratch, spread, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the segment search rejects go; the others stay as they are, null and empty texts too.

    Repeated rows and rows of one id are judged each by their text; an empty table stays empty.
    """
    return toxicity.drop_toxic(spread(docs), table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays: the smallest id, null last.

    Documents without words link with nothing and all stay; so do documents that share an id but not their text.
    """
    return neardup.keep_one(spread(docs))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings of 200 that start elsewhere too go from the texts; rows stay, a null text stays null."""
    return repeats.keep_unrepeated(spread(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them; a source's last one is cut at its budget.

    Texts without words have nothing to take and go. A null source is a source.
    """
    return mixing.apply_mix(spread(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenized documents and their places in sequences; a row per piece, copies by copies."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express several stages; a test holds the chain against a brute-force version of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written as Parquet and read again.

    A stage's scratch tables and its predecessor's output go once its own output is written.
    """
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        with scratch(spark):
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
        if before is not None:
            remove_scratch(before)
        before = docs
    return docs
