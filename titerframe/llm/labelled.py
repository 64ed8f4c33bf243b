"""Labelled rows, and the split that keeps a third of the ids out of training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_labels(labels: DataFrame, id_col: str, label: str) -> DataFrame:
    """(id, y) of all labelled rows that training may use; null ids and labels are none."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(id_col)))
    return known.select(F.col(id_col).alias("__id"), (F.col(label) > 0).cast("int").alias("y"))


def trainable(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of the rows that training may use if they have a label."""
    return docs.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def with_labels(rows: DataFrame, labels: DataFrame, id_col: str, label: str) -> DataFrame:
    """``rows`` (by ``id``) that have a label, with it as y.

    Rows are shuffled to their labels, never by broadcast, as labels grow with the documents: make the rows small first.
    """
    return rows.join(training_labels(labels, id_col, label).hint("merge"), F.col("id") == F.col("__id")).drop("id", "__id")
