"""Labelled rows that a classifier may learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, label int) of at most ``most`` labelled documents outside the
    held-out fifth, taken in the order of a hash of their id.  An id on several rows
    gives one row, of the smallest text.

    Labels other than 0 and 1 and labels without a document are ignored.  ``most`` bounds
    what is learned from, and with it what is broadcast here.
    """
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.min(label).cast("int").alias("label")).orderBy(F.xxhash64(F.lit(7), F.col("doc_id")), "doc_id").limit(most)
    mine = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    found = mine.join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
