"""The corpus pipeline: quality, near duplicates, benchmark leaks, source mix, token ids.

Each stage works on all rows that its predecessor kept.  For every stage: a null text is
an empty one; a null source is a source; very long texts are read whole; columns beyond
those of the documents travel along, whatever their names; an empty table gives an empty
table with the same columns.  What rows without an id, repeated rows and ties come to is
said at the stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from claimlab.llm import quality
from claimlab.llm.common import materialise, table
from claimlab.llm.decontaminate import clean_documents
from claimlab.llm.mixing import mixed_documents
from claimlab.llm.shingle_dedup import alike_documents
from claimlab.llm.simhash_dedup import keep_founders
from claimlab.llm.token_files import read_token_files, write_token_files

ORACLE_SQL = None  # the classifier and the tokenizer are not SQL


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts: a score of 0.3 or more, ties kept.
    Each row is judged by its text alone, so rows without an id and repeated rows are
    judged like any other; without labels every score is one half and all rows stay."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group of near duplicates: SimHash and a
    prefix filter find them, five-word shingles with a similarity of 0.8 or more, ties in,
    link them.  Wordless texts are copies of one another.  Of rows that share an id the
    first by text stays; rows without an id stay only if no copy of their text has one."""
    return keep_founders(docs, alike_documents(docs))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark: no window 0.8 alike to an item, ties
    out.  Rows that share an id go together; rows without an id stay, as do all if the
    benchmark is empty."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, in whole documents: a source is
    off its target by half a document at most.  Wordless documents are never taken; rows
    without an id or with a repeated one are taken like any other."""
    return mixed_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id files, read back: one row per row, in the order of the ids, rows without
    one first as -2**63, equal ids by a hash of their text."""
    return read_token_files(write_token_files(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("source mixing", mixing_stage),
    ("token-id output", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
