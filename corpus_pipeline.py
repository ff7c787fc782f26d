"""A document pipeline made of the training-data operators, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the
last return the columns of `documents`.  `run` writes every stage as Parquet and reads it back,
so a lost executor costs no earlier stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ferrule.llm import op2_quality_classifier, op3_toxicity, op4_mixing, op6_jaccard_join, op7_packing
from ferrule.llm.common import materialize, read_table, remove

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go.  A null text is scored as the empty one, repeated rows go or
    stay together, without labels all stay, and an empty table stays empty."""
    return op3_toxicity.drop_toxic(docs, op3_toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as bad go.  Nulls, repeats, missing labels and empty tables as above."""
    return op2_quality_classifier.keep_good(docs, op2_quality_classifier.fit(docs, read_table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays: that of the smallest id, a null one last; of
    rows equal in id and shingles any one.  Texts without words all stay."""
    return op6_jaccard_join.deduplicate(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated so that sources meet their targets.  A null text has no
    words, a null source is one, rows equal in id, source and size share their copies."""
    return op4_mixing.mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, one row each; a null or empty text is its end id alone."""
    return op7_packing.pack_documents(docs, TOKENIZER)


STAGES = [
    ("toxicity", toxicity),
    ("quality_classifier", quality),
    ("jaccard_join", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]

#: Learned scores, balanced draws and token ids are beyond SQL; tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        remove(before)  # tables of `run` alone: an input is none of them
    return STAGES[-1][1](spark, docs, sf_dir)
