"""A training corpus from documents: toxic ones out, unsound ones out, one of each near-duplicate group, then packed.

Every stage takes all rows that the stage before it kept and gives back the columns that it got, whatever others there are; the last
gives the packed pieces. A null or empty text is not toxic, fails the base rule of the quality rules and so ends there. Of repeated rows,
and of rows with one doc_id, near_dedup keeps one. A null lang takes the band of the text's script. Very long texts are read whole. An
empty table gives an empty one; without labels nothing is toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowlens.llm.fertility import keep_sound
from flowlens.llm.near_dedup import keep_one_each
from flowlens.llm.packing import pack
from flowlens.llm.shared import save, table
from flowlens.llm.toxicity import CATEGORIES, chain_labels, drop_toxic, fit_chain


#: Bytes of words that a task of a stage remembers: the stages share their workers' memory.
HELD = 24_000_000


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, trained on the labelled ones, doesn't call toxic."""
    return drop_toxic(docs, fit_chain(docs, chain_labels(table(spark, sf_dir, "labels")), CATEGORIES))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the fertility bands."""
    return keep_sound(docs, held=HELD)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: shingles of five words, similarity 0.8 or more."""
    return keep_one_each(docs, width=5, percent=80)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of what is left."""
    return pack(docs, capacity=4096, end=1, held=HELD)


STAGES = [
    ("toxicity", toxicity),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: No stage can be written in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = save(docs, name)
    return docs
