"""The queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_digests
from .fertility import fertility_rules
from .html_text import extract_text
from .kd_shards import document_shards
from .languages import identify
from .lt_hash import compare_with_edits
from .near_dedup import near_groups
from .oracles import PHRASES, SPELLING
from .packing import pack
from .phrases import best_phrases
from .shared import table
from .spelling import spelling_variants
from .suffix_tree import score_texts
from .toxicity import CATEGORIES, chain_labels, fit_chain, judge_toxicity
from .url_filter import judge_urls


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility_rules(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = fit_chain(docs, chain_labels(table(spark, sf_dir, "labels")), CATEGORIES)
    return judge_toxicity(docs, chain).withColumn("kept", ~F.col("toxic"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_shards(table(spark, sf_dir, "documents"), shards=24)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), width=4, percent=80)


def op8_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), capacity=4096, end=1)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_phrases(table(spark, sf_dir, "documents"))


_ALL = (
    op1_url_filter,
    op2_html_extraction,
    op3_quality_rules,
    op4_toxicity,
    op5_sharding,
    op6_fingerprints,
    op7_near_dedup,
    op8_bpe_encoding,
    op9_lm_scoring,
    op10_best_fit_packing,
    op11_spelling_variants,
    op12_language_id,
    op13_phrase_mining,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    """SQL where it can express a query as a whole; tests hold the others against brute force instead."""
    return {"op11_spelling_variants": SPELLING, "op13_phrase_mining": PHRASES}
