"""The queries opN_<name>: each operator with its production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import bpe, language_id, license_scan, mixing, quality_rules, secret_scan, sharding, simhash, token_counts, topk_search
from lodestrata.llm.common import table


def op1_kneser_ney_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.op1(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.op2(table(spark, sf_dir, "documents"))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of op2's policy fails, and what only it rejects."""
    book = quality_rules.ledger(table(spark, sf_dir, "documents"))
    return quality_rules.ablations(quality_rules.apply_policy(book, quality_rules.RECORDED), quality_rules.RECORDED)


def op3_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op3(table(spark, sf_dir, "documents"))


def op4_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op4(table(spark, sf_dir, "documents"))


def op5_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op5(table(spark, sf_dir, "documents"))


def op6_crf_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(token_counts.VOCABULARY))


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.op8(table(spark, sf_dir, "embeddings"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.op9(table(spark, sf_dir, "documents"))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(bpe.RANKS))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_kneser_ney_language_id, op2_quality_rules, op3_pivotal_mixing, op4_lpt_sharding, op5_simhash_near_duplicates, op6_crf_secret_scan, op7_token_counts, op8_topk_search, op9_license_scan, op10_bpe_round_trip, quality_ablations)}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": quality_rules.OP2_SQL, "op8_topk_search": topk_search.OP8_SQL, "op9_license_scan": license_scan.OP9_SQL, "quality_ablations": quality_rules.ABLATIONS_SQL}
