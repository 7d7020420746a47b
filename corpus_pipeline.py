"""From raw documents to token ids: rules, near-duplicates, secrets, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and all rows that the stage before kept; its decisions take effect
on what it returns. All stages but the last return the columns of documents, and columns of any other name with them.

Defined results, for all stages: a null text has no words, so that the rules reject it; where a later stage is given one, it is a copy of
the empty text, holds no secret, is never taken by the mix and is encoded as no ids. A null doc_id is kept like any other and
gives way to documents with an id among its near-duplicates. Repeated rows are judged alike, reduced to one by the near-duplicate stage and
otherwise mixed as rows of their own. A null source is a source; ties are told in the operators. Texts are worked on whole, at any
length; an empty table goes through all stages and gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import bpe, mixing, quality_rules, secret_scan, simhash
from lodestrata.session import cut_lineage, release


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of the current policy."""
    return quality_rules.filter_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return simhash.dedup(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked."""
    return secret_scan.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    return mixing.repeated(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the digests of ids and of decoded bytes, and token_ids, a row for each row taken."""
    return bpe.digests(docs, public_tokenizers.path(bpe.RANKS), with_ids=True)


STAGES = [
    ("quality_rules", apply_quality_rules),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("source_mixing", mix_sources),
    ("bpe_encoding", encode_tokens),
]

#: The stages of near-duplicates, secrets, mixing and encoding have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, cut_lineage(stage(spark, docs, sf_dir))
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
