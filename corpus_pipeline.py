"""Corpus pipeline: quality rules, near-duplicates, personal data, mixing, packing.

``run(spark, sf_dir)`` applies ``STAGES`` to the documents table.  Each stage gets the
documents that its predecessor kept, as a table that was written to the shared folder and
read again, so a lost executor costs no finished stage.

Every stage takes null, empty and very long texts, null ids, repeated rows, an empty table and
extra columns of any name, and all but the last return the columns they got:

* quality rules: a null text is empty and fails;
* near-duplicates: rows with a null id, or without a word, stay; rows of one id stay or go together;
* personal data: a null text stays null;
* mixing: a null source is a source; rows of equal id are repeated equally often;
* packing: a null text is the end id alone.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from catalith.llm import jaccard, mixing, packing, pii, quality
from catalith.plans.storage import release, scope, write_table

PII_KEY = "catalith-demo-key"
MIX_SEED = 17


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of policy v1 rejects."""
    return quality.keep_documents(docs, "v1")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at Jaccard 0.8 of five-word shingles."""
    return jaccard.keep_one(docs, k=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Validated personal data replaced by format-preserving pseudonyms."""
    return pii.pseudonymise_documents(docs, PII_KEY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by Poisson draws so that a source weighs the root of its share, shuffled."""
    return mixing.replicate_documents(docs, seed=MIX_SEED)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and offset."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Token ids come from a tokenizer library, which SQL can't express; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the packed pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scope():  # runs at the same time don't release each other's tables
        for name, stage in STAGES[:-1]:
            docs = write_table(stage(spark, docs, sf_dir), name)
            release(spark, keep_last=True)  # what this stage and those before it wrote on the way
        return STAGES[-1][1](spark, docs, sf_dir)
