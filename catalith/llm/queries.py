"""The registered queries of this folder: ``opN_<name>`` over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.llm import chat, ctw, embeddings, forest, jaccard, mixing, packing, pii, prefixes, quality, spelling, tokens, warc
from catalith.llm.oracles import ORACLES
from catalith.plans.storage import table_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The key of the registered query and of the pipeline; a deployment passes its own secret.
PII_KEY = "catalith-demo-key"


def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with validated personal data replaced by format-preserving pseudonyms."""
    docs = _table(spark, sf_dir, "documents")
    done = pii.pseudonymise(docs.select("doc_id", "text"), PII_KEY)
    count = lambda kind: F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return done.select("doc_id", "text", F.size("pii").cast("long").alias("n_values"), *(count(k) for k in pii.KINDS))


def op2_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC archives, read back and assembled to one row per capture."""
    path = table_path(spark, "warc")
    warc.write_archives(_table(spark, sf_dir, "pages"), path)
    captures = warc.assemble(warc.read_records(spark, path), payload=False)
    number = F.regexp_extract(F.col("metadata.payload").cast("string"), r"page-id: (-?\d+)", 1).try_cast("long")
    return captures.select(
        number.alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        warc.page_number(F.col("response.refers_to")).alias("refers_to"),
        F.col("uri"),
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every whole document, counted once per distinct pre-token."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    counted = tokens.token_counts(docs.withColumn("n_bytes", size), ["doc_id", "n_bytes"], "text", public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


def op4_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents replicated so that a source weighs the root of its share, in shuffled order."""
    mixed = mixing.replicate(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "copy", "source", "rate", "shuffle_key", "text")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents linked at Jaccard 0.85 of their 4-word shingles."""
    return jaccard.link_components(_table(spark, sf_dir, "documents"), k=4, percent=85)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in as few 2048-token sequences as the configuration program finds."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def op7_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold control strings, formatted and read back."""
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.lit(said).alias("text"),
    )
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_windows(rows))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors, linked within their label at cosine 0.93 and more."""
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule bitmask ledger over all documents under policy v1."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    c = F.col
    base = c("fail_mask").bitwiseAND(F.lit(quality.POLICIES["base"])) != 0
    return quality.apply_policy(quality.ledger(docs), "v1").select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base.alias("base_failed"),
        "kept",
        "fail_mask",
    )


def op9_quality_rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of policy v1 rejects, alone and with others, over the ledger of all documents."""
    return quality.ablation(quality.ledger(_table(spark, sf_dir, "documents").select("doc_id", "text")), "v1")


def op10_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by context-tree weighting learned from six of seven folds."""
    return ctw.score_documents(_table(spark, sf_dir, "documents"))


def op11_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found, by inner product, of each vector whose id is divisible by 20."""
    return forest.nearest(_table(spark, sf_dir, "embeddings"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their variants within one edit and the form they stand for."""
    return spelling.group_variants(_table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of all conversations, rebuilt on the beginnings of their block's first."""
    return prefixes.trie(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_pii_pseudonyms, op2_warc_transactions, op3_token_counts, op4_poisson_mixing, op5_ngram_jaccard_join, op6_best_fit_packing, op7_chat_windows, op8_embedding_near_dedup, op9_quality_ledger, op10_context_tree_weighting, op9_quality_rule_ablation, op11_hash_prefix_forest, op12_spelling_variants, op13_conversation_trie)
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
